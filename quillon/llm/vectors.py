"""Problems 1 and 2 over the concept vectors: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.forms import usable_vector
from quillon.llm.clusters import cluster_vectors, describe
from quillon.llm.similar import similar_vectors
from quillon.plans.tables import table

K, COSINE, PART = 10, 0.8, ["model", "layer"]
#: A query whose k-th hash candidate is less similar than this is completed exactly (see pstable.complete).
SURE = 0.8


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "replication_results").where(F.col("vector_id").isNotNull() & usable_vector("embeddings", "embedding_dim"))
    return rows.select("vector_id", *PART, "embeddings")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(usable(spark, sf_dir), PART, "vector_id", "embeddings", K, COSINE)
    return near.select(F.least("vector_id", "neighbour_id").alias("vector_id_a"), F.greatest("vector_id", "neighbour_id").alias("vector_id_b")).distinct()


def p1_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar of every vector whose id is divisible by 20, against all vectors."""
    return similar_vectors(usable(spark, sf_dir), PART, "vector_id", "embeddings", K, sure=SURE, ask_every=20).select("vector_id", F.col("position").cast("int").alias("position"), "neighbour_id", "cosine")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(usable(spark, sf_dir), PART, "vector_id", "embeddings", COSINE).select("cluster_id", "vector_id")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = usable(spark, sf_dir).dropDuplicates(["vector_id"])
    return describe(cluster_vectors(distinct, PART, "vector_id", "embeddings", COSINE))


_USABLE = "WITH u AS (SELECT vector_id, any_value(model) AS model, any_value(layer) AS layer, any_value(embeddings)::DOUBLE[] AS v FROM replication_results WHERE embeddings IS NOT NULL AND len(embeddings) = embedding_dim AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0 GROUP BY vector_id)"
_PAIRS = _USABLE + ", p AS (SELECT a.vector_id AS a, b.vector_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.model IS NOT DISTINCT FROM b.model AND a.layer IS NOT DISTINCT FROM b.layer AND a.vector_id <> b.vector_id)"
_MEMBERS = _PAIRS + ", m AS (SELECT a AS vector_id, least(a, min(b)) AS cluster_id FROM p WHERE c >= 0.8 GROUP BY a)"
SQL = {
    "p1_top10": _PAIRS + " SELECT a AS vector_id, CAST(rn AS INTEGER) AS position, b AS neighbour_id, round(c, 9) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS rn FROM p WHERE a % 20 = 0) WHERE rn <= 10",
    "p2_clusters": _MEMBERS
    + ", g AS (SELECT x.cluster_id, x.vector_id AS a, avg(p.c) AS mc FROM m x JOIN p ON p.a = x.vector_id JOIN m y ON y.vector_id = p.b AND y.cluster_id = x.cluster_id GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(mc, 6) DESC, a) AS rn, count(*) OVER (PARTITION BY cluster_id) AS size FROM g) SELECT cluster_id, max(size) AS size, list(a ORDER BY rn) FILTER (WHERE rn <= 3) AS typical_members FROM k GROUP BY 1",
    "p2_found": _MEMBERS + " SELECT cluster_id, vector_id FROM m",
}
#: The exact pairs, of which p1_found may miss some: tests measure its recall by them.
EXACT = {"p1_found": _PAIRS + ", r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS rn FROM p WHERE round(c, 9) >= 0.8) SELECT DISTINCT least(a, b) AS vector_id_a, greatest(a, b) AS vector_id_b FROM r WHERE rn <= 10"}
QUERIES = {"p1_found": p1_found, "p1_top10": p1_top10, "p2_found": p2_found, "p2_clusters": p2_clusters}
