"""The vectors of ``replication_results`` in the data model of representational geometry.

Models are compared on the concepts of the core roster, at the last layer (``-1``) unless a query says otherwise.
A concept's usable vectors are its images; its source is the one most of its files in ``image_file`` have; a run
is what was extracted before, or from, 2025 on. The same definitions stand as SQL in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.forms import label_form, usable_vector
from quillon.plans.tables import table

#: Kinds of models by the type the vectors are delivered with.
KINDS = {"language": "causal", "contrastive_vlm": "vision_language", "autoregressive_vlm": "vision_language_autoregressive"}
FRACTIONS = [0.0, 0.25, 0.5, 0.75, 1.0]
TEMPLATES = 3
LAST = "-1"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, kind, size (billions of parameters by the name; language models only): a row a model, so a small table."""
    kind = F.col("type")
    for k, v in KINDS.items():
        kind = F.when(F.col("type") == k, v).otherwise(kind)
    known = F.when(F.col("type").isin(*KINDS), kind).otherwise("vision")
    m = table(spark, sf_dir, "replication_results").where("model is not null").groupBy("model").agg(F.max("model_type").alias("type")).select("model", known.alias("kind"))
    size = F.nullif(F.regexp_extract(F.lower("model"), r"(\d+(?:\.\d+)?)b", 1), F.lit("")).try_cast("double")
    return m.withColumn("size", F.when(F.col("kind") == "causal", size))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """concept, place: the roster's concepts (some 250), numbered from 0 by ordinal."""
    r = table(spark, sf_dir, "roster_core").select(label_form("concept").alias("concept"), "ordinal").where("concept is not null").groupBy("concept").agg(F.max("ordinal").alias("ordinal"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("ordinal").asc_nulls_last(), "concept")
    return r.select("concept", (F.row_number().over(order) - 1).alias("place"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """concept, source: the source of most of a concept's files (ties: by name)."""
    f = table(spark, sf_dir, "image_file").select("file_id", label_form("concept").alias("concept"), label_form("source").alias("source")).where("concept is not null and source is not null").dropDuplicates(["file_id"])
    return f.groupBy("concept", "source").agg(F.count("*").alias("n")).groupBy("concept").agg(F.min_by("source", F.struct(-F.col("n"), "source")).alias("source"))


def all_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, model, layer, concept, run, x: every usable vector of a roster concept once."""
    rows = table(spark, sf_dir, "replication_results").where(F.col("vector_id").isNotNull() & F.col("model").isNotNull() & F.col("layer").isNotNull() & usable_vector("embeddings", "embedding_dim"))
    run = F.when(F.col("extracted_at") < F.lit("2025-01-01").cast("timestamp_ntz"), "a").otherwise("b")
    rows = rows.select(F.col("vector_id").alias("vec_id"), "model", "layer", label_form("concept").alias("concept"), run.alias("run"), F.col("embeddings").cast("array<double>").alias("x"))
    # The roster is a table of fixed size, so its names are broadcast.
    return rows.join(F.broadcast(places(spark, sf_dir).select("concept")), "concept", "left_semi").dropDuplicates(["vec_id"])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``all_images`` of the last layer."""
    return all_images(spark, sf_dir).where(F.col("layer") == LAST).drop("layer")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``all_images`` with layer as a number: the middle one, then the last."""
    return all_images(spark, sf_dir).withColumn("layer", F.when(F.col("layer") == LAST, 1).otherwise(0))


def templates(cent: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """model (language only), template, concept, x: prompts shift each dimension of the centroids by a fixed amount."""
    spoken = models(spark, sf_dir).where("kind = 'causal'").select("model")
    rows = cent.join(F.broadcast(spoken), "model", "left_semi").join(F.broadcast(places(spark, sf_dir)), "concept").withColumn("template", F.explode(F.sequence(F.lit(0), F.lit(TEMPLATES - 1))))
    moved = F.transform("x", lambda v, d: v + F.col("template") * 0.02 * (F.pmod(F.col("place") * 7 + d * 3, F.lit(5)) - 2))
    return rows.select("model", "template", "concept", moved.alias("x"))


def _label(c: str) -> str:
    return f"nullif(regexp_replace(lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '[\\s\\p{{Z}}_-]+', '_', 'g'), '')"


CTE = f"""
pl AS (SELECT concept, row_number() OVER (ORDER BY max(ordinal) NULLS LAST, concept) - 1 AS place FROM (SELECT {_label('concept')} AS concept, ordinal FROM roster_core) WHERE concept IS NOT NULL GROUP BY concept),
av AS (SELECT vector_id AS vec_id, any_value(model) AS model, any_value(layer) AS layer, any_value({_label('concept')}) AS concept, any_value(CASE WHEN extracted_at < TIMESTAMP '2025-01-01' THEN 'a' ELSE 'b' END) AS run, any_value(embeddings)::DOUBLE[] AS x FROM replication_results
  WHERE vector_id IS NOT NULL AND model IS NOT NULL AND layer IS NOT NULL AND embeddings IS NOT NULL AND len(embeddings) = embedding_dim AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0 AND {_label('concept')} IN (SELECT concept FROM pl) GROUP BY 1),
ai AS (SELECT vec_id, model, layer, concept, run, unnest(x) AS v, unnest(range(len(x))) AS d FROM av),
img AS (SELECT * FROM ai WHERE layer = '{LAST}'),
md AS (SELECT model, CASE max(model_type) WHEN 'language' THEN 'causal' WHEN 'contrastive_vlm' THEN 'vision_language' WHEN 'autoregressive_vlm' THEN 'vision_language_autoregressive' ELSE 'vision' END AS kind, CASE WHEN max(model_type) = 'language' THEN TRY_CAST(nullif(regexp_extract(lower(model), '(\\d+(?:\\.\\d+)?)b', 1), '') AS DOUBLE) END AS size FROM replication_results WHERE model IS NOT NULL GROUP BY 1),
so AS (SELECT concept, source FROM (SELECT concept, source, row_number() OVER (PARTITION BY concept ORDER BY count(*) DESC, source) AS k FROM (SELECT file_id, any_value({_label('concept')}) AS concept, any_value({_label('source')}) AS source FROM image_file GROUP BY 1) WHERE concept IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
cen AS (SELECT model, concept, d, avg(v) AS v FROM img GROUP BY ALL)
"""


def edges_cte(name: str, source: str, by: str) -> str:
    """SQL of similarity edges over a long relation; ``by``: comma-separated key columns."""
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cols = ", ".join(f"a.{k}" for k in keys)
    return f"""
{name}_n AS (SELECT {by}, concept, CASE WHEN sum(v * v) = 0 THEN 1 ELSE sqrt(sum(v * v)) END AS n FROM {source} GROUP BY ALL),
{name}_u AS (SELECT {by}, concept, list(v / n ORDER BY d) AS u FROM {source} s JOIN {name}_n USING ({by}, concept) GROUP BY ALL),
{name} AS (SELECT {cols}, a.concept AS i, b.concept AS j, round(greatest(-1, least(1, list_dot_product(a.u, b.u))), 12) AS s FROM {name}_u a JOIN {name}_u b ON {on} AND a.concept < b.concept)"""


def rho_cte(name: str, edges: str, by: str = "", model: str = "model") -> str:
    """SQL of all model pairs' rank correlation on shared edges; ``by``: further key columns. ``{name}_r`` has the ranks."""
    keys = [k.strip() for k in by.split(",") if k.strip()]
    on = " AND ".join([f"a.{k} = b.{k}" for k in [*keys, "i", "j"]] + [f"a.{model} < b.{model}"])
    cols = "".join(f"a.{k}, " for k in keys)
    own = "".join(f"{k}, " for k in keys)
    at = f"PARTITION BY {own}model_a, model_b"
    return f"""
{name}_j AS (SELECT {cols}a.{model} AS model_a, b.{model} AS model_b, a.i, a.j, a.s AS sa, b.s AS sb FROM {edges} a JOIN {edges} b ON {on}),
{name}_r AS (SELECT *, rank() OVER ({at} ORDER BY sa) + (count(*) OVER ({at}, sa) - 1) / 2.0 AS ra, rank() OVER ({at} ORDER BY sb) + (count(*) OVER ({at}, sb) - 1) / 2.0 AS rb FROM {name}_j),
{name} AS (SELECT {own}model_a, model_b, CASE WHEN stddev_pop(ra) * stddev_pop(rb) = 0 THEN 0 ELSE covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS rho, count(*) AS n_edges FROM {name}_r GROUP BY ALL)"""


def ranks_cte(name: str, edges: str, by: str) -> str:
    return f"""
{name} AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY s) + (count(*) OVER (PARTITION BY {by}, s) - 1) / 2.0 AS r FROM {edges})"""
