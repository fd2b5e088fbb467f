"""Problems 7 and 8 over the documents: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import decode, encode, token_counts
from quillon.llm.packing import fill_containers, fill_report
from quillon.plans.durable import durable
from quillon.plans.tables import table

CAPACITY = 2048


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_ids(spark, sf_dir).select("doc_id", decode(F.col("ids")).alias("text"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written down, or the optimizer would count the tokens once for every use of the size.
    sizes = durable(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return fill_containers(sizes, "doc_id", "n_tokens", CAPACITY).withColumnsRenamed({"record": "doc_id", "size": "n_tokens"})


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p8_containers(spark, sf_dir), CAPACITY)


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers, counted: documents in them, containers too full, documents cut without need."""
    rows = durable(p8_containers(spark, sf_dir))
    over = rows.groupBy("container").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > CAPACITY).agg(F.count("*").alias("n_over"))
    per = rows.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.countDistinct("piece").alias("p"))
    cut = (F.col("k") != F.greatest(F.lit(1), F.ceil(F.col("n") / CAPACITY))) | (F.col("p") != F.col("k"))
    # Two rows of one number each.
    return per.agg(F.count("*").alias("n_documents"), F.count_if(cut).alias("n_wrongly_cut")).join(over)


SQL = {"p8_checks": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_wrongly_cut, CAST(0 AS BIGINT) AS n_over FROM documents WHERE doc_id IS NOT NULL", "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL"}
QUERIES = {"p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_checks": p8_checks}
