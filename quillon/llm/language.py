"""Problem 9 over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.functions.forms import label_form
from quillon.llm.abuse import abuse_rates, abuse_scores
from quillon.plans.tables import table


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse_scores(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where("score >= 1").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select("doc_id", label_form("source").alias("source"))
    return abuse_rates(p9_scores(spark, sf_dir).join(sources, "doc_id"), "source")


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_rates": p9_rates, "p9_scores": p9_scores}
