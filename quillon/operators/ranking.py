"""Rank-shaped operators: average ranks, false-discovery rates, first-seen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *by: str) -> Column:
    """Ranks from 1 within ``by``; equal values share the mean of their ranks."""
    tied = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (tied - 1) / 2.0


def with_fdr(df: DataFrame, p: str, order: str, *by: str) -> DataFrame:
    """``df`` with q, the Benjamini-Hochberg q-values of the p-values within ``by``.

    ``order`` makes equal p-values distinct.
    """
    n = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(p, order))
    tail = Window.partitionBy(*by).orderBy("_place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = df.withColumn("_n", n).withColumn("_place", place)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_place")).over(tail))).drop("_n", "_place")


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: a union in which later rows replace earlier ones."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order]))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate; 0 where a side has no variance."""
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))
