"""Integrity checks: every check gives rows check_name, item, detail for what violates it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, name: str, where: Column, item: Column, detail: Column) -> DataFrame:
    """The rows of ``df`` for which ``where`` holds, as violations."""
    return df.where(where).select(F.lit(name).alias("check_name"), item.cast("string").alias("item"), detail.cast("string").alias("detail"))


def at_least(df: DataFrame, by: list[str], minimum: int, name: str) -> DataFrame:
    """Groups with fewer than ``minimum`` rows."""
    return violations(df.groupBy(*by).agg(F.count("*").alias("n")), name, F.col("n") < minimum, F.concat_ws("/", *by), F.col("n"))


def unique(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Keys that stand more than once."""
    return violations(df.groupBy(*by).agg(F.count("*").alias("n")), name, F.col("n") > 1, F.concat_ws("/", *by), F.col("n"))


def missing(expected: DataFrame, actual: DataFrame, on: list[str], name: str) -> DataFrame:
    """Expected keys that are not there."""
    left = expected.select(*on).distinct().join(actual.select(*on).distinct(), on, "left_anti")
    return violations(left, name, F.lit(True), F.concat_ws("/", *on), F.lit("missing"))


def uniform(df: DataFrame, by: list[str], column: Column, name: str) -> DataFrame:
    """Groups in which ``column`` has more than one value."""
    sizes = df.withColumn("_v", column).groupBy(*by).agg(F.min("_v").alias("a"), F.max("_v").alias("b"))
    return violations(sizes, name, F.col("a") != F.col("b"), F.concat_ws("/", *by), F.concat_ws("..", "a", "b"))


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def first_of(*checks: DataFrame) -> DataFrame:
    """As ``all_of``, with an item reported by the first check only: later ones are cut short by earlier ones."""
    ranked = all_of(*[c.withColumn("_p", F.lit(i)) for i, c in enumerate(checks)])
    first = F.min("_p").over(Window.partitionBy("item"))
    return ranked.withColumn("_first", first).where("_p = _first").drop("_p", "_first")


def summary(found: DataFrame, shown: int = 3) -> DataFrame:
    """Per check: violations, and its first items by name."""
    place = F.row_number().over(Window.partitionBy("check_name").orderBy("item", "detail"))
    top = found.withColumn("_k", place).where(F.col("_k") <= shown).groupBy("check_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "item"))), lambda x: x["item"]), ", ").alias("examples"))
    return found.groupBy("check_name").agg(F.count("*").alias("n")).join(top, "check_name")
