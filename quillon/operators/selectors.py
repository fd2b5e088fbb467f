"""Choosing rows: layers by request, concepts by list, candidates by fallback, values with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layer_key(layer: Column) -> Column:
    """Sort key of layer names: ``layer_N`` by number, then ``layer_last``, then others by name."""
    number = F.nullif(F.regexp_extract(layer, r"^layer_(\d+)$", 1), F.lit("")).try_cast("int")
    return F.struct(F.when(number.isNotNull(), 0).when(layer == "layer_last", 1).otherwise(2).alias("kind"), F.coalesce(number, F.lit(0)).alias("number"), layer.alias("name"))


def resolve_layer(df: DataFrame, model: str, layer: str, default: str, request: str) -> DataFrame:
    """Per model the layer that ``request`` means.

    ``selected`` and ``default`` mean the model's ``default`` column; ``last`` and ``-1`` mean that too if it
    is set, else the last layer in order; another name means itself if the model has it, else the default;
    a model without a default falls back to its last layer.
    """
    layers = df.groupBy(model).agg(F.max(default).alias("_d"), F.max_by(layer, layer_key(F.col(layer))).alias("_last"), F.bool_or(F.col(layer) == request).alias("_has"))
    fallback = F.coalesce("_d", "_last")
    chosen = fallback if request in ("selected", "default", "last", "-1") else F.when(F.col("_has"), F.lit(request)).otherwise(fallback)
    return layers.select(model, chosen.alias("resolved"))


def in_order(df: DataFrame, key: str, order: str, wanted: list[str], unknown: str = "ignore") -> DataFrame:
    """The rows whose ``key`` is in ``wanted``, numbered in the order of ``df``; unknown names are ignored or an error."""
    names = df.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], f"{key} string")
    if unknown == "error":
        lost = names.join(df.select(key).distinct(), key, "left_anti")
        missing = [r[0] for r in lost.orderBy(key).limit(5).collect()]
        if missing:
            raise ValueError(f"unknown names: {', '.join(missing)}")
    kept = df.join(F.broadcast(names), key, "left_semi")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, key)))


def fallback(parts: list[DataFrame], group: str, record: str, order: list[str], cap: int) -> DataFrame:
    """Up to ``cap`` records per group, from the first part, then the next; a record counts where it comes first."""
    tagged = [p.select(group, record, *order).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for p in tagged[1:]:
        both = both.unionByName(p)
    once = both.groupBy(group, record).agg(F.min(F.struct("part", *order)).alias("_at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_at", record))).where(F.col("place") <= cap).select(group, record, F.col("_at.part").alias("part"), "place")


def backfill(df: DataFrame, scores: DataFrame, key: str, column: str, overwrite: bool = False) -> DataFrame:
    """``column`` filled from scores(key, new): where it is missing, or wherever there is a score with ``overwrite``."""
    value = F.coalesce("new", column) if overwrite else F.coalesce(column, "new")
    return df.join(scores, key, "left").withColumn(column, value).drop("new")


def stat(value: Column, default: float) -> Column:
    """An aggregate with a default for groups without values."""
    return F.coalesce(value, F.lit(default))
