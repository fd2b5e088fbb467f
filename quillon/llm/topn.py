"""The N best items of every group, found band by band from the top of the score range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.durable import durable, scratch

#: Shares of all rows at or above the lower edge of each band; the last band holds the rest.
BANDS = (0.05, 0.3)


def band_edges(rows: DataFrame, score: str, shares: Sequence[float] = BANDS) -> list[float]:
    """Descending score edges so that about ``shares`` of all rows lie at or above them."""
    found = rows.agg(F.percentile_approx(score, [1 - s for s in shares], 2000).alias("e")).first()["e"]
    return sorted({float(e) for e in found or []}, reverse=True)


def top_n_per_group(df: DataFrame, group: str, score: str, tie: Sequence[Column], n: int, record: str, shares: Sequence[float] = BANDS) -> DataFrame:
    """The ``n`` best records of each group: by ``score`` descending, then by ``tie``.

    The score range is cut into bands. Bands are worked off from the top; from a lower band only
    the rows of groups that are not filled yet are read on (anti-join), and within a band an exact
    ranking that includes all ties decides. Equal scores never straddle a band. The ranking keeps
    at most the ranks 1..n of a group in each map task before the shuffle, so a group with a third
    of all rows costs no more than any other.

    Rows with a null group or null score are in no group. A record repeated under the same
    ``record`` id counts once. Groups with fewer than ``n`` records keep all. ``tie`` must end in a
    unique column. Other columns of ``df`` are passed on unchanged, whatever their names; an empty
    table gives an empty result. Columns ``__rank`` and ``__band`` are taken for the operator.
    """
    order = [F.col(score).desc(), *tie]
    rows = df.where(F.col(group).isNotNull() & F.col(score).isNotNull())
    edges = band_edges(rows, score, shares)
    band = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        band = F.when(F.col(score) >= edge, i).otherwise(band)
    # The record as second key spreads a frequent score over several tasks; a band has files of its own.
    banded = rows.withColumn("__band", band).repartitionByRange(F.col(score).desc(), F.col(record))
    path = scratch(df.sparkSession)
    banded.write.partitionBy("__band").parquet(path)
    banded = df.sparkSession.read.schema(banded.schema).parquet(path)
    best: DataFrame | None = None
    for i in range(len(edges) + 1):
        part = banded.where(F.col("__band") == i).drop("__band")
        if best is not None:
            have = best.groupBy(group).agg(F.max("__rank").alias("__have"))
            part = part.join(have.where(F.col("__have") >= n), group, "left_anti")
        ranked = part.withColumn("__rank", F.dense_rank().over(Window.partitionBy(group).orderBy(*order)))
        ranked = ranked.where(F.col("__rank") <= n).dropDuplicates([record])
        if best is not None:
            ranked = ranked.join(have, group, "left").withColumn("__rank", F.col("__rank") + F.coalesce("__have", F.lit(0))).where(F.col("__rank") <= n).drop("__have")
            ranked = best.unionByName(ranked)
        best = durable(ranked) if i < len(edges) else ranked
    return best
