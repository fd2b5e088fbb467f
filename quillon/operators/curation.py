"""Operators of dataset curation: quotas, dense counts, queues, swaps, upserts and greedy acceptance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.durable import durable

def first_n(df: DataFrame, by: list[str], order: list, n: int, name: str = "slot") -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1; limited in the map tasks."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def dense(keys: DataFrame, values: list[str], column: str, counted: DataFrame, by: list[str]) -> DataFrame:
    """``counted`` (by, column, n) with a row for every key and value, 0 where there is none."""
    grid = keys.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(counted, [*by, column], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def exact_quota(counts: DataFrame, by: list[str], values: list[str], column: str, target: int) -> DataFrame:
    """Keys of which every value has exactly ``target`` rows and no other value has any."""
    held = F.count_if(F.col(column).isin(values) & (F.col("n") == target))
    return counts.where("n > 0").groupBy(*by).agg(held.alias("_held"), F.count("*").alias("_all")).where((F.col("_held") == len(values)) & (F.col("_all") == len(values))).select(*by)


def upsert(target: DataFrame, updates: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``target`` with the non-null ``columns`` of ``updates``, which holds a key once; other keys are not added."""
    new = updates.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def replace_in_place(df: DataFrame, column: str, swaps: DataFrame) -> DataFrame:
    """``column`` renamed by swaps(old, new), rows keeping their place; replaced: whether it was."""
    joined = df.join(swaps, F.col(column) == F.col("old"), "left")
    rest = [c for c in df.columns if c != column]
    return joined.select(*rest, F.coalesce("new", column).alias(column), F.col("new").isNotNull().alias("replaced"))


def ordered_union(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Keys of the first in its order, then those only the second has, each once: key, place."""
    both = first.select(key, F.lit(0).alias("_part"), order).unionByName(second.select(key, F.lit(1).alias("_part"), order))
    once = both.groupBy(key).agg(F.min(F.struct("_part", order)).alias("_at"))
    return once.select(key, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_at", key)).alias("place"))


def capped_splits(hits: DataFrame, label: str, split_order: str, order: list[str], cap: int) -> DataFrame:
    """Per label at most ``cap`` hits in each split; a split is skipped once earlier ones hold ``cap`` together."""
    kept = first_n(hits, [label, split_order], order, cap, "_k")
    per = kept.groupBy(label, split_order).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy(split_order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = per.withColumn("_before", before).where(F.col("_before") < cap).select(label, split_order)
    return kept.join(open_, [label, split_order]).drop("_k")


def closure(edges: DataFrame) -> DataFrame:
    """child, ancestor, level: the whole transitive closure of edges(child, parent); level: the fewest steps.

    Known paths are joined to known paths, each round written to a table, until no pair appears or comes nearer:
    a chain of m nodes takes about log m rounds. Nodes of a cycle are their own ancestors.
    """
    e = edges.where("child is not null and parent is not null").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("level")).distinct()
    known, before = durable(e), None
    while True:
        found = known.agg(F.count("*"), F.sum("level")).first()
        if tuple(found) == before:
            return known
        before = tuple(found)
        on = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("level").alias("_more"))
        longer = known.join(on, "ancestor").select("child", F.col("_far").alias("ancestor"), (F.col("level") + F.col("_more")).alias("level"))
        known = durable(known.unionByName(longer).groupBy("child", "ancestor").agg(F.min("level").alias("level")))


def reachable(edges: DataFrame, roots: DataFrame, depth: int, limit: int) -> DataFrame:
    """root, node, level: at most ``limit`` nodes below each root, breadth first, then by name."""
    spark = edges.sparkSession
    walked = spark.sql(
        f"""WITH RECURSIVE down(root, node, level) AS (
          SELECT root, root, 0 FROM {{r}} UNION ALL SELECT down.root, e.child, level + 1 FROM down JOIN {{e}} e ON e.parent = down.node WHERE level < {int(depth)})
        SELECT root, node, min(level) AS level FROM down GROUP BY root, node""",
        e=edges,
        r=roots,
    )
    return first_n(walked, ["root"], ["level", "node"], limit, "_k").drop("_k")


def average_hash(pixels: Column) -> Column:
    """A 64-bit hash of 64 values: bit i is set where value i is above the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / F.size(pixels)
    bits = F.transform(pixels, lambda x, i: F.when(x.cast("double") > mean, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def greedy_accept(df: DataFrame, group: str, record: str, hash_bits: str, source: str, order: list[str], need: int, distance: int) -> DataFrame:
    """group, record, accepted, reason: candidates taken one by one until each source of a group has ``need``.

    A candidate within ``distance`` bits of one accepted before in its group is a near duplicate. The
    outcome depends on the order, so a group's rows are read one after the other, sorted by the
    engine and streamed by; what is kept of a group are its accepted hashes, at most ``need`` per
    source. Candidates after a source's quota is met leave no row. Rows with a null group are left out,
    a null hash is near to nothing. Give rows that passed the plain filters only.
    """
    schema = f"{group} string, {record} long, accepted boolean, reason string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept, held = None, [], {}
        for pdf in batches:
            out = []
            for g, rec, bits, known, src in pdf[["_g", record, "_h", "_known", source]].itertuples(index=False):
                if g != now:
                    now, kept, held = g, [], {}
                if held.get(src, 0) >= need:
                    continue
                near = known and any(((int(bits) ^ k) & ((1 << 64) - 1)).bit_count() <= distance for k in kept)
                if not near:
                    held[src] = held.get(src, 0) + 1
                    if known:
                        kept.append(int(bits))
                out.append((g, rec, not near, "near_duplicate" if near else "accepted"))
            yield pd.DataFrame(out, columns=[group, record, "accepted", "reason"])

    columns = [c for c in dict.fromkeys([record, source, *order]) if c != group]
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("_g"), F.col(hash_bits).isNotNull().alias("_known"), F.coalesce(hash_bits, F.lit(0).cast("long")).alias("_h"), *columns)
    return rows.repartition("_g").sortWithinPartitions("_g", *order).mapInPandas(run, schema)
