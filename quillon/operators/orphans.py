"""References whose target is not in place, found with compressed bitmaps per key range and period.

Keys are dictionary-encoded as integers. Bit ``i`` of word ``w`` stands for the key ``64 w + i``.
References are one bitmap per key range and period (month); the parent table is one bitmap per key
range and span of whole periods in which its keys are in place throughout. ``reference AND NOT
parent`` leaves the keys that are missing for at least a part of the period; they are decoded and
only their references are compared with the parents' exact intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.durable import durable, lookup_join

#: Keys go to dictionary parts by their hash, one for so many distinct rows of both sides; ids are dense within a part.
PART_ROWS, LEAST_PARTS = 1 << 14, 16
FOREVER = 1 << 20


def month_number(ts: Column) -> Column:
    """Months since year 0."""
    return F.year(ts) * 12 + F.month(ts) - 1


def _spans(parents: DataFrame) -> DataFrame:
    """key, first, last: the months a parent row covers from their first to their last moment."""
    start, end = F.col("valid_from"), F.col("valid_to")
    whole = F.when(F.date_trunc("month", start) == start, month_number(start)).otherwise(month_number(start) + 1)
    return parents.select("key", whole.alias("first"), F.coalesce(month_number(end) - 1, F.lit(FOREVER)).alias("last"))


def encode(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The union of both sides by key, each distinct (key, period) or (key, span) once, with ids.

    One shuffle on the dictionary part brings both sides of a key together; the id is the part and
    the rank of the key in it, so no dictionary has to be joined or collected. Both sides are made
    distinct in the map tasks first: a key named in a third of all references goes on as one row a
    period. Ids follow from the keys alone and are the same when a task is run again. Both steps are written
    down, as the bitmaps and their decoding read them.
    """
    refs = references.select("key", month_number(F.col("at")).alias("first"), F.lit(None).cast("int").alias("last")).distinct()
    rows = durable(refs.unionByName(_spans(parents).distinct()))
    parts = max(LEAST_PARTS, -(-rows.count() // PART_ROWS))
    ranked = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).selectExpr("*", "dense_rank() over (partition by part order by key) - 1 as rank")
    return durable(ranked.select("key", "part", "rank", "first", "last"))


def missing_keys(references: DataFrame, parents: DataFrame) -> DataFrame:
    """key, period: referenced keys that no parent row covers for the whole period.

    ``references``: key, at. ``parents``: key, valid_from, valid_to (null: still valid).
    """
    coded = encode(references, parents)
    bit = F.expr("shiftleft(1L, cast(rank % 64 as int))")
    words = coded.groupBy("part", (F.col("rank") / 64).cast("int").alias("word"), "first", "last").agg(F.bit_or(bit).alias("bits"))
    is_ref = F.col("last").isNull()
    entry = F.struct("first", "last", "bits")
    ranges = words.groupBy("part", "word").agg(F.collect_list(F.when(is_ref, entry)).alias("refs"), F.collect_list(F.when(~is_ref, entry)).alias("held"))
    covered = "aggregate(filter(held, h -> h.first <= r.first and h.last >= r.first), 0L, (a, h) -> a | h.bits)"
    left = ranges.where(F.size("refs") > 0).selectExpr("part", "word", f"filter(transform(refs, r -> named_struct('period', r.first, 'bits', r.bits & ~({covered}))), x -> x.bits != 0) as gaps")
    bits = left.selectExpr("part", "word", "inline(gaps)").selectExpr("part", "period", "explode(filter(transform(sequence(0, 63), i -> if((shiftright(bits, i) & 1) = 1, word * 64 + i, null)), i -> i is not null)) as rank")
    names = coded.where(is_ref).select("part", "rank", F.col("first").alias("period"), "key")
    return names.join(bits, ["part", "rank", "period"]).select("key", "period")


def orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The references whose key was not in place at their own time, with a ``reason``.

    ``references``: key, at and any other columns, which are passed on. ``parents``: key, valid_from
    (inclusive), valid_to (exclusive, null: still valid). Reasons: ``never`` (no such key), ``gone``
    (only earlier), ``later`` (only later) and ``between``.

    References with a null key or null time are no cases. Parent rows with a null key or start, or
    that end before they start, hold nothing. Repeated parent rows hold once; repeated references
    stay repeated. Empty tables give an empty result, an empty parent table makes every reference an
    orphan. Names of other columns are free but for ``period``, ``spans``, ``first_end`` and ``last_start``.
    """
    refs = references.where(F.col("key").isNotNull() & F.col("at").isNotNull())
    held = parents.where(F.col("key").isNotNull() & F.col("valid_from").isNotNull() & F.coalesce(F.col("valid_to") > F.col("valid_from"), F.lit(True))).select("key", "valid_from", "valid_to")
    gaps = durable(missing_keys(refs, held))
    # Within a period without a parent that covers it whole, only parents that begin or end in it matter.
    ends = held.distinct().join(gaps.select("key").distinct(), "key", "left_semi")
    month = F.array_distinct(F.array_compact(F.array(month_number(F.col("valid_from")), month_number(F.col("valid_to")))))
    near = ends.withColumn("period", F.explode(month)).join(gaps, ["key", "period"], "left_semi")
    near = near.groupBy("key", "period").agg(F.collect_set(F.struct("valid_from", "valid_to")).alias("spans"))
    around = ends.groupBy("key").agg(F.min("valid_to").alias("first_end"), F.max("valid_from").alias("last_start"))
    known = durable(gaps.join(near, ["key", "period"], "left").join(around, "key", "left"))
    suspects = lookup_join(refs.withColumn("period", month_number(F.col("at"))), known, ["key", "period"])
    in_place = F.expr("exists(spans, s -> s.valid_from <= at and (s.valid_to is null or at < s.valid_to))")
    before, after = F.coalesce(F.col("first_end") <= F.col("at"), F.lit(False)), F.col("last_start") > F.col("at")
    reason = F.when(F.col("last_start").isNull(), "never").when(before & after, "between").when(before, "gone").otherwise("later")
    return suspects.where(~F.coalesce(in_place, F.lit(False))).withColumn("reason", reason).drop("spans", "period", "first_end", "last_start")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per ref_table, ref_field, month of ``at`` and reason."""
    keys = ["ref_table", "ref_field", F.date_format("at", "yyyy-MM").alias("month"), "reason"]
    return found.groupBy(*keys).agg(F.count("*").alias("n_orphans"), F.countDistinct("key").alias("n_keys"))
