"""Samples that match target shares of categories, with deficits reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.forms import uniform_hash
from quillon.plans.durable import durable, lookup_join

KEYS = ["run_id", "category_field", "category_value"]


def quotas(targets: DataFrame) -> DataFrame:
    """Rows wanted of each category: the larger of min_rows and round(target_share x sample_size).

    ``targets``: run_id, category_field, category_value, target_share, min_rows, sample_size, with
    categories in canonical form. Rows with a null key are dropped, repeated categories count once
    (the largest figures hold), null figures count as 0.
    """
    one = targets.where(" and ".join(f"{k} is not null" for k in KEYS)).groupBy(*KEYS).agg(*[F.max(F.coalesce(c, F.lit(0))).alias(c) for c in ("target_share", "min_rows", "sample_size")])
    share = F.round(F.col("target_share").cast("decimal(18,6)") * F.col("sample_size"), 0).cast("long")
    return one.select(*KEYS, "target_share", "min_rows", "sample_size", F.greatest(F.col("min_rows").cast("long"), share).alias("quota"))


def supply(members: DataFrame, quota: DataFrame) -> DataFrame:
    """``quota`` with the number of members there are: n_available, and shortfall (0 where met).

    ``members``: record, run_id and one row per category the record is in (category_field,
    category_value), each record once per category. Counting combines in the map tasks.
    """
    counted = members.groupBy(*KEYS).agg(F.count("*").alias("n_available"))
    return quota.join(counted, KEYS, "left").withColumn("n_available", F.coalesce("n_available", F.lit(0))).withColumn("shortfall", F.greatest(F.col("quota") - F.col("n_available"), F.lit(0)))


def draw(members: DataFrame, supplied: DataFrame, seed: int = 42) -> DataFrame:
    """The sample: rows of ``members`` of each category, exactly min(quota, n_available) of each.

    Every record has a fixed random number by ``seed``. A category's acceptance probability is its
    quota over its members, raised by four standard deviations; each record is accepted by itself in the
    map tasks, and the accepted of a category are cut to the quota by rank. A category with no more members
    than its quota takes all, unranked. One that came out short by chance accepts anew with four times the
    probability, until it is full. So a task ranks little more rows of a category than its quota, whatever its size.
    """
    q = F.col("quota").cast("double")
    probability = F.least(F.lit(1.0), (q + 4 * F.sqrt(q) + 8) / F.col("n_available"))
    plan = supplied.where("quota > 0 and n_available > 0").select(*KEYS, "quota", "n_available", probability.alias("p"))
    u = uniform_hash(seed, "run_id", "category_field", "record")
    everyone = F.col("n_available") <= F.col("quota")

    def accept(plan: DataFrame) -> DataFrame:
        rows = lookup_join(members, plan, KEYS, salt_on="record").withColumn("u", u).where("u < p")
        rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("u", "record"))
        cut = rows.where(~everyone).withColumn("draw_rank", rank).where("draw_rank <= quota")
        return rows.where(everyone).select("record", *KEYS).unionByName(cut.select("record", *KEYS))

    sample = durable(accept(plan))
    while True:
        reached = sample.groupBy(*KEYS).agg(F.count("*").alias("n_drawn"))
        short = plan.join(reached, KEYS, "left").where("p < 1 and coalesce(n_drawn, 0) < quota")
        short = durable(short.select(*KEYS, "quota", "n_available", F.least(F.lit(1.0), F.col("p") * 4).alias("p")))
        if short.isEmpty():
            return sample
        sample = durable(sample.join(short.select(*KEYS), KEYS, "left_anti").select("record", *KEYS).unionByName(accept(short)))
        plan = short


def deficits(supplied: DataFrame, sample: DataFrame) -> DataFrame:
    """``supplied`` with n_drawn, the rows of ``sample`` in each category, and shortfall, what is left of the quota."""
    drawn = sample.groupBy(*KEYS).agg(F.count("*").alias("n_drawn"))
    return supplied.drop("shortfall").join(drawn, KEYS, "left").withColumn("n_drawn", F.coalesce("n_drawn", F.lit(0))).withColumn("shortfall", F.greatest(F.col("quota") - F.col("n_drawn"), F.lit(0)))
