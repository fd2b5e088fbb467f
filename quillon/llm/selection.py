"""Problems 3, 4 and 6 over the candidate tables: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.forms import label_form, usable_score
from quillon.llm.cutoff import DyadicCountTree, cutoffs, kept_records
from quillon.llm.quota import KEYS, deficits, draw, quotas, supply
from quillon.llm.topn import top_n_per_group
from quillon.plans.durable import durable, lookup_join
from quillon.plans.tables import table

TOP = 5
SEED = 42


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidate").where(usable_score("clip_score")).select("candidate_id", label_form("concept").alias("concept"), "clip_score", F.nullif(F.col("aux_score"), F.lit(float("nan"))).alias("aux_score"))
    return top_n_per_group(rows, "concept", "clip_score", [F.col("aux_score").desc_nulls_last(), F.col("candidate_id").asc()], TOP, "candidate_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir).select("candidate_id")


def p3_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir).select("concept", F.col("__rank").cast("int").alias("position"), "candidate_id", "clip_score", "aux_score")


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DyadicCountTree, DataFrame]:
    """The tree over all candidates, added in three batches by the year they came in."""
    tree = DyadicCountTree(spark)
    rows = table(spark, sf_dir, "candidate").where(usable_score("clip_score")).select("candidate_id", label_form("source").alias("source"), "clip_score", F.year("ingested_at").alias("year"))
    targets = table(spark, sf_dir, "source_target").select(label_form("source").alias("source"), "target_fraction")
    for batch in (F.coalesce(F.col("year") < 2025, F.lit(True)), F.col("year") == 2025, F.col("year") > 2025):
        tree.add_batch(rows.where(batch), "source", "clip_score", "candidate_id")
    return tree, targets


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, targets = _tree(spark, sf_dir)
    return kept_records(tree, durable(cutoffs(tree, targets))).select(F.col("record").alias("candidate_id"))


def p4_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, targets = _tree(spark, sf_dir)
    return cutoffs(tree, targets)


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """concept, stratum, source_feasibility of every concept in the roster or the reserve."""
    cols = [label_form(c).alias(c) for c in ("concept", "stratum", "source_feasibility")]
    both = table(spark, sf_dir, "roster_core").select(*cols).unionByName(table(spark, sf_dir, "reserve_catalog").select(*cols))
    return both.where("concept is not null").groupBy("concept").agg(F.max("stratum").alias("stratum"), F.max("source_feasibility").alias("source_feasibility"))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "sample_target")
    return quotas(t.select("run_id", F.lower(F.trim("category_field")).alias("category_field"), label_form("category_value").alias("category_value"), "target_share", "min_rows", "sample_size"))


def members(spark: SparkSession, sf_dir: str, targets: DataFrame) -> DataFrame:
    """record, run_id, category_field, category_value: each candidate once per category it is in that a target asks for."""
    rows = table(spark, sf_dir, "candidate").select(F.col("candidate_id").alias("record"), "run_id", label_form("concept").alias("concept"), label_form("source").alias("source"))
    rows = rows.where("record is not null and run_id is not null").dropDuplicates(["record"])
    rows = lookup_join(rows, categories(spark, sf_dir), ["concept"], "left", "record")
    fields = F.array(*[F.struct(F.lit(c).alias("category_field"), F.col(c).alias("category_value")) for c in ("stratum", "source", "source_feasibility")])
    rows = rows.select("record", "run_id", F.explode(fields).alias("x")).select("record", "run_id", "x.*").where("category_value is not null")
    return lookup_join(rows, targets.select(*KEYS), KEYS, salt_on="record").select("record", *KEYS)


def sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sample, and the targets with what there is of each."""
    targets = durable(wanted(spark, sf_dir))
    rows = durable(members(spark, sf_dir, targets))
    supplied = durable(supply(rows, targets))
    return draw(rows, supplied, SEED), supplied


def p6_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that the sample, as drawn, falls short of."""
    sample, supplied = sampled(spark, sf_dir)
    return deficits(supplied, sample).where("shortfall > 0").select(*KEYS, "quota", "n_available", "shortfall")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_deficits(spark, sf_dir).select(*KEYS)


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark, sf_dir)[0].withColumnRenamed("record", "candidate_id")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sample holds of each category against its quota."""
    sample, supplied = sampled(spark, sf_dir)
    return deficits(supplied, sample).select(*KEYS, "quota", "n_available", "n_drawn", "shortfall")


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the sample, counted: records repeated in a category, and records that are in no candidate row."""
    sample = sampled(spark, sf_dir)[0]
    repeated = sample.groupBy("record", *KEYS).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_repeated"))
    known = table(spark, sf_dir, "candidate").select(F.col("candidate_id").alias("record"), "run_id").distinct()
    unknown = sample.join(known, ["record", "run_id"], "left_anti").agg(F.count("*").alias("n_unknown"))
    # Two rows of one number each.
    return repeated.join(unknown).join(sample.agg(F.count("*").alias("n_sampled")))


def _label(c: str) -> str:
    return f"nullif(regexp_replace(lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '[\\s\\p{{Z}}_-]+', '_', 'g'), '')"


_USABLE = "clip_score IS NOT NULL AND NOT isnan(clip_score) AND clip_score BETWEEN 0 AND 1"
_P3 = f"""WITH c AS (SELECT DISTINCT candidate_id, {_label('concept')} AS concept, clip_score, CASE WHEN isnan(aux_score) THEN NULL ELSE aux_score END AS aux_score FROM candidate WHERE {_USABLE}),
 r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY clip_score DESC, aux_score DESC NULLS LAST, candidate_id) AS rn FROM c WHERE concept IS NOT NULL)"""
_P4 = f"""WITH c AS (SELECT DISTINCT candidate_id, {_label('source')} AS source, clip_score FROM candidate WHERE {_USABLE}),
 t AS (SELECT {_label('source')} AS source, max(target_fraction) AS target_fraction FROM source_target GROUP BY 1),
 s AS (SELECT source, clip_score, count(*) AS n FROM c GROUP BY ALL),
 k AS (SELECT source, clip_score, sum(n) OVER (PARTITION BY source ORDER BY clip_score DESC) AS kept, sum(n) OVER (PARTITION BY source) AS total FROM s),
 cut AS (SELECT k.source, max(clip_score) AS cutoff, min(kept) AS kept FROM k JOIN t ON t.source = k.source WHERE kept >= CAST(target_fraction AS DECIMAL(10,9)) * total GROUP BY 1)"""
_P6 = f"""WITH cat AS (SELECT concept, max(stratum) AS stratum, max(source_feasibility) AS source_feasibility FROM (
   SELECT {_label('concept')} AS concept, {_label('stratum')} AS stratum, {_label('source_feasibility')} AS source_feasibility FROM roster_core
   UNION ALL SELECT {_label('concept')}, {_label('stratum')}, {_label('source_feasibility')} FROM reserve_catalog) GROUP BY 1),
 c AS (SELECT DISTINCT candidate_id, run_id, {_label('concept')} AS concept, {_label('source')} AS source FROM candidate WHERE candidate_id IS NOT NULL AND run_id IS NOT NULL),
 j AS (SELECT c.*, stratum, source_feasibility FROM c LEFT JOIN cat ON cat.concept = c.concept),
 m AS (SELECT run_id, 'stratum' AS category_field, stratum AS category_value FROM j UNION ALL SELECT run_id, 'source', source FROM j UNION ALL SELECT run_id, 'source_feasibility', source_feasibility FROM j),
 n AS (SELECT run_id, category_field, category_value, count(*) AS n_available FROM m GROUP BY ALL),
 t AS (SELECT run_id, lower(trim(category_field)) AS category_field, {_label('category_value')} AS category_value, greatest(max(coalesce(min_rows, 0)), CAST(round(CAST(max(coalesce(target_share, 0)) AS DECIMAL(18,6)) * max(coalesce(sample_size, 0)), 0) AS BIGINT)) AS quota FROM sample_target GROUP BY ALL),
 s AS (SELECT t.run_id, t.category_field, t.category_value, CAST(quota AS BIGINT) AS quota, coalesce(n_available, 0) AS n_available FROM t LEFT JOIN n ON n.run_id = t.run_id AND n.category_field = t.category_field AND n.category_value = t.category_value WHERE t.run_id IS NOT NULL AND t.category_value IS NOT NULL)"""

SQL = {
    "p3_found": _P3 + " SELECT candidate_id FROM r WHERE rn <= 5",
    "p3_ranked": _P3 + " SELECT concept, CAST(rn AS INTEGER) AS position, candidate_id, clip_score, aux_score FROM r WHERE rn <= 5",
    "p4_found": _P4 + " SELECT candidate_id FROM c JOIN cut ON cut.source = c.source WHERE clip_score >= cutoff",
    "p4_cutoffs": _P4 + ", tot AS (SELECT source, count(*) AS n_scored FROM c GROUP BY 1) SELECT t.source, target_fraction, coalesce(n_scored, 0) AS n_scored, cutoff, CAST(coalesce(kept, 0) AS BIGINT) AS kept FROM t LEFT JOIN cut ON cut.source = t.source LEFT JOIN tot ON tot.source = t.source WHERE t.source IS NOT NULL",
    "p6_found": _P6 + " SELECT run_id, category_field, category_value FROM s WHERE n_available < quota",
    "p6_deficits": _P6 + " SELECT run_id, category_field, category_value, quota, n_available, quota - n_available AS shortfall FROM s WHERE n_available < quota",
    "p6_checks": _P6 + " SELECT CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_unknown, CAST(coalesce(sum(least(quota, n_available)), 0) AS BIGINT) AS n_sampled FROM s",
    "p6_shares": _P6 + " SELECT run_id, category_field, category_value, quota, n_available, least(quota, n_available) AS n_drawn, greatest(quota - n_available, 0) AS shortfall FROM s",
}
QUERIES = {"p3_found": p3_found, "p3_ranked": p3_ranked, "p4_found": p4_found, "p4_cutoffs": p4_cutoffs, "p6_found": p6_found, "p6_deficits": p6_deficits, "p6_sample": p6_sample, "p6_shares": p6_shares, "p6_checks": p6_checks}
