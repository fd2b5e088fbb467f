"""Queries of resampling and inference over the representational geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.forms import label_form
from quillon.operators import families
from quillon.operators.ranking import with_fdr
from quillon.operators.resample import bootstrap_rsa, edge_bootstrap, holdout_rsa, image_draws, intervals, mantel, placed_in, short_of_images, subset_rsa
from quillon.plans.rsa import _EDGES, _KINDS, _TYPE, base_centroids, base_edges, kinds, pairs, r6
from quillon.plans.tables import table
from quillon.plans.views import CTE, _label, images, models, rho_cte, sources

#: The reference's defaults: image draws and images a draw, permutations, draws of edges and of subsets, sizes of subsets.
DRAWS, SLOTS, PERMUTATIONS, EDGE_DRAWS, SUBSET_DRAWS, SEED, MIN_CONCEPTS = 300, 10, 3000, 1000, 1000, 42, 8
SIZES = [8, 10, 12, 15, 18]
#: Fewer draws, permutations and sizes, for the queries named ``..._small`` that are held against SQL.
FEW, FEW_SIZES = 20, [8, 12]
PAIR = ["model_a", "model_b"]


def placed_images(spark, sf_dir) -> DataFrame:
    """The image models' images with their position within model and concept."""
    seen = models(spark, sf_dir).where(families.broad("kind") == "image").select("model")
    return placed_in(images(spark, sf_dir).join(seen, "model", "left_semi"), ["model", "concept"], "vec_id")


def image_counts(spark, sf_dir) -> DataFrame:
    return placed_images(spark, sf_dir).groupBy("model", "concept").agg(F.max("n").alias("n"))


def _bootstrap(spark, sf_dir, draws=DRAWS) -> DataFrame:
    moving = placed_images(spark, sf_dir)
    fixed = base_centroids(spark, sf_dir).join(moving.select("model").distinct(), "model", "left_anti")
    return bootstrap_rsa(moving, fixed.select("model", "concept", "x"), draws, SLOTS, SEED)


def bootstrap_ci(spark, sf_dir, draws=DRAWS):
    """Point estimates with intervals; pairs without an image model have width 0."""
    ci = intervals(_bootstrap(spark, sf_dir, draws), "rho", PAIR)
    df = kinds(pairs(spark, sf_dir).join(ci, PAIR, "left"), sf_dir)
    fixed = (families.broad("kind_a") != "image") & (families.broad("kind_b") != "image")
    return df.select(*PAIR, r6("rho"), fixed.alias("deterministic"), r6(F.when(fixed, F.col("rho")).otherwise(F.col("ci_low")), "ci_low"), r6(F.when(fixed, F.col("rho")).otherwise(F.col("ci_high")), "ci_high"))


def bootstrap_ci_small(spark, sf_dir):
    return bootstrap_ci(spark, sf_dir, FEW)


def bootstrap_widths(spark, sf_dir, draws=DRAWS):
    """Widths of the intervals and how many hold the point estimate, by whether a pair is deterministic, and in all."""
    df = bootstrap_ci(spark, sf_dir, draws).withColumn("width", F.col("ci_high") - F.col("ci_low")).withColumn("inside", F.col("rho").between(F.col("ci_low"), F.col("ci_high")).cast("double"))
    return df.withColumn("deterministic", F.col("deterministic").cast("string")).rollup("deterministic").agg(r6(F.avg("width"), "mean_width"), r6(F.median("width"), "median_width"), r6(F.min("width"), "min_width"), r6(F.max("width"), "max_width"), r6(F.avg("inside"), "inside"), F.count("*").alias("n"))


def bootstrap_widths_small(spark, sf_dir):
    return bootstrap_widths(spark, sf_dir, FEW)


def bootstrap_draws(spark, sf_dir):
    """Images drawn with replacement, with their multiplicity."""
    return image_draws(image_counts(spark, sf_dir), DRAWS, SLOTS, SEED).select("model", "draw", "concept", "pos", "w")


def subsample_draws(spark, sf_dir):
    """Images drawn without replacement."""
    return image_draws(image_counts(spark, sf_dir), DRAWS, SLOTS, SEED, replacement=False).select("model", "draw", "concept", "pos", "w")


def subsample_short(spark, sf_dir):
    """Concepts of a model with too few images for draws without replacement."""
    return short_of_images(image_counts(spark, sf_dir), SLOTS)


def _mantel(spark, sf_dir, permutations=PERMUTATIONS) -> DataFrame:
    df = mantel(base_edges(spark, sf_dir), permutations, SEED).withColumn("pair", F.concat_ws("|", *PAIR))
    return with_fdr(df, "p", "pair")


def mantel_test(spark, sf_dir, permutations=PERMUTATIONS):
    """Permutation p-values with false-discovery q-values over all pairs."""
    return _mantel(spark, sf_dir, permutations).select(*PAIR, r6("rho"), r6("p"), r6("q"), (F.col("q") < 0.05).alias("significant"))


def mantel_small(spark, sf_dir):
    return mantel_test(spark, sf_dir, FEW)


def mantel_shares(spark, sf_dir, permutations=PERMUTATIONS):
    """Share of significant pairs by type, and the least p-value there can be."""
    df = kinds(_mantel(spark, sf_dir, permutations), sf_dir).withColumn("pair_type", families.pair_type("kind_a", "kind_b"))
    return df.groupBy("pair_type").agg(F.count("*").alias("n_pairs"), F.count_if(F.coalesce("q", F.lit(1.0)) < 0.05).alias("n_significant"), r6(F.avg((F.coalesce("q", F.lit(1.0)) < 0.05).cast("double")), "share"), r6(F.lit(1.0 / (permutations + 1)), "least_p"))


def mantel_shares_small(spark, sf_dir):
    return mantel_shares(spark, sf_dir, FEW)


def holdout_pairs(spark, sf_dir):
    return holdout_rsa(base_edges(spark, sf_dir), sources(spark, sf_dir), "source", MIN_CONCEPTS).select("mode", "source", *PAIR, r6("rho"), "n_concepts")


def holdout_changes(spark, sf_dir):
    """Changes against all concepts, per scenario."""
    base = pairs(spark, sf_dir).select(*PAIR, F.col("rho").alias("base"))
    change = F.col("rho") - F.col("base")
    held = holdout_rsa(base_edges(spark, sf_dir), sources(spark, sf_dir), "source", MIN_CONCEPTS)
    return held.join(base, PAIR).groupBy("mode", "source").agg(r6(F.avg(change), "mean_change"), r6(F.avg(F.abs(change)), "mean_abs"), r6(F.max(F.abs(change)), "max_abs"), F.count("*").alias("n"))


def holdout_by_stratum(spark, sf_dir):
    """As holdout_pairs, with the roster's strata as groups."""
    strata = table(spark, sf_dir, "roster_core").select(label_form("concept").alias("concept"), label_form("stratum").alias("stratum")).where("concept is not null and stratum is not null").groupBy("concept").agg(F.max("stratum").alias("stratum"))
    return holdout_rsa(base_edges(spark, sf_dir), strata, "stratum", MIN_CONCEPTS).select("mode", "stratum", *PAIR, r6("rho"), "n_concepts")


def edge_bootstrap_ci(spark, sf_dir, draws=EDGE_DRAWS):
    return intervals(edge_bootstrap(base_edges(spark, sf_dir), draws, SEED), "rho", PAIR).select(*PAIR, r6("ci_low"), r6("ci_high"))


def edge_bootstrap_small(spark, sf_dir):
    return edge_bootstrap_ci(spark, sf_dir, FEW)


def subset_drift(spark, sf_dir, sizes=SIZES, draws=SUBSET_DRAWS):
    """How far the correlations move when only k concepts are kept: mean and 95 % point of |change|."""
    base = pairs(spark, sf_dir).select(*PAIR, F.col("rho").alias("base"))
    drift = F.abs(F.col("rho") - F.col("base"))
    found = subset_rsa(base_edges(spark, sf_dir), sizes, draws, SEED)
    return found.join(base, PAIR).groupBy("k").agg(r6(F.avg(drift), "mean_drift"), r6(F.percentile(drift, 0.95), "p95_drift"), F.count("*").alias("n"))


def subset_drift_small(spark, sf_dir):
    return subset_drift(spark, sf_dir, FEW_SIZES, FEW)


def subset_claims(spark, sf_dir, sizes=SIZES, draws=SUBSET_DRAWS):
    """Share of draws in which language pairs agree more than language-image pairs, by k."""
    df = kinds(subset_rsa(base_edges(spark, sf_dir), sizes, draws, SEED), sf_dir).withColumn("t", families.pair_type("kind_a", "kind_b"))
    means = df.groupBy("k", "draw").agg(F.avg(F.when(F.col("t") == "language-language", F.col("rho"))).alias("ll"), F.avg(F.when(F.col("t") == "language-image", F.col("rho"))).alias("li"))
    return means.groupBy("k").agg(r6(F.avg((F.coalesce(F.round("ll", 9) > F.round("li", 9), F.lit(False))).cast("double")), "retained"), F.count("*").alias("n_draws"))


def subset_claims_small(spark, sf_dir):
    return subset_claims(spark, sf_dir, FEW_SIZES, FEW)


def centroid_precision(spark, sf_dir):
    """Spread of each model's centroids over the dimensions, a check that no model is degenerate."""
    c = base_centroids(spark, sf_dir).select("model", "concept", F.posexplode("x").alias("d", "v"))
    return c.groupBy("model").agg(F.countDistinct("concept").alias("n_concepts"), F.countDistinct("d").alias("n_dims"), r6(F.stddev_pop("v"), "spread"), F.count_if(F.isnan("v")).alias("n_nan"))


_H = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"


def _h(*parts: str) -> str:
    return _H.format(" || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts))


_IMGS = ", ip AS (SELECT model, concept, vec_id, row_number() OVER (PARTITION BY model, concept ORDER BY vec_id % 64, vec_id) - 1 AS pos FROM (SELECT DISTINCT model, concept, vec_id FROM img JOIN md USING (model) WHERE kind IN ('vision', 'vision_language'))), icn AS (SELECT model, concept, count(*) AS n FROM ip GROUP BY ALL)"


def _draw(draws: int) -> str:
    return _IMGS + f", dr AS (SELECT model, CAST(draw AS INTEGER) AS draw, concept, n, slot FROM icn, (SELECT unnest(range({draws})) AS draw), (SELECT unnest(range({SLOTS})) AS slot)), tk AS (SELECT model, draw, concept, {_h(str(SEED), 'draw', 'concept', 'slot')} % n AS pos, count(*) AS w FROM dr GROUP BY ALL)"


def _holds(c: str) -> str:
    return f"CASE WHEN ka NOT IN ('vision', 'vision_language') AND kb NOT IN ('vision', 'vision_language') THEN p.rho ELSE {c} END"


_BOOT = _EDGES + _draw(FEW) + f""", mv AS (SELECT draw, i.model, i.concept, d, sum(v * w) / sum(w) AS v FROM img i JOIN ip USING (model, concept, vec_id) JOIN tk USING (model, concept, pos) GROUP BY ALL),
 mn AS (SELECT draw, model, concept, CASE WHEN sum(v * v) = 0 THEN 1 ELSE sqrt(sum(v * v)) END AS n FROM mv GROUP BY ALL), mu AS (SELECT draw, model, concept, list(v / n ORDER BY d) AS u FROM mv JOIN mn USING (draw, model, concept) GROUP BY ALL),
 bs AS (SELECT * FROM mu UNION ALL SELECT CAST(draw AS INTEGER), model, concept, u FROM e_u, (SELECT unnest(range({FEW})) AS draw) WHERE model NOT IN (SELECT model FROM ip)),
 be AS (SELECT a.draw, a.model, a.concept AS i, b.concept AS j, round(greatest(-1, least(1, list_dot_product(a.u, b.u))), 12) AS s FROM bs a JOIN bs b ON a.draw = b.draw AND a.model = b.model AND a.concept < b.concept),""" + rho_cte("bp", "be", "draw") + f""",
 ci AS (SELECT model_a, model_b, quantile_cont(rho, 0.025) AS lo, quantile_cont(rho, 0.975) AS hi FROM bp GROUP BY ALL),
 bc AS (SELECT p.model_a, p.model_b, round(p.rho, 6) + 0.0 AS rho, (ka NOT IN ('vision', 'vision_language') AND kb NOT IN ('vision', 'vision_language')) AS deterministic, round({_holds('lo')}, 6) + 0.0 AS ci_low, round({_holds('hi')}, 6) + 0.0 AS ci_high FROM p JOIN ci USING (model_a, model_b) JOIN (SELECT model AS model_a, kind AS ka FROM md) USING (model_a) JOIN (SELECT model AS model_b, kind AS kb FROM md) USING (model_b))"""
_MANTEL = _EDGES + f""", cs AS (SELECT DISTINCT model_a, model_b, concept FROM (SELECT model_a, model_b, i AS concept FROM p_r UNION SELECT model_a, model_b, j FROM p_r)), ca AS (SELECT *, row_number() OVER (PARTITION BY model_a, model_b ORDER BY concept) AS k FROM cs),
 mo AS (SELECT *, row_number() OVER (PARTITION BY model_a, model_b, perm ORDER BY CASE WHEN perm = 0 THEN 0 ELSE {_h(str(SEED), 'perm', 'concept')} END, concept) AS k FROM cs, (SELECT unnest(range({FEW + 1})) AS perm)),
 pm AS (SELECT mo.model_a, mo.model_b, perm, mo.concept, ca.concept AS goes_to FROM mo JOIN ca USING (model_a, model_b, k)),
 ec AS (SELECT model_a, model_b, i, j, ra - avg(ra) OVER (PARTITION BY model_a, model_b) AS a, rb - avg(rb) OVER (PARTITION BY model_a, model_b) AS b FROM p_r), nn AS (SELECT model_a, model_b, sqrt(sum(a * a)) * sqrt(sum(b * b)) AS n FROM ec GROUP BY ALL),
 mr AS (SELECT b.model_a, b.model_b, x.perm, sum(coalesce(a.a, 0) * b.b) / nullif(any_value(n), 0) AS rho FROM ec b JOIN pm x ON x.model_a = b.model_a AND x.model_b = b.model_b AND x.concept = b.i JOIN pm y ON y.model_a = b.model_a AND y.model_b = b.model_b AND y.perm = x.perm AND y.concept = b.j
   LEFT JOIN ec a ON a.model_a = b.model_a AND a.model_b = b.model_b AND a.i = least(x.goes_to, y.goes_to) AND a.j = greatest(x.goes_to, y.goes_to) JOIN nn ON nn.model_a = b.model_a AND nn.model_b = b.model_b GROUP BY 1, 2, 3),
 ob AS (SELECT model_a, model_b, perm, coalesce(rho, 0) AS rho, max(CASE WHEN perm = 0 THEN coalesce(rho, 0) END) OVER (PARTITION BY model_a, model_b) AS obs FROM mr),
 mt AS (SELECT model_a, model_b, max(obs) AS rho, (sum(CASE WHEN perm > 0 AND round(abs(rho), 10) >= round(abs(obs), 10) THEN 1 ELSE 0 END) + 1) / {FEW + 1}.0::DOUBLE AS p FROM ob GROUP BY 1, 2),
 mk AS (SELECT *, row_number() OVER (ORDER BY p, model_a || '|' || model_b) AS k, count(*) OVER () AS n FROM mt),
 mq AS (SELECT model_a, model_b, rho, p, least(1.0, min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM mk)"""


def _hold(group: str, source: str) -> str:
    """``source``: a relation (concept, group)."""
    return f""", ht AS (SELECT concept, {group} AS g FROM {source} WHERE concept IN (SELECT i FROM e UNION SELECT j FROM e)), hc AS (SELECT g, count(*) AS c FROM ht GROUP BY 1),
 hn AS (SELECT * FROM (SELECT 'only' AS mode, g AS held, c AS n_concepts FROM hc UNION ALL SELECT 'without', g, (SELECT count(*) FROM ht) - c FROM hc) WHERE n_concepts >= {MIN_CONCEPTS}),
 hk AS (SELECT mode, held, model, i, j, s FROM e JOIN ht x ON x.concept = i JOIN ht y ON y.concept = j JOIN hn ON (mode = 'only' AND x.g = held AND y.g = held) OR (mode = 'without' AND x.g <> held AND y.g <> held)),""" + rho_cte("hp", "hk", "mode, held")


_STRATA = f", sr AS (SELECT concept, stratum FROM (SELECT {_label('concept')} AS concept, max({_label('stratum')}) AS stratum FROM roster_core GROUP BY 1) WHERE concept IS NOT NULL AND stratum IS NOT NULL)"
_SUB = _KINDS + f""", sc AS (SELECT DISTINCT model_a, model_b, concept FROM (SELECT model_a, model_b, i AS concept FROM p_r UNION SELECT model_a, model_b, j FROM p_r)), sz AS (SELECT model_a, model_b, count(*) AS n FROM sc GROUP BY ALL),
 su AS (SELECT model_a, model_b, k, CAST(draw AS INTEGER) AS draw, concept, row_number() OVER (PARTITION BY model_a, model_b, k, draw ORDER BY {_h(str(SEED), 'k', 'draw', 'concept')}, concept) AS o FROM sc JOIN sz USING (model_a, model_b), (SELECT unnest(range({FEW})) AS draw), (SELECT CAST(unnest({FEW_SIZES}) AS INTEGER) AS k) WHERE n >= k),
 sl AS (SELECT * FROM su WHERE o <= k), se AS (SELECT x.k, x.draw, r.model_a, r.model_b, sa, sb FROM p_r r JOIN sl x ON x.model_a = r.model_a AND x.model_b = r.model_b AND x.concept = r.i JOIN sl y ON y.model_a = r.model_a AND y.model_b = r.model_b AND y.concept = r.j AND y.k = x.k AND y.draw = x.draw),
 st AS (SELECT *, rank() OVER (PARTITION BY k, draw, model_a, model_b ORDER BY sa) + (count(*) OVER (PARTITION BY k, draw, model_a, model_b, sa) - 1) / 2.0 AS qa, rank() OVER (PARTITION BY k, draw, model_a, model_b ORDER BY sb) + (count(*) OVER (PARTITION BY k, draw, model_a, model_b, sb) - 1) / 2.0 AS qb FROM se),
 sp AS (SELECT k, draw, model_a, model_b, CASE WHEN stddev_pop(qa) * stddev_pop(qb) = 0 THEN 0 ELSE covar_pop(qa, qb) / (stddev_pop(qa) * stddev_pop(qb)) END AS rho FROM st GROUP BY ALL)"""
_EB = _EDGES + f""", ei AS (SELECT model_a, model_b, sa, sb, row_number() OVER (PARTITION BY model_a, model_b ORDER BY i, j) - 1 AS ed, count(*) OVER (PARTITION BY model_a, model_b) AS n FROM p_r),
 es AS (SELECT draw, model_a, model_b, {_h(str(SEED), 'draw', 'ed')} % n AS ed FROM ei, (SELECT unnest(range({FEW})) AS draw)), ek AS (SELECT draw, model_a, model_b, sa, sb FROM es JOIN ei USING (model_a, model_b, ed)),
 er2 AS (SELECT *, rank() OVER (PARTITION BY draw, model_a, model_b ORDER BY sa) + (count(*) OVER (PARTITION BY draw, model_a, model_b, sa) - 1) / 2.0 AS qa, rank() OVER (PARTITION BY draw, model_a, model_b ORDER BY sb) + (count(*) OVER (PARTITION BY draw, model_a, model_b, sb) - 1) / 2.0 AS qb FROM ek),
 ep AS (SELECT draw, model_a, model_b, CASE WHEN round(stddev_pop(qa) * stddev_pop(qb), 9) = 0 THEN 0 ELSE covar_pop(qa, qb) / (stddev_pop(qa) * stddev_pop(qb)) END AS rho FROM er2 GROUP BY ALL)"""

SQL = {
    "bootstrap_ci_small": _BOOT + " SELECT * FROM bc",
    "bootstrap_widths_small": _BOOT + ", bw AS (SELECT *, ci_high - ci_low AS w, CASE WHEN rho BETWEEN ci_low AND ci_high THEN 1.0 ELSE 0.0 END AS ins FROM bc) SELECT CAST(deterministic AS VARCHAR) AS deterministic, round(avg(w), 6) + 0.0 AS mean_width, round(median(w), 6) + 0.0 AS median_width, round(min(w), 6) + 0.0 AS min_width, round(max(w), 6) + 0.0 AS max_width, round(avg(ins), 6) + 0.0 AS inside, count(*) AS n FROM bw GROUP BY ROLLUP (deterministic)",
    "bootstrap_draws": "WITH " + CTE + _draw(DRAWS) + " SELECT model, draw, concept, pos, w FROM tk",
    "subsample_draws": "WITH " + CTE + _IMGS + f", wr AS (SELECT model, CAST(draw AS INTEGER) AS draw, concept, pos, row_number() OVER (PARTITION BY model, draw, concept ORDER BY {_h(str(SEED), 'draw', 'concept', 'pos')}, pos) AS k FROM ip, (SELECT unnest(range({DRAWS})) AS draw)) SELECT model, draw, concept, pos, CAST(1 AS BIGINT) AS w FROM wr WHERE k <= {SLOTS}",
    "subsample_short": "WITH " + CTE + _IMGS + f" SELECT model, concept, n FROM icn WHERE n < {SLOTS}",
    "mantel_small": _MANTEL + " SELECT model_a, model_b, round(rho, 6) + 0.0 AS rho, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q, q < 0.05 AS significant FROM mq",
    "mantel_shares_small": _MANTEL + f", mj AS (SELECT mq.*, ma.kind AS kind_a, mb.kind AS kind_b FROM mq JOIN md ma ON ma.model = model_a JOIN md mb ON mb.model = model_b) SELECT {_TYPE} AS pair_type, count(*) AS n_pairs, CAST(sum(CASE WHEN q < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_significant, round(avg(CASE WHEN q < 0.05 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share, round(1.0::DOUBLE / {FEW + 1}, 6) + 0.0 AS least_p FROM mj GROUP BY 1",
    "holdout_pairs": _EDGES + _hold("source", "so") + " SELECT mode, held AS source, model_a, model_b, round(rho, 6) + 0.0 AS rho, n_concepts FROM hp JOIN hn USING (mode, held)",
    "holdout_changes": _EDGES + _hold("source", "so") + " SELECT mode, held AS source, round(avg(hp.rho - p.rho), 6) + 0.0 AS mean_change, round(avg(abs(hp.rho - p.rho)), 6) + 0.0 AS mean_abs, round(max(abs(hp.rho - p.rho)), 6) + 0.0 AS max_abs, count(*) AS n FROM hp JOIN p USING (model_a, model_b) GROUP BY 1, 2",
    "holdout_by_stratum": _EDGES + _STRATA + _hold("stratum", "sr") + " SELECT mode, held AS stratum, model_a, model_b, round(rho, 6) + 0.0 AS rho, n_concepts FROM hp JOIN hn USING (mode, held)",
    "edge_bootstrap_small": _EB + " SELECT model_a, model_b, round(quantile_cont(rho, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(rho, 0.975), 6) + 0.0 AS ci_high FROM ep GROUP BY 1, 2",
    "subset_drift_small": _SUB + " SELECT k, round(avg(abs(sp.rho - p.rho)), 6) + 0.0 AS mean_drift, round(quantile_cont(abs(sp.rho - p.rho), 0.95), 6) + 0.0 AS p95_drift, count(*) AS n FROM sp JOIN p USING (model_a, model_b) GROUP BY 1",
    "subset_claims_small": _SUB + f", sj AS (SELECT sp.*, ma.kind AS kind_a, mb.kind AS kind_b FROM sp JOIN md ma ON ma.model = model_a JOIN md mb ON mb.model = model_b), sm AS (SELECT k, draw, avg(rho) FILTER (WHERE {_TYPE} = 'language-language') AS ll, avg(rho) FILTER (WHERE {_TYPE} = 'language-image') AS li FROM sj GROUP BY 1, 2) SELECT k, round(avg(CASE WHEN round(ll, 9) > round(li, 9) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS retained, count(*) AS n_draws FROM sm GROUP BY 1",
    "centroid_precision": "WITH " + CTE + " SELECT model, count(DISTINCT concept) AS n_concepts, count(DISTINCT d) AS n_dims, round(stddev_pop(v), 6) + 0.0 AS spread, CAST(sum(CASE WHEN isnan(v) THEN 1 ELSE 0 END) AS BIGINT) AS n_nan FROM cen GROUP BY 1",
}
#: At the reference's counts DuckDB is too slow for their SQL.
LONG = ["bootstrap_ci", "bootstrap_widths", "mantel_test", "mantel_shares", "edge_bootstrap_ci", "subset_drift", "subset_claims"]
QUERIES = {n: globals()[n] for n in [*SQL, *LONG]}
