"""Queries of representational similarity: pairs, summaries, CKA, depth, prompts, compounds, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import families
from quillon.operators.geometry import centroids, cka_pairs, dot, layer_at, norm, ranked_edges, rsa_pairs, similarity_edges, symmetrised, unit_vectors
from quillon.operators.ranking import average_rank, correlation
from quillon.plans.views import CTE, FRACTIONS, edges_cte, images, layers, models, places, ranks_cte, rho_cte, templates

D = 6


def r6(c: str, name: str | None = None):
    """Rounded for comparison, without a negative zero."""
    return (F.round(c, D) + 0.0).alias(name or c)


def base_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids(images(spark, sf_dir), ["model"])


def base_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_edges(base_centroids(spark, sf_dir), ["model"])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rsa_pairs(base_edges(spark, sf_dir))


def kinds(df: DataFrame, sf_dir: str) -> DataFrame:
    """Model pairs with kind_a, kind_b, size_a, size_b of the models' table, of a row a model."""
    m = models(df.sparkSession, sf_dir)
    for side in "ab":
        df = df.join(m.withColumnsRenamed({c: f"{c}_{side}" for c in m.columns}), f"model_{side}")
    return df


def rsa_centroids(spark, sf_dir):
    return base_centroids(spark, sf_dir).select("model", "concept", F.posexplode("x").alias("d", "v")).select("model", "concept", "d", r6("v"))


def rsa_similarity(spark, sf_dir):
    return base_edges(spark, sf_dir).select("model", "i", "j", r6("s"))


def rsa_ranks(spark, sf_dir):
    return ranked_edges(base_edges(spark, sf_dir), ["model"]).select("model", "i", "j", "r")


def rsa_model_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("model_a", "model_b", r6("rho"), "n_edges")


def rsa_type_summary(spark, sf_dir):
    typed = kinds(pairs(spark, sf_dir), sf_dir).withColumn("pair_type", families.pair_type("kind_a", "kind_b"))
    return typed.groupBy("pair_type").agg(r6(F.avg("rho"), "mean_rho"), r6(F.median("rho"), "median_rho"), r6(F.min("rho"), "min_rho"), r6(F.max("rho"), "max_rho"), F.count("*").alias("n_pairs"))


def rsa_pair_families(spark, sf_dir):
    """Summaries over the finer families, with the totals of a rollup."""
    df = kinds(pairs(spark, sf_dir), sf_dir).withColumn("family", families.pair_family_of("kind_a", "kind_b"))
    return df.rollup("family").agg(r6(F.avg("rho"), "mean_rho"), F.count("*").alias("n_pairs"))


def rsa_family_block(spark, sf_dir):
    both = kinds(symmetrised(pairs(spark, sf_dir)), sf_dir).select(families.extension("kind_a").alias("family_a"), families.extension("kind_b").alias("family_b"), "rho")
    return both.groupBy("family_a", "family_b").agg(r6(F.avg("rho"), "mean_rho"), F.count("*").alias("n"))


FAMILIES = ["language", "vision", "contrastive_vlm", "autoregressive_vlm"]


def rsa_bridge(spark, sf_dir):
    """Each model's mean correlation to the other models of every family, and vision minus language."""
    both = kinds(symmetrised(pairs(spark, sf_dir)), sf_dir).withColumn("family_b", families.extension("kind_b"))
    wide = both.groupBy("model_a").pivot("family_b", FAMILIES).agg(F.avg("rho"))
    return wide.select(F.col("model_a").alias("model"), *[r6(f, f"to_{f}") for f in FAMILIES], r6(F.col("vision") - F.col("language"), "vision_minus_language"))


def rsa_model_order(spark, sf_dir):
    """Models by family, then name, as a heat map lists them."""
    order = {f: i for i, f in enumerate(FAMILIES)}
    m = models(spark, sf_dir).withColumn("family", families.extension("kind"))
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("family")]
    return m.select("model", "family", families.broad("kind").alias("broad"), families.pilot("kind").alias("pilot"), families.plot("kind").alias("plot"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(rank, "model")).alias("place"))


def rsa_scale_curve(spark, sf_dir):
    """Size against the mean correlation with vision models, per language model, with the rank correlation."""
    df = kinds(symmetrised(pairs(spark, sf_dir)), sf_dir).where("kind_a = 'causal' and kind_b = 'vision'").groupBy(F.col("model_a").alias("model"), F.col("size_a").alias("size")).agg(F.avg("rho").alias("mean_rho"), F.count("*").alias("n"))
    ranked = df.withColumn("_g", F.lit(0)).withColumn("_x", average_rank("size", "_g")).withColumn("_y", average_rank("mean_rho", "_g"))
    w = Window.partitionBy("_g")
    cov = F.avg(F.col("_x") * F.col("_y")).over(w) - F.avg("_x").over(w) * F.avg("_y").over(w)
    rho = F.coalesce(F.try_divide(cov, F.stddev_pop("_x").over(w) * F.stddev_pop("_y").over(w)), F.lit(0.0))
    return ranked.withColumn("size_rho", rho).select("model", "size", r6("mean_rho"), "n", r6("size_rho"))


def rsa_cka(spark, sf_dir):
    return cka_pairs(base_centroids(spark, sf_dir)).select("model_a", "model_b", r6("cka"))


def rsa_cka_agreement(spark, sf_dir):
    both = pairs(spark, sf_dir).join(cka_pairs(base_centroids(spark, sf_dir)), ["model_a", "model_b"])
    both = both.where("cka is not null").select(F.round("rho", 9).alias("rho"), F.round("cka", 9).alias("cka"), F.lit(0).alias("_g"))
    ranked = both.withColumn("_r", average_rank("rho", "_g")).withColumn("_c", average_rank("cka", "_g"))
    return ranked.agg(r6(correlation("rho", "cka"), "pearson"), r6(correlation("_r", "_c"), "spearman"), F.count("*").alias("n_pairs"))


def depth_pairs(spark, sf_dir):
    at = layer_at(centroids(layers(spark, sf_dir), ["model", "layer"]), FRACTIONS)
    return rsa_pairs(similarity_edges(at.drop("layer"), ["fraction", "model"]), ["fraction"])


def rsa_depth(spark, sf_dir):
    """Mean correlation at each depth: over all pairs, and by type, in one pass of grouping sets."""
    df = kinds(depth_pairs(spark, sf_dir), sf_dir).withColumn("pair_type", families.pair_type("kind_a", "kind_b"))
    rolled = df.rollup("fraction", "pair_type").agg(F.avg("rho").alias("mean_rho"), F.count("*").alias("n")).where("fraction is not null")
    return rolled.select("fraction", F.coalesce("pair_type", F.lit("all")).alias("pair_type"), r6("mean_rho"), "n")


def rsa_depth_layers(spark, sf_dir):
    return layer_at(layers(spark, sf_dir), FRACTIONS).select("model", "fraction", "layer", F.format_string("d%02d", (F.col("fraction") * 100).cast("int")).alias("label")).distinct()


def _prompt_edges(spark, sf_dir) -> DataFrame:
    t = templates(base_centroids(spark, sf_dir), spark, sf_dir)
    single = t.withColumn("template", F.concat(F.lit("t"), "template"))
    ensemble = centroids(unit_vectors(t, ["model", "template"]), ["model"]).withColumn("template", F.lit("ensemble"))
    return similarity_edges(single.unionByName(ensemble), ["model", "template"])


def prompt_agreement(spark, sf_dir):
    """Rank correlation between the prompts of a model, the mean of their unit vectors among them."""
    e = _prompt_edges(spark, sf_dir).withColumnsRenamed({"model": "lm", "template": "model"})
    return rsa_pairs(e, ["lm"]).select(F.col("lm").alias("model"), F.col("model_a").alias("prompt_a"), F.col("model_b").alias("prompt_b"), r6("rho"))


def _prompt_images(spark, sf_dir) -> DataFrame:
    lm = _prompt_edges(spark, sf_dir)
    seen = models(spark, sf_dir).where("kind <> 'causal'").select("model")
    im = base_edges(spark, sf_dir).join(seen, "model", "left_semi").select(F.col("model").alias("image_model"), "i", "j", F.col("s").alias("s_i"))
    keys = ["model", "template", "image_model"]
    both = lm.join(im, ["i", "j"]).withColumn("r", average_rank("s", *keys)).withColumn("r_i", average_rank("s_i", *keys))
    return both.groupBy(*keys).agg(correlation("r", "r_i").alias("rho"))


def prompt_sensitivity(spark, sf_dir):
    """Per prompt: least, mean and greatest correlation with the image models, and the largest change from the first."""
    df = _prompt_images(spark, sf_dir)
    base = df.where("template = 't0'").select("model", "image_model", F.col("rho").alias("rho_0"))
    return df.join(base, ["model", "image_model"]).groupBy("model", "template").agg(r6(F.min("rho"), "min_rho"), r6(F.avg("rho"), "mean_rho"), r6(F.max("rho"), "max_rho"), r6(F.max(F.abs(F.col("rho") - F.col("rho_0"))), "max_change"))


def prompt_wins(spark, sf_dir):
    """How often each prompt is the best of a model for an image model (ties: first in order)."""
    best = _prompt_images(spark, sf_dir).withColumn("_rho", F.round("rho", 9)).groupBy("model", "image_model").agg(F.max_by("template", F.struct("_rho", F.struct(-F.ascii(F.substring("template", 1, 1)), -F.ascii(F.substring("template", 2, 1))))).alias("template"))
    return best.groupBy("template").agg(F.count("*").alias("wins"))


def compositionality(spark, sf_dir):
    """How evenly a compound lies between its parts, and how near their sum, by model and set, with v2 - v1.

    The roster's concepts in order make one compound of three: two parts and the whole; every second compound is of set v2.
    """
    at = places(spark, sf_dir).select("concept", F.floor(F.col("place") / 3).alias("compound"), F.pmod("place", F.lit(3)).alias("role"))
    x = base_centroids(spark, sf_dir).join(F.broadcast(at), "concept")
    part = lambda r: F.first(F.when(F.col("role") == r, F.col("x")), ignorenulls=True)
    df = x.groupBy("model", "compound").agg(part(0).alias("a"), part(1).alias("b"), part(2).alias("c")).where("a is not null and b is not null and c is not null")
    cos = lambda a, b: dot(a, b) / (norm(a) * norm(b))
    df = df.withColumn("s1", cos(F.col("c"), F.col("a"))).withColumn("s2", cos(F.col("c"), F.col("b"))).withColumn("additive", cos(F.col("c"), F.zip_with("a", "b", lambda a, b: a + b)))
    share = F.when(F.col("s1") + F.col("s2") > 0, F.col("s2") / (F.col("s1") + F.col("s2"))).otherwise(0.5)
    df = df.withColumn("balance", 1 - 2 * F.abs(0.5 - share))
    v = lambda col, s: F.avg(F.when(F.pmod("compound", F.lit(2)) == s, F.col(col)))
    return df.groupBy("model").agg(r6(F.avg("balance"), "balance"), r6(F.avg("additive"), "additive"), r6(v("balance", 0), "balance_v1"), r6(v("balance", 1), "balance_v2"), r6(v("balance", 1) - v("balance", 0), "balance_change"))


def _runs(spark, sf_dir) -> DataFrame:
    """Edges of the two runs."""
    return similarity_edges(centroids(images(spark, sf_dir), ["run", "model"]), ["run", "model"])


def run_continuity(spark, sf_dir):
    """Rank correlation of each model's own geometry between the two runs, on shared edges."""
    e = _runs(spark, sf_dir).withColumnsRenamed({"model": "lm", "run": "model"})
    return rsa_pairs(e, ["lm"]).select(F.col("lm").alias("model"), r6("rho"), "n_edges")


def _changes(spark, sf_dir) -> DataFrame:
    p = rsa_pairs(_runs(spark, sf_dir), ["run"])
    a, b = (p.where(F.col("run") == r).select("model_a", "model_b", F.col("rho").alias(f"rho_{r}")) for r in "ab")
    return kinds(a.join(b, ["model_a", "model_b"]), sf_dir).withColumn("change", F.col("rho_b") - F.col("rho_a"))


def run_changes(spark, sf_dir):
    """Changes between the runs overall and by type of pair."""
    df = _changes(spark, sf_dir).withColumn("types", F.array_join(F.array_sort(F.array("kind_a", "kind_b")), " x "))
    return df.rollup("types").agg(r6(F.avg("change"), "mean_change"), r6(F.median("change"), "median_change"), r6(F.avg(F.abs("change")), "mean_abs"), r6(F.min("change"), "least"), r6(F.max("change"), "most"), F.count("*").alias("n"))


def run_extremes(spark, sf_dir):
    """The eight pairs that rose and the eight that fell most."""
    df = _changes(spark, sf_dir).select("model_a", "model_b", r6("change"))
    up = df.orderBy(F.desc("change"), "model_a", "model_b").limit(8).withColumn("side", F.lit("up"))
    return up.unionByName(df.orderBy("change", "model_a", "model_b").limit(8).withColumn("side", F.lit("down")))


def run_pair_sets(spark, sf_dir):
    """Pairs that are positive in one run only, and in both: set operations on the pairs' keys."""
    p = rsa_pairs(_runs(spark, sf_dir), ["run"]).where("round(rho, 6) > 0")
    a, b = (p.where(F.col("run") == r).select("model_a", "model_b") for r in "ab")
    named = lambda df, s: df.withColumn("state", F.lit(s))
    return named(b.subtract(a), "new").unionByName(named(a.subtract(b), "lost")).unionByName(named(a.intersect(b), "kept"))


_EDGES = "WITH " + CTE + "," + edges_cte("e", "cen", "model") + "," + rho_cte("p", "e")
_KINDS = _EDGES + ", k AS (SELECT p.*, ma.kind AS kind_a, mb.kind AS kind_b, ma.size AS size_a FROM p JOIN md ma ON ma.model = model_a JOIN md mb ON mb.model = model_b)"
_TYPE = "CASE WHEN kind_a = 'causal' AND kind_b = 'causal' THEN 'language-language' WHEN kind_a <> 'causal' AND kind_b <> 'causal' THEN 'image-image' ELSE 'language-image' END"


def _ext(c: str) -> str:
    return f"CASE {c} WHEN 'causal' THEN 'language' WHEN 'vision_language' THEN 'contrastive_vlm' WHEN 'vision_language_autoregressive' THEN 'autoregressive_vlm' ELSE 'vision' END"


def _pilot(c: str) -> str:
    return f"CASE {c} WHEN 'causal' THEN 'language' WHEN 'vision' THEN 'vision' WHEN 'vision_language' THEN 'vlm' ELSE 'other' END"


_SYM = _KINDS + f", sym AS (SELECT model_a, model_b, kind_a, kind_b, rho FROM k UNION ALL SELECT model_b, model_a, kind_b, kind_a, rho FROM k), sf AS (SELECT model_a, {_ext('kind_a')} AS family_a, {_ext('kind_b')} AS family_b, rho FROM sym)"
_CKA = """, un AS (SELECT model, concept, d, v / n AS v FROM cen JOIN e_n USING (model, concept)),
 pp AS (SELECT a.model AS model_a, b.model AS model_b, a.concept FROM e_n a JOIN e_n b ON a.concept = b.concept AND a.model < b.model),
 xa AS (SELECT model_a, model_b, concept, list(v ORDER BY d) AS x FROM (SELECT model_a, model_b, pp.concept, d, v - avg(v) OVER (PARTITION BY model_a, model_b, d) AS v FROM pp JOIN un ON un.model = model_a AND un.concept = pp.concept) GROUP BY ALL),
 xb AS (SELECT model_a, model_b, concept, list(v ORDER BY d) AS x FROM (SELECT model_a, model_b, pp.concept, d, v - avg(v) OVER (PARTITION BY model_a, model_b, d) AS v FROM pp JOIN un ON un.model = model_b AND un.concept = pp.concept) GROUP BY ALL),
 ga AS (SELECT a.model_a, a.model_b, a.concept AS i, b.concept AS j, list_dot_product(a.x, b.x) AS g FROM xa a JOIN xa b USING (model_a, model_b)),
 gb AS (SELECT a.model_a, a.model_b, a.concept AS i, b.concept AS j, list_dot_product(a.x, b.x) AS g FROM xb a JOIN xb b USING (model_a, model_b)),
 cka AS (SELECT model_a, model_b, CASE WHEN round(sqrt(sum(a.g * a.g)) * sqrt(sum(b.g * b.g)), 12) = 0 THEN NULL ELSE sum(a.g * b.g) / (sqrt(sum(a.g * a.g)) * sqrt(sum(b.g * b.g))) END AS cka FROM ga a JOIN gb b USING (model_a, model_b, i, j) GROUP BY 1, 2)"""
_LAYERS = "WITH " + CTE + f""", lay AS (SELECT model, CASE WHEN layer = '-1' THEN 1 ELSE 0 END AS layer, concept, d, avg(v) AS v FROM ai GROUP BY ALL),
 lo AS (SELECT model, layer, row_number() OVER (PARTITION BY model ORDER BY layer) - 1 AS at_no, count(*) OVER (PARTITION BY model) AS n FROM (SELECT DISTINCT model, layer FROM lay)),
 fr AS (SELECT unnest({FRACTIONS})::DOUBLE AS fraction),
 pick AS (SELECT DISTINCT l.model, l.layer, fraction FROM lo l, fr WHERE l.at_no = round_even(fraction * (l.n - 1), 0)),
 dl AS (SELECT fraction, lay.model, concept, d, v FROM lay JOIN pick USING (model, layer))"""
_PROMPT = "WITH " + CTE + """, tp AS (SELECT cen.model, 't' || t AS template, cen.concept, d, v + t * 0.02::DOUBLE * ((place * 7 + d * 3) % 5 - 2) AS v FROM cen JOIN md USING (model) JOIN pl ON pl.concept = cen.concept, (SELECT unnest(range(3)) AS t) WHERE kind = 'causal'),
 tn AS (SELECT model, template, concept, CASE WHEN sum(v * v) = 0 THEN 1 ELSE sqrt(sum(v * v)) END AS n FROM tp GROUP BY ALL), ens AS (SELECT model, 'ensemble' AS template, concept, d, avg(v / n) AS v FROM tp JOIN tn USING (model, template, concept) GROUP BY ALL),
 ta AS (SELECT * FROM tp UNION ALL SELECT * FROM ens)""" + "," + edges_cte("te", "ta", "model, template") + "," + edges_cte("e", "cen", "model") + """,
 pq AS (SELECT t.model, t.template, e.model AS image_model, t.s AS sa, e.s AS sb FROM te t JOIN e ON e.i = t.i AND e.j = t.j JOIN md ON md.model = e.model AND kind <> 'causal'),
 pr AS (SELECT *, rank() OVER (PARTITION BY model, template, image_model ORDER BY sa) + (count(*) OVER (PARTITION BY model, template, image_model, sa) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY model, template, image_model ORDER BY sb) + (count(*) OVER (PARTITION BY model, template, image_model, sb) - 1) / 2.0 AS rb FROM pq),
 pi AS (SELECT model, template, image_model, CASE WHEN stddev_pop(ra) * stddev_pop(rb) = 0 THEN 0 ELSE covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS rho FROM pr GROUP BY ALL)"""
_RUNS = "WITH " + CTE + ", rc AS (SELECT run, model, concept, d, avg(v) AS v FROM img GROUP BY ALL)," + edges_cte("re", "rc", "run, model")
_RUNP = _RUNS + "," + rho_cte("rp", "re", "run") + """, ch AS (SELECT a.model_a, a.model_b, b.rho - a.rho AS change, ma.kind AS kind_a, mb.kind AS kind_b FROM rp a JOIN rp b ON a.run = 'a' AND b.run = 'b' AND a.model_a = b.model_a AND a.model_b = b.model_b JOIN md ma ON ma.model = a.model_a JOIN md mb ON mb.model = a.model_b)"""


def _cos(a: str, b: str) -> str:
    return f"sum({a} * {b}) / (sqrt(sum({a} * {a})) * sqrt(sum({b} * {b})))"


SQL = {
    "rsa_centroids": "WITH " + CTE + " SELECT model, concept, d, round(v, 6) + 0.0 AS v FROM cen",
    "rsa_similarity": _EDGES + " SELECT model, i, j, round(s, 6) + 0.0 AS s FROM e",
    "rsa_ranks": _EDGES + "," + ranks_cte("er", "e", "model") + " SELECT model, i, j, r::DOUBLE AS r FROM er",
    "rsa_model_pairs": _EDGES + " SELECT model_a, model_b, round(rho, 6) + 0.0 AS rho, n_edges FROM p",
    "rsa_type_summary": _KINDS + f" SELECT {_TYPE} AS pair_type, round(avg(rho), 6) + 0.0 AS mean_rho, round(median(rho), 6) + 0.0 AS median_rho, round(min(rho), 6) + 0.0 AS min_rho, round(max(rho), 6) + 0.0 AS max_rho, count(*) AS n_pairs FROM k GROUP BY 1",
    "rsa_pair_families": _KINDS + f", f AS (SELECT least({_pilot('kind_a')}, {_pilot('kind_b')}) || '-' || greatest({_pilot('kind_a')}, {_pilot('kind_b')}) AS family, rho FROM k) SELECT family, round(avg(rho), 6) + 0.0 AS mean_rho, count(*) AS n_pairs FROM f GROUP BY ROLLUP (family)",
    "rsa_family_block": _SYM + " SELECT family_a, family_b, round(avg(rho), 6) + 0.0 AS mean_rho, count(*) AS n FROM sf GROUP BY ALL",
    "rsa_bridge": _SYM + " SELECT model_a AS model, " + ", ".join(f"round(avg(rho) FILTER (WHERE family_b = '{f}'), 6) + 0.0 AS to_{f}" for f in FAMILIES) + ", round(avg(rho) FILTER (WHERE family_b = 'vision') - avg(rho) FILTER (WHERE family_b = 'language'), 6) + 0.0 AS vision_minus_language FROM sf GROUP BY 1",
    "rsa_model_order": "WITH " + CTE + f", f AS (SELECT model, kind, {_ext('kind')} AS family FROM md) SELECT model, family, CASE kind WHEN 'causal' THEN 'language' WHEN 'vision' THEN 'image' WHEN 'vision_language' THEN 'image' ELSE 'other' END AS broad, {_pilot('kind')} AS pilot, CASE WHEN kind IN ('causal', 'vision_language', 'vision_language_autoregressive') THEN kind ELSE 'vision' END AS plot, CAST(row_number() OVER (ORDER BY list_position(['language','vision','contrastive_vlm','autoregressive_vlm'], family), model) AS INTEGER) AS place FROM f",
    "rsa_scale_curve": _SYM + ", c AS (SELECT model_a AS model, md.size, avg(rho) AS mean_rho, count(*) AS n FROM sym JOIN md ON md.model = model_a WHERE kind_a = 'causal' AND kind_b = 'vision' GROUP BY ALL), cr AS (SELECT *, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0 AS x, rank() OVER (ORDER BY mean_rho) + (count(*) OVER (PARTITION BY mean_rho) - 1) / 2.0 AS y FROM c) SELECT model, size, round(mean_rho, 6) + 0.0 AS mean_rho, n, round((SELECT corr(x, y) FROM cr), 6) + 0.0 AS size_rho FROM cr",
    "rsa_cka": _EDGES + _CKA + " SELECT model_a, model_b, round(cka, 6) + 0.0 AS cka FROM cka",
    "rsa_cka_agreement": _EDGES + _CKA + ", t AS (SELECT round(rho, 9) AS rho, round(cka, 9) AS cka FROM p JOIN cka USING (model_a, model_b) WHERE cka IS NOT NULL), b AS (SELECT rho, cka, rank() OVER (ORDER BY rho) + (count(*) OVER (PARTITION BY rho) - 1) / 2.0 AS x, rank() OVER (ORDER BY cka) + (count(*) OVER (PARTITION BY cka) - 1) / 2.0 AS y FROM t) SELECT round(corr(rho, cka), 6) + 0.0 AS pearson, round(corr(x, y), 6) + 0.0 AS spearman, count(*) AS n_pairs FROM b",
    "rsa_depth": _LAYERS + "," + edges_cte("de", "dl", "fraction, model") + "," + rho_cte("dp", "de", "fraction") + f", dk AS (SELECT fraction, rho, ma.kind AS kind_a, mb.kind AS kind_b FROM dp JOIN md ma ON ma.model = model_a JOIN md mb ON mb.model = model_b), dt AS (SELECT fraction, rho, {_TYPE} AS pair_type FROM dk) SELECT fraction, coalesce(pair_type, 'all') AS pair_type, round(avg(rho), 6) + 0.0 AS mean_rho, count(*) AS n FROM dt GROUP BY GROUPING SETS ((fraction), (fraction, pair_type))",
    "rsa_depth_layers": _LAYERS + " SELECT model, fraction, CAST(layer AS INTEGER) AS layer, 'd' || CASE WHEN fraction < 0.1 THEN '0' ELSE '' END || CAST(CAST(fraction * 100 AS INTEGER) AS VARCHAR) AS label FROM pick",
    "prompt_agreement": _PROMPT + "," + rho_cte("tq", "te", "model", "template").replace("model_a", "prompt_a").replace("model_b", "prompt_b") + " SELECT model, prompt_a, prompt_b, round(rho, 6) + 0.0 AS rho FROM tq",
    "prompt_sensitivity": _PROMPT + " SELECT a.model, a.template, round(min(a.rho), 6) + 0.0 AS min_rho, round(avg(a.rho), 6) + 0.0 AS mean_rho, round(max(a.rho), 6) + 0.0 AS max_rho, round(max(abs(a.rho - b.rho)), 6) + 0.0 AS max_change FROM pi a JOIN pi b ON a.model = b.model AND a.image_model = b.image_model AND b.template = 't0' GROUP BY 1, 2",
    "prompt_wins": _PROMPT + ", w AS (SELECT model, image_model, template, row_number() OVER (PARTITION BY model, image_model ORDER BY round(rho, 9) DESC, template) AS rn FROM pi) SELECT template, count(*) AS wins FROM w WHERE rn = 1 GROUP BY 1",
    "compositionality": "WITH " + CTE + ", q AS (SELECT model, place // 3 AS compound, place % 3 AS role, d, v FROM cen JOIN pl USING (concept)), j AS (SELECT c.model, c.compound, c.v AS c, x.v AS a, y.v AS b FROM q c JOIN q x ON x.role = 0 AND x.model = c.model AND x.compound = c.compound AND x.d = c.d JOIN q y ON y.role = 1 AND y.model = c.model AND y.compound = c.compound AND y.d = c.d WHERE c.role = 2),"
    + f" s AS (SELECT model, compound, {_cos('c', 'a')} AS s1, {_cos('c', 'b')} AS s2, {_cos('c', '(a + b)')} AS additive FROM j GROUP BY ALL), t AS (SELECT *, 1 - 2 * abs(0.5 - CASE WHEN s1 + s2 > 0 THEN s2 / (s1 + s2) ELSE 0.5 END) AS balance FROM s)"
    + " SELECT model, round(avg(balance), 6) + 0.0 AS balance, round(avg(additive), 6) + 0.0 AS additive, round(avg(balance) FILTER (WHERE compound % 2 = 0), 6) + 0.0 AS balance_v1, round(avg(balance) FILTER (WHERE compound % 2 = 1), 6) + 0.0 AS balance_v2, round(avg(balance) FILTER (WHERE compound % 2 = 1) - avg(balance) FILTER (WHERE compound % 2 = 0), 6) + 0.0 AS balance_change FROM t GROUP BY 1",
    "run_continuity": _RUNS + "," + rho_cte("rq", "re", "model", "run") + " SELECT model, round(rho, 6) + 0.0 AS rho, n_edges FROM rq",
    "run_changes": _RUNP + ", t AS (SELECT least(kind_a, kind_b) || ' x ' || greatest(kind_a, kind_b) AS types, change FROM ch) SELECT types, round(avg(change), 6) + 0.0 AS mean_change, round(median(change), 6) + 0.0 AS median_change, round(avg(abs(change)), 6) + 0.0 AS mean_abs, round(min(change), 6) + 0.0 AS least, round(max(change), 6) + 0.0 AS most, count(*) AS n FROM t GROUP BY ROLLUP (types) HAVING count(*) > 0",
    "run_extremes": _RUNP + ", r AS (SELECT model_a, model_b, round(change, 6) + 0.0 AS change FROM ch), u AS (SELECT *, row_number() OVER (ORDER BY change DESC, model_a, model_b) AS up, row_number() OVER (ORDER BY change, model_a, model_b) AS down FROM r) SELECT model_a, model_b, change, 'up' AS side FROM u WHERE up <= 8 UNION ALL SELECT model_a, model_b, change, 'down' FROM u WHERE down <= 8",
    "run_pair_sets": _RUNP + ", a AS (SELECT model_a, model_b FROM rp WHERE run = 'a' AND round(rho, 6) > 0), b AS (SELECT model_a, model_b FROM rp WHERE run = 'b' AND round(rho, 6) > 0) SELECT *, 'new' AS state FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'lost' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'kept' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)",
}
QUERIES = {n: globals()[n] for n in SQL}
