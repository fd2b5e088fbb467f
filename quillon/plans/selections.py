"""Queries of selectors, fallbacks, presence and summary statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.functions.forms import label_form
from quillon.operators import families
from quillon.operators.geometry import centroids, layer_at, rsa_pairs, similarity_edges, symmetrised
from quillon.operators.selectors import backfill, fallback, in_order, resolve_layer, stat
from quillon.plans.curation import _CUR, _label, _norm, accepted, candidates, reserve, roster
from quillon.plans.rsa import _KINDS, _LAYERS, _RUNP, _changes, _pilot, kinds, pairs, r6
from quillon.plans.tables import table
from quillon.plans.views import CTE, FRACTIONS, edges_cte, layers, rho_cte


def rsa_matrix(spark, sf_dir):
    """The whole correlation matrix, with ones on its diagonal."""
    p = symmetrised(pairs(spark, sf_dir)).select("model_a", "model_b", r6("rho"))
    diagonal = p.select("model_a").distinct().select("model_a", F.col("model_a").alias("model_b"), F.lit(1.0).alias("rho"))
    return p.unionByName(diagonal)


def rsa_family_medians(spark, sf_dir):
    """Median correlation of each model's pairs by the other's family; 0 where there is none."""
    both = kinds(symmetrised(pairs(spark, sf_dir)), sf_dir)
    wide = both.groupBy("model_a").agg(*[r6(stat(F.median(F.when(families.pilot("kind_b") == f, F.col("rho"))), 0.0), f) for f in ("language", "vision", "vlm", "other")])
    return wide.withColumnRenamed("model_a", "model")


def run_movers(spark, sf_dir):
    """The twenty pairs that changed most, counted by their families."""
    top = _changes(spark, sf_dir).withColumn("size", F.round(F.abs("change"), 9)).orderBy(F.desc("size"), "model_a", "model_b").limit(20)
    return top.groupBy(families.pair_family_of("kind_a", "kind_b").alias("families")).agg(F.count("*").alias("n"), r6(F.max("size"), "most"))


def base_concepts(spark, sf_dir):
    """Concepts with vectors that are in the roster and not in the reserve."""
    v = table(spark, sf_dir, "replication_results").select(label_form("concept").alias("concept")).where("concept is not null").distinct()
    return v.join(roster(spark, sf_dir), "concept", "left_semi").join(reserve(spark, sf_dir), "concept", "left_anti")


def resolved_layers(spark, sf_dir):
    """What a request for ``mid``, for the last and for an unknown layer means, per model."""
    v = table(spark, sf_dir, "replication_results").where("model is not null and layer is not null").select("model", "layer", F.when(F.col("model") < "M", F.col("layer")).alias("d"))
    v = v.groupBy("model", "layer").agg(F.max("d").alias("d"))
    out = None
    for request in ("mid", "last", "layer_7"):
        one = resolve_layer(v, "model", "layer", "d", request).withColumn("request", F.lit(request))
        out = one if out is None else out.unionByName(one)
    return out


def chosen_concepts(spark, sf_dir):
    """Three named models' rows in the order of the table, unknown names ignored."""
    m = table(spark, sf_dir, "replication_results").where("model is not null").groupBy("model").agg(F.min("vector_id").alias("first_id"))
    return in_order(m, "model", "first_id", ["Tessaly-0.8B", "no such", "Brenta-4B", "MaskField-B"]).select("model", "place")


def fallback_candidates(spark, sf_dir):
    """Up to three candidates a concept: detections first, then label matches."""
    c = candidates(spark, sf_dir, F.expr("concept is not null and acquisition_method is not null"))
    first, second = (c.where(F.col("acquisition_method").contains(w)) for w in ("detection", "label"))
    return fallback([first, second], "concept", "candidate_id", ["fetched_at"], 3)


def backfilled_scores(spark, sf_dir):
    """Missing scores filled with the run's mean, scores that are there kept."""
    c = candidates(spark, sf_dir, F.expr("run_id is not null")).select("candidate_id", "run_id", F.when(~F.isnan("clip_score") & F.col("clip_score").between(0, 1), F.col("clip_score")).alias("score"))
    mean = c.groupBy("run_id").agg(F.avg("score").alias("new"))
    return backfill(c, mean, "run_id", "score").groupBy("run_id").agg(F.count("score").alias("n"), F.round(F.sum("score"), 4).alias("total"))


def source_presence(spark, sf_dir):
    """Sources of candidates against those of files, present in one only marked as skipped."""
    c = candidates(spark, sf_dir, F.expr("source is not null")).groupBy("source").agg(F.count("*").alias("n_candidates"))
    f = table(spark, sf_dir, "image_file").groupBy("file_id").agg(F.max(label_form("source")).alias("source")).where("source is not null").groupBy("source").agg(F.count("*").alias("n_files"))
    both = c.join(f, "source", "full_outer")
    state = F.when(F.col("n_files").isNull(), "no_files").when(F.col("n_candidates").isNull(), "no_candidates").otherwise("both")
    return both.select("source", stat(F.col("n_candidates"), 0).cast("long").alias("n_candidates"), stat(F.col("n_files"), 0).cast("long").alias("n_files"), state.alias("state"))


def score_stats(spark, sf_dir):
    """Mean, median and outer quantiles of the scores per source, without NaN; 0 where there are none."""
    x = F.nullif(F.col("clip_score"), F.lit(float("nan")))
    good = F.when(x.between(0, 1), x)
    g = candidates(spark, sf_dir).groupBy("source")
    return g.agg(F.round(stat(F.avg(good), 0.0), 6).alias("mean"), F.round(stat(F.median(good), 0.0), 6).alias("median"), F.round(stat(F.percentile(good, 0.025), 0.0), 6).alias("low"), F.round(stat(F.percentile(good, 0.975), 0.0), 6).alias("high"), F.count(good).alias("n"))


def image_scores(spark, sf_dir):
    """Every accepted image with its score; one without a score is an error, not a null."""
    a = accepted(spark, sf_dir).select("concept", "candidate_id")
    s = candidates(spark, sf_dir).select("candidate_id", "clip_score")
    j = a.join(s, "candidate_id", "left")
    checked = F.when(F.col("clip_score").isNotNull(), F.col("clip_score")).otherwise(F.raise_error(F.lit("an image has no score")).cast("double"))
    return j.select("concept", "candidate_id", checked.alias("clip_score"))


def distinct_sets(spark, sf_dir):
    """Sources and classes of each run as sorted lists, and whether all of its candidates have a source."""
    c = candidates(spark, sf_dir)
    return c.groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.countDistinct("source_class_id").alias("n_classes"), F.bool_and(F.col("source").isNotNull()).alias("all_have"), F.bool_or(F.col("proxy_used") == "true").alias("any_proxy"))


def largest_boxes(spark, sf_dir):
    """The largest box of each picture and label, small ones left out; boxes come from line items."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("picture"), F.col("l_returnflag").alias("label"), (F.col("l_discount") * 10).alias("w"), (F.col("l_tax") * 10).alias("h"))
    return b.groupBy("picture", "label").agg(F.round(F.max(F.col("w") * F.col("h")), 6).alias("area")).where("area >= 0.06")


def class_hits(spark, sf_dir):
    """Hits of each class: in all, the most in one run, and their first ids in order."""
    c = candidates(spark, sf_dir, F.expr("source_class_id is not null and run_id is not null"))
    per = c.groupBy("source_class_id", "run_id").agg(F.count("*").alias("n"))
    first = c.withColumn("k", F.row_number().over(Window.partitionBy("source_class_id").orderBy("candidate_id"))).where("k <= 4").groupBy("source_class_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("candidate_id")), lambda i: i.cast("string")), ",").alias("first_ids"))
    return per.groupBy("source_class_id").agg(F.sum("n").alias("n_hits"), F.max("n").alias("most")).join(first, "source_class_id")


def wanted_classes(spark, sf_dir):
    """The classes that unfilled roster concepts need, each once."""
    need = candidates(spark, sf_dir).join(roster(spark, sf_dir).select("concept"), "concept", "left_semi").where("proxy_used = 'true' and source_class_id is not null")
    return need.select("source_class_id").distinct()


def overlapping_names(spark, sf_dir):
    """Roster concepts that share a word with a class label, and how many labels do."""
    r = roster(spark, sf_dir).select("concept", F.split(S.normalise(F.col("concept")), " ").alias("words"))
    labels = table(spark, sf_dir, "candidate").select(S.normalise(F.col("source_class_label")).alias("label")).where("label <> ''").distinct()
    # By word, so that no concept is held against every label.
    a = r.select("concept", F.explode("words").alias("word"))
    b = labels.select("label", F.explode(F.split("label", " ")).alias("word"))
    return a.join(b, "word").groupBy("concept").agg(F.countDistinct("label").alias("n_labels"))


def fn_queries(spark, sf_dir):
    """Search texts of each roster concept: an override or the photo prompt, then variations, in order."""
    r = roster(spark, sf_dir).select("concept")
    name = S.normalise(F.col("concept"))
    override = F.create_map(F.lit("drokasto drum"), F.lit("a drum on a stage"))
    texts = F.array(F.coalesce(F.try_element_at(override, name), F.concat(F.lit("a photo of "), name)), name, F.concat(name, F.lit(" close up")), F.concat(F.lit("wild "), name))
    return r.select("concept", F.posexplode(texts).alias("place", "text"))


def fn_layer_text(spark, sf_dir):
    """Layer requests in their stored form, file suffixes from them, and formatted figures."""
    texts = ["-1", " ALL ", "aligned5", "0, 3,-1", "layer 7/x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    spec = F.regexp_replace(F.lower(F.trim("text")), r"\s*,\s*", ",")
    profile = F.when(spec == "-1", "last").when(spec.isin("all", "aligned5"), spec).otherwise(F.concat(F.lit("custom_"), F.regexp_replace(spec, ",", "_")))
    suffix = F.regexp_replace(spec, "[^a-z0-9._-]+", "_")
    return df.select("i", spec.alias("spec"), profile.alias("profile"), suffix.alias("suffix"), F.format_string("%.3f", F.col("i") / 7).alias("figure"), F.array_join(F.transform(F.split("text", ","), lambda x: F.replace(F.trim(x), F.lit("_"), F.lit(" "))), ", ").alias("joined"))


def label_rules(spark, sf_dir):
    """Whether a class may stand for a roster concept: allowed by list, denied by list, exact, below it, else not."""
    allowed, denied = ["kiosk"], ["hare", "heron"]
    r = roster(spark, sf_dir).select("concept", S.normalise(F.col("concept")).alias("name"), F.element_at(F.split(S.normalise(F.col("concept")), " "), -1).alias("word"))
    labels = table(spark, sf_dir, "candidate").select(S.normalise(F.col("source_class_label")).alias("label")).where("label <> ''").distinct()
    # A label is tried for the concepts that share its last word; others can't be below one another.
    j = r.join(labels.withColumn("word", F.element_at(F.split("label", " "), -1)), "word")
    rule = F.when(F.col("label").isin(allowed), "allowed").when(F.col("label").isin(denied), "denied").when(F.col("label") == F.col("name"), "exact").when(F.col("word") == F.col("label"), "above").otherwise("no")
    return j.groupBy(rule.alias("rule")).agg(F.count("*").alias("n"), F.countDistinct("concept").alias("n_concepts"))


def rsa_depth_runs(spark, sf_dir):
    """Mean correlation at each depth in two runs, side by side."""
    rows = centroids(layers(spark, sf_dir), ["run", "model", "layer"])
    p = rsa_pairs(similarity_edges(layer_at(rows, FRACTIONS).drop("layer"), ["run", "fraction", "model"]), ["run", "fraction"])
    wide = p.groupBy("fraction").pivot("run", ["a", "b"]).agg(F.avg("rho"))
    return wide.select("fraction", r6("a", "run_a"), r6("b", "run_b"), r6(F.col("b") - F.col("a"), "change"))


def concept_lists(spark, sf_dir):
    """Whether a model's layers list the same concepts, as sets and in the order of delivery."""
    v = table(spark, sf_dir, "replication_results").select("model", "layer", label_form("concept").alias("concept"), "vector_id").where("model is not null and layer is not null and concept is not null")
    once = v.groupBy("model", "layer", "concept").agg(F.min("vector_id").alias("at"))
    named = once.groupBy("model", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "concept"))), lambda x: x["concept"]).alias("l"))
    a, b = (named.where(F.col("layer") == x).select("model", F.col("l").alias(n)) for x, n in (("-1", "a"), ("mid", "b")))
    j = a.join(b, "model")
    return j.select("model", (F.sort_array("a") == F.sort_array("b")).alias("same_set"), (F.col("a") == F.col("b")).alias("same_list"), F.size(F.array_except("a", "b")).alias("n_only_last"), F.size(F.array_except("b", "a")).alias("n_only_mid"))


def result_payload(spark, sf_dir):
    """The sections of a result document with their number of rows, and the keys that are missing."""
    wanted = ["pairs", "summary", "holdout"]
    p = pairs(spark, sf_dir)
    doc = p.agg(F.to_json(F.struct(F.count("*").alias("pairs"), F.struct(F.countDistinct("model_a").alias("models")).alias("summary"))).alias("doc"))
    keys = F.json_object_keys("doc")
    return doc.select(F.get_json_object("doc", "$.pairs").cast("long").alias("n_pairs"), F.get_json_object("doc", "$.summary.models").cast("long").alias("n_models"), F.array_join(F.array_except(F.array(*[F.lit(w) for w in wanted]), keys), ",").alias("missing"))


def review_pick(spark, sf_dir):
    """One unreviewed document per source, picked by hash: the same one on every run."""
    done = table(spark, sf_dir, "doc_review").select("doc_id").where("doc_id is not null").distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", label_form("source").alias("source")).join(done, "doc_id", "left_anti")
    return d.groupBy("source").agg(F.min_by("doc_id", F.struct(F.md5(F.concat_ws("|", F.lit(42), "doc_id")), "doc_id")).alias("doc_id"))


SQL = {
    "fn_layer_text": "WITH t AS (SELECT unnest(range(5))::INTEGER AS i, unnest(['-1', ' ALL ', 'aligned5', '0, 3,-1', 'layer 7/x']) AS text), s AS (SELECT *, regexp_replace(lower(trim(text)), '\\s*,\\s*', ',', 'g') AS spec FROM t) SELECT i, spec, CASE WHEN spec = '-1' THEN 'last' WHEN spec IN ('all', 'aligned5') THEN spec ELSE 'custom_' || replace(spec, ',', '_') END AS profile, regexp_replace(spec, '[^a-z0-9._-]+', '_', 'g') AS suffix, printf('%.3f', i / 7) AS figure, list_aggregate(list_transform(string_split(text, ','), lambda x: replace(trim(x), '_', ' ')), 'string_agg', ', ') AS joined FROM s",
    "label_rules": _CUR + f", l AS (SELECT DISTINCT {_norm('source_class_label')} AS label FROM candidate WHERE {_norm('source_class_label')} <> ''), j AS (SELECT concept, {_norm('concept')} AS name, label, split_part(label, ' ', -1) AS word FROM ro JOIN l ON split_part({_norm('concept')}, ' ', -1) = split_part(label, ' ', -1)) SELECT CASE WHEN label = 'kiosk' THEN 'allowed' WHEN label IN ('hare', 'heron') THEN 'denied' WHEN label = name THEN 'exact' WHEN label = word THEN 'above' ELSE 'no' END AS rule, count(*) AS n, count(DISTINCT concept) AS n_concepts FROM j GROUP BY 1",
    "rsa_depth_runs": _LAYERS.replace("SELECT model, CASE WHEN layer", "SELECT run, model, CASE WHEN layer").replace("SELECT fraction, lay.model", "SELECT run, fraction, lay.model") + "," + edges_cte("de", "dl", "run, fraction, model") + "," + rho_cte("dp", "de", "run, fraction") + " SELECT fraction, round(avg(rho) FILTER (WHERE run = 'a'), 6) + 0.0 AS run_a, round(avg(rho) FILTER (WHERE run = 'b'), 6) + 0.0 AS run_b, round(avg(rho) FILTER (WHERE run = 'b') - avg(rho) FILTER (WHERE run = 'a'), 6) + 0.0 AS change FROM dp GROUP BY 1",
    "concept_lists": f"WITH v AS (SELECT model, layer, {_label('concept')} AS concept, min(vector_id) AS at_id FROM replication_results WHERE model IS NOT NULL AND layer IS NOT NULL AND {_label('concept')} IS NOT NULL GROUP BY ALL), g AS (SELECT model, layer, list(concept ORDER BY at_id, concept) AS l FROM v GROUP BY ALL) SELECT a.model, list_sort(a.l) = list_sort(b.l) AS same_set, a.l = b.l AS same_list, CAST(len(list_filter(a.l, lambda x: NOT list_contains(b.l, x))) AS INTEGER) AS n_only_last, CAST(len(list_filter(b.l, lambda x: NOT list_contains(a.l, x))) AS INTEGER) AS n_only_mid FROM g a JOIN g b ON a.model = b.model AND a.layer = '-1' AND b.layer = 'mid'",
    "result_payload": _KINDS + " SELECT count(*) AS n_pairs, count(DISTINCT model_a) AS n_models, 'holdout' AS missing FROM p",
    "review_pick": f"WITH d AS (SELECT doc_id, {_label('source')} AS source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_review WHERE doc_id IS NOT NULL)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS k FROM d) SELECT source, doc_id FROM r WHERE k = 1",
    "rsa_matrix": _KINDS + " SELECT model_a, model_b, round(rho, 6) + 0.0 AS rho FROM p UNION ALL SELECT model_b, model_a, round(rho, 6) + 0.0 FROM p UNION ALL SELECT model, model, 1.0 FROM (SELECT model_a AS model FROM p UNION SELECT model_b FROM p)",
    "rsa_family_medians": _KINDS + ", s AS (SELECT model_a AS model, kind_b, rho FROM k UNION ALL SELECT model_b, kind_a, rho FROM k) SELECT model, " + ", ".join(f"round(coalesce(median(rho) FILTER (WHERE {_pilot('kind_b')} = '{f}'), 0), 6) + 0.0 AS {f}" for f in ("language", "vision", "vlm", "other")) + " FROM s GROUP BY 1",
    "run_movers": _RUNP + f", t AS (SELECT *, round(abs(change), 9) AS size FROM ch ORDER BY round(abs(change), 9) DESC, model_a, model_b LIMIT 20) SELECT least({_pilot('kind_a')}, {_pilot('kind_b')}) || '-' || greatest({_pilot('kind_a')}, {_pilot('kind_b')}) AS families, count(*) AS n, round(max(size), 6) + 0.0 AS most FROM t GROUP BY 1",
    "base_concepts": _CUR + f" SELECT DISTINCT {_label('concept')} AS concept FROM replication_results WHERE {_label('concept')} IN (SELECT concept FROM ro) AND {_label('concept')} NOT IN (SELECT concept FROM re)",
    "resolved_layers": "WITH v AS (SELECT model, layer, CASE WHEN model < 'M' THEN layer END AS d FROM replication_results WHERE model IS NOT NULL AND layer IS NOT NULL), g AS (SELECT model, max(d) AS d, max(layer) AS l, bool_or(layer = 'mid') AS m FROM v GROUP BY 1) SELECT model, CASE WHEN m THEN 'mid' ELSE coalesce(d, l) END AS resolved, 'mid' AS request FROM g UNION ALL SELECT model, coalesce(d, l), 'last' FROM g UNION ALL SELECT model, coalesce(d, l), 'layer_7' FROM g",
    "chosen_concepts": "WITH m AS (SELECT model, min(vector_id) AS f FROM replication_results WHERE model IN ('Tessaly-0.8B', 'Brenta-4B', 'MaskField-B') GROUP BY 1) SELECT model, CAST(row_number() OVER (ORDER BY f, model) AS INTEGER) AS place FROM m",
    "fallback_candidates": _CUR + ", t AS (SELECT concept, candidate_id, min((CASE WHEN contains(acquisition_method, 'detection') THEN 0 ELSE 1 END)) AS part, min(fetched_at) AS f FROM ca WHERE concept IS NOT NULL AND (contains(acquisition_method, 'detection') OR contains(acquisition_method, 'label')) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY part, f NULLS FIRST, candidate_id) AS place FROM t) SELECT concept, candidate_id, CAST(part AS INTEGER) AS part, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3",
    "backfilled_scores": _CUR + ", s AS (SELECT run_id, CASE WHEN NOT isnan(clip_score) AND clip_score BETWEEN 0 AND 1 THEN clip_score END AS score FROM ca WHERE run_id IS NOT NULL), m AS (SELECT run_id, avg(score) AS new FROM s GROUP BY 1) SELECT run_id, count(coalesce(score, new)) AS n, round(sum(coalesce(score, new)), 4) AS total FROM s JOIN m USING (run_id) GROUP BY 1",
    "source_presence": _CUR + f", c AS (SELECT source, count(*) AS n FROM ca WHERE source IS NOT NULL GROUP BY 1), f AS (SELECT source, count(*) AS n FROM (SELECT file_id, max({_label('source')}) AS source FROM image_file GROUP BY 1) WHERE source IS NOT NULL GROUP BY 1) SELECT coalesce(c.source, f.source) AS source, coalesce(c.n, 0) AS n_candidates, coalesce(f.n, 0) AS n_files, CASE WHEN f.n IS NULL THEN 'no_files' WHEN c.n IS NULL THEN 'no_candidates' ELSE 'both' END AS state FROM c FULL JOIN f ON f.source = c.source",
    "score_stats": _CUR + ", s AS (SELECT source, CASE WHEN NOT isnan(clip_score) AND clip_score BETWEEN 0 AND 1 THEN clip_score END AS x FROM ca) SELECT source, round(coalesce(avg(x), 0), 6) AS mean, round(coalesce(median(x), 0), 6) AS median, round(coalesce(quantile_cont(x, 0.025), 0), 6) AS low, round(coalesce(quantile_cont(x, 0.975), 0), 6) AS high, count(x) AS n FROM s GROUP BY 1",
    "image_scores": _CUR + " SELECT concept, candidate_id, clip_score FROM ac",
    "distinct_sets": _CUR + " SELECT run_id, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources, count(DISTINCT source_class_id) AS n_classes, bool_and(source IS NOT NULL) AS all_have, bool_or(proxy_used = 'true') AS any_proxy FROM ca GROUP BY 1",
    "largest_boxes": "SELECT l_orderkey AS picture, l_returnflag AS label, round(max((l_discount * 10) * (l_tax * 10)), 6) AS area FROM lineitem GROUP BY 1, 2 HAVING round(max((l_discount * 10) * (l_tax * 10)), 6) >= 0.06",
    "class_hits": _CUR + ", h AS (SELECT source_class_id, run_id, candidate_id, row_number() OVER (PARTITION BY source_class_id ORDER BY candidate_id) AS k FROM ca WHERE source_class_id IS NOT NULL AND run_id IS NOT NULL), p AS (SELECT source_class_id, run_id, count(*) AS n FROM h GROUP BY 1, 2), f AS (SELECT source_class_id, string_agg(CAST(candidate_id AS VARCHAR), ',' ORDER BY candidate_id) AS first_ids FROM h WHERE k <= 4 GROUP BY 1) SELECT source_class_id, CAST(sum(n) AS BIGINT) AS n_hits, max(n) AS most, any_value(first_ids) AS first_ids FROM p JOIN f USING (source_class_id) GROUP BY 1",
    "wanted_classes": _CUR + " SELECT DISTINCT source_class_id FROM ca WHERE concept IN (SELECT concept FROM ro) AND proxy_used = 'true' AND source_class_id IS NOT NULL",
    "overlapping_names": _CUR + f", w AS (SELECT concept, unnest(string_split({_norm('concept')}, ' ')) AS word FROM ro), l AS (SELECT DISTINCT {_norm('source_class_label')} AS label FROM candidate WHERE {_norm('source_class_label')} <> ''), x AS (SELECT label, unnest(string_split(label, ' ')) AS word FROM l) SELECT concept, count(DISTINCT label) AS n_labels FROM w JOIN x USING (word) GROUP BY 1",
    "fn_queries": _CUR + f", n AS (SELECT concept, {_norm('concept')} AS n FROM ro), t AS (SELECT concept, [CASE WHEN n = 'drokasto drum' THEN 'a drum on a stage' ELSE 'a photo of ' || n END, n, n || ' close up', 'wild ' || n] AS a FROM n) SELECT concept, CAST(unnest(range(4)) AS INTEGER) AS place, unnest(a) AS text FROM t",
}
QUERIES = {n: globals()[n] for n in SQL}
