"""Integrity queries over manifests, files, vectors and rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.functions.forms import label_form, path_form, usable_vector
from quillon.operators.constraints import all_of, at_least, first_of, missing, summary, uniform, unique, violations
from quillon.operators.ranking import last_wins
from quillon.plans.curation import _CUR, SOURCES, _label, _path, accepted, builds, candidates, counts, roster
from quillon.plans.tables import table

CAP, MIN_IMAGES = 700_000, 6


def _last_builds(spark, sf_dir) -> DataFrame:
    return last_wins(builds(spark, sf_dir), ["concept"], ["built_at", "build_row_id"])


def manifest_checks(spark, sf_dir):
    """Last builds with too few images, with counts that are off, or with a slug that is not the concept's."""
    b = _last_builds(spark, sf_dir).withColumn("n", F.coalesce(F.size("images"), F.lit(0)))
    b = b.withColumn("n", F.greatest("n", F.lit(0)))
    c = F.col("concept")
    return all_of(
        violations(b, "too_few_images", F.col("n") < MIN_IMAGES, c, F.col("n")),
        violations(b, "count_is_off", F.coalesce(F.col("num_images") != F.col("n"), F.lit(True)), c, F.concat_ws("/", F.col("num_images"), F.col("n"))),
        violations(b, "wrong_slug", F.coalesce(F.col("slug") != S.slug(c), F.lit(True)), c, F.coalesce("slug", F.lit(""))),
    )


def balance_checks(spark, sf_dir):
    """Source balance of accepted images: unknown before too few before off target; an item is reported once."""
    n = counts(spark, sf_dir).withColumn("item", F.concat_ws("/", "concept", "source"))
    total = n.groupBy("concept").agg(F.sum("n").alias("n"))
    none = violations(total, "no_images", F.col("n") == 0, F.col("concept"), F.col("n"))
    cells = n.join(total.where("n > 0").select("concept"), "concept", "left_semi")
    few = violations(cells, "under_minimum", F.col("n") < 2, F.col("item"), F.col("n"))
    off = violations(cells, "off_target", F.col("n") != 5, F.col("item"), F.col("n"))
    return first_of(none, few, off)


def score_coverage(spark, sf_dir):
    """Concepts of which no candidate, or only some, have a usable score."""
    c = candidates(spark, sf_dir, F.expr("concept is not null")).groupBy("concept").agg(F.count("*").alias("n"), F.count_if(F.expr("clip_score is not null and not isnan(clip_score) and clip_score between 0 and 1")).alias("k"))
    detail = F.concat_ws("/", "k", "n")
    return all_of(violations(c, "no_scores", F.col("k") == 0, F.col("concept"), detail), violations(c, "some_scores", (F.col("k") > 0) & (F.col("k") < F.col("n")), F.col("concept"), detail))


def vector_checks(spark, sf_dir):
    """Unusable vectors, lengths that differ within a model and layer, and missing metadata."""
    v = table(spark, sf_dir, "replication_results").select("vector_id", "model", "model_type", "layer", "embedding_dim", "embeddings")
    v = v.groupBy("vector_id").agg(F.max("model").alias("model"), F.max("model_type").alias("model_type"), F.max("layer").alias("layer"), F.max("embedding_dim").alias("dim"), F.bool_or(usable_vector("embeddings", "embedding_dim")).alias("ok"))
    i = F.col("vector_id")
    return all_of(violations(v, "unusable_vector", ~F.col("ok"), i, F.coalesce("dim", F.lit(0))), violations(v, "no_model_type", F.col("model_type").isNull(), i, F.lit("null")), uniform(v.where("model is not null and layer is not null"), ["model", "layer"], F.col("dim"), "mixed_lengths"))


def vector_completeness(spark, sf_dir):
    """Roster concepts that a model and layer has no vector of: expected less actual keys."""
    v = table(spark, sf_dir, "replication_results").select("model", "layer", label_form("concept").alias("concept")).where("model is not null and layer is not null and concept is not null").distinct()
    # Each concept names the models and layers it needs; their number is that of the models' table.
    needed = v.select("model", "layer").distinct().agg(F.collect_set(F.struct("model", "layer")).alias("keys"))
    expected = roster(spark, sf_dir).select("concept").join(F.broadcast(needed)).select("concept", F.inline("keys"))
    return missing(expected, v, ["model", "layer", "concept"], "no_vector").groupBy(F.split_part("item", F.lit("/"), F.lit(1)).alias("model"), F.split_part("item", F.lit("/"), F.lit(2)).alias("layer")).agg(F.count("*").alias("n_missing"))


def file_checks(spark, sf_dir):
    """Files over the size cap, of a forbidden kind, of a name that is not their path's, or of no source."""
    f = table(spark, sf_dir, "image_file").groupBy("file_id").agg(F.max(path_form("relpath")).alias("relpath"), F.max("filename").alias("filename"), F.max("size_bytes").alias("size"), F.max(label_form("source")).alias("source"))
    i = F.col("file_id")
    return summary(
        all_of(
            violations(f, "too_large", F.col("size") > CAP, i, F.col("size")),
            violations(f, "forbidden_kind", S.glob(F.col("relpath"), "*.png"), i, F.col("relpath")),
            violations(f, "name_is_not_the_path's", S.basename(F.col("relpath")) != path_form("filename"), i, F.col("filename")),
            violations(f, "no_source", F.col("source").isNull(), i, F.lit("null")),
        )
    )


def release_checks(spark, sf_dir):
    """Registered manifests no file comes from, unregistered ones files come from, and repeated registrations."""
    reg = table(spark, sf_dir, "manifest_registry").select(path_form("manifest_path").alias("manifest"), "registered_at").distinct()
    used = table(spark, sf_dir, "image_file").select(path_form("source_manifest").alias("manifest")).where("manifest is not null").distinct()
    return all_of(missing(reg, used, ["manifest"], "unused"), missing(used, reg, ["manifest"], "unregistered"), unique(reg, ["manifest"], "registered_again"))


def roster_slots(spark, sf_dir):
    """Concepts with fewer accepted images than their roster target."""
    a = accepted(spark, sf_dir)
    return at_least(a, ["concept", "source"], 5, "under_five").groupBy(F.split_part("item", F.lit("/"), F.lit(2)).alias("source")).agg(F.count("*").alias("n"))


_LB = ", lb AS (SELECT *, greatest(coalesce(len(images), 0), 0) AS n FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY built_at DESC, build_row_id DESC) AS k FROM bu) WHERE k = 1)"
_F = f"WITH f AS (SELECT file_id, max({_path('relpath')}) AS relpath, max(filename) AS filename, max(size_bytes) AS size, max({_label('source')}) AS source FROM image_file GROUP BY 1)"

SQL = {
    "manifest_checks": _CUR + _LB + f" SELECT 'too_few_images' AS check_name, concept AS item, CAST(n AS VARCHAR) AS detail FROM lb WHERE n < {MIN_IMAGES} UNION ALL SELECT 'count_is_off', concept, concat_ws('/', num_images, n) FROM lb WHERE coalesce(num_images <> n, TRUE) UNION ALL SELECT 'wrong_slug', concept, coalesce(slug, '') FROM lb WHERE coalesce(slug <> trim(regexp_replace(lower(trim(concept)), '[^a-z0-9]+', '_', 'g'), '_'), TRUE)",
    "balance_checks": _CUR + ", t AS (SELECT concept, sum(n) AS n FROM ct GROUP BY 1), c AS (SELECT ct.concept || '/' || source AS item, ct.n FROM ct JOIN t ON t.concept = ct.concept AND t.n > 0) SELECT 'no_images' AS check_name, concept AS item, '0' AS detail FROM t WHERE n = 0 UNION ALL SELECT 'under_minimum', item, CAST(n AS VARCHAR) FROM c WHERE n < 2 UNION ALL SELECT 'off_target', item, CAST(n AS VARCHAR) FROM c WHERE n <> 5 AND n >= 2",
    "score_coverage": _CUR + ", s AS (SELECT concept, count(*) AS n, sum(CASE WHEN clip_score IS NOT NULL AND NOT isnan(clip_score) AND clip_score BETWEEN 0 AND 1 THEN 1 ELSE 0 END) AS k FROM ca WHERE concept IS NOT NULL GROUP BY 1) SELECT CASE WHEN k = 0 THEN 'no_scores' ELSE 'some_scores' END AS check_name, concept AS item, k || '/' || n AS detail FROM s WHERE k < n",
    "vector_checks": "WITH v AS (SELECT vector_id, max(model) AS model, max(model_type) AS model_type, max(layer) AS layer, max(embedding_dim) AS dim, coalesce(bool_or(embeddings IS NOT NULL AND len(embeddings) = embedding_dim AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0), FALSE) AS ok FROM replication_results GROUP BY 1) SELECT 'unusable_vector' AS check_name, CAST(vector_id AS VARCHAR) AS item, CAST(coalesce(dim, 0) AS VARCHAR) AS detail FROM v WHERE NOT ok UNION ALL SELECT 'no_model_type', CAST(vector_id AS VARCHAR), 'null' FROM v WHERE model_type IS NULL UNION ALL SELECT 'mixed_lengths', model || '/' || layer, min(dim) || '..' || max(dim) FROM v WHERE model IS NOT NULL AND layer IS NOT NULL GROUP BY model, layer HAVING min(dim) <> max(dim)",
    "vector_completeness": _CUR + f", v AS (SELECT DISTINCT model, layer, {_label('concept')} AS concept FROM replication_results WHERE model IS NOT NULL AND layer IS NOT NULL AND {_label('concept')} IS NOT NULL) SELECT k.model, k.layer, count(*) AS n_missing FROM (SELECT DISTINCT model, layer FROM v) k CROSS JOIN ro LEFT JOIN v ON v.model = k.model AND v.layer = k.layer AND v.concept = ro.concept WHERE v.concept IS NULL GROUP BY 1, 2",
    "file_checks": _F + f", x AS (SELECT 'too_large' AS check_name, CAST(file_id AS VARCHAR) AS item, CAST(size AS VARCHAR) AS detail FROM f WHERE size > {CAP} UNION ALL SELECT 'forbidden_kind', CAST(file_id AS VARCHAR), relpath FROM f WHERE relpath LIKE '%.png' UNION ALL SELECT 'name_is_not_the_path''s', CAST(file_id AS VARCHAR), filename FROM f WHERE split_part(relpath, '/', -1) <> {_path('filename')} UNION ALL SELECT 'no_source', CAST(file_id AS VARCHAR), 'null' FROM f WHERE source IS NULL), y AS (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY item, detail) AS k FROM x) SELECT check_name, count(*) AS n, string_agg(item, ', ' ORDER BY k) FILTER (WHERE k <= 3) AS examples FROM y GROUP BY 1",
    "release_checks": f"WITH r AS (SELECT DISTINCT {_path('manifest_path')} AS m, registered_at FROM manifest_registry), u AS (SELECT DISTINCT {_path('source_manifest')} AS m FROM image_file WHERE {_path('source_manifest')} IS NOT NULL) SELECT 'unused' AS check_name, m AS item, 'missing' AS detail FROM (SELECT DISTINCT m FROM r) WHERE m NOT IN (SELECT m FROM u) UNION ALL SELECT 'unregistered', m, 'missing' FROM u WHERE m NOT IN (SELECT m FROM r) UNION ALL SELECT 'registered_again', m, CAST(count(*) AS VARCHAR) FROM r GROUP BY m HAVING count(*) > 1",
    "roster_slots": _CUR + " SELECT source, count(*) AS n FROM (SELECT concept, source FROM ac GROUP BY ALL HAVING count(*) < 5) GROUP BY 1",
}
QUERIES = {n: globals()[n] for n in SQL}
