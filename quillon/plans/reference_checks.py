"""Problem 5: the references of the image manifests and the seed provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.forms import path_form
from quillon.operators.orphans import orphan_report, orphans
from quillon.plans.tables import table

#: Joins the two parts of a compound key; it can't be in a path.
SEP = "\u0001"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_table, ref_field, row_id, ref_key, key, at: every reference once per row, also in repeated rows."""
    builds = table(spark, sf_dir, "data_manifest_250").select(F.col("build_row_id").alias("row_id"), F.col("built_at").alias("at"), F.explode("concept_to_images").alias("path"))
    images = builds.select(F.lit("data_manifest_250").alias("ref_table"), F.lit("concept_to_images").alias("ref_field"), "row_id", path_form("path").alias("ref_key"), "at")
    seeds = table(spark, sf_dir, "scale250_seed_provenance").select(F.col("seed_id").alias("row_id"), F.col("selected_at").alias("at"), path_form("source_manifest").alias("manifest"), path_form("source_filename").alias("file"))
    fields = F.array(
        F.struct(F.lit("source_manifest").alias("ref_field"), F.col("manifest").alias("ref_key"), F.concat(F.lit("m"), "manifest").alias("key")),
        F.struct(F.lit("source_filename").alias("ref_field"), F.col("file").alias("ref_key"), F.concat(F.lit("f"), "manifest", F.lit(SEP), "file").alias("key")),
    )
    seeds = seeds.select("row_id", "at", F.explode(fields).alias("x")).select(F.lit("scale250_seed_provenance").alias("ref_table"), "x.ref_field", "row_id", "x.ref_key", "at", "x.key")
    both = images.withColumn("key", F.concat(F.lit("i"), "ref_key")).unionByName(seeds)
    return both.where("key is not null and row_id is not null").dropDuplicates(["ref_table", "ref_field", "row_id", "ref_key"])


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, valid_from, valid_to of images by relpath, of files by manifest and name, and of manifests."""
    files = table(spark, sf_dir, "image_file").select(
        F.explode(F.array(F.concat(F.lit("i"), path_form("relpath")), F.concat(F.lit("f"), path_form("source_manifest"), F.lit(SEP), path_form("filename")))).alias("key"), F.col("created_at").alias("valid_from"), F.col("deleted_at").alias("valid_to")
    )
    manifests = table(spark, sf_dir, "manifest_registry").select(F.concat(F.lit("m"), path_form("manifest_path")).alias("key"), F.col("registered_at").alias("valid_from"), F.col("retired_at").alias("valid_to"))
    return files.unionByName(manifests)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(references(spark, sf_dir), parents(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("ref_table", "ref_field", "row_id", "ref_key")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(found(spark, sf_dir))


_PATH = "nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '\\\\', '/', 'g'), '/+', '/', 'g'), '^(\\./)+', ''), '')"


def _path(c: str) -> str:
    return _PATH.format(c)


_FOUND_SQL = f"""
WITH refs AS (
  SELECT DISTINCT 'data_manifest_250' AS ref_table, 'concept_to_images' AS ref_field, build_row_id AS row_id, {_path('p')} AS ref_key, NULL AS manifest, built_at AS seen_at
  FROM (SELECT build_row_id, built_at, unnest(concept_to_images) AS p FROM data_manifest_250)
  UNION ALL SELECT DISTINCT 'scale250_seed_provenance', 'source_manifest', seed_id, {_path('source_manifest')}, NULL, selected_at FROM scale250_seed_provenance
  UNION ALL SELECT DISTINCT 'scale250_seed_provenance', 'source_filename', seed_id, {_path('source_filename')}, {_path('source_manifest')}, selected_at FROM scale250_seed_provenance),
 r AS (SELECT * FROM refs WHERE ref_key IS NOT NULL AND row_id IS NOT NULL AND seen_at IS NOT NULL AND (ref_field <> 'source_filename' OR manifest IS NOT NULL)),
 img AS (SELECT DISTINCT {_path('relpath')} AS rel, {_path('source_manifest')} AS man, {_path('filename')} AS fn, created_at, deleted_at FROM image_file),
 reg AS (SELECT DISTINCT {_path('manifest_path')} AS man, registered_at, retired_at FROM manifest_registry),
 spans AS (
  SELECT 'concept_to_images' AS f, rel AS k, NULL AS m, created_at AS s, deleted_at AS e FROM img
  UNION ALL SELECT 'source_filename', fn, man, created_at, deleted_at FROM img
  UNION ALL SELECT 'source_manifest', man, NULL, registered_at, retired_at FROM reg),
 o AS (SELECT r.*, max(CASE WHEN e <= seen_at THEN 1 ELSE 0 END) AS b, max(CASE WHEN s > seen_at THEN 1 ELSE 0 END) AS a, count(s) AS n
  FROM r LEFT JOIN spans ON f = ref_field AND k = ref_key AND m IS NOT DISTINCT FROM manifest
  GROUP BY ref_table, ref_field, row_id, ref_key, manifest, seen_at
  HAVING coalesce(max(CASE WHEN s <= seen_at AND (e IS NULL OR e > seen_at) THEN 1 ELSE 0 END), 0) = 0)
"""

SQL = {
    "p5_found": _FOUND_SQL + "SELECT ref_table, ref_field, row_id, ref_key FROM o",
    "p5_report": _FOUND_SQL
    + "SELECT ref_table, ref_field, strftime(seen_at, '%Y-%m') AS month, CASE WHEN n = 0 THEN 'never' WHEN b = 1 AND a = 1 THEN 'between' WHEN b = 1 THEN 'gone' ELSE 'later' END AS reason, count(*) AS n_orphans, count(DISTINCT ref_key || coalesce(manifest, '')) AS n_keys FROM o GROUP BY ALL",
}
QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
