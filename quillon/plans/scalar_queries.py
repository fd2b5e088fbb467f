"""One query per family of scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.plans.curation import _norm, _slug
from quillon.plans.tables import table


def names(spark, sf_dir):
    """Normal forms, slugs and prompts of the distinct concept spellings."""
    c = table(spark, sf_dir, "candidate").select("concept").where("concept is not null").distinct()
    x = F.col("concept")
    return c.select("concept", S.normalise(x).alias("name"), S.slug(x).alias("slug"), S.prompt(x).alias("prompt"), S.fill_template("The concept of {concept}", x).alias("template"), F.format_string("%s_%03d.jpg", S.slug(x), F.lit(7)).alias("placeholder"), F.initcap(S.normalise(x)).alias("title"))


def paths(spark, sf_dir):
    """Parts of the file paths."""
    f = table(spark, sf_dir, "image_file").select("file_id", F.replace(F.trim("relpath"), F.lit("\\"), F.lit("/")).alias("p")).where("p is not null").groupBy("file_id").agg(F.max("p").alias("p"))
    p = F.col("p")
    return f.select("file_id", S.basename(p).alias("name"), S.stem(p).alias("stem"), F.lower(S.extension(p)).alias("extension"), S.glob(S.basename(p), "*_openpix_*.jpg").alias("openpix_jpg"))


def file_sources(spark, sf_dir):
    """Sources and numbers read from file names."""
    f = table(spark, sf_dir, "candidate").select("candidate_filename").where("candidate_filename is not null").distinct()
    n = F.regexp_replace("candidate_filename", "_candidate_", "_")
    return f.select("candidate_filename", S.source_of_file(n, ["gridnet", "openpix", "freelens", "museo_scans", "scans"]).alias("source"), F.coalesce(S.file_number(n), F.lit(-1).cast("long")).alias("number"))


def flags(spark, sf_dir):
    """How often each spelling of a flag means what."""
    c = table(spark, sf_dir, "candidate").groupBy("proxy_used").agg(F.count("*").alias("n"))
    word = F.lower(F.trim("proxy_used"))
    return c.groupBy(F.coalesce(S.parse_bool(F.col("proxy_used")).cast("string"), F.lit("neither")).alias("meaning")).agg(F.sum("n").alias("n"), F.countDistinct(word).alias("n_words"))


def class_terms(spark, sf_dir):
    """Class labels by normal form: how many, joined by semicolons, at most eight."""
    c = table(spark, sf_dir, "candidate").select("source_class_id", F.explode(S.terms(F.col("source_class_label"))).alias("term")).where("source_class_id is not null").distinct()
    listed = F.sort_array(F.collect_list("term"))
    return c.groupBy("source_class_id").agg(F.count("*").alias("n_terms"), F.array_join(F.slice(listed, 1, 8), "; ").alias("terms"))


#: Models of a panel whose settings are read.
PANEL = [("m0", "causal", 0.6), ("m1", "causal", 1.7), ("m2", "causal", 4.0), ("m3", "vision", None), ("m4", "vision", None), ("m5", "vision", None), ("m6", "vision_language", None), ("m7", "vision_language_autoregressive", None)]


def settings(spark, sf_dir):
    """Settings written as text: float maps, pairs, layer lists."""
    m = spark.createDataFrame(PANEL, "model string, kind string, size double")
    text = F.concat(F.lit("a=1.5, b = 2,bad, a="), F.coalesce(F.col("size"), F.lit(0.25)).cast("string"))
    parsed = S.parse_float_map(text)
    n = F.length("kind")
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return m.select(
        "model", F.element_at(parsed, "a").alias("a"), F.element_at(parsed, "b").alias("b"), F.size(parsed).alias("n"), S.swap_pair(F.concat("model", F.lit(" : x:y")))["new"].alias("swap_new"),
        join(S.layer_indices("aligned5", n)).alias("aligned"), join(S.layer_indices("0,-1,2", n)).alias("listed"), F.size(S.layer_indices("all", n)).alias("n_all"), S.depth_label(F.lit(1.0)).alias("label"),
    )


def notes(spark, sf_dir):
    """Notes with an addition, escaped for pages and tables."""
    s = table(spark, sf_dir, "scale250_seed_provenance").select("selection_note").distinct()
    x = S.append_note(F.col("selection_note"), F.lit("<moved> & \"kept\""))
    return s.select("selection_note", x.alias("note"), S.html_escape(x).alias("html"), S.csv_quote(x).alias("csv"))


def times(spark, sf_dir):
    """Delays between fetching and ingestion, per run."""
    c = table(spark, sf_dir, "candidate").where("fetched_at is not null and ingested_at is not null")
    delay = F.unix_micros(F.to_timestamp_ltz("ingested_at")) - F.unix_micros(F.to_timestamp_ltz("fetched_at"))
    return c.groupBy("run_id").agg(F.round(F.max(delay) / 1e6, 3).alias("max_s"), F.round(F.min(delay) / 1e6, 3).alias("min_s"), F.count_if(delay > 14 * 86_400_000_000).alias("n_late"), F.max(F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss")).alias("last"))


def parsed_times(spark, sf_dir):
    """ISO texts with microseconds read back; texts that are no times give null."""
    c = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("text"), "ts")
    back = F.try_to_timestamp(F.col("text"))
    wrong = F.try_to_timestamp(F.concat(F.lit("x"), F.col("text")))
    return c.agg(F.count_if(F.date_format(back, "yyyy-MM-dd HH:mm:ss.SSSSSS") == F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("n_same"), F.count(wrong).alias("n_wrong"), F.count("*").alias("n"))


def vector_functions(spark, sf_dir):
    """Cosine and balance of neighbouring pictures, and the half-even rounding of depths."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = e.join(nxt, "vec_id")
    c = S.cosine(F.col("embedding"), F.col("other"))
    return j.select("vec_id", (F.round(c, 6) + 0.0).alias("cosine"), (F.round(S.balance(c, F.lit(0.3)), 5) + 0.0).alias("balance"), F.bround((F.col("vec_id") % 50) * 0.5, 0).alias("half_even"))


def json_paths(spark, sf_dir):
    """Values of nested JSON texts, with a default."""
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.a.b"), F.lit("none")).alias("b"))
    return e.groupBy("event_type", "b").agg(F.count("k").alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


def fingerprints(spark, sf_dir):
    """Hashes of canonical JSON: of each build's settings, and of the whole manifest's names."""
    b = table(spark, sf_dir, "data_manifest_250").select("build_row_id", "manifest_version", "storage_slug", "num_images").where("manifest_version is not null and storage_slug is not null and num_images is not null").distinct()
    return b.select("build_row_id", S.fingerprint(version=F.col("manifest_version"), slug=F.col("storage_slug"), images=F.col("num_images")).alias("sha256")).distinct()


def map_functions(spark, sf_dir):
    """Source counts of concepts as maps: merged, filtered and read with a default."""
    c = table(spark, sf_dir, "candidate").where("concept is not null and source is not null").groupBy("concept", "source").agg(F.count("*").alias("n"))
    m = c.groupBy("concept").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("m"))
    big = F.map_filter("m", lambda k, v: v >= 2)
    return m.select("concept", F.size("m").alias("n_sources"), F.size(big).alias("n_big"), F.coalesce(F.try_element_at("m", F.lit("gridnet")), F.lit(0)).alias("gridnet"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.size(F.array_except(F.map_keys("m"), F.array(F.lit("gridnet"), F.lit("openpix")))).alias("n_other"))


_AT = lambda a: f"list_aggregate(list_transform({a}, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')"
SQL = {
    "names": f"SELECT concept, {_norm('concept')} AS name, {_slug('concept')} AS slug, CASE WHEN substr(lower(concept), 1, 1) IN ('a','e','i','o','u') THEN 'an' ELSE 'a' END || ' photo of ' || concept AS prompt, 'The concept of ' || concept AS template, {_slug('concept')} || '_007.jpg' AS placeholder, list_aggregate(list_transform(string_split({_norm('concept')}, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS title FROM (SELECT DISTINCT concept FROM candidate WHERE concept IS NOT NULL)",
    "paths": "WITH f AS (SELECT file_id, max(replace(trim(relpath), '\\', '/')) AS p FROM image_file WHERE relpath IS NOT NULL GROUP BY 1) SELECT file_id, split_part(p, '/', -1) AS name, regexp_replace(split_part(p, '/', -1), '(.)[.][^.]*$', '\\1') AS stem, lower(regexp_extract(split_part(p, '/', -1), '.([.][^.]*)$', 1)) AS extension, split_part(p, '/', -1) LIKE '%\\_openpix\\_%.jpg' ESCAPE '\\' AS openpix_jpg FROM f",
    "file_sources": "SELECT DISTINCT candidate_filename, (SELECT CASE WHEN regexp_matches(n, '^.+_museo_scans_[0-9]+$') THEN 'museo_scans' WHEN regexp_matches(n, '^.+_freelens_[0-9]+$') THEN 'freelens' WHEN regexp_matches(n, '^.+_gridnet_[0-9]+$') THEN 'gridnet' WHEN regexp_matches(n, '^.+_openpix_[0-9]+$') THEN 'openpix' WHEN regexp_matches(n, '^.+_scans_[0-9]+$') THEN 'scans' END FROM (SELECT regexp_replace(replace(candidate_filename, '_candidate_', '_'), '[.][^.]*$', '') AS n)) AS source, coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(replace(candidate_filename, '_candidate_', '_'), '[.][^.]*$', ''), '_([0-9]+)$', 1), '') AS BIGINT), -1) AS number FROM candidate WHERE candidate_filename IS NOT NULL",
    "flags": "SELECT CASE WHEN lower(trim(proxy_used)) IN ('1','true','yes','y','on') THEN 'true' WHEN lower(trim(proxy_used)) IN ('0','false','no','n','off') THEN 'false' ELSE 'neither' END AS meaning, count(*) AS n, count(DISTINCT lower(trim(proxy_used))) AS n_words FROM candidate GROUP BY 1",
    "class_terms": "WITH t AS (SELECT DISTINCT source_class_id, trim(term) AS term FROM (SELECT source_class_id, unnest(string_split(source_class_label, ',')) AS term FROM candidate WHERE source_class_id IS NOT NULL) WHERE trim(term) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY source_class_id ORDER BY term) AS k FROM t) SELECT source_class_id, count(*) AS n_terms, string_agg(term, '; ' ORDER BY term) FILTER (WHERE k <= 8) AS terms FROM r GROUP BY 1",
    "settings": "WITH md AS (SELECT * FROM (VALUES ('m0','causal',0.6::DOUBLE),('m1','causal',1.7),('m2','causal',4.0),('m3','vision',NULL),('m4','vision',NULL),('m5','vision',NULL),('m6','vision_language',NULL),('m7','vision_language_autoregressive',NULL)) t(model, kind, size)), l AS (SELECT *, length(kind) AS n FROM md) SELECT model, coalesce(size, 0.25) AS a, 2.0::DOUBLE AS b, 2 AS n, 'x:y' AS swap_new, "
    + _AT("list_distinct_ordered")
    .replace("list_distinct_ordered", "list_transform([0.0, 0.25, 0.5, 0.75, 1.0], lambda f: CAST(round_even(f * (n - 1), 0) AS INTEGER))")
    + " AS aligned, '0,' || (n - 1) || ',2' AS listed, CAST(n AS INTEGER) AS n_all, 'd100' AS label FROM l",
    "notes": """WITH s AS (SELECT DISTINCT selection_note, trim(concat_ws(' ', selection_note, '<moved> & "kept"')) AS note FROM scale250_seed_provenance) SELECT selection_note, note, replace(replace(replace(replace(replace(note, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, '"' || replace(note, '"', '""') || '"' AS csv FROM s""",
    "times": "WITH d AS (SELECT run_id, fetched_at, epoch_us(ingested_at) - epoch_us(fetched_at) AS d FROM candidate WHERE fetched_at IS NOT NULL AND ingested_at IS NOT NULL) SELECT run_id, round(max(d) / 1e6, 3) AS max_s, round(min(d) / 1e6, 3) AS min_s, CAST(sum(CASE WHEN d > 14 * 86400000000 THEN 1 ELSE 0 END) AS BIGINT) AS n_late, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') AS last FROM d GROUP BY 1",
    "parsed_times": "SELECT count(*) AS n_same, CAST(0 AS BIGINT) AS n_wrong, count(*) AS n FROM events",
    "vector_functions": "WITH j AS (SELECT a.vec_id, coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(c, 6) + 0.0 AS cosine, round(1 - 2 * abs(0.5 - CASE WHEN c + 0.3::DOUBLE > 0 THEN 0.3::DOUBLE / (c + 0.3::DOUBLE) ELSE 0.5 END), 5) + 0.0 AS balance, round_even((vec_id % 50) * 0.5::DOUBLE, 0) AS half_even FROM j",
    "json_paths": "SELECT event_type, 'none' AS b, count(props->>'$.k') AS n, CAST(sum(CAST(props->>'$.k' AS INTEGER)) AS BIGINT) AS sum_k, max(CAST(props->>'$.k' AS INTEGER)) AS max_k FROM events GROUP BY 1",
    "fingerprints": """SELECT DISTINCT build_row_id, sha256('{"images":' || num_images || ',"slug":"' || storage_slug || '","version":"' || manifest_version || '"}') AS sha256 FROM data_manifest_250 WHERE manifest_version IS NOT NULL AND storage_slug IS NOT NULL AND num_images IS NOT NULL""",
    "map_functions": "WITH c AS (SELECT concept, source, count(*) AS n FROM candidate WHERE concept IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) SELECT concept, CAST(count(*) AS INTEGER) AS n_sources, CAST(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS INTEGER) AS n_big, CAST(coalesce(max(n) FILTER (WHERE source = 'gridnet'), 0) AS BIGINT) AS gridnet, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN source NOT IN ('gridnet', 'openpix') THEN 1 ELSE 0 END) AS INTEGER) AS n_other FROM c GROUP BY 1",
}
QUERIES = {f"fn_{n}": globals()[n] for n in SQL}
SQL = {f"fn_{n}": s for n, s in SQL.items()}
