"""Round trips through the sources, sinks and streams, as queries with the tables' own figures as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators.ranking import last_wins
from quillon.plans.durable import scratch
from quillon.plans.tables import table
from quillon.sources.files import read_csv, read_json, write_json, write_one_csv
from quillon.streaming.ledger import last_states, run_to_table, tumbling_counts


def _place(spark) -> str:
    return scratch(spark, "io")


def io_json(spark, sf_dir):
    """Builds out as compressed JSON, nested lists and nulls included, and back with a given schema."""
    path = _place(spark)
    b = table(spark, sf_dir, "data_manifest_250").select("build_row_id", "concept", "concept_to_images", "num_images")
    write_json(b, path, compressed=True)
    back = read_json(spark, path, b.schema, lines=True).dropDuplicates(["build_row_id"])
    n = F.when(F.col("concept_to_images").isNull(), -1).otherwise(F.size("concept_to_images"))
    return back.select("build_row_id", "concept", n.cast("int").alias("n_listed"))


def io_csv(spark, sf_dir):
    """The seed ledger out as one quoted CSV and back as text columns."""
    path = _place(spark)
    s = table(spark, sf_dir, "scale250_seed_provenance").select("seed_id", "target_concept", "target_filename", "selection_note").distinct()
    write_one_csv(s, path)
    return read_csv(spark, path, "seed_id long, target_concept string, target_filename string, selection_note string")


def io_partitioned(spark, sf_dir):
    """Vectors out by model and layer; only one model's folders are read back."""
    path = _place(spark)
    v = table(spark, sf_dir, "replication_results").where("model is not null and layer is not null").select("vector_id", "model", "layer", "num_images")
    v.repartition("model", "layer").write.partitionBy("model", "layer").parquet(path)
    schema = "vector_id long, num_images int, model string, layer string"
    return spark.read.schema(schema).parquet(path).where("model = 'Brenta-1B'").groupBy("layer").agg(F.count("*").alias("n"), F.countDistinct("vector_id").alias("n_vectors"))


def _events(spark, sf_dir):
    """The events as a stream of files: delivered twice over, as in two runs of an export."""
    path = _place(spark)
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.round("value", 2).alias("value"))
    e.repartitionByRange(4, "ts").write.parquet(path)
    e.where("event_id % 10 = 0").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).parquet(path)


def stream_counts(spark, sf_dir):
    """Tumbling counts by type over the stream; one day more than the last event closes all windows."""
    path = _place(spark)
    s = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = run_to_table(tumbling_counts(s, "ts", "event_id", "event_type", "value"), path)
    # Windows within the allowed lateness of the end stay open, as more could come.
    return counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", (F.round("total", 2) + 0.0).alias("total"))


def stream_states(spark, sf_dir):
    """The last event type of each user over the stream."""
    path = _place(spark)
    s = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_table(last_states(s, "user_id", "ts", "event_type"), path, "update")
    return last_wins(out, ["user_id"], ["_batch"]).select("user_id", F.col("state").alias("event_type"))


SQL = {
    "io_json": "SELECT DISTINCT build_row_id, concept, CASE WHEN concept_to_images IS NULL THEN -1 ELSE CAST(len(concept_to_images) AS INTEGER) END AS n_listed FROM data_manifest_250",
    "io_csv": "SELECT DISTINCT seed_id, target_concept, target_filename, selection_note FROM scale250_seed_provenance",
    "io_partitioned": "SELECT layer, count(*) AS n, count(DISTINCT vector_id) AS n_vectors FROM replication_results WHERE model = 'Brenta-1B' AND layer IS NOT NULL GROUP BY 1",
    "stream_counts": "WITH e AS (SELECT date_trunc('day', ts) AS d, event_type, round(value, 2) AS value FROM events), m AS (SELECT max(ts) - INTERVAL 2 DAY AS w FROM events) SELECT strftime(d, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) + 0.0 AS total FROM e, m WHERE d + INTERVAL 1 DAY <= w GROUP BY 1, 2",
    "stream_states": "SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY 1",
}
QUERIES = {n: globals()[n] for n in SQL}
