"""A ledger of reviews as a stream: repeated deliveries dropped, tumbling counts, last state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_ledger(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling_counts(events: DataFrame, time: str, record: str, kind: str, value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per window and kind: events and sum of values; an event delivered again within ``late`` counts once."""
    once = events.withWatermark(time, late).dropDuplicatesWithinWatermark([record])
    return once.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def last_states(events: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """key, state, changes after each batch in which a key had events; the last event in time holds.

    State per key is its last time, state and number of changes.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        at, now, n = group.get if group.exists else (-1, None, 0)
        rows = pd.concat([b[[time, state]] for b in batches]).sort_values([time, state])
        for t, s in rows.itertuples(index=False):
            micros = int(pd.Timestamp(t).value // 1000)
            if micros >= at:
                n, at, now = n + int(s != now), micros, s
        group.update((at, now, n))
        yield pd.DataFrame({key: [k[0]], "state": [now], "changes": [n]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, changes long", "at long, state string, n long", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Work off what there is and return what was written; ``path`` holds output and checkpoint."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    else:
        # Each batch of changed rows is a folder of its own; a batch that is run again replaces it.
        q = stream.writeStream.foreachBatch(lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/out/part={i}")).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out") if mode == "append" else spark.read.parquet(f"{path}/out")
