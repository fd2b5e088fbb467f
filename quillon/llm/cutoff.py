"""Score cutoffs that keep a target fraction of every source, from a persistent dyadic count tree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.durable import durable, lookup_join, scratch


class DyadicCountTree:
    """Counts of scores per source on all levels of a dyadic tree over integer-coded scores.

    A score in [0, 1] has the code ``min(floor(score * 2**depth), 2**depth - 1)``; node ``k`` of a
    level covers codes of one interval and has the children ``2k`` and ``2k + 1`` (1 is the root).
    ``add_batch`` appends a batch's node counts and its new records under ``path``; a record whose
    id came in an earlier batch, or twice in one, counts once. Any source's rank is found by walking
    from the root, so a new batch costs a pass over that batch and over the ids of the earlier ones. Each batch is written to its
    own folder and marked as done only then: a batch that was lost half way is not seen and is written
    anew. A tree on the path of an earlier one goes on after its batches; it must have the same depth.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, depth: int = 12):
        self.spark, self.depth = spark, depth
        self.path = path or scratch(spark, "trees")
        self.batches: list[str] = []
        while self._mark(len(self.batches), False):
            self.batches.append(f"{self.path}/{len(self.batches)}")

    def _mark(self, batch: int, write: bool) -> bool:
        """Whether a batch is marked as done; with ``write`` it is from then on."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{batch}/_DONE")
        files = done.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if write:
            files.create(done, True).close()
        return files.exists(done)

    def add_batch(self, df: DataFrame, source: str, score: str, record: str) -> None:
        """Add the records of ``df`` with a non-null source and score; other columns are ignored."""
        code = F.least(F.floor(F.col(score) * (1 << self.depth)), F.lit((1 << self.depth) - 1)).cast("int")
        rows = df.where(F.col(source).isNotNull() & F.col(score).isNotNull())
        rows = rows.select(F.col(record).alias("record"), F.col(source).alias("source"), F.col(score).alias("score"), code.alias("code")).dropDuplicates(["record"])
        if self.batches:
            rows = rows.join(self.records(), "record", "left_anti")
        at = f"{self.path}/{len(self.batches)}"
        rows.write.mode("overwrite").parquet(f"{at}/records")
        leaves = self.spark.read.parquet(f"{at}/records").groupBy("source", "code").agg(F.count("*").alias("n"))
        nodes = leaves.select("source", F.explode(F.expr(f"transform(sequence(0, {self.depth}), h -> shiftright(code + {1 << self.depth}, h))")).alias("node"), "n")
        nodes.groupBy("source", "node").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{at}/nodes")
        self._mark(len(self.batches), True)
        self.batches.append(at)

    def records(self) -> DataFrame:
        """All records added so far: record, source, score, code."""
        return self.spark.read.parquet(*[f"{b}/records" for b in self.batches])

    def nodes(self) -> DataFrame:
        """The tree: source, node, n."""
        return self.spark.read.parquet(*[f"{b}/nodes" for b in self.batches]).groupBy("source", "node").agg(F.sum("n").alias("n"))

    def descend(self, ranks: DataFrame) -> DataFrame:
        """For ranks (source, wanted: from the top, 1 is the best score): source, code, above, total.

        ``code`` is the leaf that holds the rank, ``above`` the count of records in higher leaves.
        A source has at most ``2**(depth + 1)`` nodes, which bounds a task's rows.
        """
        depth = self.depth

        def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            counts = dict(zip(pdf["node"], pdf["n"]))
            node, left = 1, int(pdf["wanted"].iloc[0])
            for _ in range(depth):
                upper = counts.get(2 * node + 1, 0)
                node, left = (2 * node + 1, left) if left <= upper else (2 * node, left - upper)
            return pd.DataFrame({"source": [key[0]], "code": [node - (1 << depth)], "above": [int(pdf["wanted"].iloc[0]) - left]})

        asked = self.nodes().join(ranks, "source")
        return asked.groupBy("source").applyInPandas(walk, "source string, code int, above long")


def cutoffs(tree: DyadicCountTree, targets: DataFrame) -> DataFrame:
    """source, target_fraction, n_scored, cutoff, kept for each row of targets(source, target_fraction).

    The cutoff is the highest occurring score such that the records at or above it are at least
    ``target_fraction`` of the source's records; the fraction is taken to nine decimals. Sources
    without records have a null cutoff and keep none. A target of 0 or less keeps the best score's
    records, one above 1 is read as 1. Null targets are dropped; of a source named twice the larger counts.
    """
    wanted = targets.where("source is not null and target_fraction is not null").groupBy("source").agg(F.max("target_fraction").alias("target_fraction"))
    totals = tree.nodes().where("node = 1").select("source", F.col("n").alias("n_scored"))
    need = F.greatest(F.lit(1), F.ceil(F.least(F.col("target_fraction"), F.lit(1.0)).cast("decimal(10,9)") * F.col("n_scored"))).cast("long")
    ranks = wanted.join(totals, "source").withColumn("wanted", need)
    leaf = durable(ranks.join(tree.descend(ranks.select("source", "wanted")), "source"))
    inside = lookup_join(tree.records(), leaf.select("source", "code", "above", "wanted"), ["source", "code"], salt_on="record")
    steps = inside.groupBy("source", "score").agg(F.count("*").alias("n"), F.first("above").alias("above"), F.first("wanted").alias("wanted"))
    running = F.col("above") + F.sum("n").over(Window.partitionBy("source").orderBy(F.col("score").desc()))
    hit = steps.withColumn("kept", running).where("kept >= wanted").groupBy("source").agg(F.max_by("score", "score").alias("cutoff"), F.min("kept").alias("kept"))
    return wanted.join(totals, "source", "left").join(hit, "source", "left").select("source", "target_fraction", F.coalesce("n_scored", F.lit(0)).alias("n_scored"), "cutoff", F.coalesce("kept", F.lit(0)).alias("kept"))


def kept_records(tree: DyadicCountTree, found: DataFrame) -> DataFrame:
    """The records (record, source, score) at or above their source's cutoff."""
    cut = found.where("cutoff is not null").select("source", "cutoff")
    return lookup_join(tree.records(), cut, ["source"], salt_on="record").where("score >= cutoff").select("record", "source", "score")
