"""Clusters of mutually similar vectors from mergeable cluster-feature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.cftree import CFTree, ward
from quillon.llm.shards import SHARD_ROWS, Cells, by_part, fit_cells, list_array, matrix, part_sizes, routed, unit, visited
from quillon.plans.durable import durable, lookup_join

#: A map task sends its leaves on and starts anew when its trees have so many entries together.
FLUSH_ENTRIES = 40_000
#: Leaves of one cluster must meet in a cell, and a centroid its members, so they visit more cells than a search does.
LEAF_MARGIN, CENTRE_MARGIN = 0.06, 0.1
FEATURE = "_n float, _sum array<float>, _low long, _high long"


def _features(leaves: tuple) -> list[pa.Array]:
    sums, n, low, high = leaves
    return [pa.array(n, pa.float32()), list_array(sums), pa.array(low), pa.array(high)]


def _into(tree: CFTree, sums: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    for s, k, a, b in zip(sums, n.tolist(), low.tolist(), high.tolist()):
        tree.insert(s, k, a, b)


def leaf_features(df: DataFrame, keys: list[str], threshold: float, cells: Cells) -> DataFrame:
    """The leaves of one tree per part, grown in each map task over the rows it reads, with the cell (_shard) they lie in."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple, CFTree] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, tree in trees.items():
                leaves = tree.leaves()
                centre = unit(leaves[0]).astype(np.float32)
                cell = visited(centre, cells.centres[key], None)[1] if key in cells.centres else np.zeros(len(centre), np.int64)
                yield pa.RecordBatch.from_arrays([*[pa.array([k] * len(cell), pa.string()) for k in key], pa.array(cell), *_features(leaves)], names=[*keys, "_shard", "_n", "_sum", "_low", "_high"])
            trees.clear()

        for batch in batches:
            ids = batch.column("_id").to_numpy()
            for key, at in by_part(batch, keys):
                x = unit(matrix(batch.column("_v").take(pa.array(at)))).astype(np.float32)
                tree = trees.setdefault(key, CFTree(x.shape[1], threshold)) if key not in trees else trees[key]
                _into(tree, x, np.ones(len(at), np.float32), ids[at], ids[at])
            if sum(t.entries for t in trees.values()) > FLUSH_ENTRIES:
                yield from flush()
        yield from flush()

    return df.select(*keys, "_id", "_v").mapInArrow(grow, ", ".join(f"{k} string" for k in keys) + ", _shard long, " + FEATURE)


def reduce_leaves(leaves: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Trees of the same ``by`` merged into one, of which the leaves come back.

    The leaves of a cell go by in batches, so that memory is that of the merged tree only.
    """
    types = dict(leaves.dtypes)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, name = None, []
        for batch in batches:
            sums = matrix(batch.column("_sum"))
            if tree is None:
                tree, name = CFTree(sums.shape[1], threshold), [batch.column(k)[0] for k in by]
            _into(tree, sums, *[batch.column(c).to_numpy() for c in ("_n", "_low", "_high")])
        if tree is not None:
            found = _features(tree.leaves())
            yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()] * len(found[0]), k.type) for k in name], *found], names=[*by, "_n", "_sum", "_low", "_high"])

    return leaves.groupBy(*by).applyInArrow(merge, ", ".join(f"{k} {types[k]}" for k in by) + ", " + FEATURE)


def _agglomerate(threshold: float, keys: list[str]):
    """The leaves of a cell's clusters under the smallest id among them (_label); lone vectors are left out.

    A cluster of visitors alone is that of another cell.
    """

    def run(table: pa.Table) -> pa.Table:
        home = table.column("_home").to_numpy(zero_copy_only=False).astype(bool)
        sums, n = matrix(table.column("_sum")).astype(np.float64), table.column("_n").to_numpy().astype(np.float64)
        low = table.column("_low").to_numpy()
        _, group = np.unique(ward(sums, n, threshold), return_inverse=True)
        size = int(group.max()) + 1
        some = (np.bincount(group, weights=home, minlength=size) > 0) & (np.bincount(group, weights=n, minlength=size) > 1)
        label = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(label, group, low)
        at = pa.array(np.flatnonzero(some[group]))
        return table.select([*keys, "_n", "_sum", "_low", "_high"]).append_column("_label", pa.array(label[group])).take(at)

    return run


def _linked(local: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters of several cells that share a leaf become one: keys, _label, _n, _sum of each.

    Labels move along shared leaves and, by looking up the label of the label, in steps that double, so a
    chain of m cells takes about log m rounds. A leaf counts once, in however many cells it was seen.
    """
    local = durable(local)
    held = local.select(*keys, "_label", "_low", "_high", "_n").distinct()
    shared = held.groupBy(*keys, "_low", "_high", "_n").agg(F.min("_label").alias("_to"), F.collect_set("_label").alias("_all")).where(F.size("_all") > 1)
    links = durable(shared.select(*keys, F.explode("_all").alias("_label"), "_to").where("_label <> _to").distinct())
    if not links.isEmpty():
        both = durable(links.unionByName(links.select(*keys, F.col("_to").alias("_label"), F.col("_label").alias("_to"))))
        names = durable(both.select(*keys, "_label").distinct().withColumn("_final", F.col("_label")))
        while True:
            low = both.join(names.withColumnsRenamed({"_label": "_to", "_final": "_lowest"}), [*keys, "_to"]).groupBy(*keys, "_label").agg(F.min("_lowest").alias("_lowest"))
            step = names.join(low, [*keys, "_label"]).select(*keys, "_label", F.least("_final", "_lowest").alias("_next"), "_final")
            jump = names.select(*keys, F.col("_label").alias("_next"), F.col("_final").alias("_far"))
            new = durable(step.join(jump, [*keys, "_next"]).select(*keys, "_label", F.least("_next", "_far").alias("_final"), (F.least("_next", "_far") < F.col("_final")).alias("_moved")))
            names = new.drop("_moved")
            if new.where("_moved").isEmpty():
                break
        local = local.join(names, [*keys, "_label"], "left").withColumn("_label", F.coalesce("_final", "_label"))

    def add(table: pa.Table) -> pa.Table:
        at = {x: i for i, x in enumerate(zip(*[table.column(c).to_pylist() for c in ("_low", "_high", "_n")]))}
        x = matrix(table.column("_sum"))[list(at.values())].astype(np.float64).sum(axis=0, keepdims=True)
        return pa.table([*[table.column(c).slice(0, 1) for c in [*keys, "_label"]], pa.array([sum(k[2] for k in at)], pa.float32()), list_array(x)], names=[*keys, "_label", "_n", "_sum"])

    return local.groupBy(*keys, "_label").applyInArrow(add, ", ".join(f"{k} string" for k in keys) + ", _label long, _n float, _sum array<float>")


def _assign(threshold: float):
    def run(vectors: pa.Table, clusters: pa.Table) -> pa.Table:
        names = ["label", "vector_id", "mean_cosine"]
        if not vectors.num_rows or not clusters.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, first = np.unique(vectors.column("_id").to_numpy(), return_index=True)
        x = unit(matrix(vectors.column("_v"))[first])
        sums, n = matrix(clusters.column("_sum")).astype(np.float64), clusters.column("_n").to_numpy().astype(np.float64)
        label, c32 = clusters.column("_label").to_numpy(), (sums / n[:, None]).astype(np.float32)
        best = np.empty(len(x), np.int64)
        for lo in range(0, len(x), 1024):
            best[lo : lo + 1024] = (x[lo : lo + 1024].astype(np.float32) @ c32.T).argmax(axis=1)
        dot = np.einsum("ij,ij->i", x, sums[best])
        ok = dot / n[best] >= threshold - 1e-6
        return pa.table([pa.array(label[best][ok]), pa.array(ids[ok]), pa.array(((dot - 1) / np.maximum(n[best] - 1, 1))[ok])], names=names)

    return run


def cluster_vectors(df: DataFrame, part: list[str], record: str, vector: str, threshold: float = 0.8, shard_rows: int = SHARD_ROWS, seed: int = 42) -> DataFrame:
    """cluster_id, vector_id, mean_cosine, size: the members of clusters of two or more.

    ``df`` holds usable vectors; those of another length are another part. Every part, whatever its size,
    takes the same steps. Map tasks grow a tree per part and send its leaves to their cells (``quillon.llm.shards``);
    the trees of a cell are merged into one; its leaves, and those that visit from other cells, are
    agglomerated by Ward's cost as long as the mean cosine between two clusters is at least ``threshold``;
    clusters of several cells that share a leaf become one; and one pass assigns every vector to the
    centroid it is nearest to if its mean cosine to the members is that high. Where all pairs within
    the true clusters reach the threshold and no pair across does, the result is those, but for
    members whose centroid does not visit their cell (the README has the measured share). The pass cuts the vectors of a dense
    cell into pieces by row hash, and centroids, of which there are few, go to all of them.

    ``cluster_id`` is the smallest id in the cluster, ``mean_cosine`` a member's mean cosine to the
    others (as weighted by repeated rows; give distinct rows for exact values). A repeated id is the
    same vector again and counts once. Vectors without a partner and empty tables give no rows. Null
    parts are a part of their own. Other columns are ignored.
    """
    keys = [*[f"_p{i}" for i in range(len(part))], "_dim"]
    rows = df.select(*[F.coalesce(F.col(p).cast("string"), F.lit("\u0001")).alias(k) for k, p in zip(keys, part)], F.size(vector).cast("string").alias("_dim"), F.col(record).cast("long").alias("_id"), F.col(vector).cast("array<float>").alias("_v"))
    cells = fit_cells(rows, keys, "_v", "_id", part_sizes(rows, keys), shard_rows, seed)
    leaves = reduce_leaves(leaf_features(rows, keys, threshold, cells), [*keys, "_shard"], threshold).drop("_shard")
    visiting = routed(leaves, keys, "_sum", "_low", ["_n", "_sum", "_low", "_high"], cells, {}, LEAF_MARGIN)
    local = visiting.groupBy(*keys, "_shard").applyInArrow(_agglomerate(threshold, keys), ", ".join(f"{k} string" for k in keys) + f", {FEATURE}, _label long")
    clusters = _linked(local, keys)
    homes = routed(rows, keys, "_v", "_id", ["_id", "_v"], cells, cells.rows, None)
    centres = routed(clusters, keys, "_sum", "_label", ["_label", "_n", "_sum"], cells, cells.rows, CENTRE_MARGIN)
    by = [*keys, "_shard", "_piece"]
    assigned = durable(homes.groupBy(*by).cogroup(centres.groupBy(*by)).applyInArrow(_assign(threshold), "label long, vector_id long, mean_cosine double").dropDuplicates(["vector_id"]))
    totals = assigned.groupBy("label").agg(F.min("vector_id").alias("cluster_id"), F.count("*").alias("size")).where("size > 1")
    return lookup_join(assigned, totals, ["label"], salt_on="vector_id").select("cluster_id", "vector_id", "mean_cosine", "size")


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """cluster_id, size, typical_members: the ids of highest mean cosine to the rest (ties: smaller id)."""
    order = Window.partitionBy("cluster_id").orderBy(F.round("mean_cosine", 6).desc(), F.col("vector_id"))
    top = members.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= typical)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "vector_id")))
    return top.groupBy("cluster_id").agg(F.max("size").alias("size"), F.transform(listed, lambda x: x["vector_id"]).alias("typical_members"))
