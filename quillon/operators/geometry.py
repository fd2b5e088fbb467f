"""Representational geometry: centroids, similarity edges, rank correlation and CKA between models.

Vectors stay arrays: (key columns, concept, x). All operators take ``by``: columns such as a run, a layer or a
scenario that make independent problems of one plan. The number of concepts of a problem, which its
roster bounds, is what bounds a task; the number of rows behind a concept is not, as means add up in the map tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.arrays import groups, lists, matrix
from quillon.operators.ranking import average_rank, correlation

#: Similarities are compared to so many decimals, so that equal vectors tie.
DECIMALS = 12
#: Sums that a map task holds before it sends them on.
HELD = 20_000


def _types(df: DataFrame, columns: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in columns)


def centroids(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, concept, x: the mean of the concept's vectors.

    Sums are built in the map tasks, so a concept with a third of all rows sends one row a task. Vectors of
    one key that differ in length, or lack values, are an error.
    """
    keys = [*by, "concept"]

    def send(held: dict, fields: list) -> pa.RecordBatch:
        arrays = [pa.array([k[i] for k in held], f.type) for i, f in enumerate(fields)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([v[0].tolist() for v in held.values()], pa.list_(pa.float64())), pa.array([v[1] for v in held.values()], pa.int64())], names=[*keys, "_s", "_n"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        fields: list = []
        for batch in batches:
            fields = [batch.schema.field(k) for k in keys]
            for key, at in groups(batch, keys):
                x = matrix(batch.column("x").take(pa.array(at)))
                if key in held:
                    if len(held[key][0]) != x.shape[1]:
                        raise ValueError("vectors of a group differ in length or lack values")
                    held[key][0] += x.sum(axis=0)
                    held[key][1] += len(x)
                else:
                    held[key] = [x.sum(axis=0), len(x)]
            if len(held) > HELD:
                yield send(held, fields)
                held = {}
        if held:
            yield send(held, fields)

    def mean(table: pa.Table) -> pa.Table:
        x = matrix(table.column("_s")).sum(axis=0, keepdims=True) / sum(table.column("_n").to_pylist())
        return table.slice(0, 1).select(keys).append_column("x", lists(x))

    sums = rows.select(*keys, F.col("x").cast("array<double>").alias("x")).mapInArrow(part, _types(rows, keys) + ", _s array<double>, _n bigint")
    return sums.groupBy(*keys).applyInArrow(mean, _types(rows, keys) + ", x array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """The Euclidean length, with 1 for a zero vector."""
    length = F.sqrt(dot(a, a))
    return F.when(length == 0, 1.0).otherwise(length)


def unit_vectors(vecs: DataFrame, by: list[str]) -> DataFrame:
    n = vecs.withColumn("_n", norm(F.col("x")))
    return n.select(*by, "concept", F.transform("x", lambda v: v / F.col("_n")).alias("x"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.clip(x @ y.T, -1, 1).round(DECIMALS) + 0.0


def similarity_edges(vecs: DataFrame, by: list[str]) -> DataFrame:
    """by, i, j, s for i < j: the upper triangle of the cosine matrix, clipped to [-1, 1], by block products."""

    def edges(table: pa.Table) -> pa.Table:
        table = table.sort_by("concept")
        x = unit_rows(matrix(table.column("x")))
        names = table.column("concept").combine_chunks()
        out = []
        for lo in range(0, len(x), 512):
            s = cosines(x[lo : lo + 512], x)
            i, j = np.nonzero(np.arange(len(x))[None, :] > np.arange(lo, lo + len(s))[:, None])
            out.append(pa.table([*[pa.array([table.column(k)[0].as_py()] * len(i), table.schema.field(k).type) for k in by], names.take(pa.array(i + lo)), names.take(pa.array(j)), pa.array(s[i, j])], names=[*by, "i", "j", "s"]))
        return pa.concat_tables(out)

    kind = dict(vecs.dtypes)["concept"]
    return vecs.select(*by, "concept", "x").groupBy(*by).applyInArrow(edges, _types(vecs, by) + f", i {kind}, j {kind}, s double")


def ranked_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, i, j, s, r: with average ranks of the similarities."""
    return edges.withColumn("r", average_rank("s", *by))


def pair_up(edges: DataFrame, model: str, by: list[str], columns: list[str]) -> DataFrame:
    """Each unordered pair of models on the same edge: both sides come from one exchange on (by, i, j)."""
    a = edges.select(*by, "i", "j", F.col(model).alias("model_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = edges.select(*by, "i", "j", F.col(model).alias("model_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, [*by, "i", "j"]).where("model_a < model_b")


def rsa_pairs(edges: DataFrame, by: list[str] = [], model: str = "model") -> DataFrame:  # noqa: B006
    """by, model_a, model_b, rho, n_edges: Spearman's correlation of two models' similarities (0 if constant).

    Ranks are those among the edges that both models have.
    """
    keys = [*by, "model_a", "model_b"]
    pairs = pair_up(edges, model, by, ["s"])
    ranked = pairs.withColumn("r_a", average_rank("s_a", *keys)).withColumn("r_b", average_rank("s_b", *keys))
    return ranked.groupBy(*keys).agg(correlation("r_a", "r_b").alias("rho"), F.count("*").alias("n_edges"))


def linear_cka(x: np.ndarray, y: np.ndarray) -> float | None:
    """Linear CKA of two matrices with the same rows (null if one is constant)."""
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    gx, gy = x @ x.T, y @ y.T
    below = round(float(np.linalg.norm(gx) * np.linalg.norm(gy)), DECIMALS)
    return float((gx * gy).sum()) / below if below else None


def paired_models(vecs: DataFrame, model: str = "model") -> DataFrame:
    """model_a, model_b of all pairs: one row of names (there are few models), taken apart again."""
    names = vecs.agg(F.sort_array(F.collect_set(model)).alias("_m")).select(F.posexplode("_m").alias("_i", "model_a"), "_m")
    return names.select("model_a", F.explode(F.slice("_m", F.col("_i") + 2, F.size("_m"))).alias("model_b"))


def cka_pairs(vecs: DataFrame, model: str = "model", normalise: bool = True) -> DataFrame:
    """model_a, model_b, cka: linear CKA of the column-centred matrices over the concepts that both models have (none: no row)."""
    pairs = paired_models(vecs, model).withColumn("_pair", F.concat_ws("\u0001", "model_a", "model_b"))
    sides = pairs.select("_pair", "model_a", "model_b", F.explode(F.array("model_a", "model_b")).alias("_side"))
    rows = vecs.select(F.col(model).alias("_side"), "concept", "x").join(sides, "_side")

    def cka(table: pa.Table) -> pa.Table:
        a, b = table.column("model_a")[0].as_py(), table.column("model_b")[0].as_py()
        at = dict(groups(table, ["_side"]))
        x, y = ({c: v for c, v in zip(table.column("concept").take(pa.array(at[k,])).to_pylist(), matrix(table.column("x").take(pa.array(at[k,]))))} for k in (a, b))
        shared = sorted(x.keys() & y.keys())
        n = min(len(shared), 1)
        value = []
        if shared:
            both = [np.array([z[c] for c in shared]) for z in (x, y)]
            value = [linear_cka(*[unit_rows(z) if normalise else z for z in both])]
        return pa.table([table.column("model_a").slice(0, n), table.column("model_b").slice(0, n), pa.array(value, pa.float64())], names=["model_a", "model_b", "cka"])

    kind = dict(vecs.dtypes)[model]
    return rows.select("_pair", "model_a", "model_b", "_side", "concept", "x").groupBy("_pair").applyInArrow(cka, f"model_a {kind}, model_b {kind}, cka double")


def symmetrised(pairs: DataFrame) -> DataFrame:
    """Every pair both ways round."""
    rest = [c for c in pairs.columns if c not in ("model_a", "model_b")]
    return pairs.select("model_a", "model_b", *rest).unionByName(pairs.select(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), *rest))


def layer_at(rows: DataFrame, fractions: list[float]) -> DataFrame:
    """``rows`` (model, layer, ...) at each fraction of the depth: the layer whose ordinal is nearest.

    Ordinals follow the layer's number; half-way goes to the even ordinal.
    """
    layers = rows.select("model", "layer").distinct()
    layers = layers.withColumn("_at", F.row_number().over(Window.partitionBy("model").orderBy("layer")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("model")))
    wanted = layers.select("model", "_n").distinct().withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("_at", F.bround(F.col("fraction") * (F.col("_n") - 1), 0).cast("int"))
    return rows.join(layers.drop("_n").join(wanted, ["model", "_at"]).select("model", "layer", "fraction"), ["model", "layer"])
