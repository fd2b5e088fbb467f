"""Resampling and inference: bootstraps, permutation tests, hold-outs and subsamples.

Draws come from md5 of the seed and the draw's place, so that a result does not depend on partitions,
executors or retries, and any engine with md5 can repeat it. The draws are cut into blocks, one task
each: a block has its draws' hashes and one row a model with all its similarities, of which the roster of
concepts bounds the length, and works on them as matrices.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.arrays import groups, matrix
from quillon.operators.geometry import cosines, rsa_pairs, unit_rows

#: Most edges of one model that a block may hold: those of 2,000 concepts. More is an error.
EDGES = 2_000_000
BLOCKS = 24
#: Images of a concept are counted in so many buckets of their id, so that no task sorts a whole concept.
BUCKETS = 64


def md5_number(*parts: Column) -> Column:
    """A whole number below 2**32 from the md5 of the parts joined by ``|``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def each(n: int) -> Column:
    """Rows for 0 .. n - 1 of every row."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def placed_in(rows: DataFrame, by: list[str], record: str) -> DataFrame:
    """``rows`` (a record once) with pos, 0 .. n - 1 within ``by``, and n: in order of record % BUCKETS, then record.

    Positions are taken within buckets and moved by the sizes of the buckets before.
    """
    bucket = rows.withColumn("_b", F.pmod(F.col(record), F.lit(BUCKETS)))
    size = bucket.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_c")
    size = size.withColumn("_before", before).withColumn("n", F.sum("_c").over(Window.partitionBy(*by))).drop("_c")
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(record)) - 1
    return bucket.withColumn("_p", place).join(size, [*by, "_b"]).withColumn("pos", F.col("_p") + F.col("_before")).drop("_b", "_p", "_before")


def image_draws(images: DataFrame, n_draws: int, n_slots: int, seed: int, replacement: bool = True) -> DataFrame:
    """draw, concept, pos, w (and other columns of ``images``): how often each draw takes each image.

    ``images``: concept, n (its number of images); of one concept there may be several, such as one a model,
    which share their draws. Without replacement the ``n_slots`` images of lowest hash are taken; ``short_of_images``
    tells which concepts have fewer, and they take all.
    """
    rest = [c for c in images.columns if c not in ("concept", "n")]
    if replacement:
        slots = images.select(*rest, "concept", "n", each(n_draws).alias("draw")).withColumn("slot", each(n_slots))
        at = F.pmod(md5_number(F.lit(seed), F.col("draw"), F.col("concept"), F.col("slot")), F.col("n"))
        return slots.select(*rest, "draw", "concept", at.alias("pos")).groupBy(*rest, "draw", "concept", "pos").agg(F.count("*").alias("w"))
    every = images.select(*rest, "concept", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos")).withColumn("draw", each(n_draws))
    place = F.row_number().over(Window.partitionBy(*rest, "draw", "concept").orderBy(md5_number(F.lit(seed), F.col("draw"), F.col("concept"), F.col("pos")), "pos"))
    return every.withColumn("_k", place).where(F.col("_k") <= n_slots).select(*rest, "draw", "concept", "pos", F.lit(1).cast("long").alias("w"))


def short_of_images(images: DataFrame, n_slots: int) -> DataFrame:
    """The rows of ``images`` (n) with too few images for a draw of ``n_slots`` without replacement."""
    return images.where(F.col("n") < n_slots)


def intervals(drawn: DataFrame, value: str, by: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """by, ci_low, ci_high: exact percentiles over the draws; NaN is left out."""
    x = F.nullif(F.col(value), F.lit(float("nan")))
    return drawn.groupBy(*by).agg(F.percentile(x, low).alias("ci_low"), F.percentile(x, high).alias("ci_high"))


def average_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal values share the mean of their ranks."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(s)] if len(s) else starts
    out = np.empty(len(v))
    out[order] = np.repeat((starts + ends + 1) / 2, ends - starts)
    return out


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson's correlation, 0 where a side has no variance."""
    a, b = a - a.mean(), b - b.mean()
    below = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / below if below else 0.0


def packed(edges: DataFrame) -> DataFrame:
    """model, i, j (places of the concepts in alphabetical order), s: one row a model. Too many edges are an error."""
    names = edges.select(F.explode(F.array("i", "j")).alias("concept")).distinct()
    # The concepts are those of a roster; all of them stand in one row.
    names = names.agg(F.sort_array(F.collect_set("concept")).alias("_c")).select(F.posexplode("_c").alias("_at", "concept"))
    at = lambda c: names.withColumnsRenamed({"concept": c, "_at": f"_{c}"})
    rows = edges.join(at("i"), "i").join(at("j"), "j").groupBy("model").agg(F.array_sort(F.collect_list(F.struct("_i", "_j", "s"))).alias("e"))
    e = F.when(F.size("e") <= EDGES, F.col("e")).otherwise(F.raise_error(F.lit("more concepts than a block may hold")))
    return rows.withColumn("e", e).select("model", F.col("e._i").alias("i"), F.col("e._j").alias("j"), F.col("e.s").alias("s"))


def concepts_of(edges: DataFrame) -> DataFrame:
    """One row with all concepts of the edges, in order."""
    return edges.select(F.explode(F.array("i", "j")).alias("c")).agg(F.sort_array(F.collect_set("c")).alias("concepts"))


class Pair:
    """The edges that two models share: concepts' places, ends among them, and both similarities."""

    def __init__(self, a: dict, b: dict):
        both, ia, ib = np.intersect1d(a["key"], b["key"], assume_unique=True, return_indices=True)
        self.a, self.b = a["s"][ia], b["s"][ib]
        i, j = both >> 32, both & 0xFFFFFFFF
        self.concepts = np.unique(np.r_[i, j])
        self.i, self.j = np.searchsorted(self.concepts, i), np.searchsorted(self.concepts, j)


def in_blocks(edges: DataFrame, draws: DataFrame, run: Callable[[Pair, pa.Table], list[tuple[np.ndarray, ...]]], columns: str) -> DataFrame:
    """model_a, model_b and ``columns`` of ``run`` for every pair of models and every block of ``draws`` (with a column block)."""
    models = packed(edges).withColumn("block", each(BLOCKS))
    types = [pa.int32() if c.split()[1] == "int" else pa.float64() for c in columns.split(", ")]
    names = [c.split()[0] for c in columns.split(", ")]

    def block(models: pa.Table, draws: pa.Table) -> pa.Table:
        sides = []
        for r in models.select(["model", "i", "j", "s"]).to_pylist() if draws.num_rows else ():
            i, j = np.array(r["i"], np.int64), np.array(r["j"], np.int64)
            sides.append({"model": r["model"], "key": (i << 32) | j, "s": np.array(r["s"], np.float64)})
        sides.sort(key=lambda m: m["model"])
        out: list[list] = [[] for _ in range(2 + len(names))]
        for x, a in enumerate(sides):
            for b in sides[x + 1 :]:
                pair = Pair(a, b)
                if not len(pair.a):
                    continue
                found = run(pair, draws)
                n = len(found[0])
                for o, v in zip(out, ([a["model"]] * n, [b["model"]] * n, *[np.asarray(f).tolist() for f in found])):
                    o.extend(v)
        return pa.table([pa.array(v, t) for v, t in zip(out, [pa.string(), pa.string(), *types])], names=["model_a", "model_b", *names])

    return models.groupBy("block").cogroup(draws.groupBy("block")).applyInArrow(block, "model_a string, model_b string, " + columns)


def _hashed(edges: DataFrame, draws: DataFrame, seed: int, *parts: Column) -> DataFrame:
    """``draws`` with block, and h: a number for every concept in order."""
    every = draws.join(F.broadcast(concepts_of(edges)))
    h = F.transform("concepts", lambda c: md5_number(F.lit(seed), *parts, c))
    return every.select(*draws.columns, F.pmod(F.xxhash64(*draws.columns), F.lit(BLOCKS)).cast("int").alias("block"), h.alias("h"))


def mantel(edges: DataFrame, n_permutations: int, seed: int = 42) -> DataFrame:
    """model_a, model_b, rho, p: a two-sided Mantel test over the shared concepts, p = (hits + 1) / (n + 1).

    Relabelling the concepts of one matrix moves its ranks about but keeps their mean and spread, so
    ranks and norms are taken once and each permutation only adds up products of centred ranks. A
    permutation is the order of the concepts by md5 of (seed, permutation, concept); all pairs share them.
    """
    spark = edges.sparkSession
    perms = _hashed(edges, spark.range(1, n_permutations + 1).select(F.col("id").cast("int").alias("perm")), seed, F.col("perm"))

    def run(p: Pair, draws: pa.Table) -> list:
        h = matrix(draws.column("h"))[:, p.concepts]
        a, b = average_ranks(p.a), average_ranks(p.b)
        a, b = a - a.mean(), b - b.mean()
        below = float(np.linalg.norm(a) * np.linalg.norm(b))
        observed = float(a @ b) / below if below else 0.0
        full = np.zeros((len(p.concepts),) * 2)
        full[p.i, p.j] = full[p.j, p.i] = a
        to = np.argsort(np.argsort(h, axis=1, kind="stable"), axis=1)
        hits, step = 0, max(1, (1 << 20) // len(b))
        for k in range(0, len(to), step):
            s = full[to[k : k + step][:, p.i], to[k : k + step][:, p.j]] @ b
            rho = s / below if below else np.zeros(len(s))
            hits += int((np.abs(rho).round(10) >= round(abs(observed), 10)).sum())
        return [np.array([observed]), np.array([hits])]

    found = in_blocks(edges, perms, run, "rho double, hits int")
    return found.groupBy("model_a", "model_b").agg(F.min("rho").alias("rho"), ((F.sum("hits") + 1) / (n_permutations + 1.0)).alias("p"))


def edge_bootstrap(edges: DataFrame, n_draws: int, seed: int = 42) -> DataFrame:
    """draw, model_a, model_b, rho over edges drawn with replacement, by the same hashes for all pairs.

    Slot k of a draw takes the edge ``hash % n`` of a pair's n shared edges in order of their concepts. An edge
    drawn w times counts w times; ranks come from one sort of each side and running sums of the weights.
    """
    spark = edges.sparkSession
    most = edges.groupBy("model").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    draws = spark.range(n_draws).select(F.col("id").cast("int").alias("draw")).join(F.broadcast(most))
    h = F.transform(F.sequence(F.lit(0), F.col("most") - 1), lambda slot: md5_number(F.lit(seed), F.col("draw"), slot))
    draws = draws.where("most > 0").select("draw", F.pmod("draw", F.lit(BLOCKS)).alias("block"), h.alias("h"))

    def run(p: Pair, draws: pa.Table) -> list:
        n = len(p.a)
        sides = []
        for v in (p.a, p.b):
            order = np.argsort(v, kind="stable")
            _, start = np.unique(v[order], return_index=True)
            sides.append((order, start))
        out = []
        for h in draws.column("h"):
            w = np.bincount(h.values.to_numpy()[:n] % n, minlength=n)
            r = []
            for order, start in sides:
                tied = np.add.reduceat(w[order], start)
                mean = np.cumsum(tied) - (tied - 1) / 2.0
                rank = np.empty(n)
                rank[order] = np.repeat(mean, np.diff(np.r_[start, n]))
                r.append(rank - (rank * w).sum() / n)
            below = float(np.sqrt((w * r[0] ** 2).sum()) * np.sqrt((w * r[1] ** 2).sum()))
            out.append(float((w * r[0] * r[1]).sum()) / below if round(below, 9) else 0.0)
        return [draws.column("draw").to_numpy(), np.array(out)]

    return in_blocks(edges, draws, run, "draw int, rho double")


def subset_rsa(edges: DataFrame, sizes: list[int], n_draws: int, seed: int = 42) -> DataFrame:
    """k, draw, model_a, model_b, rho on ``k`` of a pair's shared concepts, those of lowest md5 in each draw.

    A pair with fewer than ``k`` shared concepts has no rows for that ``k``.
    """
    spark = edges.sparkSession
    draws = spark.range(n_draws).select(F.col("id").cast("int").alias("draw")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes])))
    draws = _hashed(edges, draws, seed, F.col("k"), F.col("draw"))

    def run(p: Pair, draws: pa.Table) -> list:
        h, ks = matrix(draws.column("h"))[:, p.concepts], draws.column("k").to_numpy()
        out: list[list] = [[], [], []]
        at = np.full((len(p.concepts),) * 2, -1)
        at[p.i, p.j] = np.arange(len(p.a))
        for row, k, draw in zip(np.argsort(h, axis=1, kind="stable"), ks.tolist(), draws.column("draw").to_pylist()):
            if k > len(p.concepts):
                continue
            some = np.sort(row[:k])
            edge = at[some[:, None], some[None, :]][np.triu_indices(k, 1)]
            edge = edge[edge >= 0]
            if len(edge):
                for o, v in zip(out, (k, draw, pearson(average_ranks(p.a[edge]), average_ranks(p.b[edge])))):
                    o.append(v)
        return out

    return in_blocks(edges, draws, run, "k int, draw int, rho double")


def bootstrap_rsa(moving: DataFrame, fixed: DataFrame, n_draws: int, n_slots: int, seed: int = 42) -> DataFrame:
    """draw, model_a, model_b, rho over resampled images of the ``moving`` models; pairs of two ``fixed`` ones have none.

    ``moving``: model, concept, pos, n, x, a row an image (see ``placed_in``); ``fixed``: model, concept, x. A draw takes
    ``n_slots`` images of a concept with replacement, image ``hash % n`` for the hash of (draw, concept, slot), so models
    share their draws. Only images that some draw takes are gathered: at most draws x slots of a concept and model.
    """
    counts = moving.groupBy("model", "concept").agg(F.max("n").alias("n"))
    slots = counts.select("model", "concept", "n", F.explode(F.sequence(F.lit(0), F.lit(n_draws * n_slots - 1))).alias("_q"))
    draw, slot = F.floor(F.col("_q") / n_slots).cast("int"), F.pmod("_q", F.lit(n_slots))
    taken = slots.select("model", "concept", F.pmod(md5_number(F.lit(seed), draw, F.col("concept"), slot), F.col("n")).alias("pos"), "_q")
    picked = moving.select("model", "concept", "pos", "x").join(taken.select("model", "concept", "pos").distinct(), ["model", "concept", "pos"], "left_semi")
    size = -(-n_draws // BLOCKS)

    def means(images: pa.Table, taken: pa.Table) -> pa.Table:
        if not images.num_rows or not taken.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()))], names=["block", "model", "concept", "u"])
        x, pos = matrix(images.column("x")), images.column("pos").to_numpy()
        order = np.argsort(pos)
        at = order[np.searchsorted(pos[order], taken.column("pos").to_numpy()[np.argsort(taken.column("_q").to_numpy())])]
        u = unit_rows(np.concatenate([x[at[k * n_slots : (k + 1) * n_slots]].mean(axis=0, keepdims=True) for k in range(n_draws)]))
        blocks = range(0, n_draws, size)
        flat = pa.array([u[b : b + size].ravel().tolist() for b in blocks], pa.list_(pa.float64()))
        return pa.table([pa.array([b // size for b in blocks], pa.int32()), *[pa.array([images.column(c)[0].as_py()] * len(blocks), pa.string()) for c in ("model", "concept")], flat], names=["block", "model", "concept", "u"])

    by = ["model", "concept"]
    asked = taken.select(F.col("model").alias("_m"), F.col("concept").alias("_c"), "pos", "_q")
    moved = picked.groupBy(*by).cogroup(asked.groupBy("_m", "_c")).applyInArrow(means, "block int, model string, concept string, u array<double>")
    still = fixed.select(each(-(-n_draws // size)).alias("block"), "model", "concept", F.col("x").alias("u"))
    rows = moved.withColumn("_still", F.lit(False)).unionByName(still.withColumn("_still", F.lit(True)))

    def correlate(table: pa.Table) -> pa.Table:
        first = int(table.column("block")[0].as_py()) * size
        here = min(size, n_draws - first)
        sides = {}
        for (model, same), at in groups(table, ["model", "_still"]):
            own = table.take(pa.array(at)).sort_by("concept")
            sides[model] = (own.column("concept").to_pylist(), matrix(own.column("u")), same)
        out: list[list] = [[], [], [], []]
        names = sorted(sides)
        for x, a in enumerate(names):
            for b in names[x + 1 :]:
                (ca, ua, sa), (cb, ub, sb) = sides[a], sides[b]
                shared = sorted(set(ca) & set(cb))
                if (sa and sb) or len(shared) < 2:
                    continue
                upper = np.triu_indices(len(shared), 1)
                ia, ib = [ca.index(c) for c in shared], [cb.index(c) for c in shared]
                ranks: list = [None, None]
                for d in range(here):
                    for side, (at, u, same) in enumerate(((ia, ua, sa), (ib, ub, sb))):
                        if ranks[side] is None or not same:
                            v = u[at] if same else u[at].reshape(len(at), here, -1)[:, d]
                            v = unit_rows(v)
                            ranks[side] = average_ranks(cosines(v, v)[upper])
                    for o, v in zip(out, (first + d, a, b, pearson(*ranks))):
                        o.append(v)
        return pa.table([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.string(), pa.string(), pa.float64()))], names=["draw", "model_a", "model_b", "rho"])

    return rows.groupBy("block").applyInArrow(correlate, "draw int, model_a string, model_b string, rho double")


def holdout_rsa(edges: DataFrame, group_of: DataFrame, group: str, minimum: int) -> DataFrame:
    """mode, group, model_a, model_b, rho, n_concepts: without each group of concepts, and with it alone.

    ``group_of``: concept, ``group``, a concept once. A scenario with fewer than ``minimum`` concepts is skipped.
    """
    there = edges.select(F.explode(F.array("i", "j")).alias("concept")).distinct().join(group_of, "concept")
    sizes = there.groupBy(group).agg(F.count("*").alias("_c"))
    total = there.agg(F.count("*").alias("_total"), F.collect_set(group).alias("_all"))
    both = sizes.join(F.broadcast(total.select("_total"))).select(F.col(group).alias("held"), F.explode(F.array(F.struct(F.lit("only").alias("mode"), F.col("_c").alias("n_concepts")), F.struct(F.lit("without").alias("mode"), (F.col("_total") - F.col("_c")).alias("n_concepts")))).alias("s")).select("held", "s.*")
    enough = both.where(F.col("n_concepts") >= minimum)
    at = lambda c: group_of.select(F.col("concept").alias(c), F.col(group).alias(f"_{c}"))
    marked = edges.join(at("i"), "i").join(at("j"), "j").join(F.broadcast(total.select("_all")))
    without = F.transform(F.array_except("_all", F.array("_i", "_j")), lambda g: F.struct(F.lit("without").alias("mode"), g.alias("held")))
    only = F.when(F.col("_i") == F.col("_j"), F.array(F.struct(F.lit("only").alias("mode"), F.col("_i").alias("held")))).otherwise(F.array().cast(f"array<struct<mode:string,held:{dict(group_of.dtypes)[group]}>>"))
    rows = marked.select("model", "i", "j", "s", F.explode(F.concat(without, only)).alias("x")).select("model", "i", "j", "s", "x.*").join(enough, ["mode", "held"], "left_semi")
    return rsa_pairs(rows, ["mode", "held"]).join(enough, ["mode", "held"]).select("mode", F.col("held").alias(group), "model_a", "model_b", "rho", "n_concepts")
