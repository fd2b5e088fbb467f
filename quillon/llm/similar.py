"""The k most similar vectors of every vector, by multiprobe p-stable hashing and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.pstable import SLACK, HashParams, candidates, scan
from quillon.llm.shards import MARGIN, SHARD_ROWS, Cells, by_part, fit_cells, matrix, part_sizes, placed, unit
from quillon.plans.durable import durable, lookup_join

#: Cosines are compared to so many decimals; below that, equal directions count as equally similar.
DECIMALS = 9
#: Vectors that a map task remembers to have sent, so as not to send further copies.
REMEMBERED = 100_000
#: Rows of a piece, and asking rows of a block, in an exact scan.
SCAN_ROWS, SCAN_ASKS = 65_536, 16_384
FOUND = "vector_id long, neighbour_id long, cosine double"


def _collapsed(vectors: pa.Array, ids: list[list[int]], keep: int) -> tuple[np.ndarray, list[list[int]]]:
    """The places of the distinct vectors, and of each the ``keep`` smallest ids that have it."""
    x = np.ascontiguousarray(matrix(vectors))
    _, first, code = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
    merged = [ids[i] for i in first.tolist()]
    extra: dict[int, set[int]] = {}
    for i in np.flatnonzero(first[code] != np.arange(len(code))).tolist():
        extra.setdefault(int(code[i]), set()).update(ids[i])
    for c, more in extra.items():
        merged[c] = sorted(more.union(merged[c]))[:keep]
    return first, merged


def _sender(keys: list[str], cells: Cells, margin: float, keep: int, ask_every: int):
    """Rows of a map task to their cells: distinct vectors with their ``keep`` smallest ids.

    Copies are collapsed on the way, in each batch and, while there is room to remember them, over the
    whole task, so a vector that a third of all rows repeat is sent a few times a task.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple, list[int]] = {}
        for batch in batches:
            for key, at in by_part(batch, keys):
                own = batch.take(pa.array(at))
                vectors = own.column("_v")
                first, ids = _collapsed(vectors, [[i] for i in own.column("_id").to_pylist()], keep)
                new = np.ones(len(first), bool)
                for j in [j for j, i in enumerate(ids) if len(i) > 1]:
                    name = (key, hash(tuple(vectors[int(first[j])].as_py())))
                    before = sent.get(name)
                    after = sorted({*ids[j], *(before or ())})[:keep]
                    new[j] = after != before
                    if before is not None or len(sent) < REMEMBERED:
                        sent[name] = after
                first, ids = first[new], [i for i, n in zip(ids, new.tolist()) if n]
                own = own.take(pa.array(first))
                x = unit(matrix(own.column("_v"))).astype(np.float32)
                # Copies take the same piece: it goes by the vector, not by the id.
                lead = x.view(np.uint32).astype(np.uint64)
                code = (lead * (np.arange(x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(axis=1)
                rows, cell, piece, home = placed(x, code, key, cells, cells.distinct, margin)
                asks = np.array([any(i % ask_every == 0 for i in some) for some in ids], bool)[rows] if ask_every > 1 else np.ones(len(rows), bool)
                rows, cell, piece, home, asks = (z[home | asks] for z in (rows, cell, piece, home, asks))
                own = own.take(pa.array(rows))
                lists = pa.array([ids[r] for r in rows.tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[own.column(k) for k in keys], pa.array(cell), pa.array(piece), pa.array(home), pa.array(asks), lists, own.column("_v")], names=[*keys, "_shard", "_piece", "_home", "_asks", "_ids", "_v"])

    return send


def _answers(x64: np.ndarray, ids: list[list[int]], asks: np.ndarray, home: np.ndarray, q: np.ndarray, c: np.ndarray, k: int, least: float, both: bool) -> pa.Table:
    """The rows of the result for pairs (asking row, base row), reranked in double precision.

    ``asks`` and ``home`` are flags of all rows. With ``both``, a base row learns of the visitors that found it, too.
    """
    s = np.concatenate([np.einsum("ij,ij->i", x64[q[i : i + 65536]], x64[c[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.empty(0)]).round(DECIMALS)
    ok = (q != c) & (s >= least)
    q, c, s = q[ok], c[ok], s[ok]
    if both:
        back = ~home[q] & asks[c]
        q, c, s = np.r_[q, c[back]], np.r_[c, q[back]], np.r_[s, s[back]]
    # Copies of a vector at home are each other's neighbours.
    own = np.flatnonzero(home & asks & np.array([len(i) > 1 for i in ids], bool))
    q, c, s = np.r_[q, own], np.r_[c, own], np.r_[s, np.ones(len(own))]
    lowest = np.array([i[0] for i in ids], np.int64)
    order = np.lexsort((lowest[c], -s, q))
    q, c, s = q[order], c[order], s[order]
    top = np.arange(len(q)) - np.searchsorted(q, q, "left") <= k
    q, c, s = q[top], c[top], s[top]
    count = np.array([len(i) for i in ids], np.int64)
    flat, start = np.fromiter((i for some in ids for i in some), np.int64), np.cumsum(count) - count

    def each(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of every row as often as it has ids, and those ids."""
        at = np.repeat(np.arange(len(rows)), count[rows])
        within = np.arange(len(at)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
        return at, flat[start[rows][at] + within]

    at, b = each(c)
    q, s = q[at], s[at]
    at, a = each(q)
    b, s = b[at], s[at]
    ok = a != b
    a, b, s = a[ok], b[ok], s[ok]
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    ok = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
    return pa.table({"vector_id": pa.array(a[ok], pa.int64()), "neighbour_id": pa.array(b[ok], pa.int64()), "cosine": pa.array(s[ok], pa.float64())})


def _table(table: pa.Table, keep: int) -> tuple[np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
    """Unit vectors, ids, home? and asks? of the distinct vectors of a task's rows."""
    vectors = table.column("_v").combine_chunks()
    if not len(vectors):
        return np.empty((0, 1)), [], np.empty(0, bool), np.empty(0, bool)
    home, asks = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("_home", "_asks"))
    first, ids = _collapsed(vectors, table.column("_ids").to_pylist(), keep)
    if len(first) == len(home):
        return unit(matrix(vectors))[first], ids, home[first], asks[first]
    x = np.ascontiguousarray(matrix(vectors))
    _, code = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    flags = [np.bincount(code, weights=f) > 0 for f in (home, asks)]
    return unit(x[first]), ids, *flags


def _search(k: int, least: float, params: HashParams):
    def run(table: pa.Table) -> pa.Table:
        x64, ids, home, asks = _table(table, k + 1)
        base, ask = np.flatnonzero(home), np.flatnonzero(asks)
        x = x64.astype(np.float32)
        best = candidates(x[base], x[ask], k, params, least) if len(base) and len(ask) else (np.empty(0, np.int64),) * 3
        q, c = _with_ties(x, base, ask[best[0]], base[best[1]], best[2], k)
        return _answers(x64, ids, asks, home, q, c, k, least, True)

    return run


def _scan(k: int, least: float):
    """The exact answer of a block of asking vectors over one piece of their part."""

    def run(table: pa.Table) -> pa.Table:
        x64, ids, home, asks = _table(table, k + 1)
        base, ask = np.flatnonzero(home), np.flatnonzero(asks)
        x = x64.astype(np.float32)
        best = scan(x[base], x[ask], k, least) if len(base) and len(ask) else (np.empty(0, np.int64),) * 3
        q, c = _with_ties(x, base, ask[best[0]], base[best[1]], best[2], k)
        return _answers(x64, ids, asks, home, q, c, k, least, False)

    return run


def _with_ties(x: np.ndarray, home: np.ndarray, q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows as near as a query's k-th, for queries whose kept candidates end within a run of equals.

    Such runs, of vectors that differ in length only, can be longer than what a query keeps; they are
    read off exactly, in blocks.
    """
    if not len(q):
        return q, c
    order = np.lexsort((-s, q))
    qs, ss = q[order], s[order]
    ask, first, size = np.unique(qs, return_index=True, return_counts=True)
    long = size == k + SLACK
    kth, last = ss[first[long] + k - 1], ss[first[long] + k + SLACK - 1]
    tied = kth - last < 1e-6
    open_, floors = ask[long][tied], (kth - 1e-6)[tied].astype(np.float32)
    if not len(open_):
        return q, c
    more_q, more_c = [q], [c]
    for lo in range(0, len(open_), 512):
        rows = open_[lo : lo + 512]
        i, j = np.nonzero(x[rows] @ x[home].T >= floors[lo : lo + 512, None])
        more_q.append(rows[i])
        more_c.append(home[j])
    pair = np.unique((np.concatenate(more_q) << 32) | np.concatenate(more_c))
    return pair >> 32, pair & 0xFFFFFFFF


def _scanned(rows: DataFrame, found: DataFrame, keys: list[str], sizes: DataFrame, k: int, least: float, sure: float, ask_every: int) -> DataFrame:
    """The exact lists of the asking vectors that have fewer than ``k`` neighbours at ``sure`` or above in ``found``.

    Each asks every row of its part: pieces are cut by row hash and the asking vectors go by in blocks,
    so that no task grows with the part.
    """
    done = found.where(F.col("cosine") >= sure).groupBy("vector_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select(F.col("vector_id").alias("_id"))
    asks = rows.where(F.pmod("_id", F.lit(ask_every)) == 0).join(done, "_id", "left_anti").select(*rows.columns)
    # There are no more blocks than the part's asking rows need, if all of them were open.
    cut = lambda rows_a_cut: F.greatest(F.lit(1), F.ceil(F.col("_n") / rows_a_cut)).cast("int")
    plan = durable(asks.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, cut(SCAN_ASKS).alias("_blocks")).join(sizes.select(*keys, cut(SCAN_ROWS).alias("_pieces")), keys))
    zero, h = F.lit(0), F.xxhash64("_id")
    base = lookup_join(rows, plan, keys, "inner", "_id").withColumns({"_piece": F.pmod(h, "_pieces").cast("int"), "_block": F.explode(F.sequence(zero, F.col("_blocks") - 1)), "_home": F.lit(True), "_asks": F.lit(False)})
    asks = lookup_join(asks, plan, keys, "inner", "_id").withColumns({"_block": F.pmod(F.shiftright(h, 20), "_blocks").cast("int"), "_piece": F.explode(F.sequence(zero, F.col("_pieces") - 1)), "_home": F.lit(False), "_asks": F.lit(True)})
    columns = [*keys, "_piece", "_block", "_home", "_asks", F.array("_id").alias("_ids"), "_v"]
    return base.select(*columns).unionByName(asks.select(*columns)).groupBy(*keys, "_piece", "_block").applyInArrow(_scan(k, least), FOUND)


def similar_vectors(df: DataFrame, part: list[str], record: str, vector: str, k: int = 10, least: float = -1.0, params: HashParams = HashParams(), sure: float | None = None, ask_every: int = 1, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vector_id, neighbour_id, cosine, position: the ``k`` most similar others in the same part.

    ``df`` holds usable vectors (see ``usable_vector``); those of another length are another part.
    ``record`` is a bigint id, and a repeated id is the same vector again. Equal cosines (to nine decimals): smaller
    id first. Neighbours under ``least`` are left out. The rows whose id is divisible by ``ask_every``
    ask; all rows are searched. With ``sure``, a query with fewer than ``k`` hash candidates that similar
    is answered by an exact scan of its part, in blocks. A vector that is alone in its part has no
    neighbours; an empty table gives none. Null parts are a part of their own. Other columns are ignored.

    Vectors are hashed in cells of bounded size (``quillon.llm.shards``), whatever the size of the part;
    map tasks send distinct vectors instead of copies, each standing for its ``k + 1`` smallest ids.
    Further copies, however many, have those as their neighbours and are joined to them by id alone.
    """
    rows = df.select(*[F.coalesce(F.col(p).cast("string"), F.lit("\u0001")).alias(f"_p{i}") for i, p in enumerate(part)], F.size(vector).cast("string").alias("_dim"), F.col(record).cast("long").alias("_id"), F.col(vector).cast("array<float>").alias("_v"))
    keys = [*[f"_p{i}" for i in range(len(part))], "_dim"]
    sizes = part_sizes(rows, keys)
    cells = fit_cells(rows, keys, "_v", "_id", sizes, shard_rows, params.seed)
    types = ", ".join(f"{key} string" for key in keys)
    sent = rows.mapInArrow(_sender(keys, cells, MARGIN, k + 1, ask_every), f"{types}, _shard long, _piece long, _home boolean, _asks boolean, _ids array<long>, _v array<float>")
    found = sent.groupBy(*keys, "_shard", "_piece").applyInArrow(_search(k, least, params), FOUND)
    asking = F.pmod(F.col("vector_id"), F.lit(ask_every)) == 0
    if sure is not None:
        found = durable(found.where(asking))
        found = found.unionByName(_scanned(rows, found.distinct(), keys, sizes, k, least, sure, ask_every))
    # Of more than k + 1 copies, those beyond have the k smallest ids as their neighbours.
    ids = rows.select(F.xxhash64(*keys, "_v").alias("_h1"), F.hash("_v", *keys).alias("_h2"), "_id")
    ranked = ids.withColumn("_rank", F.dense_rank().over(Window.partitionBy("_h1", "_h2").orderBy("_id"))).where(F.col("_rank") <= k + 2)
    full = ranked.groupBy("_h1", "_h2").agg(F.max("_rank").alias("_m"), F.array_sort(F.collect_set("_id")).alias("_ids")).where(F.col("_m") > k + 1)
    full = durable(full.select("_h1", "_h2", F.slice("_ids", 1, k + 1).alias("_ids")))
    if not full.isEmpty():
        more = lookup_join(ids.distinct(), full, ["_h1", "_h2"], salt_on="_id").where(F.col("_id") > F.element_at("_ids", k + 1))
        found = found.unionByName(more.select(F.col("_id").alias("vector_id"), F.explode(F.slice("_ids", 1, k)).alias("neighbour_id"), F.lit(1.0).alias("cosine")))
    best = Window.partitionBy("vector_id").orderBy(F.col("cosine").desc(), F.col("neighbour_id"))
    # A visitor of several cells has a list from each.
    return found.where(asking).distinct().withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)
