"""Multiprobe p-stable hashing of unit vectors, with exact reranking of the merged candidates."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Candidates that a query keeps beyond its k before the distances are taken in double precision.
SLACK = 12
_GEMM_PAIRS, _BLOCK, _SCAN_PAIRS = 2048, 1024, 1 << 24


@dataclass(frozen=True)
class HashParams:
    """``tables`` hash tables of ``hashes`` functions of slot width ``width``; ``probes`` extra buckets."""

    tables: int = 8
    hashes: int = 20
    width: float = 2.6
    probes: int = 40
    seed: int = 42


def probing_sequence(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks (1: the nearest slot boundary ... 2 x hashes: the farthest) in estimated success order.

    A set stands for moving over the boundaries of those ranks at once. Its cost is the expected sum
    of squared distances; a set that moves one function both ways is left out.
    """
    m = hashes
    cost = [0.0] + [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    found: list[tuple[int, ...]] = []
    heap = [(cost[1], (1,))]
    while heap and len(found) < probes:
        c, s = heapq.heappop(heap)
        if all(2 * m + 1 - j not in s for j in s):
            found.append(s)
        last = s[-1]
        if last < 2 * m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*s, last + 1)))
    return found


def projections(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count)).astype(np.float32)


def _codes(x: np.ndarray, a: np.ndarray, shift: np.ndarray, width: float, mult: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (x @ a + shift) / width
    slot = np.floor(at)
    return (slot.astype(np.int64) * mult).sum(axis=1), at - slot


def _probes(frac: np.ndarray, mult: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """Offsets of the perturbed buckets' codes: one column a set."""
    m = frac.shape[1]
    distance = np.concatenate([frac, 1 - frac], axis=1)
    step = np.concatenate([-mult, mult])[np.argsort(distance, axis=1)]
    out = np.zeros((len(frac), len(sets)), np.int64)
    for t, s in enumerate(sets):
        for rank in s:
            out[:, t] += step[:, rank - 1]
    return out if m else out[:, :0]


def _merge(q: np.ndarray, c: np.ndarray, s: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best distinct candidates of each query."""
    # The same pair may come from several tables and probes, with the last bits apart.
    _, one = np.unique((q << 32) | c, return_index=True)
    q, c, s = q[one], c[one], s[one]
    # Products of unit vectors in single precision may be a little over 1.
    order = np.argsort((q << 32) | (np.clip(1 - s, 0, 2) * (1 << 30)).astype(np.int64), kind="stable")
    q, c, s = q[order], c[order], s[order]
    ok = np.arange(len(q)) - np.searchsorted(q, q, "left") < keep
    return q[ok], c[ok], s[ok]


def candidates(base: np.ndarray, queries: np.ndarray, k: int, p: HashParams, least: float = -1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base row, similarity) of the best ``k + SLACK`` hash candidates of each query.

    ``base`` and ``queries`` are unit vectors in single precision. A bucket's candidates are scored
    as one block product, small ones pair by pair; no bucket is capped. Pairs under ``least`` are
    left out as soon as they are scored.
    """
    floor = least - 1e-5
    dim, keep = base.shape[1], k + SLACK
    rng = np.random.default_rng([p.seed, dim, 1])
    a = projections(dim, p.tables * p.hashes, p.seed)
    shifts = rng.uniform(0, p.width, p.tables * p.hashes).astype(np.float32)
    mults = rng.integers(1, 1 << 62, p.tables * p.hashes) | 1
    sets = probing_sequence(p.hashes, p.probes)
    best = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float32))
    for t in range(p.tables):
        part = slice(t * p.hashes, (t + 1) * p.hashes)
        code, _ = _codes(base, a[:, part], shifts[part], p.width, mults[part])
        order = np.argsort(code, kind="stable")
        code = code[order]
        own, frac = _codes(queries, a[:, part], shifts[part], p.width, mults[part])
        asked = np.concatenate([own[:, None], own[:, None] + _probes(frac, mults[part], sets)], axis=1).ravel()
        who = np.repeat(np.arange(len(queries)), len(sets) + 1)
        bucket, low, size = np.unique(code, return_index=True, return_counts=True)
        at = np.minimum(np.searchsorted(bucket, asked), max(len(bucket) - 1, 0))
        hit = bucket[at] == asked if len(bucket) else np.zeros(len(asked), bool)
        who, low, size = who[hit], low[at[hit]], size[at[hit]]
        by = np.argsort(low, kind="stable")
        who, low, size = who[by], low[by], size[by]
        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.empty(0, np.int64)
        counts = np.diff(np.r_[starts, len(low)])
        found = [best]
        big = counts * size[starts] >= _GEMM_PAIRS
        for i, n in zip(starts[big], counts[big]):
            rows = order[low[i] : low[i] + size[i]]
            members = base[rows]
            for j in range(i, i + n, _BLOCK):
                ask = who[j : min(j + _BLOCK, i + n)]
                sims = queries[ask] @ members.T
                if len(rows) > keep:
                    top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
                    q, c, sims = np.repeat(ask, keep), rows[top].ravel(), np.take_along_axis(sims, top, 1).ravel()
                else:
                    q, c, sims = np.repeat(ask, len(rows)), np.tile(rows, len(ask)), sims.ravel()
                near = sims >= floor
                found.append((q[near], c[near], sims[near]))
        small = ~np.repeat(big, counts)
        who, low, size = who[small], low[small], size[small]
        for lo in range(0, len(who), 1 << 16):
            w, l, n = who[lo : lo + (1 << 16)], low[lo : lo + (1 << 16)], size[lo : lo + (1 << 16)]
            q = np.repeat(w, n)
            within = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            c = order[np.repeat(l, n) + within]
            for x in range(0, len(q), 1 << 17):
                qs, cs = q[x : x + (1 << 17)], c[x : x + (1 << 17)]
                sims = np.einsum("ij,ij->i", queries[qs], base[cs])
                near = sims >= floor
                found.append((qs[near], cs[near], sims[near]))
        best = _merge(*(np.concatenate(z) for z in zip(*found)), keep)
    return best


def scan(base: np.ndarray, queries: np.ndarray, k: int, least: float = -1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base row, similarity) of the best ``k + SLACK`` rows of each query, by all products in blocks."""
    keep, found = min(k + SLACK, len(base)), []
    block = max(1, min(_BLOCK, _SCAN_PAIRS // max(1, len(base))))
    for lo in range(0, len(queries), block):
        sims = queries[lo : lo + block] @ base.T
        top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
        q, c, s = np.repeat(np.arange(lo, lo + len(sims)), keep), top.ravel(), np.take_along_axis(sims, top, 1).ravel()
        near = s >= least - 1e-5
        found.append((q[near], c[near], s[near]))
    return tuple(np.concatenate(z) for z in zip(*found))
