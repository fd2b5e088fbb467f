import os

import numpy as np
import pytest

from quillon.llm.cftree import CFTree, ward
from quillon.llm.clusters import cluster_vectors, describe
from quillon.llm.pstable import HashParams, _merge, candidates, probing_sequence
from quillon.llm.shards import centres_of, visited
from quillon.llm.similar import similar_vectors
from quillon.llm.vectors import EXACT, p1_found
from tests.conftest import SMALL, rows
from tests.sqlcheck import connect

SCHEMA = "id long, part string, v array<float>, extra string"


def clustered(seed, n, dim=32, sizes=(1, 2, 3, 12, 40)):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        centre = rng.normal(size=dim)
        for _ in range(rng.choice(sizes)):
            out.append((centre + 0.2 * rng.normal(size=dim)) * rng.uniform(0.1, 9))
    return np.array(out[:n], np.float32)


def frame(spark, groups):
    data, i = [], 0
    for part, x in groups.items():
        for v in x:
            data.append((i, part, [float(y) for y in v], "e"))
            i += 1
    rng = np.random.default_rng(0)
    again = [data[k] for k in rng.choice(len(data), 20)]
    return spark.createDataFrame(data + again, SCHEMA).repartition(3)


def truth(groups, k, least):
    lists, start, comps = {}, 0, set()
    for x in groups.values():
        u = x.astype(np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        s = np.round(u @ u.T, 9)
        np.fill_diagonal(s, -2)
        for i, r in enumerate(s):
            order = np.lexsort((np.arange(len(r)), -r))[:k]
            lists[start + i] = [start + int(j) for j in order if r[j] >= least]
            near = np.flatnonzero(r >= 0.8)
            if len(near):
                comps.add((start + min(int(near[0]), i), start + i))
        start += len(x)
    return lists, comps


@pytest.fixture(scope="module")
def groups():
    copies = np.tile(clustered(9, 1), (40, 1)) * np.linspace(1, 2, 40, dtype=np.float32)[:, None]
    same = np.tile(clustered(8, 1), (30, 1))
    return {"a": np.concatenate([clustered(1, 400), copies, same]), "b": clustered(2, 150), "one": clustered(3, 1)}


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_pairs_against_brute_force(spark, groups, shard_rows):
    lists, _ = truth(groups, 10, 0.8)
    got = {}
    for r in similar_vectors(frame(spark, groups), ["part"], "id", "v", 10, 0.8, shard_rows=shard_rows).collect():
        got.setdefault(r["vector_id"], {})[r["position"]] = r["neighbour_id"]
    hit = sum(len(set(got.get(i, {}).values()) & set(w)) for i, w in lists.items())
    assert hit / sum(len(w) for w in lists.values()) > 0.98
    # Exact copies: all others are equally near, so the smallest ids come first.
    first = 440
    for i in range(first, first + 30):
        assert [got[i][p] for p in sorted(got[i])] == [j for j in range(first, first + 11) if j != i][:10]


def test_complete_lists(spark, groups):
    lists, _ = truth(groups, 5, -1)
    found = similar_vectors(frame(spark, groups), ["part"], "id", "v", 5, sure=0.9, ask_every=7)
    got = {}
    for r in found.collect():
        got.setdefault(r["vector_id"], []).append((r["position"], r["neighbour_id"]))
    assert set(got) == {i for i in lists if i % 7 == 0 and lists[i]}
    right = sum([j for _, j in sorted(v)] == lists[i] for i, v in got.items())
    assert right / len(got) > 0.97


def test_complete_lists_do_not_depend_on_shards(spark, groups):
    """Lone vectors have their true neighbours in cells they do not visit."""
    rng = np.random.default_rng(4)
    groups = {**groups, "lone": rng.normal(size=(500, 32)).astype(np.float32)}
    lists, _ = truth(groups, 10, -1)
    got = {}
    for r in similar_vectors(frame(spark, groups), ["part"], "id", "v", 10, sure=0.9, ask_every=7, shard_rows=60).collect():
        got.setdefault(r["vector_id"], []).append((r["position"], r["neighbour_id"]))
    assert set(got) == {i for i in lists if i % 7 == 0 and lists[i]}
    assert sum([j for _, j in sorted(v)] == lists[i] for i, v in got.items()) / len(got) > 0.97


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_clusters_are_exact(spark, groups, shard_rows):
    _, comps = truth(groups, 1, 0.8)
    got = cluster_vectors(frame(spark, groups), ["part"], "id", "v", 0.8, shard_rows=shard_rows)
    assert {(r["cluster_id"], r["vector_id"]) for r in got.collect()} == comps


def test_description(spark, groups):
    df = frame(spark, groups).dropDuplicates(["id"])
    got = {r["cluster_id"]: r for r in describe(cluster_vectors(df, ["part"], "id", "v", 0.8)).collect()}
    _, comps = truth(groups, 1, 0.8)
    x = np.concatenate(list(groups.values())).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for c in {c for c, _ in comps}:
        ids = sorted(i for k, i in comps if k == c)
        s = x[ids] @ x[ids].T
        mean = np.round((s.sum(axis=1) - 1) / (len(ids) - 1), 5)
        assert got[c]["size"] == len(ids)
        best = mean[[ids.index(i) for i in got[c]["typical_members"]]]
        assert sorted(best, reverse=True) == pytest.approx(sorted(mean, reverse=True)[: len(best)], abs=2e-5)


def test_nothing_and_nulls(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similar_vectors(empty, ["part"], "id", "v").count() == 0
    assert cluster_vectors(empty, ["part"], "id", "v").count() == 0
    null = spark.createDataFrame([(1, None, [1.0, 0.0], None), (2, None, [1.0, 0.1], None), (3, "p", [1.0, 0.0], None), (4, None, [1.0, 0.0, 0.1], None)], SCHEMA)
    assert rows(similar_vectors(null, ["part"], "id", "v").select("vector_id", "neighbour_id")) == [(1, 2), (2, 1)]
    assert rows(cluster_vectors(null, ["part"], "id", "v").select("cluster_id", "vector_id")) == [(1, 1), (1, 2)]


def test_probing_order():
    found = probing_sequence(6, 20)
    assert found[0] == (1,) and len(set(found)) == 20
    assert all(13 - j not in s for s in found for j in s)


def test_candidates_of_odd_sizes():
    x = np.eye(3, dtype=np.float32)
    q, c, s = candidates(x[:0], x, 2, HashParams())
    assert len(q) == 0
    q, c, s = candidates(x, x[:1], 2, HashParams(tables=2))
    assert (0, 0) in set(zip(q.tolist(), c.tolist()))


def test_merge_keeps_the_best_of_each_query():
    s = np.array([1.0000001, 0.5, 1.0000001, 0.9, 0.9, 0.2], np.float32)
    q, c, sims = _merge(np.array([0, 0, 1, 1, 1, 1]), np.array([0, 1, 1, 0, 0, 2]), s, 2)
    assert list(zip(q.tolist(), c.tolist())) == [(0, 0), (0, 1), (1, 1), (1, 0)]


def test_cells_cover_near_vectors():
    x = clustered(6, 3000, 48)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = x @ x.T
    np.fill_diagonal(s, 0)
    a, b = np.nonzero(s >= 0.8)
    for count in (1, 4, 16, 64):
        centres = centres_of(x[: 32 * count], count, 1)
        row, cell, home = visited(x, centres, 0.04)
        assert home.sum() == len(x) and len(row) <= 4 * len(x)
        goes = np.zeros((len(x), len(centres)), bool)
        goes[row, cell] = True
        at = cell[home]
        assert (goes[a, at[b]] | goes[b, at[a]]).mean() > 0.97


def test_tree_and_ward():
    x = clustered(5, 500)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    tree = CFTree(32, 0.8)
    for i, v in enumerate(u):
        tree.insert(v, 1.0, i, i)
    sums, n, low, high = tree.leaves()
    assert n.sum() == 500 and np.allclose(sums.sum(axis=0), u.sum(axis=0), atol=1e-3)
    labels = ward(sums, n, 0.8)
    _, comps = truth({"a": x}, 1, 0.8)
    merged = {}
    for label, lo, count in zip(labels, low, n):
        a = merged.setdefault(label, [500, 0])
        a[0], a[1] = min(a[0], int(lo)), a[1] + int(count)
    sizes = {}
    for c, _ in comps:
        sizes[c] = sizes.get(c, 0) + 1
    assert {lo: k for lo, k in merged.values() if k > 1} == sizes


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_recall_of_the_query(spark):
    found = {tuple(r) for r in p1_found(spark, SMALL).collect()}
    exact = set(connect(SMALL).execute(EXACT["p1_found"]).fetchall())
    assert len(found & exact) >= 0.98 * len(exact) and len(found & exact) >= 0.98 * len(found)
