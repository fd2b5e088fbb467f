import random

import pytest
from pyspark.sql import functions as F

from quillon.llm.cutoff import DyadicCountTree, cutoffs, kept_records
from quillon.llm.quota import draw, quotas, supply
from quillon.llm.topn import top_n_per_group
from quillon.plans import durable as durable_module
from tests.conftest import rows

CAND = "id long, g string, s double, a double, source string"


def best(df, n=3, **kw):
    return top_n_per_group(df, "g", "s", [F.col("a").desc_nulls_last(), F.col("id")], n, "id", **kw)


def brute_best(data, n):
    out, seen = {}, set()
    for r in sorted(set(data), key=lambda r: (-(r[2] if r[2] is not None else -1), r[3] is None, -(r[3] or 0), r[0])):
        if r[1] is not None and r[2] is not None and r[0] not in seen:
            seen.add(r[0])
            out.setdefault(r[1], []).append(r[0])
    return sorted(i for ids in out.values() for i in ids[:n])


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    out = [(i, rng.choice(["hot"] * 5 + ["b", "c", "d", None] + [f"r{i % 40}"]), rng.choice([None, *[x / 20 for x in range(21)]]), rng.choice([None, 0.1, 0.2]), rng.choice(["s1"] * 6 + ["s2", "s3", None])) for i in range(2500)]
    return out + out[:100]


@pytest.mark.parametrize("shares", [(0.05, 0.3), (0.5,), (), (0.001, 0.01, 0.1, 0.9)])
def test_top_n(spark, data, shares):
    assert sorted(r["id"] for r in best(spark.createDataFrame(data, CAND), shares=shares).collect()) == brute_best(data, 3)


def test_top_n_ranks_and_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "g", 0.5, None, "x"), (2, "g", 0.5, 0.1, "x"), (3, "g", 0.9, None, "x")], CAND).withColumn("rank", F.lit("own"))
    assert rows(best(df, 2).select("__rank", "id", "rank")) == [(1, 3, "own"), (2, 2, "own")]


def test_top_n_edge_cases(spark):
    empty = spark.createDataFrame([], CAND)
    assert best(empty).count() == 0
    ties = spark.createDataFrame([(i, "g", 0.5, 0.1, "x") for i in range(50)] * 2, CAND)
    assert sorted(r["id"] for r in best(ties).collect()) == [0, 1, 2]
    assert best(spark.createDataFrame([(1, None, 0.5, None, None), (2, "g", None, None, None)], CAND)).count() == 0


def brute_cut(data, source, f):
    scores = sorted((s for _, s in {(r[0], r[2]) for r in data if r[4] == source and r[2] is not None}), reverse=True)
    need = max(1, -(-int(round(f * 1000)) * len(scores) // 1000))
    return (scores[need - 1], sum(s >= scores[need - 1] for s in scores)) if scores else (None, 0)


@pytest.mark.parametrize("depth", [2, 12])
def test_cutoffs(spark, data, depth):
    tree = DyadicCountTree(spark, depth=depth)
    tree.add_batch(spark.createDataFrame(data, CAND), "source", "s", "id")
    targets = spark.createDataFrame([("s1", 0.35), ("s2", 1.0), ("s3", 0.001), ("none", 0.5), (None, 0.1), ("s1", 0.2)], "source string, target_fraction double")
    found = {r["source"]: (r["cutoff"], r["kept"]) for r in cutoffs(tree, targets).collect()}
    assert found == {"s1": brute_cut(data, "s1", 0.35), "s2": brute_cut(data, "s2", 1.0), "s3": brute_cut(data, "s3", 0.001), "none": (None, 0)}
    kept = kept_records(tree, cutoffs(tree, targets)).groupBy("source").count()
    assert {r["source"]: r["count"] for r in kept.collect()} == {s: n for s, (c, n) in found.items() if n}


def test_batches_are_the_same_as_one(spark, data):
    targets = spark.createDataFrame([("s1", 0.35), ("s2", 0.5)], "source string, target_fraction double")
    one, many = DyadicCountTree(spark), DyadicCountTree(spark)
    one.add_batch(spark.createDataFrame(data, CAND), "source", "s", "id")
    for lo in range(0, len(data), 900):
        many.add_batch(spark.createDataFrame(data[max(0, lo - 50) : lo + 900], CAND), "source", "s", "id")
    assert rows(cutoffs(one, targets)) == rows(cutoffs(many, targets))


def test_tree_of_nothing(spark):
    tree = DyadicCountTree(spark)
    tree.add_batch(spark.createDataFrame([], CAND), "source", "s", "id")
    targets = spark.createDataFrame([("s1", 0.35)], "source string, target_fraction double")
    assert rows(cutoffs(tree, targets)) == [("s1", 0.35, 0, None, 0)]
    assert kept_records(tree, cutoffs(tree, targets)).count() == 0


MEM = "record long, run_id long, category_field string, category_value string"
TGT = "run_id long, category_field string, category_value string, target_share double, min_rows int, sample_size int"


def test_quota_sample(spark, monkeypatch):
    members = spark.createDataFrame([(i, 1, "f", "hot" if i % 3 else ("rare" if i % 30 == 0 else "mid")) for i in range(3000)], MEM)
    targets = spark.createDataFrame([(1, "f", "hot", 0.5, 0, 100), (1, "f", "hot", 0.5, 0, 100), (1, "f", "mid", 0.29, 0, 100), (1, "f", "rare", 0.01, 120, 100), (1, "f", "gone", 0.2, 5, 100), (1, "f", None, 0.2, 5, 100), (1, "f", "zero", 0.0, 0, 100)], TGT)
    for bound in (20_000, 0):
        monkeypatch.setattr(durable_module, "BROADCAST_ROWS", bound)
        s = supply(members, quotas(targets))
        assert {r["category_value"]: (r["quota"], r["n_available"], r["shortfall"]) for r in s.collect()} == {"hot": (50, 2000, 0), "mid": (29, 900, 0), "rare": (120, 100, 20), "gone": (20, 0, 20), "zero": (0, 0, 0)}
        got = draw(members, s, 5)
        assert rows(got.groupBy("category_value").count()) == [("hot", 50), ("mid", 29), ("rare", 100)]
        assert got.count() == got.distinct().count()
        assert rows(got) == rows(draw(members.repartition(7), s, 5))
        assert rows(got) != rows(draw(members, s, 6))


def test_quota_of_nothing(spark):
    e = supply(spark.createDataFrame([], MEM), quotas(spark.createDataFrame([], TGT)))
    assert e.count() == 0 and draw(spark.createDataFrame([], MEM), e).count() == 0


def test_tree_is_reopened(spark, tmp_path):
    schema = "id long, source string, score double"
    DyadicCountTree(spark, str(tmp_path)).add_batch(spark.createDataFrame([(1, "s", 0.1), (2, "s", 0.9)], schema), "source", "score", "id")
    DyadicCountTree(spark, str(tmp_path)).add_batch(spark.createDataFrame([(2, "s", 0.9), (3, "s", 0.5)], schema), "source", "score", "id")
    tree = DyadicCountTree(spark, str(tmp_path))
    assert sorted(r["record"] for r in tree.records().collect()) == [1, 2, 3]
    assert tree.nodes().where("node = 1").first()["n"] == 3
