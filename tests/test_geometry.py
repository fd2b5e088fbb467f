import numpy as np
import pytest
from tests.conftest import SMALL, rows

from quillon.operators.constraints import first_of, uniform, unique, violations
from quillon.operators.curation import average_hash, capped_splits, closure, greedy_accept, hamming, reachable, replace_in_place, upsert
from quillon.operators.geometry import centroids, cka_pairs, rsa_pairs, similarity_edges
from quillon.operators.ranking import average_rank, with_fdr
from quillon.operators.resample import average_ranks, bootstrap_rsa, edge_bootstrap, image_draws, mantel, placed_in, subset_rsa
from quillon.plans import inference
from pyspark.sql import functions as F


def arrays(spark, x):
    """x: model -> concept x dim."""
    data = [(m, c, [float(v) for v in row]) for m, a in x.items() for c, row in enumerate(a)]
    return spark.createDataFrame(data, "model string, concept int, x array<double>")


def ranks(v):
    order = np.argsort(v, kind="stable")
    r = np.empty(len(v))
    r[order] = np.arange(1, len(v) + 1)
    for x in np.unique(v):
        r[v == x] = r[v == x].mean()
    return r


def rho(a, b):
    out = []
    for x in (a, b):
        u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
        s = np.round(np.clip(u @ u.T, -1, 1)[np.triu_indices(len(x), 1)], 12)
        out.append(ranks(s))
    if out[0].std() * out[1].std() == 0:
        return 0.0
    return float(np.corrcoef(*out)[0, 1])


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 5))
    return {"a": base, "b": base + 0.5 * rng.normal(size=(12, 5)), "c": rng.normal(size=(12, 5)), "flat": np.ones((12, 5)), "zero": np.zeros((12, 5))}


def test_rsa_is_numpys(spark, x):
    got = {(r["model_a"], r["model_b"]): r["rho"] for r in rsa_pairs(similarity_edges(arrays(spark, x), ["model"])).collect()}
    assert len(got) == 10
    for (a, b), v in got.items():
        assert v == pytest.approx(rho(x[a], x[b]), abs=1e-9)


def test_rsa_ignores_scale(spark, x):
    one = {"a": x["a"], "b": x["b"]}
    two = {"a": x["a"] * 7, "b": x["b"] * 0.1}
    f = lambda d: rsa_pairs(similarity_edges(arrays(spark, d), ["model"])).first()["rho"]
    assert f(one) == pytest.approx(f(two), abs=1e-9)


def test_cka_is_numpys_and_ignores_rotation(spark, x):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(5, 5)))
    d = {"a": x["a"], "b": x["b"], "r": x["a"] @ q, "flat": x["flat"]}
    got = {(r["model_a"], r["model_b"]): r["cka"] for r in cka_pairs(arrays(spark, d)).collect()}

    def gram(m):
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        u = u - u.mean(axis=0)
        return u @ u.T

    a, b = gram(x["a"]), gram(x["b"])
    assert got["a", "b"] == pytest.approx((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()), abs=1e-9)
    assert got["a", "r"] == pytest.approx(1.0, abs=1e-9)
    assert got["a", "flat"] is None


def test_pairs_use_shared_concepts_only(spark, x):
    df = arrays(spark, {"a": x["a"], "b": x["b"]}).where("model = 'a' or concept < 7")
    r = rsa_pairs(similarity_edges(df, ["model"])).first()
    assert r["n_edges"] == 21 and r["rho"] == pytest.approx(rho(x["a"][:7], x["b"][:7]), abs=1e-9)


def test_centroids_are_means_and_lengths_are_checked(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 1, [3.0, 6.0]), ("a", 2, [0.0, 1.0])], "model string, concept int, x array<float>").repartition(3)
    assert rows(centroids(df, ["model"])) == [("a", 1, [2.0, 4.0]), ("a", 2, [0.0, 1.0])]
    bad = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 1, [3.0])], "model string, concept int, x array<float>")
    with pytest.raises(Exception, match="differ in length"):
        centroids(bad, ["model"]).collect()


def test_resampling_is_numpys(spark, x):
    e = similarity_edges(arrays(spark, {k: x[k] for k in "ab"}), ["model"])
    full = rho(x["a"], x["b"])
    all_of = {r["rho"] for r in subset_rsa(e, [12], 5).collect()}
    assert all(v == pytest.approx(full, abs=1e-9) for v in all_of) and subset_rsa(e, [13], 5).count() == 0
    drawn = [r["rho"] for r in edge_bootstrap(e, 40).collect()]
    assert len(drawn) == 40 and min(drawn) < full < max(drawn)
    assert average_ranks(np.array([3.0, 1.0, 3.0, 2.0])).tolist() == [3.5, 1.0, 3.5, 2.0]


def test_image_bootstrap(spark, x):
    rng = np.random.default_rng(3)
    data = [(i * 100 + n, "m", i, [float(v) for v in row + 0.1 * rng.normal(size=5)]) for i, row in enumerate(x["a"]) for n in range(i + 1)]
    df = placed_in(spark.createDataFrame(data, "vec_id long, model string, concept int, x array<double>").withColumn("concept", F.format_string("%02d", "concept")), ["model", "concept"], "vec_id")
    assert all(sorted(r["p"]) == list(range(r["n"])) for r in df.groupBy("concept", "n").agg(F.collect_list("pos").alias("p")).collect())
    fixed = arrays(spark, {"f": x["b"], "g": x["c"]}).withColumn("concept", F.format_string("%02d", "concept"))
    got = bootstrap_rsa(df, fixed, 30, 4).collect()
    assert {(r["model_a"], r["model_b"]) for r in got} == {("f", "m"), ("g", "m")} and {r["draw"] for r in got} == set(range(30))
    mean = np.mean([r["rho"] for r in got if r["model_a"] == "f"])
    assert abs(mean - rho(x["a"], x["b"])) < 0.2


def test_average_rank_and_fdr(spark):
    df = spark.createDataFrame([("g", v) for v in (3.0, 1.0, 3.0, 2.0)], "g string, v double")
    assert [r["r"] for r in df.withColumn("r", average_rank("v", "g")).orderBy("v").collect()] == [1.0, 2.0, 3.5, 3.5]
    p = [0.01, 0.04, 0.03, 0.5, 0.04]
    got = {r["k"]: r["q"] for r in with_fdr(spark.createDataFrame(list(enumerate(p)), "k int, p double"), "p", "k").collect()}
    order = sorted(range(5), key=lambda i: (p[i], i))
    want, low = {}, 1.0
    for place in range(5, 0, -1):
        low = min(low, p[order[place - 1]] * 5 / place)
        want[order[place - 1]] = low
    assert got == pytest.approx(want)
    assert all(got[i] >= p[i] for i in got)


def test_mantel_bounds(spark, x):
    got = mantel(similarity_edges(arrays(spark, {k: x[k] for k in "abc"}), ["model"]), 30).collect()
    for r in got:
        assert 1 / 31 <= r["p"] <= 1
        assert r["rho"] == pytest.approx(rho(x[r["model_a"]], x[r["model_b"]]), abs=1e-9)
    assert min(got, key=lambda r: r["p"])["model_b"] == "b"


def test_draws(spark):
    n = spark.createDataFrame([("c", 4), ("e", 9)], "concept string, n long")
    w = image_draws(n, 5, 6, 1).groupBy("draw", "concept").agg(F.sum("w").alias("w"), F.max("pos").alias("p")).collect()
    assert {r["w"] for r in w} == {6} and all(r["p"] < (4 if r["concept"] == "c" else 9) for r in w)
    without = image_draws(n, 5, 6, 1, replacement=False).groupBy("draw", "concept").count().collect()
    assert {(r["concept"], r["count"]) for r in without} == {("c", 4), ("e", 6)}


def test_closure_and_reach(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "b"), ("a", "c")], "child string, parent string")
    assert rows(closure(e)) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("x", "b", 1), ("x", "c", 2)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(None, 3), (20, 20)], "child int, parent int")
    up = closure(chain)
    assert up.where("child = 0").count() == 12 and up.where("child = 0").agg(F.max("level")).first()[0] == 12 and up.where("child = 20").count() == 1
    r = spark.createDataFrame([("c",)], "root string")
    assert rows(reachable(e, r, 1, 2).select("node", "level")) == [("a", 1), ("c", 0)]


def test_hash_and_distance(spark):
    df = spark.createDataFrame([([float(i == 63) for i in range(64)], [float(i < 2) for i in range(64)])], "a array<float>, b array<float>")
    r = df.select(average_hash(F.col("a")).alias("a"), average_hash(F.col("b")).alias("b")).select("a", "b", hamming(F.col("a"), F.col("b")).alias("d")).first()
    assert (r["a"], r["b"], r["d"]) == (-(1 << 63), 3, 3)


def test_greedy_accept(spark):
    data = [("c", 1, 0b0000, "s"), ("c", 2, 0b0001, "s"), ("c", 3, 0b1111, "s"), ("c", 4, 0b1111 << 8, "s"), ("c", 5, 0b1111, "t"), ("c", 6, 0b1111 << 20, "t"), (None, 7, 0, "s"), ("d", 8, 1 << 62, "s"), ("d", 9, (1 << 62) + 7, "s"), ("d", 10, None, "t"), ("d", 11, None, "t")]
    df = spark.createDataFrame(data, "g string, id long, h long, src string")
    got = sorted(map(tuple, greedy_accept(df, "g", "id", "h", "src", ["src", "id"], 2, 2).select("id", "accepted").collect()))
    # 2 is near 1; 4 comes after the quota of s and leaves no row; 5 is near 3, of another source.
    assert got == [(1, True), (2, False), (3, True), (5, False), (6, True), (8, True), (9, True), (10, True), (11, True)]


def test_capped_splits(spark):
    hits = spark.createDataFrame([("l", 1, i) for i in range(3)] + [("l", 2, i) for i in range(5)] + [("l", 3, 0)], "label string, split int, pos int")
    got = capped_splits(hits, "label", "split", ["pos"], 4).groupBy("split").count()
    assert rows(got) == [(1, 3), (2, 4)]


def test_upsert_and_replace(spark):
    t = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n int, s string")
    u = spark.createDataFrame([("a", None, "new"), ("z", 9, "no")], "k string, n int, s string")
    assert rows(upsert(t, u, ["k"], ["n", "s"])) == [("a", 1, "new"), ("b", 2, "x")]
    swaps = spark.createDataFrame([("a", "q")], "old string, new string")
    assert rows(replace_in_place(t.select("k"), "k", swaps)) == [("b", False), ("q", True)]


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, n int")
    v = lambda name, cond: violations(df, name, cond, F.col("k"), F.col("n"))
    assert rows(unique(df, ["k"], "u")) == [("u", "a", "2")]
    assert rows(uniform(df, ["k"], F.col("n"), "m")) == [("m", "a", "1..2")]
    assert rows(first_of(v("one", F.col("n") == 2), v("two", F.col("n") > 0))) == [("one", "a", "2"), ("two", "b", "5")]


def test_registered_counts_are_the_reference_s(spark):
    w = inference.QUERIES["bootstrap_draws"](spark, SMALL).groupBy("model", "draw", "concept").agg(F.sum("w").alias("w"))
    assert w.agg(F.countDistinct("draw"), F.min("w"), F.max("w")).first() == (300, 10, 10)
    assert (inference.PERMUTATIONS, inference.EDGE_DRAWS, inference.SUBSET_DRAWS, inference.SIZES) == (3000, 1000, 1000, [8, 10, 12, 15, 18])
