import random
from datetime import datetime, timedelta

from tests.conftest import rows
from pyspark.sql import functions as F
import pytest

from quillon.operators.orphans import orphans
from quillon.plans import durable as durable_module

REF = "key string, at timestamp_ntz, key2 string"
PAR = "key string, valid_from timestamp_ntz, valid_to timestamp_ntz"


def run(spark, refs, parents):
    return rows(orphans(spark.createDataFrame([(*r, "x") for r in refs], REF), spark.createDataFrame(parents, PAR)).select("key", "at", "reason"))


def brute(refs, parents):
    out = []
    for k, t in refs:
        if k is None or t is None:
            continue
        spans = [(a, b) for x, a, b in parents if x == k and a is not None and (b is None or b > a)]
        if not any(a <= t and (b is None or t < b) for a, b in spans):
            before, after = any(b is not None and b <= t for a, b in spans), any(a > t for a, b in spans)
            out.append((k, t, "never" if not spans else "between" if before and after else "gone" if before else "later"))
    return sorted(out, key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("bound", [20_000, 0])
def test_against_brute_force(spark, bound, monkeypatch):
    monkeypatch.setattr(durable_module, "BROADCAST_ROWS", bound)
    rng = random.Random(3)
    day = lambda: datetime(2024, 1, 1) + timedelta(days=rng.randrange(200), hours=rng.choice([0, 7]))
    keys = [f"k{i}" for i in range(150)]
    parents = []
    for _ in range(200):
        a = day()
        parents.append((rng.choice(keys), a, rng.choice([None, a + timedelta(days=rng.randrange(-3, 90))])))
    parents += parents[:20] + [(None, day(), None), ("k1", None, None)]
    refs = [(rng.choice(keys + ["k1"] * 300), day()) for _ in range(900)] + [(None, day()), ("k2", None)]
    refs += refs[:10]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_month_borders(spark):
    d = datetime
    parents = [("a", d(2024, 2, 1), d(2024, 3, 1))]
    refs = [("a", d(2024, 2, 1)), ("a", d(2024, 2, 29, 23)), ("a", d(2024, 3, 1)), ("a", d(2024, 1, 31))]
    assert run(spark, refs, parents) == brute(refs, parents)
    assert len(run(spark, refs, parents)) == 2


def test_empty_tables(spark):
    t = datetime(2024, 5, 5)
    assert run(spark, [], [("a", t, None)]) == []
    assert run(spark, [("a", t)], []) == [("a", t, "never")]
    assert run(spark, [], []) == []


def test_more_keys_than_a_word(spark):
    t = datetime(2024, 5, 5)
    refs = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(t).cast("timestamp_ntz").alias("at"))
    parents = spark.range(0, 5000, 2).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    assert orphans(refs, parents).count() == 2500
