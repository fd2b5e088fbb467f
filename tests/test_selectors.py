import pytest
from pyspark.sql import functions as F

from quillon.operators.selectors import backfill, fallback, in_order, resolve_layer
from tests.conftest import rows


def test_layers_resolve(spark):
    df = spark.createDataFrame([("a", "layer_2", "layer_2"), ("a", "layer_10", "layer_2"), ("b", "layer_3", None), ("b", "layer_11", None), ("c", "layer_last", None), ("c", "layer_1", None), ("d", "x", None)], "m string, l string, d string")
    get = lambda r: dict(rows(resolve_layer(df, "m", "l", "d", r)))
    assert get("last") == {"a": "layer_2", "b": "layer_11", "c": "layer_last", "d": "x"}
    assert get("layer_10") == {"a": "layer_10", "b": "layer_11", "c": "layer_last", "d": "x"}
    assert get("default") == get("-1") == get("selected")


def test_in_order(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "k string, o int")
    assert rows(in_order(df, "k", "o", ["a", "z", "c"]).select("place", "k")) == [(1, "c"), (2, "a")]
    with pytest.raises(ValueError, match="z"):
        in_order(df, "k", "o", ["a", "z"], unknown="error")


def test_fallback(spark):
    one = spark.createDataFrame([("g", 1, 5), ("g", 1, 5)], "g string, id int, o int")
    two = spark.createDataFrame([("g", 1, 0), ("g", 2, 9), ("g", 3, 1), ("h", 4, 0)], "g string, id int, o int")
    assert rows(fallback([one, two], "g", "id", ["o"], 2)) == [("g", 1, 0, 1), ("g", 3, 1, 2), ("h", 4, 1, 1)]


def test_backfill(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, None)], "id int, s double")
    new = spark.createDataFrame([(1, 0.9), (2, 0.1)], "id int, new double")
    assert rows(backfill(df, new, "id", "s")) == [(1, 0.5), (2, 0.1), (3, None)]
    assert rows(backfill(df, new, "id", "s", overwrite=True).select("id", F.col("s"))) == [(1, 0.9), (2, 0.1), (3, None)]
