from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.functions.forms import label_form, path_form, uniform_hash, usable_score, usable_vector


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


def test_label_form(spark):
    for text, want in ((" Road - Craft ", "road_craft"), ("a__b", "a_b"), ("", None), (None, None), ("　x y ", "x_y"), ("-", "_")):
        assert one(spark, label_form("x"), text) == want


def test_path_form(spark):
    for text, want in ((" ./a\\b//c.jpg ", "a/b/c.jpg"), ("././a", "a"), ("", None), ("./", None), (None, None), ("A/b", "A/b"), (".//x", "x")):
        assert one(spark, path_form("x"), text) == want


def test_usable_score(spark):
    for v, want in ((0.0, True), (1.0, True), (1.1, False), (-0.1, False), (float("nan"), False), (None, False)):
        assert bool(one(spark, usable_score("x"), v, "double")) is want


def test_usable_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0], 2), ([0.0, 0.0], 2), ([1.0], 2), ([float("inf"), 1.0], 2), ([float("nan"), 1.0], 2), ([None, 1.0], 2), (None, 2), ([], 0), ([1.0, 2.0], None)], "v array<float>, d int")
    assert [r[0] for r in df.select(usable_vector("v", "d")).collect()] == [True] + [False] * 8


def test_uniform_hash_is_fixed_and_even(spark):
    u = [r[0] for r in spark.range(4000).select(uniform_hash(1, "id")).collect()]
    assert min(u) >= 0 and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.02
    assert u == [r[0] for r in spark.range(4000).repartition(3).sort("id").select(uniform_hash(1, "id")).collect()]


def test_slugs_keep_their_dialects(spark):
    assert one(spark, S.slug(F.col("x")), " Café au lait! ") == "caf_au_lait"
    assert one(spark, S.slug_unicode(F.col("x")), " Café au lait! ") == "café_au_lait"


def test_prompt_keeps_the_article_of_the_concept(spark):
    assert one(spark, S.prompt(F.col("x")), "apple") == "an photo of apple"


def test_float_map_last_one_wins(spark):
    assert one(spark, S.parse_float_map(F.col("x")), "a=1,b=x,a=2, c = 3") == {"a": 2.0, "c": 3.0}
    assert one(spark, S.parse_float_map(F.col("x")), "") == {}


def test_layers(spark):
    n = F.col("x")
    assert one(spark, S.layer_indices("aligned5", n), 6, "int") == [0, 1, 2, 4, 5]
    assert one(spark, S.layer_indices("aligned5", n), 2, "int") == [0, 1]
    assert one(spark, S.layer_indices("0,-1,-1", n), 3, "int") == [0, 2]
    assert one(spark, S.layer_indices("all", n), 3, "int") == [0, 1, 2]


def test_layer_outside_raises(spark):
    import pytest

    with pytest.raises(Exception, match="outside"):
        one(spark, S.layer_indices("7", F.col("x")), 3, "int")


def test_glob_and_labels(spark):
    assert one(spark, S.glob(F.col("x"), "data/*.jp?"), "data/a/b.jpg") is True
    assert one(spark, S.glob(F.col("x"), "a.c"), "abc") is False
    assert one(spark, S.depth_label(F.col("x")), 1.0, "double") == "d100"
    assert one(spark, S.depth_label(F.col("x")), 0.0, "double") == "d00"


def test_source_prefers_the_longest(spark):
    assert one(spark, S.source_of_file(F.col("x"), ["scans", "museo_scans"]), "a/pear_museo_scans_03.jpg") == "museo_scans"
    assert one(spark, S.source_of_file(F.col("x"), ["scans"]), "pear.jpg") is None
