import json

import pytest
from tests.conftest import SMALL, rows

from quillon.sources import files
from quillon.sources.inference import extract
from quillon.sources.pages import register
from quillon.streaming.ledger import last_states, run_to_table, tumbling_counts


def test_json_strict_and_lenient(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text('{"x": ')
    df = files.read_json(spark, str(tmp_path), "x int", strict=False)
    assert rows(df.select("x", "_file")) == [(1, "a.json"), (None, "b.json")]
    with pytest.raises(Exception):  # noqa: B017
        files.read_json(spark, str(tmp_path), "x int").collect()


def test_gzip_json_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "q", b ', None), (2, "line\nbreak", ["x", None])], "k int, s string, l array<string>")
    files.write_json(df, str(tmp_path / "j"), compressed=True)
    assert rows(files.read_json(spark, str(tmp_path / "j"), df.schema, lines=True).drop("_file")) == rows(df)
    assert files.write_one_csv(df.select("k", "s"), str(tmp_path / "c"))
    assert rows(files.read_csv(spark, str(tmp_path / "c"), "k int, s string")) == rows(df.select("k", "s"))
    assert files.read_csv(spark, str(tmp_path / "none"), "k int").count() == 0
    assert not files.write_one_csv(df.where("k > 5"), str(tmp_path / "empty")) and not (tmp_path / "empty").exists()
    with pytest.raises(Exception):  # noqa: B017
        files.write_one_csv(df.select("k"), str(tmp_path / "c"), keep=True)


def test_listing_and_verification(spark, tmp_path):
    import hashlib

    (tmp_path / "a.jpg").write_bytes(b"one")
    (tmp_path / "b.png").write_bytes(b"two")
    found = files.list_files(spark, str(tmp_path), content=True)
    assert files.list_files(spark, str(tmp_path), "*.jpg").count() == 1
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("a.jpg", 3, sha(b"one")), ("b.png", 3, sha(b"x")), ("c", 1, ""), ("b.png", 4, "")], "name string, size long, sha256 string")
    assert rows(files.verify(found, manifest)) == [("a.jpg", "ok"), ("b.png", "wrong_hash"), ("b.png", "wrong_size"), ("c", "missing")]
    assert files.latest_file(found, "a").first()["path"].endswith("a.jpg")


def test_panel_array_and_log(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# models\nA # first\n\n B\n")
    assert rows(files.read_panel(spark, str(tmp_path / "p.txt"))) == [("A", 1), ("B", 3)]
    (tmp_path / "r.sh").write_text('MODELS=(\n  "m1"\n  "m 2"\n)\nOTHER=("z")\n')
    assert rows(files.read_shell_array(spark, str(tmp_path / "r.sh"), "MODELS")) == [(0, "m1"), (1, "m 2")]
    (tmp_path / "l.log").write_text("Started: 2024-01-01T00:00:00\n<<< OK: m1 (12s)\n<<< OK: m2 (3s)\nFinished: 2024-01-01T00:01:30.5\n")
    r = files.read_run_log(spark, str(tmp_path / "l.log")).first()
    assert (r["seconds"], r["models"]) == (90.5, {"m1": 12, "m2": 3})
    (tmp_path / "m.log").write_text("Started: 2024-01-01T00:00:00\n<<< OK: a (1s)\n  <<< OK: a (2s)\n<<< OK: b c (3s)\nStarted: 2024-01-01T00:01:00\nFinished: 2024-01-01T00:01:30\n")
    r = files.read_run_log(spark, str(tmp_path / "m.log")).first()
    assert (r["seconds"], r["models"]) == (30.0, {"a": 2, "b c": 3})


def test_markdown(spark):
    text = files.markdown("T", spark.createDataFrame([("a|b", None)], "x string, y string"))
    assert text.splitlines()[-1] == "| a\\|b |  |"


def test_search_pages(spark, tmp_path):
    for q, pages in {"pear": [{"items": [{"id": 1, "url": "u.jpg", "title": "t"}, {"id": 2, "url": "v.SVG"}], "next": "n"}, {"items": [{"id": 1}, {"id": 3}]}], "fig": [{"items": [{"id": 9}]}]}.items():
        (tmp_path / q).mkdir()
        for i, p in enumerate(pages):
            (tmp_path / q / f"{i}.json").write_text(json.dumps(p))
    register(spark)
    df = spark.read.format("search_pages").option("path", str(tmp_path)).load()
    assert rows(df.select("query", "item_id")) == [("fig", "9"), ("pear", "1"), ("pear", "3")]
    assert rows(df.where("query = 'fig'").select("item_id")) == [("9",)]
    with pytest.raises(Exception, match="more than 1 pages"):
        spark.read.format("search_pages").option("path", str(tmp_path)).option("max_pages", "1").load().collect()


def test_extract_uses_the_cache(spark):
    import numpy as np

    df = spark.createDataFrame([("c", 0, "ab"), ("c", 1, "abc")], "concept string, pos long, payload string")
    load = lambda: lambda s: np.array([[[len(t), 1.0], [0.0, len(t)]] for t in s])
    first = extract(df, "m", load)
    assert rows(first.select("pos", "layer", "x"))[0] == (0, 0, [2.0, 1.0])

    def broken():
        raise RuntimeError("loaded")

    assert extract(df, "m", broken, cached=spark.createDataFrame(first.collect(), first.schema)).count() == 4


def test_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    data = [(i, t + timedelta(days=i), i % 2, "ab"[i % 3 % 2], 1.0) for i in range(8)]
    df = spark.createDataFrame(data + data[:2], "id long, ts timestamp, user long, kind string, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = run_to_table(tumbling_counts(s, "ts", "id", "kind", "v"), str(tmp_path / "a"))
    assert counts.agg({"n": "sum"}).first()[0] == 5 and counts.where("n > 1").count() == 0
    states = run_to_table(last_states(s, "user", "ts", "kind"), str(tmp_path / "b"), "update")
    assert rows(states.select("user", "state")) == [(0, "a"), (1, "b")]


def test_small_tables_are_there(spark):
    assert spark.read.parquet(f"{SMALL}/candidate.parquet").count() > 0
