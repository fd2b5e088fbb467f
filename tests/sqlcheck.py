"""Rows of a query against those of its SQL in DuckDB."""

import glob
import math
import os


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        source = p if os.path.isfile(p) else f"{p}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return c


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def agree(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    result = connect(sf_dir).execute(sql)
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == names
    theirs = sorted(tuple(plain(r[at[n]]) for n in names) for r in result.fetchall())
    assert ours == theirs
