"""Sending this package to executors that do not have it installed."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@functools.lru_cache(maxsize=1)
def package_zip() -> str:
    """A zip file of the package's modules, made once per driver."""
    path = os.path.join(tempfile.mkdtemp(prefix="quillon-"), "quillon.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(ROOT):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("quillon", os.path.relpath(full, ROOT)))
    return path


def ship(spark: SparkSession) -> None:
    """Give the session's executors the package; a second call does nothing."""
    sc = spark.sparkContext
    if not getattr(sc, "_quillon_shipped", False):
        sc.addPyFile(package_zip())
        sc._quillon_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
