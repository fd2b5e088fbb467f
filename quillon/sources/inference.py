"""The interface for model inference: a model is a loader that returns a batch function.

Models run offline of this library; a loader is called once per task, and the rows that come back have
the same columns for every model, so that analyses read extracted and stored embeddings alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "concept string, pos long, layer int, x array<float>"
Batch = Callable[[pd.Series], np.ndarray]


def extract(df: DataFrame, model: str, loader: Callable[[], Batch], cached: DataFrame | None = None) -> DataFrame:
    """model, concept, pos, layer, x of df(concept, pos, payload); rows that ``cached`` has are not run again.

    The batch function gives an array of shape (rows, layers, dimensions). The model is loaded when a task
    has its first row, so that a run with everything cached loads none.
    """
    todo = df if cached is None else df.join(cached.where(F.col("model") == model).select("concept", "pos").distinct(), ["concept", "pos"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model_fn = None
        for pdf in batches:
            if not len(pdf):
                continue
            model_fn = model_fn or loader()
            out = np.asarray(model_fn(pdf["payload"]), np.float32)
            n, layers, _ = out.shape
            yield pd.DataFrame({"concept": np.repeat(pdf["concept"].to_numpy(), layers), "pos": np.repeat(pdf["pos"].to_numpy(), layers), "layer": np.tile(np.arange(layers, dtype=np.int32), n), "x": list(out.reshape(n * layers, -1))})

    new = todo.select("concept", "pos", "payload").mapInPandas(run, SCHEMA).withColumn("model", F.lit(model))
    columns = ["model", "concept", "pos", "layer", "x"]
    return new.select(*columns) if cached is None else cached.where(F.col("model") == model).select(*columns).unionByName(new.select(*columns))
