"""Filling containers of fixed capacity with items: best-two-fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.durable import durable

#: Items of one packing task.
SHARD_ITEMS = 50_000
#: Containers filled less than this take part in the second round.
FULL = 0.995


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container number for each item (0 < size <= capacity).

    A container starts with the largest unpacked item and takes the largest that fits until none
    does. Then, as long as it helps, its smallest item is exchanged for the two unpacked items whose
    sum fits the gap, widened by that item, most tightly. Ties go by position, so results repeat.
    """
    order = np.lexsort((np.arange(len(sizes)), sizes))
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order[::-1].tolist():
        stacks[sizes[i]].append(i)
    count = np.array([len(s) for s in stacks], dtype=np.int64)
    span = np.arange(capacity + 1)
    out = np.full(len(sizes), -1, dtype=np.int64)
    left, box = len(sizes), 0
    top = capacity

    def largest(most: int) -> int:
        while most > 0 and not count[most]:
            most -= 1
        return most

    def take(s: int) -> int:
        count[s] -= 1
        return stacks[s].pop()

    while left:
        top = largest(top)
        held = [(top, take(top))]
        gap = capacity - top
        while (s := largest(min(gap, top))) > 0:
            held.append((s, take(s)))
            gap -= s
        while gap and len(held) > 1 or gap and held:
            k = min(range(len(held)), key=lambda i: held[i])
            small, wide = held[k][0], gap + held[k][0]
            # floor[x]: the largest size up to x of which there is an item.
            floor = np.maximum.accumulate(np.where(count[: wide + 1] > 0, span[: wide + 1], 0))
            first = np.flatnonzero(count[:wide] > 0)
            if not len(first):
                break
            second = floor[wide - first]
            alone = (second == first) & (count[first] < 2)
            if alone.any():
                second[alone] = floor[np.maximum(first[alone] - 1, 0)]
            total = np.where(second > 0, first + second, 0)
            j = int(total.argmax())
            if total[j] <= small:
                break
            a, b = int(first[j]), int(second[j])
            stacks[small].append(held.pop(k)[1])
            count[small] += 1
            top = max(top, small)
            held += [(a, take(a)), (b, take(b))]
            gap = wide - a - b
        for _, i in held:
            out[i] = box
        left -= len(held)
        box += 1
    return out


def _pack(items: DataFrame, capacity: int, round_no: int, shard_items: int) -> DataFrame:
    shards = max(1, -(-items.count() // shard_items))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["record", "piece"], ignore_index=True)
        some = pdf["size"].to_numpy() > 0
        box = np.zeros(len(pdf), dtype=np.int64)
        box[some] = best_two_fit(pdf["size"].to_numpy()[some].astype(np.int64), capacity)
        fill = np.bincount(box, weights=pdf["size"], minlength=1)
        return pdf[["record", "piece", "size"]].assign(container=[f"{round_no}-{key[0]}-{b}" for b in box], fill=fill[box].astype(np.int64))

    placed = items.withColumn("_shard", F.pmod(F.xxhash64("record", "piece", F.lit(round_no)), F.lit(shards)))
    return durable(placed.groupBy("_shard").applyInPandas(run, "record long, piece int, size long, container string, fill long"))


def fill_containers(df: DataFrame, record: str, size: str, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """record, piece, size, container, fill: every item in a container, none over ``capacity``.

    An item longer than the capacity is cut: all pieces but its last fill a container of their own.
    No other item is split. Items of size 0 go with any container of their shard. A null record or size
    is left out; negative sizes count as 0; ``record`` is a unique bigint. Tasks pack bounded shards
    drawn by hash; the items of containers that came out less than full go into a second round
    together, with the shards mixed. An empty table gives no rows.
    """
    items = df.where(F.col(record).isNotNull() & F.col(size).isNotNull()).select(F.col(record).cast("long").alias("record"), F.greatest(F.col(size), F.lit(0)).cast("long").alias("total"))
    pieces = F.greatest(F.ceil(F.col("total") / capacity), F.lit(1)).cast("int")
    items = items.select("record", "total", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    items = durable(items.select("record", "piece", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).alias("size")))
    whole = items.where(F.col("size") == capacity).select("record", "piece", "size", F.concat_ws("-", F.lit("w"), "record", "piece").alias("container"), F.col("size").alias("fill"))
    once = _pack(items.where(F.col("size") < capacity), capacity, 1, shard_items)
    ready = F.col("fill") >= int(FULL * capacity)
    again = _pack(once.where(~ready).select("record", "piece", "size"), capacity, 2, shard_items)
    return whole.unionByName(once.where(ready)).unionByName(again)


def fill_report(filled: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens, mean fill and the least number of containers there could be."""
    boxes = filled.groupBy("container").agg(F.max("fill").alias("fill"), F.count("*").alias("n"))
    total = boxes.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("fill").alias("n_tokens"))
    return total.select("n_containers", "n_pieces", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), (F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("mean_fill"))
