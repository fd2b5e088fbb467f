"""Byte-level BPE with a public vocabulary, in Spark's higher-order functions."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.durable import spread

#: Where the vocabulary files lie; a parameter of all queries, never copied here.
TOKENIZERS = os.environ.get("QUILLON_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
#: Unicode white space; the JVM's own \s knows ASCII only.
_S = r"\t-\r \u0085   -     　"
#: Fixed by the vocabulary: how text is split before merges.
PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Texts with an unbroken run of more characters of one class than this are merged with a heap, which takes n log n steps
#: instead of n squared.
FOLD_CHARS = 256
LONG_RUN = rf"\p{{L}}{{{FOLD_CHARS}}}|\p{{N}}{{{FOLD_CHARS}}}|[{_S}]{{{FOLD_CHARS}}}|[^{_S}\p{{L}}\p{{N}}]{{{FOLD_CHARS}}}"
#: Most frequent words that are merged once for all texts; others are merged where they stand. No result depends on it.
FREQUENT, _PLACES = 32_768, 1 << 16
_BITS = 17
_SIZE = 1 << _BITS


@dataclass(frozen=True)
class Ranks:
    """bytes_[b]: the id of a byte; merges: (a, b) to the merged id (lower merges first); pieces: id to bytes."""

    bytes_: list[int]
    merges: dict[tuple[int, int], int]
    pieces: list[bytes]


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def load(path: str) -> Ranks:
    """The vocabulary of a byte-level BPE file in the JSON form of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = _byte_letters(), model["vocab"]
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    merges = {}
    for m in model["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        merges[vocab[a], vocab[b]] = vocab[a + b]
    one = {pieces[i]: i for i in vocab.values() if len(pieces[i]) == 1}
    return Ranks([one[bytes([b])] for b in range(256)], merges, pieces)


def _slots(key: int | np.ndarray, mult: int):
    return ((key * mult) >> _BITS) & (_SIZE - 1)


@lru_cache(maxsize=4)
def rank_table(path: str) -> tuple[int, int, str]:
    """(multiplier, multiplier, JSON array): a cuckoo table of ``pair << 17 | id`` with two places a pair.

    A lookup is two array reads, where a map literal would be scanned.
    """
    ranks = load(path)
    keys = [((a << _BITS) | b, i) for (a, b), i in ranks.merges.items()]
    rng = np.random.default_rng(7)
    while True:
        m1, m2 = (int(x) | 1 for x in rng.integers(1 << 26, 1 << 28, 2))
        table = [-1] * _SIZE
        if all(_place(table, (k << _BITS) | i, m1, m2) for k, i in keys):
            return m1, m2, json.dumps(table, separators=(",", ":"))


def _place(table: list[int], entry: int, m1: int, m2: int) -> bool:
    at = _slots(entry >> _BITS, m1)
    for _ in range(500):
        entry, table[at] = table[at], entry
        if entry < 0:
            return True
        k = entry >> _BITS
        one, two = _slots(k, m1), _slots(k, m2)
        at = two if at == one else one
    return False


def words(text: Column) -> Column:
    """The words of a text (null: none); all words together are the text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def fold_merges(word: Column, tab: Column, path: str) -> Column:
    """The ids of a word by the ranks ``tab``: in each step of the fold all places of its lowest-ranked pair are merged."""
    m1, m2, _ = rank_table(path)
    byte_ids = F.from_json(F.lit(json.dumps(load(path).bytes_)), "array<bigint>")
    start = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.get(byte_ids, F.ascii(c)))
    none = F.lit(None).cast("bigint")

    def lookup(a: Column, b: Column) -> Column:
        key = F.shiftleft(a, _BITS).bitwiseOR(b)
        places = [F.get(tab, F.shiftright(key * F.lit(m), _BITS).bitwiseAND(F.lit(_SIZE - 1)).cast("int")) for m in (m1, m2)]
        out = none
        for e in reversed(places):
            out = F.when(F.shiftright(e, _BITS) == key, e.bitwiseAND(F.lit(_SIZE - 1))).otherwise(out)
        return out

    def step(ids: Column) -> Column:
        pairs = F.transform(F.slice(ids, 2, F.size(ids)), lambda x, i: lookup(F.get(ids, i), x))

        def merged(best: Column) -> Column:
            def take(acc: Column, x: Column) -> Column:
                n = F.size(acc)
                hit = (n > 0) & (lookup(F.get(acc, n - 1), x) == best)
                return F.when(hit, F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(best))).otherwise(F.concat(acc, F.array(x)))

            return F.aggregate(ids, F.array().cast("array<bigint>"), take)

        return F.get(F.transform(F.array(F.array_min(pairs)), lambda best: F.when(best.isNull(), ids).otherwise(merged(best))), 0)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(start) - 1, F.lit(1))), start, lambda ids, _: step(ids))
    return F.transform(folded, lambda i: i.cast("int"))


def ranks_column(path: str) -> Column:
    """The table of ranks, as a constant of the plan."""
    return F.from_json(F.lit(rank_table(path)[2]), "array<bigint>")


def heap_merges(data: bytes, ranks: Ranks) -> list[int]:
    """The ids of one long word, exactly as by ``fold_merges``, with a heap over a linked list."""
    ids = [ranks.bytes_[b] for b in data]
    n = len(ids)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.merges.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = right[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j] = r, -1
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        right[j] = -1
        for x in (left[i], i):
            if x >= 0 and (y := right[x]) >= 0 and (q := ranks.merges.get((ids[x], ids[y]))) is not None:
                heapq.heappush(heap, (q, x, ids[x], ids[y]))
    return [i for i in ids if i >= 0]


def frequent_words(docs: DataFrame, path: str) -> str:
    """The ``FREQUENT`` most frequent words of all texts with their ids, as a JSON array of places by the word's hash.

    What stands between spaces is counted over all texts, in the map tasks first, and then cut into words;
    a bounded number comes to the driver.
    """
    between = docs.select(F.explode(F.split("_text", " ")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    counts = between.select(F.explode(words(F.concat(F.lit(" "), "part"))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where(F.length("word") < FOLD_CHARS).orderBy(F.desc("n"), "word").limit(FREQUENT)
    # A few words a task, as merging is the work and their bytes are few.
    top = top.select("word", "n").repartition(16, "word")
    ids = F.get(F.transform(F.array(ranks_column(path)), lambda tab: fold_merges(F.col("word"), tab, path)), 0)
    places: list[dict | None] = [None] * _PLACES
    for r in sorted(top.select("word", "n", ids.alias("ids"), F.xxhash64("word").alias("h")).collect(), key=lambda r: (-r["n"], r["word"])):
        at = [r["h"] & (_PLACES - 1), (r["h"] >> 20) & (_PLACES - 1)]
        if free := [i for i in at if places[i] is None]:
            places[free[0]] = {"w": r["word"], "i": list(r["ids"])}
    return json.dumps(places, separators=(",", ":"))


def _by_word(docs: DataFrame, path: str, value, joined) -> Column:
    """``joined`` of the array of the ``value`` of every word's ids, for texts without a long run.

    A frequent word is looked up at the two places its hash allows; any other is folded where it stands.
    """
    table = F.from_json(F.lit(frequent_words(docs, path)), "array<struct<w:string,i:array<int>>>")

    def known(freq: Column, word: Column) -> Column:
        h = F.xxhash64(word)
        out = None
        for place in (h, F.shiftright(h, 20)):
            entry = F.get(freq, place.bitwiseAND(F.lit(_PLACES - 1)).cast("int"))
            hit = F.when(entry["w"] == word, entry["i"])
            out = hit if out is None else F.coalesce(out, hit)
        return out

    tables = F.struct(table.alias("freq"), ranks_column(path).alias("ranks"))
    every = lambda t: F.transform(words(F.col("_text")), lambda w: value(F.coalesce(known(t["freq"], w), fold_merges(w, t["ranks"], path))))
    return F.get(F.transform(F.array(tables), lambda t: joined(every(t))), 0)


def _documents(df: DataFrame, record: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(_id, _text) of the texts without a long run, and those with one with their words."""
    docs = df.where(F.col(record).isNotNull()).select(F.col(record).alias("_id"), F.col(text).cast("string").alias("_text"))
    # Nearly all texts stop at the first condition. A run that it does not see, of mixed white space, is merely slower.
    some = F.exists(F.split("_text", " "), lambda part: F.length(part) >= FOLD_CHARS) | F.contains(F.col("_text"), F.lit(" " * FOLD_CHARS))
    long = F.coalesce(some & F.col("_text").rlike(LONG_RUN), F.lit(False))
    return spread(docs.where(~long), "_id"), docs.where(long)


def _heaped(long: DataFrame, path: str) -> DataFrame:
    """_id, ids of texts with long runs, their words merged with a heap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = load(path)
        for pdf in batches:
            yield pd.DataFrame({"_id": pdf["_id"], "ids": [[i for w in some for i in heap_merges(w.encode(), ranks)] for some in pdf["words"]]})

    return long.select("_id", words(F.col("_text")).alias("words")).mapInPandas(run, f"_id {dict(long.dtypes)['_id']}, ids array<int>")


def encode(df: DataFrame, record: str, text: str, path: str | None = None) -> DataFrame:
    """``record`` and ids (array<int>) of each text by a byte-level BPE file, without special tokens.

    Null and empty texts have an empty list; strings of special tokens are ordinary text; texts of
    any length are encoded whole. ``record`` is unique; a null record id is left out. The most frequent
    words are merged once and looked up, all others are merged where they stand, so nothing but the words'
    counts is shuffled. Other columns are ignored.
    """
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"
    docs, long = _documents(df, record, text)
    ids = docs.select("_id", _by_word(docs, path, lambda ids: ids, F.flatten).alias("ids"))
    return ids.unionByName(_heaped(long, path)).withColumnRenamed("_id", record)


def token_counts(df: DataFrame, record: str, text: str, path: str | None = None) -> DataFrame:
    """``record`` and n_tokens (0 for null and empty texts), without putting the ids together."""
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"
    docs, long = _documents(df, record, text)
    total = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n)
    sizes = docs.select("_id", _by_word(docs, path, F.size, total).alias("n_tokens"))
    return sizes.unionByName(_heaped(long, path).select("_id", F.size("ids").cast("long").alias("n_tokens"))).withColumnRenamed("_id", record)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: the pieces' bytes concatenated and read as UTF-8 (null: null)."""
    pieces = json.dumps([p.hex() for p in load(path or f"{TOKENIZERS}/{BYTE_BPE}").pieces])
    joined = F.get(F.transform(F.array(F.from_json(F.lit(pieces), "array<string>")), lambda tab: F.array_join(F.transform(ids, lambda i: F.get(tab, i)), "")), 0)
    return F.decode(F.unhex(joined), "UTF-8")
