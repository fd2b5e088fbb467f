"""Canonical forms of labels, paths, scores and vectors, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\p{Z}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """The text without leading and trailing blanks of any script."""
    return F.regexp_replace(_col(c), f"^{_BLANK}+|{_BLANK}+$", "")


def label_form(c: Column | str) -> Column:
    """Trimmed, lower case, runs of blanks, ``_`` and ``-`` as one ``_``; empty becomes null."""
    return F.nullif(F.regexp_replace(F.lower(stripped(c)), r"[\s\p{Z}_-]+", "_"), F.lit(""))


def path_form(c: Column | str) -> Column:
    """Trimmed, ``\\`` as ``/``, repeated ``/`` as one, leading ``./`` dropped; empty becomes null."""
    slashes = F.regexp_replace(F.regexp_replace(stripped(c), r"\\", "/"), "/+", "/")
    return F.nullif(F.regexp_replace(slashes, r"^(\./)+", ""), F.lit(""))


def usable_score(c: Column | str) -> Column:
    """True for a score that is not null, not NaN and lies in [0, 1]."""
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0)


def usable_vector(vector: Column | str, dim: Column | str) -> Column:
    """True for a vector of exactly ``dim`` finite values that are not all zero."""
    v, d = _col(vector), _col(dim)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == d) & (d > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def uniform_hash(seed: int, *cols: Column | str) -> Column:
    """A number in [0, 1) fixed by the seed and the columns, the same on every run and executor."""
    h = F.xxhash64(F.lit(seed), *[_col(c) for c in cols])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))
