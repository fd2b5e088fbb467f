"""Scalar functions on names, paths, settings and numbers, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(c: Column) -> Column:
    """Lower case, everything but letters and digits of ASCII as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits, runs of anything else as ``_``, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def slug_unicode(c: Column) -> Column:
    """As ``slug``, with letters and digits of all scripts kept."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def terms(c: Column) -> Column:
    """The parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda t: F.trim(t)), lambda t: t != "")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def extension(c: Column) -> Column:
    return F.regexp_extract(basename(c), r".(\.[^.]*)$", 1)


def source_of_file(c: Column, sources: list[str]) -> Column:
    """The source named in ``<slug>_<source>_<number>``, the longest that fits; null without one."""
    name, out = stem(c), F.lit(None).cast("string")
    for s in sorted(sources, key=lambda s: (len(s), s)):
        out = F.when(name.rlike(rf"^.+_{s}_\d+$"), s).otherwise(out)
    return out


def file_number(c: Column) -> Column:
    """The number a file name ends in; null without one."""
    return F.try_to_number(F.nullif(F.regexp_extract(stem(c), r"_(\d+)$", 1), F.lit("")), F.lit("999999999999")).cast("long")


def prompt(c: Column) -> Column:
    """``a photo of a pear``, ``an photo of an apple``: the article goes by the concept in both places."""
    article = F.when(F.substring(F.lower(c), 1, 1).isin(*"aeiou"), "an").otherwise("a")
    return F.concat(article, F.lit(" photo of "), c)


def fill_template(template: str, c: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{concept}"), c)


def parse_bool(c: Column) -> Column:
    """True or false for the usual words; null for others."""
    word = F.lower(F.trim(c))
    return F.when(word.isin("1", "true", "yes", "y", "on"), True).when(word.isin("0", "false", "no", "n", "off"), False)


def parse_float_map(c: Column) -> Column:
    """``k=v,k=v`` as map<string,double>; a later key wins; parts without a number are left out."""
    pairs = F.transform(terms(c), lambda t: F.struct(F.trim(F.split_part(t, F.lit("="), F.lit(1))).alias("k"), F.expr("1.0D").alias("one"), F.trim(F.split_part(t, F.lit("="), F.lit(2))).try_cast("double").alias("v")))
    good = F.filter(pairs, lambda p: p["v"].isNotNull() & (p["k"] != ""))
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.greatest(F.size(good), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def swap_pair(c: Column) -> Column:
    """``old:new`` at the first colon, as struct(old, new)."""
    parts = F.split(c, ":", 2)
    return F.struct(F.trim(F.get(parts, 0)).alias("old"), F.trim(F.get(parts, 1)).alias("new"))


def depth_label(fraction: Column) -> Column:
    """d00 ... d100."""
    return F.format_string("d%02d", F.bround(fraction * 100, 0).cast("int"))


def layer_indices(spec: str, n: Column) -> Column:
    """Layer numbers for ``-1``, ``a,b,-1``, ``all`` or ``aligned5`` of a model with ``n`` layers, in order, each once.

    Negative numbers count from the end; numbers outside raise an error. ``aligned5`` takes the depths
    0, 1/4, 1/2, 3/4 and 1, half-way to the even layer.
    """
    if spec == "all":
        return F.sequence(F.lit(0), n - 1)
    if spec == "aligned5":
        at = [F.least(F.greatest(F.bround(F.lit(f) * (n - 1), 0).cast("int"), F.lit(0)), n - 1) for f in (0.0, 0.25, 0.5, 0.75, 1.0)]
        return F.array_distinct(F.array(*at))
    wanted = [int(x) for x in spec.split(",")]
    at = [F.lit(i) if i >= 0 else n + i for i in wanted]
    checked = [F.when((x >= 0) & (x < n), x).otherwise(F.raise_error(F.lit(f"layer {i} is outside the model")).cast("int")) for i, x in zip(wanted, at)]
    return F.array_distinct(F.array(*checked))


def append_note(note: Column, suffix: Column) -> Column:
    return F.trim(F.concat_ws(" ", note, suffix))


def glob(c: Column, pattern: str) -> Column:
    """Shell-style match of the whole text; ``*`` also crosses ``/``."""
    out = "".join({"*": ".*", "?": "."}.get(x, "\\" + x if not x.isalnum() and x not in "_/" else x) for x in pattern)
    return c.rlike(f"^(?s:{out})$")


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of the fields in the order of their names."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def fingerprint(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where one is a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def balance(s1: Column, s2: Column) -> Column:
    """1 - 2 |1/2 - s2 / (s1 + s2)|, with the share 1/2 where the sum is not positive."""
    share = F.when(s1 + s2 > 0, s2 / (s1 + s2)).otherwise(0.5)
    return 1 - 2 * F.abs(F.lit(0.5) - share)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def csv_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
