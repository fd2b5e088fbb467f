"""The four family maps of models, and the labels of pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The names of kinds, families and pair types below are fixed values.


def _case(kind: Column | str, known: dict[str, str], other: str) -> Column:
    c = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(other)
    for k, v in reversed(known.items()):
        out = F.when(c == k, v).otherwise(out)
    return out


def broad(kind: Column | str) -> Column:
    """language, image or other: decides which models are resampled."""
    return _case(kind, {"causal": "language", "vision": "image", "vision_language": "image"}, "other")


def pilot(kind: Column | str) -> Column:
    return _case(kind, {"causal": "language", "vision": "vision", "vision_language": "vlm"}, "other")


def extension(kind: Column | str) -> Column:
    return _case(kind, {"causal": "language", "vision_language": "contrastive_vlm", "vision_language_autoregressive": "autoregressive_vlm"}, "vision")


#: The order in which plots list categories; models keep their own order within one.
PLOT_ORDER = ["causal", "vision_language", "vision_language_autoregressive", "vision"]


def plot(kind: Column | str) -> Column:
    """The kind itself where plots have a category for it, else vision."""
    return _case(kind, {k: k for k in PLOT_ORDER}, "vision")


def pair_type(kind_a: str, kind_b: str) -> Column:
    """language-language, image-image or language-image; every kind but causal is an image model here."""
    n = (F.col(kind_a) == "causal").cast("int") + (F.col(kind_b) == "causal").cast("int")
    return F.when(n == 2, "language-language").when(n == 0, "image-image").otherwise("language-image")


def pair_family_of(kind_a: str, kind_b: str) -> Column:
    """The two pilot families of a pair in alphabetical order, joined by a hyphen."""
    return F.concat_ws("-", F.array_sort(F.array(pilot(kind_a), pilot(kind_b))))
