"""Arrays of candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zipped(a: Column, b: Column, merge) -> Column:
    """Pairs up to the end of the shorter array."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), merge)


def best_by_char(candidates: Column) -> Column:
    """One candidate for each char, with its largest log-probability, in the order of first occurrence."""
    chars = F.array_distinct(F.transform(candidates, lambda c: c["char"]))
    return F.transform(chars, lambda ch: F.struct(ch.alias("char"), F.array_max(F.transform(F.filter(candidates, lambda c: c["char"] == ch), lambda c: c["logp"])).alias("logp")))


def top_k(scores: Column, k: int) -> Column:
    """The k best of an array of struct(score, class_id): highest score first, lowest class on ties."""
    order = F.transform(scores, lambda s: F.struct((-s["score"]).alias("neg"), s["class_id"].alias("class_id")))
    return F.transform(F.slice(F.array_sort(order), 1, k), lambda s: F.struct(s["class_id"].alias("class_id"), (-s["neg"]).alias("score")))


def flattened_candidates(top: Column, first: int = 2, last: int = 5) -> dict[str, Column]:
    """Two columns for each of the lower candidates, blank where there is none."""
    out = {}
    for k in range(first, last + 1):
        out[f"top{k}_char"] = F.coalesce(F.get(top, F.lit(k - 1))["char"], F.lit(""))
        out[f"top{k}_conf"] = F.get(top, F.lit(k - 1))["prob"]
    return out
