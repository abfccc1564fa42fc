"""Weighted fingerprint similarity and vector distance."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.text import jaccard_of_sets as jaccard

# Weights of the fingerprint fields and of the set overlaps.
FIELD_WEIGHTS = {
    "family": 0.15,
    "arity": 0.10,
    "relation": 0.25,
    "margin_operator": 0.20,
    "depth": 0.05,
}
SET_WEIGHTS = {"entities": 0.10, "primitives": 0.05, "tokens": 0.10}
# end of fixed values


def equal_weight(name: str, left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
    """Weight of one field; two missing values count as equal."""
    return F.when(left(name).eqNullSafe(right(name)), F.lit(FIELD_WEIGHTS[name])).otherwise(F.lit(0.0))


def core_similarity(left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
    """The part of the score that comes from equal fields alone."""
    total = F.lit(0.0)
    for name in FIELD_WEIGHTS:
        total = total + equal_weight(name, left, right)
    return total


def fingerprint_similarity(left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
    """Weighted agreement of two fingerprints, rounded to six places.

    ``left`` and ``right`` turn a field name into a column of that side; the three
    set fields must hold distinct members.
    """
    total = F.lit(0.0)
    for name in ("family", "arity", "relation", "margin_operator"):
        total = total + equal_weight(name, left, right)
    for name in ("entities", "primitives"):
        total = total + F.lit(SET_WEIGHTS[name]) * jaccard(left(name), right(name))
    total = total + equal_weight("depth", left, right)
    total = total + F.lit(SET_WEIGHTS["tokens"]) * jaccard(left("tokens"), right("tokens"))
    return F.round(total, 6)


def blocking_keys(threshold: float) -> list[tuple[str, ...]]:
    """Smallest sets of fields such that any pair at ``threshold`` shares one of them in full.

    Every agreement pattern that can still reach the threshold with all set
    overlaps at their best must contain a returned key.
    """
    need = threshold - sum(SET_WEIGHTS.values()) - 1e-9
    names = list(FIELD_WEIGHTS)
    patterns = [
        set(c)
        for size in range(len(names) + 1)
        for c in combinations(names, size)
        if sum(FIELD_WEIGHTS[n] for n in c) >= need
    ]
    if set() in patterns:
        return []
    # keep only patterns without a smaller reaching pattern inside them
    minimal = [p for p in patterns if not any(q < p for q in patterns)]
    return [tuple(n for n in names if n in p) for p in minimal]


def rms_distance(left: Column, right: Column) -> Column:
    """Root mean square difference; null unless both vectors have the same positive size."""
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 0), F.sqrt(total / F.size(left)))


def cell_key(axes: dict[str, Column]) -> Column:
    return F.concat_ws("|", *[F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in axes.items()])
