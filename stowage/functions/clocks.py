"""Version vectors as maps from actor to counter. A missing actor counts as zero, so zeros never matter."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "map<string,bigint>"


def empty() -> Column:
    return F.create_map().cast(EMPTY)


def normalize(v: Column) -> Column:
    return F.map_filter(v, lambda _, n: n > 0)


def merge(a: Column, b: Column) -> Column:
    """Componentwise maximum."""
    return normalize(F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))))


def bump(v: Column, actor: Column, by: int = 1) -> Column:
    one = F.map_from_arrays(F.array(actor), F.array(F.lit(by).cast("long")))
    return normalize(F.map_zip_with(v, one, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))


def dominates(a: Column, b: Column) -> Column:
    return F.forall(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) >= F.coalesce(y, F.lit(0)))), lambda ok: ok)


def strictly_dominates(a: Column, b: Column) -> Column:
    return dominates(a, b) & ~dominates(b, a)


def concurrent(a: Column, b: Column) -> Column:
    return ~dominates(a, b) & ~dominates(b, a)


def equal(a: Column, b: Column) -> Column:
    return dominates(a, b) & dominates(b, a)


def relation(a: Column, b: Column) -> Column:
    return F.when(equal(a, b), "equal").when(dominates(a, b), "after").when(dominates(b, a), "before").otherwise("concurrent")


def to_json(v: Column) -> Column:
    """Canonical: keys in order, zeros left out."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(normalize(v)))))


def from_json(text: Column) -> Column:
    return normalize(F.coalesce(F.from_json(text, EMPTY), empty()))
