"""Array and map helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F


def present(options: Sequence[Column]) -> Column:
    """Array of the non-null options, in the given order."""
    return F.filter(F.array(*options), lambda x: x.isNotNull())


def any_equal_ci(values: Column, wanted: Sequence[str]) -> Column:
    """True when any element equals one of ``wanted``, ignoring case."""
    keys = F.array(*[F.lit(w.lower()) for w in wanted])
    return F.arrays_overlap(F.transform(values, F.lower), keys)


def lookup(table: Mapping[str, object], key: Column, default: object = None) -> Column:
    """Value of a small fixed table as an expression; no join, no broadcast."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def rank_of(order: Sequence[str], key: Column) -> Column:
    """0-based position of key in ``order``; len(order) when absent."""
    return lookup({v: i for i, v in enumerate(order)}, key, len(order))


def count_values(m: Column, pred: Callable[[Column], Column]) -> Column:
    """Number of map values satisfying pred."""
    return F.size(F.filter(F.map_values(m), pred))


def sorted_distinct(nested: Column) -> Column:
    """Flatten, de-duplicate and sort an array of arrays."""
    return F.sort_array(F.array_distinct(F.flatten(nested)))
