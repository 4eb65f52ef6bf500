"""Version strings: range-prefix stripping and numeric comparison."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip_range(version: Column) -> Column:
    """Drop the first range operator (^ at the start, or the first ~ >= <=)."""
    first = F.regexp_extract(version, r"^(\^|.*?(?:~|>=|<=))", 1)
    return F.when(first == "", version).otherwise(
        F.regexp_replace(version, r"^(?:\^|(.*?)(?:~|>=|<=))", "$1")
    )


def parts(version: Column) -> Column:
    """Numeric parts; empty text counts as 0, non-numeric text as null (never comparable)."""
    return F.transform(
        F.split(version, r"\."),
        lambda p: F.when(F.trim(p) == "", F.lit(0.0)).otherwise(p.try_cast("double")),
    )


def version_lt(a: Column, b: Column) -> Column:
    """a < b on zero-padded numeric parts; false when a deciding part is not numeric."""
    pa, pb = parts(a), parts(b)
    width = F.greatest(F.size(pa), F.size(pb))
    diffs = F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda i: F.when(i < F.size(pa), F.get(pa, i)).otherwise(0.0)
        - F.when(i < F.size(pb), F.get(pb, i)).otherwise(0.0),
    )
    decisive = F.filter(diffs, lambda d: d.isNull() | (d != 0.0))
    return F.coalesce(F.get(decisive, F.lit(0)) < 0, F.lit(False))


def meets_min(version: Column, minimum: Column) -> Column:
    return ~version_lt(version, minimum)
