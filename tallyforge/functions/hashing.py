"""Content identities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def content_hash(content: Column, n: int = 64) -> Column:
    """Leading ``n`` hex digits of the SHA-256 of the text."""
    return F.left(F.sha2(content, 256), F.lit(n))
