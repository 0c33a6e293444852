"""Stable hashes of key columns, the same in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_SPACE = 1 << 32


def hash32(key: str | Column) -> Column:
    """First 32 bits of md5 of the key as text, as a non-negative bigint."""
    col = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("bigint")


def bucket(key: str | Column, n: int) -> Column:
    return hash32(key) % F.lit(n)
