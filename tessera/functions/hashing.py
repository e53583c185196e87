"""Random numbers hashed from a stream name, a replicate and a key: the same in any order, on any partitioning and in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(stream: str, rep: Column, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(stream), rep.cast("string"), key.cast("string")))


def uniform(stream: str, rep: Column, key: Column) -> Column:
    """A double of [0, 1) with 32 random bits."""
    return F.conv(F.substring(digest(stream, rep, key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def dealt(hashed: str, parts: int) -> Column:
    """floor(parts x uniform) as an int for a column of digests, read from the order of their hex digits: none is converted to a number."""
    ends = [F.lit(f"{-(-i * 2**32 // parts):08x}") for i in range(1, parts)]
    return sum(((F.col(hashed) >= e).cast("int") for e in ends), F.lit(0))
