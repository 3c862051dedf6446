"""Reproducible pseudo-random numbers from md5, the same in every engine and on every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32


def hash_int(*parts: Column | str | int) -> Column:
    """A number in [0, 2^32) from the first eight hex digits of the md5 of the joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1)."""
    return hash_int(*parts) / F.lit(float(2**HASH_BITS))
