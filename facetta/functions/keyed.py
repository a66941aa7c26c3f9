"""Random numbers from a hash of their key: the same on every engine, partitioning and rerun."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash48(*key) -> Column:
    """48 bits of the MD5 of the key's parts joined by colons."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 12), 16, 10).cast("long")


def uniform(*key) -> Column:
    """In (0, 1)."""
    return (hash48(*key) + 0.5) / float(1 << 48)


def normal(*key) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(*key, "u"))) * F.cos(2 * pi * uniform(*key, "v"))
