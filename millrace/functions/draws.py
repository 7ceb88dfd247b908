"""Random draws that depend on a seed and on the row's own value: not on partitions, order or attempts of a task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, *values: Column) -> Column:
    """32 hexadecimal digits (MD5) of the seed and the values as text, joined by colons; a null is empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(v.cast("string"), F.lit("")) for v in values)))


def uniform(digest: Column, nth: int = 0) -> Column:
    """In (0, 1), from the nth eight digits of a digest."""
    return (F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def gaussian(digest: Column) -> Column:
    """Standard normal, by the Box-Muller transform of a digest's first two numbers."""
    return F.sqrt(F.lit(-2.0) * F.log(uniform(digest))) * F.cos(F.lit(2 * 3.141592653589793) * uniform(digest, 1))
