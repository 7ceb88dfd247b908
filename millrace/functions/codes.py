"""Short character codes as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two that is not below n; 1 for n below 2."""
    return F.when(n < 2, F.lit(1).cast("bigint")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n - 1))).cast("bigint"))


def pack_code(code: Column) -> Column:
    """One to four ASCII characters as a big-endian int, zero bytes behind; any other length fails."""
    byte = lambda i: F.when(F.length(code) > i, F.ascii(F.substring(code, i + 1, 1))).otherwise(0)
    value = F.shiftleft(byte(0), 24).bitwiseOR(F.shiftleft(byte(1), 16)).bitwiseOR(F.shiftleft(byte(2), 8)).bitwiseOR(byte(3))
    return F.when(F.length(code).between(1, 4), value).when(code.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("a code has 1 to 4 characters: "), code)))
