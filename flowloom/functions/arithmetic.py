"""Small arithmetic that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def digits(x: Column, n: int = 9) -> Column:
    return F.round(x, n)


def md5_mod10(text: Column) -> Column:
    """The md5 digest as a 128-bit number, modulo 10, from four parts of 32 bits (2**32 is 6 modulo 10, as is any power of 6)."""
    part = [F.conv(F.substring(F.md5(text), 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    return F.pmod(6 * (part[0] + part[1] + part[2]) + part[3], F.lit(10)).cast("int")
