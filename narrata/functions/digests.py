"""Digests of tables that don't depend on the order of rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

def summed(row: Column) -> Column:
    """An aggregate: the sum of the first 48 bits of all rows' SHA-256, as a long. Null rows are left out; null without any.

    The sum is exact. From some 65,000 rows on it may be beyond a long; then it goes on at the least long, as sums of
    64 bits do (modulo 2^64).
    """
    first = F.conv(F.substring(F.sha2(row.cast("binary"), 256), 1, 12), 16, 10).cast("decimal(15,0)")
    half, whole = F.lit(Decimal(1 << 63)), F.lit(Decimal(1 << 64))
    return ((F.sum(first) + half) % whole - half).cast("long")
