"""Colours of speakers, and waiting times of retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of the fixed palette, and the golden angle that hues beyond it are apart (fixed values).
PALETTE, ANGLE = 16, 137.508


def hue(index: Column) -> Column:
    """Thousandths of a degree for colours beyond the palette."""
    return F.floor((index - PALETTE + 1) * ANGLE % 360 * 1000)


def backoff(attempt: Column, first: float = 1.0, most: float = 60.0) -> Column:
    """Seconds before an attempt: twice as many each time, up to a limit."""
    return F.least(F.lit(most), first * F.pow(F.lit(2.0), attempt))
