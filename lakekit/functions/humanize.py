"""Sizes for people."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal units, each used from nine tenths of it on.
UNITS = [("PB", 10**15), ("TB", 10**12), ("GB", 10**9), ("MB", 10**6), ("kB", 10**3)]


def humanize_bytes(n: float) -> str:
    """``1.23 GB``; plain bytes below 900. Halves round up."""
    for unit, size in UNITS:
        if n >= 0.9 * size:
            return f"{(Decimal(n) / size).quantize(Decimal('0.01'), ROUND_HALF_UP)} {unit}"
    return f"{Decimal(n).quantize(Decimal(1), ROUND_HALF_UP)} B"


def humanize_bytes_column(n: Column) -> Column:
    """The same for a column; null stays null."""
    text = F.format_string("%.0f B", n.cast("double"))
    for unit, size in reversed(UNITS):
        text = F.when(n >= F.lit(0.9 * size), F.format_string(f"%.2f {unit}", n.cast("double") / size)).otherwise(text)
    return F.when(n.isNotNull(), text)
