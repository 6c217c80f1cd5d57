"""Sums of doubles that do not depend on the order of the rows.

A value is split into whole numbers: its multiples of 2^32, the rest of its whole
part, and its fraction in units of 1e-9. These are added up as longs, which is
exact, in partial aggregates, windows and states alike, and put together once at
the end. Values count to the ninth decimal; values of 1e27 and more, infinities
and NaN are added up as doubles beside them.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 4294967296.0
LIMIT = 1e27
NAMES = ("hi", "lo", "nano", "wide")


def parts(value: str | Column, prefix: str) -> list[Column]:
    """The four summands of a value, named ``<prefix>_hi`` and so on."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    fits = F.abs(v) < LIMIT
    whole = F.floor(v / UNIT)
    rest = v - whole.cast("double") * UNIT          # exact: a multiple of the value's last place, below 2^32
    cols = [whole, F.floor(rest), F.round((rest - F.floor(rest)) * 1e9).cast("long")]
    return [F.when(fits, c).alias(f"{prefix}_{n}") for c, n in zip(cols, NAMES)] + [F.when(~fits, v).alias(f"{prefix}_wide")]


def columns(prefix: str) -> list[str]:
    return [f"{prefix}_{n}" for n in NAMES]


def sums(prefix: str, over=None) -> list[Column]:
    """Sums of the four columns, per group or over a window; 0 without rows."""
    out = []
    for c in columns(prefix):
        s = F.sum(c) if over is None else F.sum(c).over(over)
        out.append(F.coalesce(s, F.lit(0.0 if c.endswith("_wide") else 0)).alias(c))
    return out


def total(hi, lo, nano, wide):
    """The sum as a double; for columns and plain numbers alike."""
    return hi * UNIT + (lo + nano / 1e9) + wide


def total_of(prefix: str) -> Column:
    return total(*[F.col(c).cast("double") for c in columns(prefix)])
