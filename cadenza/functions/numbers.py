"""Numbers: rounding by the exact binary value, and arithmetic as the SQL's engine does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1 cuts a double into two halves whose products are exact


def exact_round(x: str | Column, digits: int) -> Column:
    """x to so many decimals, half to even on its binary value rather than on its shortest decimal form.

    The scaled value is rounded; where it seems a tie, the sign of the product's error tells on which side
    the exact one is. Null, NaN and numbers too large to have decimals stay as they are.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = 10.0**digits
    s_hi = _SPLITTER * scale - (_SPLITTER * scale - scale)
    s_lo = scale - s_hi
    p, cut = x * scale, x * _SPLITTER
    hi = cut - (cut - x)
    lo = x - hi
    error = ((hi * s_hi - p) + hi * s_lo + lo * s_hi) + lo * s_lo
    below = F.floor(p).cast("double")
    tie = p - below == 0.5
    whole = F.when(tie & (error > 0), below + 1).when(tie & (error < 0), below).otherwise(F.rint(p))
    return F.when(F.isnan(x) | (F.abs(p) >= 2.0**52), x).otherwise(whole / scale)


def scaled_round(x: str | Column, digits: int) -> Column:
    """x to so many decimals as SQL's engine does: the scaled double is rounded, half away from zero."""
    x = F.col(x) if isinstance(x, str) else x
    p = x * 10.0**digits
    return F.when(F.isnan(x) | (F.abs(p) >= 2.0**52), x).otherwise(F.round(p) / 10.0**digits)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with the product's error kept until the end."""
    cut_a, cut_b = a * _SPLITTER, b * _SPLITTER
    a_hi, b_hi = cut_a - (cut_a - a), cut_b - (cut_b - b)
    a_lo, b_lo, p = a - a_hi, b - b_hi, a * b
    error = ((a_hi * b_hi - p) + a_hi * b_lo + a_lo * b_hi) + a_lo * b_lo
    s = p + c
    back = s - p
    return s + (((p - (s - back)) + (c - back)) + error)


def between(low: Column, high: Column, share: Column) -> Column:
    """The value a share of the way from low to high, to the last bit as a continuous quantile of the SQL's engine."""
    plain = low * (1 - share) + high * share
    exact = fused(low, 1 - share, high * share)
    return F.when(share == 0, low).otherwise(F.when(F.abs(plain) < 1e280, exact).otherwise(plain))
