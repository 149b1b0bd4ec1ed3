"""Exact sums of doubles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A finite number below 2^63 is the sum of four whole numbers in units of 2^32, 1, 2^-32 and 2^-64 (what is smaller is cut off), which add up exactly and in any order; larger ones are added as they are, as `big`.
LIMBS = ("hi", "lo", "mid", "low")
_WORD, _LEAST_BIG = 4294967296.0, 9223372036854775808.0


def limbs(v: Column) -> dict[str, Column]:
    """The parts of a finite double, by name: LIMBS (BIGINT) and `big` (DOUBLE). Null, NaN and infinities have parts of 0."""
    plain = F.coalesce(F.abs(v) < _LEAST_BIG, F.lit(False))
    x = F.when(plain, v).otherwise(0.0)
    hi = (x / _WORD).cast("long")
    rest = x - hi * F.lit(_WORD)
    lo = rest.cast("long")
    part = (rest - lo) * _WORD
    mid = part.cast("long")
    low = ((part - mid) * _WORD).cast("long")
    big = F.when(~plain & (F.abs(v) < float("inf")), v).otherwise(0.0)
    return {"hi": hi, "lo": lo, "mid": mid, "low": low, "big": big}


def summed(parts: Mapping[str, Column]) -> Column:
    """The double of summed parts: within a unit in the last place of the exact sum, whatever order they were added in."""

    def carried(sign: int) -> list[Column]:
        hi, lo, mid, low = (parts[k] * sign if sign < 0 else parts[k] for k in LIMBS)
        mask = F.lit(4294967295).cast("long")
        mid = mid + F.shiftright(low, 32)
        lo = lo + F.shiftright(mid, 32)
        hi = hi + F.shiftright(lo, 32)
        return [hi, lo.bitwiseAND(mask), mid.bitwiseAND(mask), low.bitwiseAND(mask)]

    def value(c: list[Column]) -> Column:
        hi, lo, mid, low = (x.cast("double") for x in c)
        return hi * _WORD + lo + (mid / _WORD + low / (_WORD * _WORD))

    up = carried(1)
    return F.when(up[0] >= 0, value(up)).otherwise(-value(carried(-1))) + parts["big"]


def exact_sum(v: Column) -> Column:
    """Aggregate: the sum of the finite values, the same for any order of the rows and any partial sums; 0 without any."""
    return summed({k: F.coalesce(F.sum(x), F.lit(0)) for k, x in limbs(v).items()})
