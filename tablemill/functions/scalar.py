"""Scalar feature expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator``; null when the denominator is 0 (plain ``/`` raises under ANSI)."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def log1p(value: Column | str) -> Column:
    """Natural log of ``1 + value``; null at or below -1."""
    return F.log1p(_col(value).cast("double"))


def indicator(value: Column | str, wanted: str) -> Column:
    """1 where ``value`` equals ``wanted``, else 0; null counts as 0."""
    return F.when(_col(value) == F.lit(wanted), F.lit(1)).otherwise(F.lit(0))


def safe_share(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, null when the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def key_bucket(key: Column | str, key_type: str = "integer") -> Column:
    """A number in [0, 2^32) that depends on the key alone.

    Integer keys use multiplicative hashing, which other engines can repeat; anything else uses
    ``xxhash64``. The key is reduced first so that the product stays inside 64 bits.
    """
    space = F.lit(2**32).cast("bigint")
    if key_type == "integer":
        reduced = F.pmod(_col(key).cast("bigint"), space)
        # (a * m) mod 2^32 with a, m < 2^32: split a so that no product overflows under ANSI
        high, low = F.shiftright(reduced, 16), reduced.bitwiseAND(F.lit(0xFFFF))
        factor = F.lit(2654435761).cast("bigint")
        top = F.pmod(high * factor, F.lit(2**16).cast("bigint"))
        return F.pmod(F.shiftleft(top, 16) + low * factor, space)
    return F.pmod(F.xxhash64(_col(key)), space)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
