"""Scalar geometry and bit functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def angle_bucket(degrees: Column) -> Column:
    """horizontal / rising / vertical / falling, 45 degrees each, wrapping at 180."""
    a = F.pmod(degrees, F.lit(180.0))
    return (
        F.when((a < 22.5) | (a >= 157.5), "horizontal")
        .when(a < 67.5, "rising")
        .when(a < 112.5, "vertical")
        .otherwise("falling")
    )


def pack_bits(flags: list[Column]) -> Column:
    """Little-endian code of boolean cells."""
    code = F.lit(0)
    for position, flag in enumerate(flags):
        code = code + F.when(flag, 1 << position).otherwise(0)
    return code.cast("bigint")


def low_bit(value: Column) -> Column:
    return value.bitwiseAND(F.lit(1)).cast("bigint")


def divisible(value: Column, divisor: int) -> Column:
    return F.pmod(value, F.lit(divisor)) == 0


def transpose_bits(bits: Column, side: int = 3) -> Column:
    """Row-major square of characters read column by column."""
    return F.concat(*[F.substring(bits, c * side + r + 1, 1) for r in range(side) for c in range(side)])


def lens_area(r1: Column, r2: Column, d: Column) -> Column:
    """Area shared by two disks at centre distance ``d``."""

    def segment(r: Column, other: Column) -> Column:
        # the divisor is zero only for coincident centres, which the contained case answers
        cosine = F.try_divide(d * d + r * r - other * other, 2 * d * r)
        half = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))
        return r * r * (half - F.sin(2 * half) / 2)

    small = F.least(r1, r2)
    return (
        F.when(d >= r1 + r2, F.lit(0.0))
        .when(d <= F.abs(r1 - r2), F.lit(math.pi) * small * small)
        .otherwise(segment(r1, r2) + segment(r2, r1))
    )
