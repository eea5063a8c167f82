"""Exact integer column functions of lossless coding. All are built-in expressions: they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the field polynomial of the 16-bit parity symbols.
FIELD = 0x1100B


def side(left: Column, right: Column) -> Column:
    return left - right


def mid(left: Column, right: Column) -> Column:
    """Floor of the mean."""
    return F.shiftright(left + right, 1)


def left_of(mid_: Column, side_: Column) -> Column:
    """The left sample: the side's parity restores the bit that mid dropped."""
    return F.shiftright(2 * mid_ + side_.bitwiseAND(F.lit(1)) + side_, 1)


def zigzag(e: Column) -> Column:
    return F.when(e >= 0, 2 * e).otherwise(-2 * e - 1)


def unzigzag(z: Column) -> Column:
    return F.when(z % 2 == 0, F.shiftright(z, 1)).otherwise(-F.shiftright(z + 1, 1))


def rice_length(z: Column, k: int) -> Column:
    return F.shiftright(z, k) + 1 + k


def golomb_length(z: Column, k: int) -> Column:
    return F.greatest(F.shiftright(z, k) + k, F.lit(k + 2))


def bit_length(v: Column) -> Column:
    """Bits of a non-negative integer; 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def field_multiply(a: Column, b: Column) -> Column:
    """Product in the field of 2**16 elements, by shifts and reductions from the highest bit of b down."""

    def add(state: Column, bit: Column) -> Column:
        doubled = F.shiftleft(state, 1)
        reduced = doubled.bitwiseXOR(F.call_function("shiftright", doubled, F.lit(16)) * FIELD)
        return reduced.bitwiseXOR(F.call_function("shiftright", b, bit).bitwiseAND(F.lit(1)) * a)

    return F.aggregate(F.sequence(F.lit(15), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), add)
