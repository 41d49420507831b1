"""Rounding as results need it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it, inside functions over arrays too."""
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def even(v: Column) -> Column:
    """The nearest even integer by halving, rounding half to even and doubling: 405 gives 404."""
    return F.bround(v / F.lit(2.0)).cast("int") * 2


#: Bits of a fraction that are looked at: those of one of 2^-22 or more end before the 74th place.
BITS = 37


def _parts(size: Column, digits: int, body: Callable[[Column, Column], Column]) -> Column:
    """body of the whole part of a number that is not negative, and of the rest in units of the last digit, rounded half-even.

    Both are exact: the rest times 2^74 is a whole number, held as two of 37 bits. Scaled by 10^digits, its upper half is the
    digits and its lower half decides. A rest below 2^-22 is nothing at six digits. The units may be 10^digits.
    """
    if not 0 <= digits <= 6:
        raise ValueError("0 to 6 digits")
    half, mask, ten = 1 << (BITS - 1), (1 << BITS) - 1, 10**digits
    bits = F.lit(float(1 << BITS))
    low_bits = lambda x: x.bitwiseAND(F.lit(mask))

    def split(s: Column) -> Column:
        rest = s - F.floor(s)
        high = F.floor(rest * bits)
        low = F.floor((rest * bits - high) * bits) * ten
        return F.struct(F.floor(s).alias("whole"), (high * ten + F.shiftright(low, BITS)).alias("a"), low_bits(low).alias("b"), (rest < 2.0**-22).alias("none"))

    def rounded(x: Column) -> Column:
        units, over = F.shiftright(x["a"], BITS), low_bits(x["a"])
        odd = (units if digits else units + x["whole"]) % 2 == 1
        up = (over > half) | ((over == half) & ((x["b"] > 0) | odd))
        return F.when(x["none"], F.lit(0).cast("long")).otherwise(units + up.cast("long"))

    return let(split(size), lambda x: let(rounded(x), lambda units: body(x["whole"], units)))


def exact_round(v: Column, digits: int) -> Column:
    """The double nearest to the half-even rounding of the exact binary value to up to six digits: 1.005 to 2 gives 1.0.

    bround() rounds the shortest decimal form instead. From 2^52 on a double is whole and stays; so do NaN and null.
    """

    def near(whole: Column, units: Column) -> Column:
        text = F.concat(whole.cast("string"), F.lit("."), F.lpad(units.cast("string"), max(digits, 1), "0")).cast("double")
        carried = units == 10**digits
        small = (whole * 10**digits + units) / F.lit(float(10**digits))
        return F.when(whole < 2**53 // 10**digits - 1, small).when(carried, (whole + 1).cast("double")).otherwise(text)

    def signed(v: Column) -> Column:
        size = _parts(F.abs(v), digits, near)
        # The double nearest to a decimal of so many digits is its own rounding, which most times are; zero loses its sign below.
        done = (F.rint(v * float(10**digits)) / F.lit(float(10**digits)) == v) & (F.abs(v) < 2.0**30) & (v != 0)
        return F.when(done, v).when(F.isnan(v) | (F.abs(v) >= 2.0**52), v).when(v < 0, -size).otherwise(size)

    return let(v.cast("double"), signed)


def fixed(v: Column, digits: int) -> Column:
    """A number's text with so many decimals (up to six), rounded half-even on its exact value; null for NaN and from 2^63 on."""

    def written(whole: Column, units: Column) -> Column:
        if not digits:
            return (whole + units).cast("string")
        carried = units == 10**digits
        head = F.when(carried, whole + 1).otherwise(whole).cast("string")
        return F.concat(head, F.lit("."), F.lpad(F.when(carried, 0).otherwise(units).cast("string"), digits, "0"))

    def signed(v: Column) -> Column:
        size = _parts(F.abs(v), digits, written)
        return F.when(F.isnan(v) | (F.abs(v) >= 2.0**63), F.lit(None).cast("string")).when(v < 0, F.concat(F.lit("-"), size)).otherwise(size)

    return let(v.cast("double"), signed)


def clip(v: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(v, low), high)
