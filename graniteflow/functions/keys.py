"""Several whole numbers in one decimal, so that a maximum by them is kept in a buffer of fixed size and combines before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"


def below(value: Column, most: int) -> Column:
    """value; an error where it isn't from 0 up to, and without, ``most``, as it would run over into what stands above it. Null stays null."""
    return F.when((value >= 0) & (value < most), value).when(value.isNotNull(), F.raise_error(F.concat(F.lit(f"key part not below {most}: "), value.cast("string"))))


def packed(*parts: tuple[Column, int]) -> Column:
    """(value, digits) pairs, the first counting most; values are whole, not negative and below 10**digits (else an error), 37 digits in all at most, or 30 if it is unpacked again.

    A null part makes the key null, so such a row wins nothing.
    """
    if sum(digits for _, digits in parts) > 37:
        raise ValueError("a key has 37 digits at most")
    out = F.lit(0).cast(_WIDE)
    for value, digits in parts:
        out = (out * F.lit(10**digits).cast(_WIDE)).cast(_WIDE) + below(value, 10**digits).cast(_WIDE)
    return out.cast(_WIDE)


def falling(value: Column, digits: int) -> Column:
    """A value turned round, so that small ones count most."""
    return F.lit(10**digits - 1) - value


def unpacked(key: Column, *digits: int) -> list[Column]:
    """The values of ``packed`` again."""
    out = []
    for n in reversed(digits):
        low = key % F.lit(10**n).cast(_WIDE)
        out.append(low.cast("long"))
        key = ((key - low) / F.lit(10**n).cast(_WIDE)).cast(_WIDE)
    return out[::-1]
