"""murmur3 (32 bits, seed 0) as built-in expressions, and ring intervals.

Every step of the hash uses its input more than once, so steps are bound to lambda variables: as plain nested columns the
expression would double with each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash.
C1, C2, MIX1, MIX2, ADD, SEED = 0xCC9E2D51, 0x1B873593, 0x85EBCA6B, 0xC2B2AE35, 0xE6546B64, 0
MASK = 0xFFFFFFFF
SPAN = 1 << 32


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _times(x: Column, c: int) -> Column:
    """Product modulo 2**32 without an overflow of 64 bits."""
    return let(x, lambda v: (v.bitwiseAND(0xFFFF) * c + F.shiftleft((F.shiftright(v, 16) * c).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK))


def _rotated(x: Column, r: int) -> Column:
    return let(x, lambda v: F.shiftleft(v, r).bitwiseOR(F.shiftright(v, 32 - r)).bitwiseAND(MASK))


def _shifted(x: Column, r: int) -> Column:
    return let(x, lambda v: v.bitwiseXOR(F.shiftright(v, r)))


def _scrambled(k: Column) -> Column:
    return _times(_rotated(_times(k, C1), 15), C2)


def _little(digits: Column, start: Column, size: int) -> Column:
    """A little-endian number of ``size`` bytes from hexadecimal digits; what lies beyond the end counts as nothing."""
    parts = [F.substring(digits, start + 2 * k + 1, F.lit(2)) for k in reversed(range(size))]
    return F.conv(F.concat(F.lit("0"), *parts), 16, 10).cast("long")


def murmur3(data: Column) -> Column:
    """The hash of a binary column as a number from 0 to 2**32 - 1; null stays null."""

    def of(digits: Column) -> Column:
        n = (F.length(digits) / 2).cast("int")
        blocks = F.when(n >= 4, F.sequence(F.lit(0), (n / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        start = F.lit(SEED).cast("long")
        step = lambda h, i: (_rotated(h.bitwiseXOR(_scrambled(_little(digits, i * 8, 4))), 13) * 5 + ADD).bitwiseAND(MASK)
        body = F.aggregate(blocks, start, step)
        whole = ((n / 4).cast("int") * 8).cast("int")
        tail = F.when(n % 4 > 0, _scrambled(_little(digits, whole, 3))).otherwise(F.lit(0).cast("long"))
        mixed = body.bitwiseXOR(tail).bitwiseXOR(n.cast("long"))
        return _shifted(_times(_shifted(_times(_shifted(mixed, 16), MIX1), 13), MIX2), 16)

    return let(F.hex(data), of)


def murmur3_of(data: bytes) -> int:
    """The same hash of single bytes, on the driver."""
    h = SEED
    cut = len(data) & ~3
    for k in range(0, cut, 4):
        h ^= _scramble(int.from_bytes(data[k : k + 4], "little"))
        h = ((h << 13 | h >> 19) & MASK) * 5 + ADD & MASK
    if len(data) > cut:
        h ^= _scramble(int.from_bytes(data[cut:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * MIX1 & MASK
    h = (h ^ h >> 13) * MIX2 & MASK
    return h ^ h >> 16


def _scramble(k: int) -> int:
    k = k * C1 & MASK
    return ((k << 15 | k >> 17) & MASK) * C2 & MASK


def in_interval(h: Column, start: Column, end: Column) -> Column:
    """Whether h lies in (start, end] on the ring; start = end is the whole ring."""
    return F.when(start < end, (h > start) & (h <= end)).otherwise((h > start) | (h <= end))


def clockwise(h: Column, origin: Column) -> Column:
    """Distance from origin to h along the ring."""
    return F.pmod(h - origin, F.lit(SPAN))
