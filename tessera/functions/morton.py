"""Morton keys: y and x bits in turn, y first, as order-preserving BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGN = -(1 << 63)


def _spread(v: Column, low: int = 0) -> Column:
    """Bits ``low`` to 31 moved to the even places; the others count as 0.
    Plain long arithmetic, which compiles."""
    out = F.lit(0).cast("long")
    for i in range(low, 32):
        out = out.bitwiseOR(F.shiftleft(v.bitwiseAND(F.lit(1 << i)), i))
    return out


def _gather(v: Column, first: int) -> Column:
    """Every second bit from ``first`` on, moved together."""
    out = F.lit(0).cast("long")
    for i in range(32):
        out = out.bitwiseOR(F.shiftright(F.shiftrightunsigned(v, first).bitwiseAND(F.lit(1 << 2 * i)), i))
    return out


def truncated(v: Column, mapbits: int) -> Column:
    """World coordinate with only the top mapbits / 2 bits kept."""
    return v.bitwiseAND(F.lit((0xFFFFFFFF << (32 - mapbits // 2)) & 0xFFFFFFFF))


def key(x: Column, y: Column, mapbits: int = 64) -> Column:
    """Signed order of the result equals unsigned order of the interleaved
    bits, so ranges push down to Parquet statistics."""
    low = 32 - mapbits // 2
    return _spread(x, low).bitwiseOR(F.shiftleft(_spread(y, low), 1)).bitwiseXOR(F.lit(_SIGN))


def decode(qkey: Column) -> tuple[Column, Column]:
    """(x, y) of a key."""
    raw = qkey.bitwiseXOR(F.lit(_SIGN))
    return _gather(raw, 0), _gather(raw, 1)


def tile_range(z: int, x: int, y: int) -> tuple[int, int]:
    """First and last key of a tile, both inclusive."""
    low = 0
    for i in range(z):
        bit = z - 1 - i
        low = (low << 2) | (((y >> bit) & 1) << 1) | ((x >> bit) & 1)
    low <<= 64 - 2 * z
    return low + _SIGN, low + (1 << (64 - 2 * z)) - 1 + _SIGN


def in_tile(qkey: Column, z: int, x: int, y: int) -> Column:
    """Range predicate of a tile; every key at zoom 0."""
    low, high = tile_range(z, x, y)
    return qkey.between(low, high) if z else F.lit(True)


def merged_ranges(ranges: list[tuple[int, int]], most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` ranges that cover the given ones: neighbours join, and
    then the smallest gaps close."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    if len(out) <= most:
        return out
    gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
    kept = [0, *sorted(gaps[len(out) - most :])]
    return [(out[i][0], out[j - 1][1]) for i, j in zip(kept, [*kept[1:], len(out)], strict=True)]


def in_ranges(qkey: Column, ranges: list[tuple[int, int]]) -> Column:
    """Predicate of a few key ranges, which Parquet statistics can use."""
    found = F.lit(False)
    for low, high in ranges:
        found = found | qkey.between(low, high)
    return found
