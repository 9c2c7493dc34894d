"""Reading numbers and slices out of BINARY columns with built-in expressions.

Positions count bytes from 0. A read past the end is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def read_at(b: Column, position, n) -> Column:
    """The n bytes at position, or null where the value ends before them."""
    p, n = _c(position), _c(n)
    return F.when((p >= 0) & (p + n <= F.octet_length(b)), F.substring(b, (p + 1).cast("int"), n.cast("int")))


def be(b: Column, position, n: int) -> Column:
    """A big-endian unsigned number of n bytes (8-byte numbers wrap to signed)."""
    part = F.conv(F.hex(read_at(b, position, n)), 16, 10 if n < 8 else -10)
    return part.cast("long")


def le(b: Column, position, n: int) -> Column:
    """A little-endian unsigned number of n bytes (8-byte numbers wrap to signed)."""
    parts = [F.hex(F.substring(b, (_c(position) + k + 1).cast("int"), 1)) for k in reversed(range(n))]
    return F.when(read_at(b, position, n).isNotNull(), F.conv(F.concat(*parts), 16, 10 if n < 8 else -10).cast("long"))


def u8(b: Column, position) -> Column:
    return be(b, position, 1)


def seek_position(whence: str, offset: Column, current: Column, size: Column) -> Column:
    """The position after a seek from the begin, the current place or the end; null outside [0, size]."""
    base = {"beg": F.lit(0), "cur": current, "end": size}[whence]
    return F.when((base + offset >= 0) & (base + offset <= size), base + offset)


def bits(b: Column, first_bit, n: int) -> Column:
    """n bits (at most 32) from first_bit on, the most significant first; at the end of the value, those that are left."""
    first = _c(first_bit)
    byte = F.floor(first / 8)
    padded = F.concat(b, F.unhex(F.lit("0000000000")))
    word = F.conv(F.hex(F.substring(padded, (byte + 1).cast("int"), 5)), 16, 10).cast("long")
    have = F.greatest(F.least(F.lit(n), F.octet_length(b) * 8 - first), F.lit(0))
    shift = (F.lit(40) - (first % 8) - have).cast("int")
    return F.when(have == 0, F.lit(0)).otherwise(F.call_function("shiftright", word, shift).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), have.cast("int")) - 1))


def synchsafe(b: Column, position) -> Column:
    """Four bytes of 7 bits each; null if a top bit is set."""
    parts = [u8(b, _c(position) + k) for k in range(4)]
    ok = (parts[0] < 128) & (parts[1] < 128) & (parts[2] < 128) & (parts[3] < 128)
    return F.when(ok, F.shiftleft(parts[0], 21) + F.shiftleft(parts[1], 14) + F.shiftleft(parts[2], 7) + parts[3])


def plane_copy(b: Column, stride, row_bytes, height) -> Column:
    """The rows of a plane without the padding of its stride."""
    s, w = _c(stride), _c(row_bytes)
    rows = F.transform(F.sequence(F.lit(0), _c(height) - 1), lambda y: F.hex(F.substring(b, (y * s + 1).cast("int"), w.cast("int"))))
    return F.when(_c(height) > 0, F.unhex(F.array_join(rows, ""))).otherwise(F.unhex(F.lit("")))
