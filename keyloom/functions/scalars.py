"""Column functions over keys and packed values; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """The longest string that both start with."""
    n = F.least(F.char_length(a), F.char_length(b))
    grow = F.reduce(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc),
    )
    return F.substring(a, F.lit(1), grow)


def successor(prefix: Column) -> Column:
    """The least binary key above all keys that start with a binary prefix; null if there is none."""
    cut = F.regexp_extract(F.hex(prefix), "^((?:..)*?)(?:FF)*$", 1)
    n = F.length(cut)
    last = F.conv(F.substring(cut, n - 1, F.lit(2)), 16, 10).cast("int") + 1
    return F.when(n > 0, F.unhex(F.concat(F.substring(cut, F.lit(1), n - 2), F.lpad(F.hex(last), 2, "0"))))


def strip_prefix(key: Column, prefix: str | bytes) -> Column:
    """The rest of the key behind the prefix; null where the key does not start with it."""
    return F.when(key.startswith(F.lit(prefix)), F.substring(key, len(prefix) + 1, 2**31 - 1 - len(prefix)))


def unpack_le(value: Column, offset: int, width: int) -> Column:
    """An unsigned little-endian integer of up to 7 bytes at a byte offset (from 0) of a binary value."""
    parts = [F.conv(F.hex(F.substring(value, offset + i + 1, 1)), 16, 10).cast("long") * (1 << (8 * i)) for i in range(width)]
    return sum(parts[1:], parts[0])


def pack_le(value: Column, width: int) -> Column:
    """The reverse of ``unpack_le``."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(value, 8 * i).bitwiseAND(255)), 2, "0") for i in range(width)]))


def ordered_number(value: Column, width: int = 16) -> Column:
    """A number as lower-case hexadecimal digits that sort like it."""
    return F.lower(F.lpad(F.hex(value), width, "0"))


def parse_pairs(text: Column, pair: str = ";", equals: str = "=") -> Column:
    """A map from ``k=v;k=v`` text."""
    return F.str_to_map(text, F.lit(pair), F.lit(equals))
