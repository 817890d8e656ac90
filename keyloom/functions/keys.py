"""Keys are byte strings in unsigned lexicographic order, or Spark strings, which sort alike in UTF-8.

Filters are written as half-open ranges or prefixes that reach the Parquet scan: a binary prefix
as ``key >= p AND key < successor(p)``, a string prefix as ``startswith``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import KeyPathError, KeyTooLong, ValueTooLong

SEPARATOR = b"/"
MOST_KEY_BYTES = 65_534
MOST_VALUE_BYTES = 65_535

Key = bytes | str


def successor(prefix: bytes) -> bytes | None:
    """The least key above every key that starts with ``prefix``; None if there is no such key."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def in_prefix(key: Column, prefix: Key) -> Column:
    """Whether the key starts with ``prefix``, in a form that Parquet readers can prune by."""
    if isinstance(prefix, str):
        return key.startswith(prefix) if prefix else key.isNotNull()
    if not prefix:
        return key.isNotNull()
    end = successor(prefix)
    low = key >= F.lit(prefix)
    return low if end is None else low & (key < F.lit(end))


def after(key: Column, marker: Key | None) -> Column:
    """Strictly above the marker; no marker, no bound."""
    return F.lit(True) if marker is None else key > F.lit(marker)


def key_length(key: Column, binary: bool) -> Column:
    return F.octet_length(key) if binary else F.char_length(key)


def rollup_path(key: Column, prefix: Key, delimiter: Key) -> Column:
    """The key up to and with the first delimiter after the prefix; null if there is none.

    Binary keys are searched in pairs of hexadecimal digits: Spark counts characters in a
    position but bytes in a substring, so a plain search misplaces bytes above 0x7f.
    """
    if isinstance(prefix, str):
        n = len(prefix)
        at = F.locate(delimiter, F.substring(key, n + 1, 2**31 - 1 - n))
        return F.when(at > 0, F.substring(key, F.lit(1), at + n))
    n = len(prefix)
    head = F.regexp_extract(F.hex(F.substring(key, n + 1, 2**31 - 1 - n)), f"^((?:..)*?{delimiter.hex().upper()})", 1)
    return F.when(F.length(head) > 0, F.substring(key, F.lit(1), (F.length(head) / 2).cast("int") + n))


def check_key(key: bytes) -> bytes:
    if len(key) > MOST_KEY_BYTES:
        raise KeyTooLong(f"a key of {len(key)} bytes; at most {MOST_KEY_BYTES}")
    return key


def check_value(value: bytes) -> bytes:
    if len(value) > MOST_VALUE_BYTES:
        raise ValueTooLong(f"a value of {len(value)} bytes; at most {MOST_VALUE_BYTES}")
    return value


def _segment(segment: Key) -> bytes:
    raw = segment.encode() if isinstance(segment, str) else bytes(segment)
    if not raw:
        raise KeyPathError("a segment is empty")
    if SEPARATOR in raw or b"\0" in raw:
        raise KeyPathError("a segment holds a separator or NUL")
    if raw in (b".", b".."):
        raise KeyPathError("a segment is a relative reference")
    return raw


@dataclass(frozen=True)
class KeyPrefix:
    """A validated path prefix, always ending with the separator unless empty."""

    raw: bytes = b""

    def __bytes__(self) -> bytes:
        return self.raw

    def __len__(self) -> int:
        return len(self.raw)


@dataclass(frozen=True)
class KeyPath:
    """A path built from validated segments: not empty, without separator or NUL, not ``.`` or ``..``."""

    raw: bytes = b""

    @classmethod
    def of(cls, *segments: Key) -> KeyPath:
        out = cls()
        for s in segments:
            out = out.push(s)
        return out

    with_namespace = of

    def push(self, segment: Key) -> KeyPath:
        raw = _segment(segment)
        return KeyPath(self.raw + SEPARATOR + raw if self.raw else raw)

    def into_prefix(self) -> KeyPrefix:
        return KeyPrefix(self.raw + SEPARATOR if self.raw else b"")

    def __bytes__(self) -> bytes:
        return self.raw

    def __len__(self) -> int:
        return len(self.raw)


def path_column(*segments: Column | str) -> Column:
    """A path key from segment columns; null where a segment breaks the rules."""
    columns = [F.lit(s) if isinstance(s, str) else s.cast("string") for s in segments]
    bad = [c.isNull() | c.rlike(r"^(|\.|\.\.)$") | c.contains("/") | c.contains("\0") for c in columns]
    wrong = bad[0]
    for b in bad[1:]:
        wrong = wrong | b
    return F.when(~wrong, F.concat_ws("/", *columns))
