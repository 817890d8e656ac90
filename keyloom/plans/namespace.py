"""Views of live rows: a tree at a position of the log, scoped to a prefix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import OutsideViewScope
from ..functions.keys import Key, in_prefix
from ..operators import points, prefixjoin
from ..operators.listing import ScopedRange


@dataclass(frozen=True)
class View:
    """A frozen, prefix-scoped read of (key, value, version) rows. An empty scope is the whole tree."""

    live: DataFrame
    scope: Key = b""

    def _inside(self, key: Key) -> Key:
        if not key.startswith(self.scope):
            raise OutsideViewScope(key if isinstance(key, bytes) else key.encode(), self.scope if isinstance(self.scope, bytes) else self.scope.encode())
        return key

    def get(self, key: Key) -> bytes | None:
        row = points.get(self.live, self._inside(key)).first()
        return None if row is None else bytes(row[0]) if isinstance(row[0], bytearray) else row[0]

    def get_record(self, key: Key) -> tuple | None:
        row = points.get_record(self.live, self._inside(key)).first()
        return None if row is None else (bytes(row[0]) if isinstance(row[0], bytearray) else row[0], row[1])

    def get_version(self, key: Key) -> int | None:
        row = points.get_version(self.live, self._inside(key)).first()
        return None if row is None else row[0]

    def get_many(self, queries: DataFrame) -> DataFrame:
        return points.get_many(self.rows(), queries)

    def rows(self) -> DataFrame:
        return self.live.where(in_prefix(F.col("key"), self.scope)).select("key", "value", "version")

    def range(self) -> ScopedRange:
        return ScopedRange(self.live, self.scope)

    def scan(self, prefix: Key) -> ScopedRange:
        return ScopedRange(self.live, self._inside(prefix))

    def range_keys(self) -> ScopedRange:
        return ScopedRange(self.live, self.scope, values=False)

    def scan_keys(self, prefix: Key) -> ScopedRange:
        return ScopedRange(self.live, self._inside(prefix), values=False)

    def is_prefix_empty(self, prefix: Key) -> bool:
        return points.is_prefix_empty(self.live, self._inside(prefix)).first()[0]

    def prefix_count(self, prefix: Key, limit: int = 0) -> tuple[int, bool]:
        row = points.prefix_count(self.live, self._inside(prefix), limit).first()
        return row["count"], row["exact"]

    def longest_prefix_record(self, query: Key) -> tuple | None:
        """The longest key in scope that is a prefix of ``query``, or None."""
        row = prefixjoin.longest_prefix_record(self.rows(), self._inside(query)).first()
        return None if row is None else tuple(bytes(v) if isinstance(v, bytearray) else v for v in row)


class Snapshot(View):
    """A view with an epoch that grows from snapshot to snapshot.

    The files it reads stay until ``retire``, whatever is checkpointed and collected meanwhile.
    """

    def __init__(self, live: DataFrame, scope: Key, epoch: int, release: Callable[[], object] = lambda: None):
        super().__init__(live, scope)
        object.__setattr__(self, "epoch", epoch)
        object.__setattr__(self, "release", release)

    def view(self) -> View:
        return View(self.live, self.scope)

    def retire(self) -> None:
        self.release()


class DBView(dict):
    """Views of several trees at one position, by tree name."""

    def tree(self, name: str) -> View | None:
        return self.get(name)

    def is_empty(self) -> bool:
        return not self
