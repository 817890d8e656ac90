"""The recovery journal: a chain of opaque records between anchors (sequence, digest)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import JournalAnchorMismatch, JournalEnvelopeError, JournalPositionExpired

DIGEST_BYTES = 32
MOST_PAYLOAD_BYTES = 16 * 1024 * 1024
SCHEMA = "prev_seq long, prev_digest binary, cur_seq long, cur_digest binary, payload binary"


@dataclass(frozen=True)
class JournalAnchor:
    sequence: int
    digest: bytes

    def __post_init__(self) -> None:
        if len(self.digest) != DIGEST_BYTES:
            raise JournalEnvelopeError(f"a digest has {DIGEST_BYTES} bytes")


@dataclass(frozen=True)
class JournalEnvelope:
    previous: JournalAnchor
    current: JournalAnchor
    payload: bytes

    def __post_init__(self) -> None:
        if self.current.sequence != self.previous.sequence + 1:
            raise JournalEnvelopeError("an envelope goes on by one")
        if not self.payload:
            raise JournalEnvelopeError("an envelope has a payload")
        if len(self.payload) > MOST_PAYLOAD_BYTES:
            raise JournalEnvelopeError("the payload is too large for one record")

    def row(self) -> tuple:
        return (self.previous.sequence, self.previous.digest, self.current.sequence, self.current.digest, self.payload)


@dataclass(frozen=True)
class JournalState:
    checkpoint: JournalAnchor
    tail: JournalAnchor


@dataclass(frozen=True)
class JournalPage:
    envelopes: list[JournalEnvelope]
    next: JournalAnchor
    has_more: bool


def page_rows(journal: DataFrame, after: int, row_limit: int, byte_limit: int) -> DataFrame:
    """Rows behind ``after`` in order: at most row_limit, and no row that starts beyond byte_limit, but one at least.

    The running sum covers the first row_limit rows only, never the whole journal.
    """
    head = journal.where(F.col("cur_seq") > after).orderBy("cur_seq").limit(row_limit)
    upto = F.sum(F.octet_length("payload")).over(Window.orderBy("cur_seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = head.withColumn("upto", upto).withColumn("at", F.row_number().over(Window.orderBy("cur_seq")))
    return rows.where((F.col("upto") <= byte_limit) | (F.col("at") == 1)).drop("upto", "at")


def broken_links(journal: DataFrame, floor: int | None = None) -> DataFrame:
    """Rows whose previous anchor is not the current anchor of the row before, by an equality join on sequence.

    Rows up to ``floor``, the sequence of the journal's checkpoint, are taken as sound; without it, the first row is.
    """
    before = journal.select(F.col("cur_seq").alias("prev_seq"), F.col("cur_digest").alias("is_digest"))
    first = journal.agg((F.min("cur_seq") if floor is None else F.lit(floor)).alias("first"))
    rows = journal.join(before, "prev_seq", "left").join(F.broadcast(first), F.lit(True))
    bad = F.col("is_digest").isNull() | (F.col("is_digest") != F.col("prev_digest")) | (F.col("cur_seq") != F.col("prev_seq") + 1)
    return rows.where((F.col("cur_seq") > F.col("first")) & bad).drop("is_digest", "first")


def read_page(journal: DataFrame, state: JournalState, cursor: JournalAnchor, row_limit: int, byte_limit: int) -> JournalPage:
    """A bounded page behind the cursor, which must be a known anchor not below the checkpoint."""
    if row_limit <= 0:
        raise JournalEnvelopeError("the row limit is positive")
    if cursor.sequence < state.checkpoint.sequence:
        raise JournalPositionExpired("the cursor is older than the journal's floor")
    known = state.checkpoint if cursor.sequence == state.checkpoint.sequence else state.tail if cursor.sequence == state.tail.sequence else None
    if known is None:
        row = journal.where(F.col("cur_seq") == cursor.sequence).select("cur_digest").first()
        known = JournalAnchor(cursor.sequence, bytes(row[0])) if row else None
    if known is None or known.digest != cursor.digest:
        raise JournalAnchorMismatch("the cursor is no anchor of this journal")
    rows = page_rows(journal, cursor.sequence, row_limit, byte_limit).orderBy("cur_seq").collect()
    found = [JournalEnvelope(JournalAnchor(r[0], bytes(r[1])), JournalAnchor(r[2], bytes(r[3])), bytes(r[4])) for r in rows]
    end = found[-1].current if found else cursor
    return JournalPage(found, end, end.sequence < state.tail.sequence)
