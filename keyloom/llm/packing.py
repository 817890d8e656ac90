"""Packing by power-of-two decomposition.

A document's ids, with the closing id, are cut into pieces whose lengths are powers of two:
as many of the largest length as fit, then the binary digits of the rest, longest first.
Every piece is a sequence of its own, so no sequence crosses documents and none is padded;
sequences of one length form a bucket and are numbered together.

Very long texts are encoded in bounded parts, cut where no token can cross.

Defined cases: a null or empty text is one piece of the closing id; rows that repeat are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

LONGEST = 2048
CLOSING_ID = 1
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PART_CHARS = 500_000
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary(NamedTuple):
    """One byte-level vocabulary: the tokenizers file, the same as tiktoken ranks, and its word pattern."""

    path: str
    ranks_path: str
    pattern: str


class TextTokenizer:
    """Ids of whole texts by a byte-level BPE vocabulary.

    tiktoken encodes with the ranks of the same vocabulary, about four times as fast as the
    tokenizers library; in each worker the first ``checked`` texts are encoded by the
    tokenizers file too, and a difference is an error. The file's added tokens, such as
    <|endoftext|>, keep their own ids wherever a text holds them, as that library has it.
    """

    def __init__(self, vocabulary: Vocabulary, checked: int = 20):
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary.ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.exact = Tokenizer.from_file(vocabulary.path)
        tokens = self.exact.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or " " in t.content for t in tokens.values()):
            raise ValueError("only added tokens that are matched as they stand, and hold no space, are supported")
        added = {t.content: i for i, t in tokens.items()}
        ranks = {piece: i for piece, i in ranks.items() if i not in tokens}
        self.fast = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=added)
        self.unchecked = checked

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        raw = b"".join(np.array(self.fast.encode(part, allowed_special="all"), dtype="<u4").tobytes() for part in bounded(text))
        if self.unchecked > 0 and len(text) <= PART_CHARS:
            self.unchecked -= 1
            if np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() != raw:
                raise ValueError("the ranks file and the tokenizer file give different ids")
        return raw


def bounded(text: str, chars: int = PART_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``chars``, cut before a lone space, which is always a border between words."""
    at = 0
    while len(text) - at > chars and (m := _LONE_SPACE.search(text, at + chars)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@lru_cache(maxsize=4)
def _tokenizer(vocabulary: Vocabulary) -> TextTokenizer:
    return TextTokenizer(vocabulary)


def pieces_of(tokens: int, longest: int = LONGEST) -> list[int]:
    """Piece lengths of a document of so many tokens, longest first."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut_documents(docs: DataFrame, vocabulary: Vocabulary, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = tok.ids(text.as_py() or "") + CLOSING_ID.to_bytes(4, "little")
                view, tokens, at = memoryview(raw), len(raw) // 4, 0
                for n in pieces_of(tokens, longest):
                    out.append((doc, at, n, zlib.crc32(view[4 * at : 4 * (at + n)]), tokens))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, vocabulary: Vocabulary, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with sequence_id (dense, bucket by bucket, shortest first) and offset 0."""
    cut = cut_documents(docs, vocabulary, longest, id_col, text_col)
    # monotonically_increasing_id is the writing task's number and a row number in it.
    rows = materialise(cut.withColumn("at", F.monotonically_increasing_id()), "pieces")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # One row for each (length, task): a few for each of the input's splits.
    before = Window.orderBy("length", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("at")) - 1
    return rows.withColumn("own", own).join(starts, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("own")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
