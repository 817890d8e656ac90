"""Quality by compression: zstandard dictionaries of good and bad labelled text.

Every text is compressed in short blocks twice, once with a dictionary of good and once with
one of bad text. The normalised difference of the two sizes says which it resembles; a logistic
calibration turns it into the probability of label 1; it is fitted on sample rows that are measured
without their own text in a dictionary. Short blocks keep the dictionary at work throughout long
texts. Dictionaries hold the whole texts of the sample, and their windows and tables are as large.

Defined cases: a null or empty text has difference 0 and the calibrated score of that; very long
texts are scored whole; rows that repeat, and texts that tie, are scored each; without labels of
both kinds every score is one constant; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import Logistic, fit_logistic, known_labels, label_rate, labelled_sample
from .shared import fold, materialise

FOLDS, HELD_OUT = 3, 1
PER_CLASS = 2_000  # bound of the labelled sample, rows of each label
CLASS_BYTES = 8_000_000  # and bytes: the row that reaches them is a label's last
BLOCK = 256
LEVEL = 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    calibration: Logistic


class Measure:
    """The normalised difference of a text's UTF-8 bytes."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        def compressor(content: bytes):
            log = min(27, max(17, len(content).bit_length()))
            how = z.ZstdCompressionParameters.from_level(LEVEL, window_log=log, hash_log=min(log, 22), chain_log=min(log, 22), write_content_size=False, write_checksum=False, write_dict_id=False)
            if len(content) < 8:
                return z.ZstdCompressor(compression_params=how)
            held = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            return z.ZstdCompressor(compression_params=how, dict_data=held)

        self.good, self.bad = compressor(good), compressor(bad)

    def __call__(self, data: bytes) -> float:
        if not data:
            return 0.0
        view = memoryview(data)
        blocks = [view[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        good = sum(len(self.good.compress(b)) for b in blocks)
        bad = sum(len(self.bad.compress(b)) for b in blocks)
        return (bad - good) / (bad + good)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``per_class`` rows and about ``class_bytes`` bytes of each label outside the held-out fold.

    Each half of the sample is measured with dictionaries of the other half's whole texts; the
    calibration comes from these, the final dictionaries from both halves.
    """
    known = known_labels(labels, "quality", FOLDS, HELD_OUT)
    sample = materialise(labelled_sample(docs, known, per_class, id_col, text_col, class_bytes), "sample")
    rows = sorted(sample.select("id", "y", "half", F.col("text").cast("binary").alias("text")).collect(), key=lambda r: (r["id"], bytes(r["text"])))

    def joined(halves: tuple[int, ...]) -> tuple[bytes, bytes]:
        return tuple(b"\n".join(bytes(r["text"]) for r in rows if r["y"] == y and r["half"] in halves) for y in (1, 0))

    held = docs.sparkSession.sparkContext.broadcast((joined((1,)), joined((0,))))  # about 2 * class_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = [Measure(*d) for d in held.value]
        for batch in batches:
            x = [measure[h](t.as_py().encode("utf-8", "replace")) for t, h in zip(batch.column(0), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1).cast(pa.int32())], ["x", "y"])

    found = sorted((r["x"], r["y"]) for r in sample.select("text", "y", "half").mapInArrow(run, "x double, y int").collect())
    return Model(*joined((0, 1)), fit_logistic(np.array([x for x, _ in found]), np.array([y for _, y in found], dtype=int), label_rate(known)))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, difference per row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        measure = Measure(m.good, m.bad)
        for batch in batches:
            x = [measure((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m.calibration(v) for v in x], pa.float64()), pa.array(x, pa.float64())],
                ["doc_id", "score", "difference"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, difference double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = score_quality(docs, fit(docs, labels))
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
