"""Exact dedup against a history of digests held under a minimal perfect hash.

The history's distinct digests are dealt to shards; each shard builds one perfect hash whose
slots hold the full digest and the winner's locator (id, length, copies). Arriving digests,
aggregated to one row each before they move, look up their slot, compare all 32 bytes, and
either join the slot's group or, as nonmembers, form groups of their own. Texts never move:
only digests, lengths and ids are shuffled.

Defined cases: a null text counts as empty; null ids sort after all others; rows that repeat
an id with the same text are one document and share its decision; empty tables give empty
results; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mph import WIDTH, PerfectHash
from .shared import SPACE_CLASS, materialise, shards_for

PER_SHARD = 100_000
_GROUP = "digest binary, keep_id long, keep_length long, group_size long"


def digests(docs: DataFrame, is_history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length, digest, old): code points of the original text, SHA-256 of the text without whitespace."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace(text, f"{SPACE_CLASS}+", "")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("length"),
        F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"),
        F.coalesce(is_history, F.lit(False)).alias("old"),
    )


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per digest with its winner: the longest original text, then the smallest id."""
    best = F.min(F.struct(F.negative("length").alias("n"), F.isnull("doc_id").alias("z"), F.col("doc_id").alias("id")))
    return rows.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("b.id").alias("keep_id"), F.negative(F.col("b.n")).alias("keep_length"), "group_size"
    )


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _keys(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), WIDTH)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): the perfect hash of each shard's distinct digests, from ``group_digests`` rows."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = _keys(rows["digest"])
        mph = PerfectHash.build(keys)
        at = np.argsort(mph.slots(keys))
        null = rows["keep_id"].isna().to_numpy()
        blob = mph.to_bytes(
            digest=keys[at],
            keep_id=rows["keep_id"].fillna(0).to_numpy(np.int64)[at],
            no_id=null[at],
            keep_length=rows["keep_length"].to_numpy(np.int64)[at],
            group_size=rows["group_size"].to_numpy(np.int64)[at],
        )
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "blob": [blob]})

    return history.withColumn("shard", _shard(F.col("digest"), shards)).groupBy("shard").applyInPandas(build, "shard int, blob binary")


def look_up(arrivals: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """All groups after the arrivals: every slot, updated, and a group for each nonmember digest."""

    def merge(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        ids = new["keep_id"].fillna(0).to_numpy(np.int64)
        null = new["keep_id"].isna().to_numpy()
        length, size = new["keep_length"].to_numpy(np.int64), new["group_size"].to_numpy(np.int64)
        keys = _keys(new["digest"]) if len(new) else np.empty((0, WIDTH), np.uint8)
        member = np.zeros(len(new), dtype=bool)
        parts = []
        if len(old):
            mph, slot = PerfectHash.from_bytes(old["blob"].iloc[0])
            at = mph.slots(keys)
            member = at >= 0
            member[member] = (slot["digest"][at[member]] == keys[member]).all(axis=1)
            to = at[member]
            slot["group_size"][to] += size[member]
            a = (-length[member], null[member], ids[member])
            b = (-slot["keep_length"][to], slot["no_id"][to], slot["keep_id"][to])
            better = (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))
            for name, value in (("keep_length", length), ("no_id", null), ("keep_id", ids)):
                slot[name][to[better]] = value[member][better]
            parts.append((slot["digest"], slot["keep_id"], slot["no_id"], slot["keep_length"], slot["group_size"]))
        parts.append((keys[~member], ids[~member], null[~member], length[~member], size[~member]))
        digest, keep, none, longest, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({
            "digest": [x.tobytes() for x in digest],
            "keep_id": pd.Series(keep, dtype="Int64").mask(pd.Series(none)),
            "keep_length": longest,
            "group_size": sizes,
        })

    new = arrivals.withColumn("shard", _shard(F.col("digest"), shards))
    return new.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(merge, _GROUP)


def exact_dedup(docs: DataFrame, is_history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows where ``is_history`` holds form the index; the others arrive and look themselves up.
    The decisions do not depend on that division.
    """
    rows = materialise(digests(docs, is_history, id_col, text_col), "digests")
    n = rows.count()
    shards = shards_for(n, PER_SHARD)
    index = build_index(group_digests(rows.where("old")), shards)
    groups = look_up(group_digests(rows.where("not old")), index, shards)
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
