"""Secret scans over an incremental blob ledger.

Every historical version of a text is addressed by its SHA-256. The ledger says which rule
versions have seen which blob and what they found. A scan takes the blobs of the given rows,
leaves out every (blob, rule version) pair in the ledger, scans the rest once each, appends
to the ledger and joins findings back to all rows that hold the blob.

Only hashes and ids are grouped; a blob's text moves once, keyed by its row's id, so a blob
that a third of all rows hold lands in no single task. When few blobs are unseen, as in a
daily run, their ids are broadcast (up to ``BROADCAST_ROWS``) and no text moves at all.

``scan_into`` keeps the ledger as a growing Parquet table.

Defined cases: a null text counts as empty; rows with null or repeated ids, and texts that repeat,
are results each; very long texts are scanned whole; an empty table gives an empty result and an
empty ledger; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

BROADCAST_ROWS = 20_000
LEDGER = "blob binary, versions array<string>, spans array<struct<version:string,start:int,end:int>>"


class Rule(NamedTuple):
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    needs: tuple[str, ...] = ()  # one of these, in lower case, is in every text that matches
    hex_run: int = 0  # a run of so many hexadecimal digits is in every text that matches

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(tuple(self[:4])).encode()).hexdigest()[:16]


# The base kinds in their listed order, then kinds of well-known formats.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, ("akia",)),
    Rule("hex", r"[0-9a-f]+", 32, 0, (), 32),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0, ("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{16,}\.eyJ[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", 0, 0, ("eyj",)),
)
BASE_KINDS = ("assign", "access", "hex")
_HEX_MAP = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))


def scanner(rules: tuple[Rule, ...]) -> Callable[[str], list[tuple[str, int, int]]]:
    """A function from a text to its (rule version, start, end), in code points."""
    compiled = [(r, re.compile(r.pattern)) for r in rules]

    def scan(text: str) -> list[tuple[str, int, int]]:
        low, runs, out = text.lower(), None, []
        for r, pattern in compiled:
            if r.needs and not any(x in low for x in r.needs):
                continue
            if r.hex_run:
                runs = runs or text.encode("utf-8", "replace").translate(_HEX_MAP)
                if b"\1" * r.hex_run not in runs:
                    continue
            out += [(r.version, m.start(), m.end()) for m in pattern.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]
        return out

    return scan


def address(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob): each row's id and the SHA-256 of its text."""
    return docs.select(F.col(id_col).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("blob"))


def unseen(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, path, need): one row per blob for which some rule versions are new, with a path that holds it."""
    versions = F.array(*[F.lit(r.version) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        return blobs.withColumn("need", versions)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("seen"))
    left = blobs.join(seen, "blob", "left").withColumn("need", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))))
    return left.where(F.size("need") > 0).drop("seen")


def scan_blobs(docs: DataFrame, todo: DataFrame, rules: tuple[Rule, ...], few: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ledger rows for the blobs in ``todo``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans: dict[tuple[str, ...], Callable] = {}
        schema = pa.schema([("blob", pa.binary()), ("versions", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("version", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            needs = [tuple(x) for x in batch.column(2).to_pylist()]
            found = []
            for text, need in zip(batch.column(1), needs, strict=True):
                if need not in scans:
                    scans[need] = scanner(tuple(r for r in rules if r.version in need))
                found.append([{"version": v, "start": a, "end": b} for v, a, b in scans[need](text.as_py())])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array([list(x) for x in needs], schema.types[1]), pa.array(found, schema.types[2])], schema=schema)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("p"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("b"), text.alias("text"))
    todo = F.broadcast(todo) if few else todo.hint("shuffle_hash")
    mine = rows.join(todo, F.col("p").eqNullSafe(F.col("path")) & (F.col("b") == F.col("blob")))
    return mine.select("blob", "text", "need").mapInArrow(run, LEDGER)


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, appended): per row path, blob and spans<kind,start,end> in order; and the new ledger rows."""
    paths = materialise(address(docs, id_col, text_col), "paths")
    todo = materialise(unseen(paths, ledger, rules), "unseen")
    scanned = scan_blobs(docs, todo, rules, todo.count() <= BROADCAST_ROWS, id_col, text_col)
    appended = materialise(scanned.dropDuplicates(["blob"]), "ledger")  # rows may repeat id and text
    known = appended if ledger is None else appended.unionByName(ledger)
    kinds = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.version), F.struct(F.lit(i).alias("place"), F.lit(r.kind).alias("kind")))])
    hits = known.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).where(F.map_contains_key(kinds, F.col("s.version")))
    k = F.element_at(kinds, F.col("s.version"))
    span = F.struct(F.col("s.start").alias("start"), k.place.alias("place"), k.kind.alias("kind"), F.col("s.end").alias("end"))
    # Written before it is joined, so that a blob with very many rows can be split among tasks.
    spans = materialise(hits.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("spans")), "spans")
    return paths.join(spans, "blob", "left"), appended


def scan_into(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The findings of ``docs`` by the ledger under ``path``, to which what is new is appended."""
    spark = docs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    found, appended = secret_scan(docs, spark.read.schema(LEDGER).parquet(path) if known else None, rules, id_col, text_col)
    found = materialise(found, "found")
    appended.write.mode("append").parquet(path)
    return found


def span_text(spans: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ","), F.lit(""))
