"""Line dedup by an exact set-similarity join.

A line's words form a set; a later line (in order of document id, then place) goes when some
earlier line is similar: Jaccard at least ``THRESHOLD``. Only lines without words are never
compared. Below ``LEAST_POSTED`` distinct words, similar sets are equal sets.

The words of a line are ordered by rarity. A similar pair shares a word among the first few
(the prefix), so each line posts its prefix words only; lines meet at a shared word and are
tested by length, by position and by a signature whose distance never exceeds the number of
differing words. Counts for the order are kept in a fixed number of buckets, summed over all
lines; any fixed order gives the same result, and a bucket that counts one word posts nothing.
Texts are read once for the counts and once for the postings. Words for which many lines post are
split into blocks, and pairs of blocks are compared apart.

For each line and word the nearest candidate is verified on the whole sets. A line for which that
fails and that has others comes back with all of them: as pairs where they are few, else in a
cluster whose lines are compared in one group, of bounded size. Equal sets are grouped before.

Words are told apart by 64-bit hashes and equal sets by 128 bits. Texts are cut into words, hashed
and counted in numpy, whole buffers at a time.

Defined cases: a null text stays null and has no lines; a null id stands after all others, told
apart by text; rows that share an id share their lines' places, and a line goes from all of them
together; of equal lines the first stays; a very long text or word is read like any other; empty
tables give empty results; other columns pass through unchanged, but for n_lines and n_removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import discard, materialise, unused

THRESHOLD = (4, 5)  # 0.8
LEAST_POSTED = -(-THRESHOLD[0] // (THRESHOLD[1] - THRESHOLD[0]))  # one word more or less still leaves the wanted Jaccard
BUCKET_BITS = 22
BUCKETS = 1 << BUCKET_BITS
CHUNKS = 64
HOT = 8_192
PER_BUCKET = 300_000
FLUSH = 500_000
FEW = 16
ASKERS = 1_024
MOST_HELD = 2_000_000
BROADCAST_LINES = 100_000
GROUP_BYTES = 1 << 19
LONG_WORD = 256
LONG_LINE = 96  # words; longer lines have another kind of signature
_RANK_BITS = 12


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


# The low k bytes of a word, k from 0 to 8.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a byte buffer that ends in whitespace.

    Eight bytes of every word are read at once from its start; words that go on take further turns.
    """
    space = (buf == 32) | ((buf - np.uint8(9)) < np.uint8(5))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = edge if space[0] else np.concatenate([[0], edge])
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))
    h = size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    at, left, rows = start, size, slice(None)
    for _ in range(-(-LONG_WORD // 8)):
        own = h[rows] ^ (eight[at] & _LOW[np.minimum(left, 8)])
        own *= np.uint64(0x9E3779B97F4A7C15)
        h[rows] = own ^ (own >> np.uint64(32))
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        rows = more if isinstance(rows, slice) else rows[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxh64_intdigest(buf[start[i] : start[i] + size[i]].tobytes())
    return start, _mix(h)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def ranks(counts: np.ndarray) -> np.ndarray:
    """A number per bucket that grows with its count, in _RANK_BITS bits; 0 where nothing can be shared."""
    return np.where(counts > 1, np.minimum(np.log2(counts + 1.0) * 64, (1 << _RANK_BITS) - 1), 0).astype(np.uint16)


class Lines:
    """The lines that have words, as flat arrays of distinct word hashes, line by line.

    Within a line the words go by ``rank``, then by hash; without ranks by hash. ``chosen`` holds a
    list of line numbers for each text, where not all lines are wanted.
    """

    def __init__(self, ids: list[int], texts: list[bytes], rank: np.ndarray | None = None, chosen: list[list[int]] | None = None):
        if chosen is not None:
            parts = [t.split(b"\n") for t in texts]
            chosen = [[k for k in c if k < len(p)] for c, p in zip(chosen, parts, strict=True)]
            texts = [b"\n".join([p[k] for k in c]) for c, p in zip(chosen, parts, strict=True)]
        buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        feed = buf == 10
        start, h = word_hashes(buf)
        line = np.cumsum(feed, dtype=np.int64)[start]
        lines = int(feed.sum())
        bits = 64 - lines.bit_length() - _RANK_BITS
        key = (line.astype(np.uint64) << np.uint64(64 - lines.bit_length())) | (h >> np.uint64(64 - bits))
        if rank is not None:
            key |= rank[_bucket(h)].astype(np.uint64) << np.uint64(bits)
        order = np.argsort(key)
        key, h = key[order], h[order]
        if ((key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
            again = np.lexsort((h, key))
            order, key, h = order[again], key[again], h[again]
        line = line[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
        self.hash = h[new]
        size = np.bincount(line[new], minlength=lines)
        fit = size > 0
        if chosen is None:
            per_text = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
            no = np.arange(lines) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        else:
            per_text = np.array([max(1, len(c)) for c in chosen], dtype=np.int64)
            no = np.array([k for c in chosen for k in (c or [-1])], dtype=np.int64)
        self.size = size[fit]
        self.doc = np.repeat(np.array(ids, dtype=np.int64), per_text)[fit]
        self.no = no[fit].astype(np.int32)
        self.start = np.cumsum(self.size) - self.size
        self.line = np.repeat(np.arange(len(self.size)), self.size)

    def set_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit values that do not depend on the words' order."""
        if not len(self.size):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.add.reduceat(_mix(self.hash + np.uint64(k)), self.start).view(np.int64) for k in (1, 0x51ED27))

    def signature(self) -> tuple[np.ndarray, np.ndarray]:
        """Two words: 64 parities of word counts and 0; for lines over LONG_LINE words, 32 word counts modulo 16."""
        if not len(self.size):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        out = np.bitwise_xor.reduceat(np.uint64(1) << (self.hash & np.uint64(63)), self.start)
        more = np.zeros(len(out), dtype=np.uint64)
        long = np.flatnonzero(self.size > LONG_LINE)
        if len(long):
            words = np.concatenate([self.hash[s : s + n] for s, n in zip(self.start[long].tolist(), self.size[long].tolist(), strict=True)])
            at = np.repeat(np.arange(len(long)), self.size[long]) * 32 + (words & np.uint64(31)).astype(np.int64)
            four = (np.bincount(at, minlength=32 * len(long)) & 15).astype(np.uint64).reshape(-1, 2, 16)
            both = np.bitwise_or.reduce(four << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)
            out[long], more[long] = both[:, 0], both[:, 1]
        return out, more


def _cyclic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum over 16 counts modulo 16 of their least possible differences."""
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(0, 64, 4):
        d = ((x >> np.uint64(k)) - (y >> np.uint64(k))) & np.uint64(15)
        out += np.minimum(d, np.uint64(16) - d).astype(np.int64)
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, ...]]:
    """Rows (id, text as binary, ...) as lists, in groups of bounded size."""
    held, size = None, 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
            held = held or tuple([] for _ in row)
            for to, value in zip(held, row, strict=True):
                to.append(value.as_py() if isinstance(value, pa.Scalar) else value)
            size += len(held[1][-1])
            if size > GROUP_BYTES:
                yield held
                held, size = None, 0
    if held:
        yield held


class Tally:
    """Counts per bucket, added up some millions of words at a time."""

    def __init__(self) -> None:
        self.total = np.zeros(BUCKETS, dtype=np.int64)
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def add(self, buckets: np.ndarray) -> None:
        self.held.append(buckets.astype(np.int32))
        self.waiting += len(buckets)
        if self.waiting > 2 * BUCKETS:
            self.counts()

    def counts(self) -> np.ndarray:
        if self.held:
            self.total += np.bincount(np.concatenate(self.held), minlength=BUCKETS)
            self.held.clear()
            self.waiting = 0
        return self.total


def _packed(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for c, part in enumerate(np.split(counts.astype("<i8"), CHUNKS)):
        if part.any():
            yield c, pack(part.tobytes())


def total_counts(partial: DataFrame) -> np.ndarray:
    """The sum of all tasks' (chunk, counts) rows: BUCKETS numbers, whatever the input's size."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        total = np.zeros(BUCKETS // CHUNKS, dtype="<i8")
        for blob in rows["counts"]:
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype="<i8")
        return pd.DataFrame({"chunk": [int(rows["chunk"].iloc[0])], "counts": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})

    import zstandard

    # Sums of sums keep the rows that meet in one task few, however many tasks have counted.
    spread = max(1, partial.rdd.getNumPartitions() // 64)
    some = partial.withColumn("spread", F.pmod(F.xxhash64("counts"), F.lit(spread)))
    some = some.groupBy("chunk", "spread").applyInPandas(add, "chunk int, counts binary")
    some = some if spread == 1 else some.groupBy("chunk").applyInPandas(add, "chunk int, counts binary")
    out = np.zeros((CHUNKS, BUCKETS // CHUNKS), dtype=np.int64)
    for r in some.collect():
        out[r["chunk"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), dtype="<i8")
    return out.ravel()


def line_id(id_column: Column, text: Column) -> Column:
    """The document's id as a long; a null id becomes a place after all others, by text."""
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 3)
    return F.coalesce(id_column.cast("long"), own)


def word_counts(rows: DataFrame) -> DataFrame:
    """Each task's (chunk, counts) of all words, repeats within a line included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Tally()
        for _, texts in _texts(batches):
            total.add(_bucket(word_hashes(np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8))[1]))
        packed = list(_packed(total.counts()))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in packed], pa.int32()), pa.array([b for _, b in packed], pa.binary())], ["chunk", "counts"])

    return rows.mapInArrow(run, "chunk int, counts binary")


def _prefixes(lines: Lines, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word, line, position) of every posted prefix word, rarest first within a line."""
    num, den = THRESHOLD
    position = np.arange(len(lines.line)) - lines.start[lines.line]
    n = lines.size[lines.line]
    at = np.flatnonzero((n >= LEAST_POSTED) & (position < n + (-num * n) // den + 1))
    at = at[rank[_bucket(lines.hash[at])] > 0]
    return lines.hash[at], lines.line[at], position[at]


# A posting: the word's key, the line, its signature and size, and the word's position in it.
_FIELDS = (("key", "<u8"), ("doc", "<i8"), ("sig", "<u8"), ("sig2", "<u8"), ("no", "<i4"), ("n", "<i4"), ("pos", "<i4"), ("side", "i1"))
_KEY_BITS = 40  # words that share so many bits of their hash meet needlessly, and are told apart when verified
_WHOLE = 2


def _to_blob(columns: list[np.ndarray]) -> bytes:
    """Postings in order of key, column by column and byte by byte, keys as differences, which compresses well."""
    import zstandard

    columns = [np.diff(columns[0], prepend=np.uint64(0)), *columns[1:]]
    planes = [np.ascontiguousarray(c.astype(t)).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, (_, t) in zip(columns, _FIELDS, strict=True)]
    return len(columns[0]).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _from_blobs(blobs: list[bytes]) -> dict[str, np.ndarray]:
    import zstandard

    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in _FIELDS}
    for blob in blobs:
        n, at = int.from_bytes(blob[:4], "little"), 0
        data = zstandard.ZstdDecompressor().decompress(blob[4:])
        for name, t in _FIELDS:
            width = np.dtype(t).itemsize
            plane = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
            column = np.ascontiguousarray(plane.T).view(t).ravel()
            parts[name].append(np.cumsum(column, dtype=np.uint64) if name == "key" else column)
            at += n * width
    return {name: np.concatenate(p) for name, p in parts.items()}


def _dealt(columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of postings; a bucket holds a range of keys."""
    order = np.argsort(columns[0])
    columns = [c[order] for c in columns]
    to = (columns[0] >> np.uint64(_KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.nonzero(np.concatenate([[True], to[1:] != to[:-1]]))[0].tolist() + [len(to)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(to[a]), _to_blob([c[a:b] for c in columns])


def _key(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - _KEY_BITS)


def postings(rows: DataFrame, rank: np.ndarray, buckets: int) -> DataFrame:
    """One reading of all texts: every line (s1, s2, doc, no), the prefix words of lines as (bucket, blob), their counts as (chunk, counts).

    Of equal sets a line posts only where it comes before all that its task has read, in whatever
    order, so the first of all tasks always posts.
    """
    held = rows.sparkSession.sparkContext.broadcast(rank)  # BUCKETS numbers
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("doc", pa.int64()), ("no", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def batch(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        waiting: list[list[np.ndarray]] = []
        held_postings, total = 0, Tally()

        def flush() -> pa.RecordBatch:
            found = list(_dealt([np.concatenate(c) for c in zip(*waiting, strict=True)], buckets))
            waiting.clear()
            return batch(bucket=[b for b, _ in found], blob=[x for _, x in found])

        for ids, texts in _texts(batches):
            lines = Lines(ids, texts, held.value)
            s1, s2 = lines.set_ids()
            yield batch(s1=s1, s2=s2, doc=lines.doc, no=lines.no)
            fresh = np.zeros(len(lines.size), dtype=bool)
            order = np.lexsort((lines.no, lines.doc, s2, s1))
            least = order[(np.diff(s1[order], prepend=0) != 0) | (np.diff(s2[order], prepend=0) != 0) | (np.arange(len(order)) == 0)]
            keys = np.stack([s1[least], s2[least]], axis=1).view("V16").ravel().tolist()
            for i, key, doc, no in zip(least.tolist(), keys, lines.doc[least].tolist(), lines.no[least].tolist(), strict=True):
                place = doc << 32 | no
                if key not in seen or place < seen[key]:
                    seen[key] = place
                    fresh[i] = True
            if len(seen) > 500_000:
                seen.clear()
            word, line, position = _prefixes(lines, held.value)
            keep = fresh[line]
            word, line, position = word[keep], line[keep], position[keep]
            total.add(_bucket(word))
            if len(word):
                sig, sig2 = lines.signature()
                waiting.append([_key(word), lines.doc[line], sig[line], sig2[line], lines.no[line], lines.size[line], position, np.full(len(word), _WHOLE, dtype=np.int8)])
                held_postings += len(word)
            if held_postings > FLUSH:
                yield flush()
                held_postings = 0
        if waiting:
            yield flush()
        packed = list(_packed(total.counts()))
        yield batch(chunk=[c for c, _ in packed], counts=[b for _, b in packed])

    return rows.mapInArrow(run, "s1 long, s2 long, doc long, no int, bucket int, blob binary, chunk int, counts binary")


def split_hot(posted: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, blob) with words of over HOT postings dealt to pairs of blocks.

    In a pair of different blocks side is 0 or 1, elsewhere _WHOLE; only 0 with 1 and equal wholes meet.
    """
    if counts.max(initial=0) <= HOT:
        return posted
    blocks = posted.sparkSession.sparkContext.broadcast(np.maximum(1, -(-counts // HOT)).astype(np.int32))

    def expand(g: dict[str, np.ndarray], m: int) -> Iterator[list[np.ndarray]]:
        own = (_mix(g["doc"].view(np.uint64) * np.uint64(31) + g["no"].astype(np.uint64)) % np.uint64(m)).astype(np.int64)
        for other in range(m):
            low, high = np.minimum(own, other), np.maximum(own, other)
            side = np.where(own == other, _WHOLE, np.where(own == low, 0, 1)).astype(np.int8)
            yield [_key(_mix(_mix(g["key"] + np.uint64(1)) + (low * m + high).astype(np.uint64))), *(g[f] for f, _ in _FIELDS[1:-1]), side]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, bytes]] = []
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = _from_blobs([blob])
                k = blocks.value[(g["key"] >> np.uint64(_KEY_BITS - BUCKET_BITS)).astype(np.int64)]
                if k.max() == 1:
                    out.append((bucket, blob))
                    continue
                if (k == 1).any():
                    out += _dealt([c[k == 1] for c in g.values()], buckets)
                for m in np.unique(k[k > 1]).tolist():
                    for columns in expand({f: c[k == m] for f, c in g.items()}, m):
                        out += _dealt(columns, buckets)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])

    return posted.mapInArrow(run, "bucket int, blob binary")


def _similar(g: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(earlier, later, distance) of the index pairs that pass the length, position and signature filters."""
    num, den = THRESHOLD
    n1, n2 = g["n"][a], g["n"][b]
    need = -(-num * (n1 + n2) // (num + den))
    ok = (num * np.maximum(n1, n2) <= den * np.minimum(n1, n2)) & (np.minimum(n1 - g["pos"][a], n2 - g["pos"][b]) >= need)
    ok &= (g["side"][a] + g["side"][b] == 1) | (g["side"][a] + g["side"][b] == 2 * _WHOLE)
    at = np.flatnonzero(ok)
    a, b, n1, n2, bound = a[at], b[at], n1[at], n2[at], (n1 + n2 - 2 * need)[at]
    far = np.bitwise_count(g["sig"][a] ^ g["sig"][b]).astype(np.int64)
    long = (n1 > LONG_LINE) & (n2 > LONG_LINE)
    far[long] = sum(_cyclic(g[f][a[long]], g[f][b[long]]) for f in ("sig", "sig2"))
    far[long != ((n1 > LONG_LINE) | (n2 > LONG_LINE))] = 0  # of different kinds
    near = far <= bound
    a, b, far = a[near], b[near], far[near]
    later = (g["doc"][a] > g["doc"][b]) | ((g["doc"][a] == g["doc"][b]) & (g["no"][a] > g["no"][b]))
    two = (g["doc"][a] != g["doc"][b]) | (g["no"][a] != g["no"][b])
    return np.where(later, b, a)[two], np.where(later, a, b)[two], far[two]


def _meet(g: dict[str, np.ndarray], asks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(earlier, later, distance) of filtered pairs of postings, sorted by key, that share a key; with ``asks`` only where the later asks."""

    def found(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        if asks is None:
            return _similar(g, a, b)
        some = asks[a] | asks[b]
        a, b, far = _similar(g, a[some], b[some])
        return a[asks[b]], b[asks[b]], far[asks[b]]

    key = g["key"]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    size = np.diff(np.append(first, len(key)))
    for d in np.unique(size[(size > 1) & (size <= 64)]).tolist():
        i, j = np.triu_indices(d, 1)
        starts = first[size == d]
        step = max(1, 200_000 // len(i))
        for k in range(0, len(starts), step):
            yield found((starts[k : k + step, None] + i).ravel(), (starts[k : k + step, None] + j).ravel())
    for s, d in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        for x in range(0, d, 512):
            for y in range(x, d, 512):
                a, b = np.arange(s + x, s + min(d, x + 512)), np.arange(s + y, s + min(d, y + 512))
                a, b = np.repeat(a, len(b)), np.tile(b, len(a))
                yield found(*((a[a < b], b[a < b]) if x == y else (a, b)))


def _sorted_postings(blobs: list[bytes], asked: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The postings in order of key; with ``asked`` those of keys that a line it names has posted."""
    g = _from_blobs(blobs)
    if asked is not None:
        some = np.isin(g["key"], g["key"][asked(g["doc"], g["no"])])
        g = {k: v[some] for k, v in g.items()}
    order = np.argsort(g["key"])
    return {k: (v.astype(np.int64) if k in ("n", "pos", "side") else v)[order] for k, v in g.items()}


_PAIR = "doc long, no int, by_doc long, by_no int, more boolean"


def nearest(posted: DataFrame) -> DataFrame:
    """(doc, no, by_doc, by_no, more): for each line and key the earlier line whose signature is nearest; ``more``: there were others."""

    def out(rows: pd.DataFrame) -> pd.DataFrame:
        g = _sorted_postings(list(rows["blob"]))
        none = np.iinfo(np.int64).max
        best, found = np.full(len(g["key"]), none), np.zeros(len(g["key"]), dtype=np.int64)
        for a, b, far in _meet(g):
            np.minimum.at(best, b, far << 32 | a)
            np.add.at(found, b, 1)
        b = np.flatnonzero(best != none)
        a = best[b] & 0xFFFFFFFF
        pairs = pd.DataFrame({"doc": g["doc"][b], "no": g["no"][b], "by_doc": g["doc"][a], "by_no": g["no"][a], "more": found[b] > 1})
        return pairs.groupby(["doc", "no", "by_doc", "by_no"], as_index=False)["more"].max()

    return posted.groupBy("bucket").applyInPandas(out, _PAIR)


_ASKED = "doc long, no int, by_doc long, by_no int, asks boolean, cluster long, part int"


def every_candidate(posted: DataFrame, asked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """All earlier candidates of the lines that ``asked`` (of arrays of doc and no) names.

    Up to FEW for a line and key are pairs. Where there are more, the lines of the key that ask and all
    whom they ask are rows of a cluster, in parts of at most ASKERS that ask; blocks bound the rest.
    """

    def out(rows: pd.DataFrame) -> pd.DataFrame:
        g = _sorted_postings(list(rows["blob"]), asked)
        asks = asked(g["doc"], g["no"])
        pairs, held = [], 0
        found, known = np.zeros(len(asks), dtype=np.int64), np.zeros(len(asks), dtype=bool)
        for a, b, _ in _meet(g, asks):
            np.add.at(found, b, 1)
            if held <= MOST_HELD:
                pairs.append((a, b))
                held += len(a)
        for a, b in pairs if held <= MOST_HELD else ((a, b) for a, b, _ in _meet(g, asks)):
            known[a[found[b] > FEW]] = True
        few = [(a[found[b] <= FEW], b[found[b] <= FEW]) for a, b in (pairs if held <= MOST_HELD else ((a, b) for a, b, _ in _meet(g, asks)))]
        a, b = (np.concatenate([np.empty(0, np.int64), *(p[k] for p in few)]) for k in (0, 1))
        table = pd.DataFrame({"doc": g["doc"][b], "no": g["no"][b], "by_doc": g["doc"][a], "by_no": g["no"][a], "asks": True, "cluster": pd.array([None] * len(b), dtype="Int64"), "part": 0}).drop_duplicates()
        crowd = np.flatnonzero(asks & (found > FEW))
        parts = [table]
        for key in np.unique(g["key"][crowd]):
            own, members = crowd[g["key"][crowd] == key], np.flatnonzero(known & (g["key"] == key))
            own = own[np.lexsort((g["no"][own], g["doc"][own]))]
            for k in range(0, len(own), ASKERS):
                asker = own[k : k + ASKERS]
                last = asker[-1]
                before = (g["doc"][members] < g["doc"][last]) | ((g["doc"][members] == g["doc"][last]) & (g["no"][members] < g["no"][last]))
                at = np.concatenate([asker, np.setdiff1d(members[before], asker)])
                parts.append(pd.DataFrame({"doc": g["doc"][at], "no": g["no"][at], "by_doc": -1, "by_no": -1, "asks": np.arange(len(at)) < len(asker), "cluster": pd.array(np.full(len(at), key).astype(np.int64), dtype="Int64"), "part": k // ASKERS}))
        return pd.concat(parts)

    return posted.groupBy("bucket").applyInPandas(out, _ASKED)


def _marks(lines: DataFrame) -> np.ndarray:
    """A bit array of fixed size that has a bit for every (doc, no)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            total[_line_bucket(batch.column(0).to_numpy(), batch.column(1).to_numpy())] = 1
        packed = list(_packed(total))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in packed], pa.int32()), pa.array([b for _, b in packed], pa.binary())], ["chunk", "counts"])

    return total_counts(lines.select("doc", "no").mapInArrow(mark, "chunk int, counts binary")) > 0


def _line_bucket(doc: np.ndarray, no: np.ndarray) -> np.ndarray:
    return _bucket(_mix(doc.astype(np.int64).view(np.uint64) * np.uint64(1_000_003) + no.astype(np.int64).view(np.uint64)))


def word_sets(rows: DataFrame, wanted: DataFrame, few: bool = False) -> DataFrame:
    """(doc, no, words) of the ``wanted`` (doc, no): sorted word hashes as bytes. ``few`` are broadcast, so that no text is shuffled."""
    places = wanted.groupBy("doc").agg(F.collect_set("no").alias("nos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, nos in _texts(batches):
            lines = Lines(ids, texts, chosen=[sorted(n) for n in nos])
            words = [lines.hash[s : s + n].tobytes() for s, n in zip(lines.start.tolist(), lines.size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lines.doc), pa.array(lines.no), pa.array(words, pa.binary())], ["doc", "no", "words"])

    both = rows.join(F.broadcast(places) if few else places.hint("shuffle_hash"), "doc").select("doc", "text", "nos")
    return both.mapInArrow(run, "doc long, no int, words binary")


def _verified_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (doc, no) whose sets have the wanted Jaccard similarity."""
    num, den = THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for u, v in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(u.as_py(), np.uint64), np.frombuffer(v.as_py(), np.uint64)
                at = np.searchsorted(u, v)
                both = int((u[np.minimum(at, len(u) - 1)] == v).sum())
                keep.append(both * (num + den) >= num * (len(u) + len(v)))
            kept = pa.RecordBatch.from_arrays([batch.column(k) for k in range(2)], batch.schema.names[:2])
            yield kept.filter(pa.array(keep, pa.bool_()))

    u = sets.withColumnRenamed("words", "u")
    v = sets.select(F.col("doc").alias("by_doc"), F.col("no").alias("by_no"), F.col("words").alias("v"))
    both = pairs.select("doc", "no", "by_doc", "by_no").join(u, ["doc", "no"]).join(v, ["by_doc", "by_no"]).select("doc", "no", "u", "v")
    return both.mapInArrow(run, "doc long, no int")


def _verified_members(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The asking lines (doc, no) that are similar to an earlier line of their part of a cluster."""
    num, den = THRESHOLD

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc", "no"], kind="stable").reset_index(drop=True)
        words = [np.frombuffer(w, np.uint64) for w in rows["words"]]
        size = np.array([len(w) for w in words])
        _, code = np.unique(np.concatenate(words), return_inverse=True)
        start = np.cumsum(size) - size
        mark = np.zeros(code.max() + 1, dtype=np.int64)
        found = []
        for i in np.nonzero(rows["asks"].to_numpy(bool))[0].tolist():
            own = code[start[i] : start[i] + size[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[code[: start[i]]], start[:i]) if i else np.empty(0)
            mark[own] = 0
            earlier = (rows["doc"].to_numpy()[:i] != rows["doc"][i]) | (rows["no"].to_numpy()[:i] != rows["no"][i])
            if (earlier & (both * (num + den) >= num * (size[:i] + size[i]))).any():
                found.append(i)
        return rows.loc[found, ["doc", "no"]]

    return members.select("doc", "no", "asks", "cluster", "part").join(sets, ["doc", "no"]).groupBy("cluster", "part").applyInPandas(run, "doc long, no int")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("doc", "no").unionByName(pairs.select(F.col("by_doc").alias("doc"), F.col("by_no").alias("no")))


def _removed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, no), perhaps more than once: every line that an earlier line is similar to."""
    rows = docs.where(F.col(text_col).isNotNull()).select(line_id(F.col(id_col), F.col(text_col)).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    counts = total_counts(word_counts(rows))
    buckets = max(16, int(counts.sum()) // (4 * PER_BUCKET))
    read = materialise(postings(rows, ranks(counts), buckets), "lines")
    posted = total_counts(read.where("chunk is not null").select("chunk", "counts"))
    lines = read.where("s1 is not null").select("s1", "s2", "doc", "no")
    first = lines.groupBy("s1", "s2").agg(F.min(F.struct("doc", "no")).alias("f"), F.count(F.lit(1)).alias("k")).where("k > 1")
    first = materialise(first, "first")  # so that a very common line can be split among tasks in the join
    copies = materialise(lines.join(first, ["s1", "s2"]).where((F.col("doc") != F.col("f.doc")) | (F.col("no") != F.col("f.no"))).select("doc", "no"), "copies")
    table = split_hot(read.where("blob is not null").select("bucket", "blob"), posted, buckets)
    # Copies are gone already; they need not ask, but others may ask them.
    asking = nearest(table).join(copies, ["doc", "no"], "left_anti")
    pairs = materialise(asking.groupBy("doc", "no", "by_doc", "by_no").agg(F.max("more").alias("more")), "pairs")
    sets = materialise(word_sets(rows, _ends(pairs).distinct()), "sets")
    sure = materialise(_verified_pairs(pairs, sets), "sure")
    open_ = materialise(pairs.where("more").select("doc", "no").distinct().join(sure, ["doc", "no"], "left_anti"), "open")
    discard(first, sets)
    out = copies.unionByName(sure)
    if not open_.isEmpty():
        asked = docs.sparkSession.sparkContext.broadcast(_marks(open_))  # BUCKETS bits
        again = materialise(every_candidate(table, lambda doc, no: asked.value[_line_bucket(doc, no)]), "again")
        # Marks may name more lines than are open, and the pairs of the first round are known.
        few = again.where("cluster is null").select("doc", "no", "by_doc", "by_no").distinct().join(open_, ["doc", "no"], "left_semi")
        few = materialise(few.join(pairs.select("doc", "no", "by_doc", "by_no"), ["doc", "no", "by_doc", "by_no"], "left_anti"), "few")
        members = again.where("cluster is not null")
        wanted = materialise(_ends(few).unionByName(members.select("doc", "no")).distinct(), "wanted")
        sets = materialise(word_sets(rows, wanted, wanted.count() <= BROADCAST_LINES), "sets")
        by_pair, by_cluster = materialise(_verified_pairs(few, sets), "by_pair"), materialise(_verified_members(members, sets), "by_cluster")
        discard(again, few, wanted, sets)
        out = out.unionByName(by_pair).unionByName(by_cluster)
    discard(read, pairs, open_)
    return out


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, no): every line that an earlier line is similar to; ``doc`` as in ``line_id``."""
    return _removed(docs, id_col, text_col).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with similar later lines taken out of the text, and the columns n_lines and n_removed."""
    key, gone_col, parts_col = unused(docs, "line_doc", "gone_lines", "line_parts")
    gone = _removed(docs, id_col, text_col).groupBy(F.col("doc").alias(key)).agg(F.collect_set("no").alias(gone_col))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*names, F.coalesce(line_id(F.col(id_col), F.col(text_col)), F.lit(-1)).alias(key))
    both = keyed.join(gone.hint("shuffle_hash"), key, "left").withColumn(parts_col, F.split(F.col(text_col), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts_col) - 1), F.col(gone_col))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(parts_col), i)), "\n")
    text = F.when(F.col(gone_col).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(kept)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts_col)).cast("long")
    n_removed = F.when(F.col(gone_col).isNull() | F.col(text_col).isNull(), 0).otherwise(F.size(parts_col) - F.size(left)).cast("long")
    return both.select(*[text.alias(c) if c == text_col else F.col(c) for c in names], n_lines.alias("n_lines"), n_removed.alias("n_removed"))
