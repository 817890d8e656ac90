"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 hashes have it.
Distinct fingerprints are ordered by population counts and cut into tiles of bounded size; tile
pairs whose population counts differ beyond the radius cannot hold a link and are skipped, and
every other pair is compared exactly with numpy exclusive-or and bit counts. Within a tile pair
the same test, on the counts of the four quarters of the fingerprint, skips pairs of rows blocks.

A tile pair returns a spanning forest of its links, at most one link for each of its rows, so a
large group of near copies costs rows, not pairs; components over the forests lose no link.
Fingerprints have one 64-bit word, or several: the share of equal bits estimates the similarity
of the shingles, and more bits estimate it more sharply.

Copies share one fingerprint and are grouped before anything is compared.

``simhash_dedup`` looks for texts whose shingles have Jaccard ``VERIFIED`` or more. Such texts
differ in too many bits for population counts to tell tiles apart, so tiles go by the number of
distinct shingles, which that similarity bounds, and population counts come second. The links it
finds are candidates and are verified. All-pairs comparison within these bounds stays quadratic in
the texts of about one size, in time and in tiles moved.

Defined cases: a text without words (null, empty or blank) has fingerprint zero and links like
any other in ``simhash_groups``, and is a copy of every such text in ``simhash_dedup``; null ids
sort after all others; rows that repeat share a group, and of rows alike in id and text
``simhash_dedup`` keeps one; of texts that tie the smallest id stays; very long texts are read
whole; an empty table gives an empty result; other columns are ignored, or pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .line_dedup import _mix, line_id, word_hashes
from .shared import discard, materialise, unused

SHINGLE = 5
RADIUS = 4
TILE = 65_536
BLOCK = 256
SEED = 42
VERIFIED = (4, 5)  # 0.8
GROUP_BYTES = 8 << 20
BROADCAST_ROWS = 20_000


def fingerprint(data: bytes, shingle: int = SHINGLE) -> bytes:
    """The 64-bit fingerprint of UTF-8 text, as big-endian bytes."""
    from xxhash import xxh64_digest

    parts = data.lower().split()  # of bytes: A-Z only, and exactly space and U+0009 to U+000D
    if not parts:
        return bytes(8)
    flat = b" ".join(parts)
    if len(parts) <= shingle:
        return xxh64_digest(flat, SEED)
    ends = np.cumsum([len(w) + 1 for w in parts])
    starts = np.concatenate(([0], ends[:-1]))[: len(parts) - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    counts, n = np.zeros(64, dtype=np.int64), len(starts)
    for k in range(0, n, 16_384):
        hashes = b"".join([xxh64_digest(flat[a:b], SEED) for a, b in zip(starts[k : k + 16_384], ends[k : k + 16_384], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py() or b"", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp binary")


def _forest(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n nodes, by label spreading with pointer jumping."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[rows], label[cols])
        np.minimum.at(label, rows, low)
        np.minimum.at(label, cols, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _parts(fp: np.ndarray) -> np.ndarray:
    """Population counts of each row's words; of a single word's four quarters."""
    if fp.shape[1] > 1:
        return np.bitwise_count(fp).astype(np.int16)
    return np.concatenate([np.bitwise_count((fp >> np.uint64(16 * k)) & np.uint64(0xFFFF)) for k in range(4)], axis=1).astype(np.int16)


def _boxes(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest of each column in each block of rows."""
    at = np.arange(0, len(q), BLOCK)
    return np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least possible sum of differences of two blocks' columns, block by block."""
    (low_a, high_a), (low_b, high_b) = _boxes(a), _boxes(b)
    return np.maximum(0, np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None])).sum(-1)


def _tile(blob: bytes, words: int, sized: bool) -> np.ndarray:
    """The rows of a tile; with sizes, which stand last, in order of them."""
    fp = np.frombuffer(blob, dtype=">u8").reshape(-1, words + sized).astype(np.uint64)
    order = [*_parts(fp[:, :words]).T[::-1], *([fp[:, words]] if sized else [])]
    return fp[np.lexsort(order)]


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
    if x.shape[1] > 1:
        out = out.astype(np.uint16)
        for k in range(1, x.shape[1]):
            out += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    return out


def compare(first: bytes, second: bytes | None, radius: int = RADIUS, words: int = 1, size_gap: int | None = None) -> list[tuple[bytes, bytes]]:
    """Spanning links between or within the distinct fingerprints of two tiles; second None: within the first.

    With ``size_gap`` every fingerprint is followed by a size of 64 bits, and sizes that differ by more do not link.
    """
    sized = size_gap is not None
    a = _tile(first, words, sized)
    same = second is None
    b = a if same else _tile(second, words, sized)
    near = _gap(_parts(a[:, :words]), _parts(b[:, :words])) <= radius
    if sized:
        n, m = a[:, words].astype(np.int64), b[:, words].astype(np.int64)
        near &= _gap(n[:, None], m[:, None]) <= size_gap
    # The forest so far; links are folded in when many have gathered.
    label, rows, cols, gathered = np.arange(len(a) + (0 if same else len(b))), [], [], 0
    offset = 0 if same else len(a)

    def fold_in() -> np.ndarray:
        own = np.arange(len(label))
        return _forest(np.concatenate([own, *rows]), np.concatenate([label, *cols]), len(label))

    for i, j in zip(*np.nonzero(near), strict=True):
        if same and j < i:
            continue
        x, y = slice(i * BLOCK, (i + 1) * BLOCK), slice(j * BLOCK, (j + 1) * BLOCK)
        alike = _distance(a[x, :words], b[y, :words]) <= radius
        if sized:
            alike &= np.abs(n[x, None] - m[None, y]) <= size_gap
        r, c = np.nonzero(alike)
        if same and i == j:
            r, c = r[r < c], c[r < c]
        if len(r):
            rows.append(r + i * BLOCK)
            cols.append(c + j * BLOCK + offset)
            gathered += len(r)
            if gathered > 1_000_000:
                label, rows, cols, gathered = fold_in(), [], [], 0
    label = fold_in() if rows else label
    both = (a if same else np.concatenate([a, b])).astype(">u8")
    return [(both[i].tobytes(), both[label[i]].tobytes()) for i in np.nonzero(label != np.arange(len(label)))[0]]


def _population(fp: Column, words: int) -> Column:
    parts = [F.bit_count(F.conv(F.hex(F.substring(fp, 8 * k + 4 * h + 1, 4)), 16, 10).cast("long")) for k in range(words) for h in (0, 1)]
    return sum(parts[1:], parts[0])


def _plan_tiles(counts: dict[int, int], tile: int) -> list[tuple[int, int, int, int]]:
    """(least count, greatest count, first tile, tiles): small neighbouring counts share a tile, large ones are split."""
    out: list[tuple[int, int, int, int]] = []
    first, low, held = 0, None, 0
    for pop in sorted(counts):
        if low is not None and held + counts[pop] > tile:
            out.append((low, last, first, 1))
            first, low, held = first + 1, None, 0
        if counts[pop] > tile:
            k = -(-counts[pop] // tile)
            out.append((pop, pop, first, k))
            first += k
            continue
        low, last, held = pop if low is None else low, pop, held + counts[pop]
    if low is not None:
        out.append((low, last, first, 1))
    return out


def links(distinct: DataFrame, radius: int = RADIUS, words: int = 1, tile: int = TILE, size_gap: int | None = None) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct ``fp`` within the radius.

    Tiles hold ranges of population counts; with ``size_gap`` ranges of the sizes that end every ``fp``.
    """
    order = _population(F.col("fp"), words) if size_gap is None else F.conv(F.hex(F.substring("fp", 8 * words + 1, 8)), 16, 10)
    known = distinct.select("fp", order.cast("int").alias("pop"))
    counts = {r["pop"]: r["count"] for r in known.groupBy("pop").count().collect()}  # one for each number of bits
    n = sum(counts.values())
    plan = _plan_tiles(counts, max(1_024, min(tile, n // 12)))
    if not plan:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    place = F.create_map(*[F.lit(x) for low, high, f, k in plan for p in range(low, high + 1) for x in (p, f * 1_000_000 + k)])
    code = place[F.col("pop")]
    dealt = known.select("fp", (F.floor(code / 1_000_000) + F.pmod(F.xxhash64("fp"), code % 1_000_000)).cast("int").alias("tile"))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tile": [int(rows["tile"].iloc[0])], "fps": [b"".join(rows["fp"])]})

    packed = materialise(dealt.groupBy("tile").applyInPandas(gather, "tile int, fps binary"), "tiles")
    # Tile pairs whose population counts can be within the radius.
    tiles = [(low, high, f + i) for low, high, f, k in plan for i in range(k)]
    spans = distinct.sparkSession.createDataFrame(tiles, "low int, high int, t int")
    near = [x for _, _, x in tiles]
    t2 = F.explode(F.sequence(F.col("t"), F.lit(max(near)))).alias("t2")
    other = spans.select(F.col("low").alias("low2"), F.col("t").alias("t2"))
    pairs = spans.select("high", F.col("t").alias("t1"), t2).join(other, "t2").where(F.col("low2") - F.col("high") <= (radius if size_gap is None else size_gap)).select("t1", "t2")
    x, y = packed.select(F.col("tile").alias("t1"), F.col("fps").alias("x")), packed.select(F.col("tile").alias("t2"), F.col("fps").alias("y"))
    work = pairs.join(x, "t1").join(y, "t2").select("t1", "t2", "x", "y")
    work = work.repartition(max(2 * len(tiles), len(tiles) ** 2 // 8), "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, u, v in zip(*(batch.column(k) for k in range(4)), strict=True):
                found = compare(u.as_py(), None if t1.as_py() == t2.as_py() else v.as_py(), radius, words, size_gap)
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return work.mapInArrow(run, "a binary, b binary")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest id reachable over links)."""
    rows = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    groups = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    roots = components(links(groups, radius))
    linked = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = materialise(linked, "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.hex(fp))


def shingle_set(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; empty without words."""
    _, h = word_hashes(np.frombuffer(data.lower() + b" ", dtype=np.uint8))
    k = min(shingle, len(h))
    if not k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def _shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", shingle).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["component", "key", "shingles"])

    return rows.select("component", "key", "text").mapInArrow(run, "component binary, key string, shingles binary")


def wide_fingerprint(shingles: np.ndarray, words: int) -> bytes:
    """The fingerprint of distinct 64-bit shingle hashes, of so many words, each from hashes mixed anew."""
    out = []
    for k in range(words):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(shingles), 65_536):
            mixed = _mix(shingles[at : at + 65_536] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
            counts += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(counts * 2 > len(shingles)).tobytes())
    return b"".join(out)


# Sizes are told in steps of 2 ** (1 / 32); a size and 5/4 of it are at most so many apart.
_STEPS = 32
SIZE_GAP = int(np.ceil(np.log2(VERIFIED[1] / VERIFIED[0]) * _STEPS))


def _prints(rows: DataFrame, shingle: int, words: int) -> DataFrame:
    """(key, digest, fp): a digest of the set of shingles, and its fingerprint with its size behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", shingle) for t in batch.column(1)]
            prints = [wide_fingerprint(x, words) + int(np.log2(len(x) + 1) * _STEPS).to_bytes(8, "big") for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(prints, pa.binary())], ["key", "digest", "fp"])

    return rows.select("key", "text").mapInArrow(run, "key string, digest binary, fp binary")


def _left(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows similar to none of the kept rows, which are marked ``lead``."""
    return _decided(rows, leads_only=True)


def _kept(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows similar to no kept row before them."""
    return _decided(rows, leads_only=False)


def _decided(rows: pd.DataFrame, leads_only: bool) -> pd.DataFrame:
    num, den = VERIFIED
    rows = rows.sort_values(["lead", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    size, lead = np.array([len(x) for x in sets], dtype=np.int64), rows["lead"].to_numpy(bool)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    mark, open_ = np.zeros(len(code) + 1, dtype=np.int64), np.ones(len(rows), dtype=bool)
    for i in range(len(rows)):
        if not open_[i] or (leads_only and not lead[i]):
            continue
        rest = np.nonzero(open_[i + 1 :] & ~lead[i + 1 :])[0] + i + 1
        rest = rest[(num * size[i] <= den * size[rest]) & (num * size[rest] <= den * size[i])]
        if size[i] == 0:
            open_[rest] = False  # texts without words are alike, and like no other
            continue
        own = code[ends[i] - size[i] : ends[i]]
        mark[own] = 1
        for j in rest.tolist():
            both = int(mark[code[ends[j] - size[j] : ends[j]]].sum())
            open_[j] = both * (num + den) < num * (size[i] + size[j])
        mark[own] = 0
    return rows.loc[open_ & ~lead, ["component", "key", "shingles"]]


def _verified_kept(sets: DataFrame, group_bytes: int) -> DataFrame:
    """The keys that stay of (component, key, shingles): in order of key, whatever is similar to no kept document.

    A component's first ``group_bytes`` of sets are decided in one task; the others meet what is
    kept of those in groups of that size, and what is left of them begins anew.
    """
    kept = None
    schema = "component binary, key string, shingles binary"
    order = Window.partitionBy("component").orderBy("key")
    while True:
        size = F.octet_length("shingles") + 64
        places = sets.select("component", "key", size.alias("size")).withColumn("before", F.sum("size").over(order) - F.col("size"))
        places = materialise(places.select("component", "key", F.floor(F.col("before") / group_bytes).alias("block")), "places")
        blocks = places.groupBy("component").agg(F.max("block").alias("salts")).where("salts > 0")
        head = sets.join(places.where("block = 0"), ["component", "key"], "left_semi").withColumn("lead", F.lit(False))
        head = materialise(head.groupBy("component").applyInPandas(_kept, schema), "heads")
        kept = head.select("key") if kept is None else kept.unionByName(head.select("key"))
        blocks = materialise(blocks, "blocks")
        if blocks.isEmpty():
            return kept
        leads = head.join(blocks, "component").withColumn("salt", F.explode(F.sequence(F.lit(1), F.col("salts").cast("int"))))
        rest = sets.join(places.where("block > 0"), ["component", "key"]).withColumn("salt", F.col("block").cast("int"))
        columns = ["component", "key", "shingles", "salt"]
        both = leads.select(*columns, F.lit(True).alias("lead")).unionByName(rest.select(*columns, F.lit(False).alias("lead")))
        sets = materialise(both.groupBy("component", "salt").applyInPandas(_left, schema), "rest")
        if sets.isEmpty():
            return kept


def _row_key(id_col: Column, text: Column) -> Column:
    """A string that orders rows by id, then by a hash of the text; null ids come last."""
    number = F.lpad(F.hex(line_id(id_col, text).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(number, F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def simhash_dedup(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = 0.8, words: int = 4, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """``docs`` without those whose shingles have Jaccard ``VERIFIED`` or more with a kept document's.

    Of texts with the same set of shingles the first stays. Texts of similar size whose fingerprints
    agree in ``similarity`` of their bits link, and are compared exactly within the components of these links.
    """
    (key,) = unused(docs, "simhash_key")
    rows = docs.select(_row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))
    prints = materialise(_prints(rows, shingle, words), "prints")
    first = prints.groupBy("digest").agg(F.min(F.struct("key", "fp")).alias("f")).select("f.key", "f.fp")
    first = materialise(first, "first")
    nodes = materialise(first.select("fp").distinct(), "nodes")
    roots = components(links(nodes, int(64 * words * (1 - similarity) + 1e-9), words, size_gap=SIZE_GAP))
    groups = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", F.coalesce("root", "fp").alias("component"))
    groups = materialise(groups, "components")
    several = groups.groupBy("component").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("component")
    members = materialise(groups.join(several, "component", "left_semi"), "members")
    few = members.count() <= BROADCAST_ROWS  # then no text is shuffled
    sets = materialise(_shingle_sets(rows.join(F.broadcast(members) if few else members.hint("shuffle_hash"), "key"), shingle).dropDuplicates(["key"]), "shingles")
    alike = members.select("key").join(_verified_kept(sets, group_bytes), "key", "left_anti")
    gone = prints.select("key").distinct().join(first.select("key"), "key", "left_anti").unionByName(alike)
    gone = materialise(gone, "gone")
    repeated = materialise(prints.groupBy("key").count().where("count > 1").select("key"), "repeated")
    discard(prints, first, nodes, groups, members, sets)
    keyed = docs.withColumn(key, _row_key(F.col(id_col), F.col(text_col)))
    kept = keyed.join(gone.withColumnRenamed("key", key).hint("shuffle_hash"), key, "left_anti")
    if not repeated.isEmpty():
        twice = repeated.withColumnRenamed("key", key)
        kept = kept.join(twice, key, "left_anti").unionByName(kept.join(twice, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)
