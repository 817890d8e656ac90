import random
from collections import defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from keyloom.llm import line_dedup, simhash
from keyloom.llm.components import components

from .conftest import docs_frame, prose


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 200 + i) for i in range(30)]
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in root} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text, shingle):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, shingle, radius):
    fps = [brute_fingerprint(t, shingle) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = defaultdict(lambda: None)
    for (i, _), l in zip(rows, label):
        if i is not None:
            least[l] = i if least[l] is None else min(i, least[l])
    return sorted(map(repr, ((i, f"{fp:016x}", least[l]) for (i, _), fp, l in zip(rows, fps, label))))


def test_simhash_groups(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    base = [prose(rng, 80).split() for _ in range(6)]
    near = [(1000 + 20 * i + k, " ".join(b[:k] + ["x"] * (k % 3) + b[k + k % 3 :])) for i, b in enumerate(base) for k in range(20)]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id is null or doc_id not in (6, 7)").collect()] + near
    got = simhash.simhash_groups(docs_frame(spark, rows), shingle=4)
    got = got.select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id").collect()
    assert sorted(map(repr, map(tuple, got))) == brute_groups(rows, 4, 4)
    assert simhash.simhash_groups(no_docs).count() == 0


@pytest.mark.parametrize("words", [1, 4])
def test_tiles_lose_no_link(words):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (40, words), dtype=np.uint64)
    fp = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 63, base.shape, dtype=np.uint64)) for _ in range(20)])
    fp = np.unique(fp, axis=0)
    half = len(fp) // 2
    a, b = fp[:half].astype(">u8").tobytes(), fp[half:].astype(">u8").tobytes()
    links = simhash.compare(a, None, 4, words) + simhash.compare(b, None, 4, words) + simhash.compare(a, b, 4, words)
    index = {x.astype(">u8").tobytes(): i for i, x in enumerate(fp)}
    label = np.arange(len(fp))
    for _ in range(len(fp)):
        before = label.copy()
        for x, y in links:
            label[index[x]] = label[index[y]] = min(label[index[x]], label[index[y]])
        if (before == label).all():
            break
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1)
    assert all(label[i] == label[j] for i, j in zip(*np.nonzero(d <= 4)))
    assert all(d[index[x], label == label[index[x]]].min() == 0 for x, _ in links) and len(links) < 3 * len(fp)


def test_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(9)
    text = prose(rng, 300)
    words = text.split()
    near = " ".join(words[:100] + ["changed"] + words[101:])
    df = docs_frame(spark, [(1, prose(rng, 300)), (2, text), (3, text), (4, near), (5, None), (6, "")])
    kept = simhash.simhash_dedup(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5] and kept.columns == df.columns
    # Repeated rows and null ids: one of each text, the one with an id.
    df = docs_frame(spark, [(1, text), (1, text), (None, text), (None, near), (None, prose(rng, 300)), (1, prose(rng, 250))]).withColumnRenamed("path", "simhash_key")
    kept = simhash.simhash_dedup(df)
    assert sorted((r["doc_id"] or 0, len(r["text"].split())) for r in kept.collect()) == [(0, 300), (1, 250), (1, 300)] and kept.columns == df.columns


def test_dedup_of_no_rows(no_docs):
    assert simhash.simhash_dedup(no_docs).count() == 0


def test_dedup_finds_nearly_all_pairs_that_are_similar_enough(spark):
    rng = random.Random(21)
    rows, want = [], 0
    for i in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 800]))]
        rows.append((i, " ".join(base)))
        other = list(base)
        for at in rng.sample(range(len(base)), max(1, len(base) * 2 // 100)):
            other[at] = f"new{rng.random()}"
        rows.append((1000 + i, " ".join(other)))
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (base, other))
        want += 5 * len(a & b) >= 4 * len(a | b)
    kept = {r["doc_id"] for r in simhash.simhash_dedup(docs_frame(spark, rows)).collect()}
    assert set(range(120)) <= kept and 240 - len(kept) >= 0.95 * want and want > 40


@pytest.mark.parametrize("group_bytes", [simhash.GROUP_BYTES, 9_000])
def test_dedup_drops_only_what_is_verified(spark, group_bytes):
    rng = random.Random(10)
    base = prose(rng, 404).split()

    def changed(k):
        w = list(base)
        for at in range(0, 400, 400 // k):
            w[at] = f"new{rng.random()}"
        return " ".join(w)

    rows = [(10, " ".join(base)), (1, ""), (2, " \n "), (3, "one two three four five six")]
    rows += [(20 + k, changed(k)) for k in (2, 4, 8, 16, 20)] + [(60 + k, changed(16)) for k in range(4)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.split()) else set() for i, t in rows}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    kept = []
    for i, s in sorted(sets.items()):
        if not any(alike(s, sets[j]) for j in kept):
            kept.append(i)
    got = simhash.simhash_dedup(docs_frame(spark, rows), similarity=0.5, group_bytes=group_bytes)
    assert sorted(r["doc_id"] for r in got.collect()) == kept and 3 in kept and len(kept) > 5


def brute_lines(rows):
    seen, gone = [], defaultdict(set)
    for i, t in rows:
        for k, line in enumerate((t or "").encode().split(b"\n")):
            s = set(line.split())
            if len(s) < 1:
                continue
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone[i].add(k)
            seen.append(s)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if t is not None else None for i, t in rows}


@pytest.mark.parametrize("hot", [8_192, 4])
def test_line_dedup(spark, no_docs, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(11)
    vocabulary = [prose(rng, 1) for _ in range(60)]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 14))) for _ in range(5)]
        for _ in range(2):
            if rows and rng.random() < 0.7 and rows[-1][1]:
                words = rng.choice(rows)[1].split("\n")[0].split() or ["x"]
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
                lines.insert(rng.randrange(3), " ".join(words))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "one two three four five\none two three four five"), (103, "\n\n"), (104, "one two\tthree four five")]
    df = docs_frame(spark, rows)
    got = line_dedup.line_dedup(df)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_lines(rows)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    if hot > 4:
        assert line_dedup.line_dedup(no_docs).count() == 0


def test_line_dedup_of_odd_rows(odd_docs):
    rows = line_dedup.line_dedup(odd_docs)
    assert rows.count() == odd_docs.count()
    assert rows.where("text is null").count() == odd_docs.where("text is null").count()


@pytest.mark.parametrize("few, length", [(1, 24), (16, 24), (1, 110)])
def test_second_round_finds_what_the_first_left_out(spark, monkeypatch, few, length):
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "ASKERS", 7)
    rng = random.Random(13)
    words = [f"w{k}" for k in range(length * 5 // 4)]
    rows = [(i, " ".join(rng.sample(words, length + i % 3))) for i in range(80)]
    got = line_dedup.line_dedup(docs_frame(spark, rows))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_lines(rows)


@pytest.mark.parametrize("group", [1, 1 << 20])
def test_first_copy_posts_in_any_order_of_reading(spark, monkeypatch, group):
    monkeypatch.setattr(line_dedup, "GROUP_BYTES", group)
    copied = " ".join(f"w{k}" for k in range(20))
    rows = [(900, copied), (5, copied), (100, copied.replace("w7", "other"))]
    got = line_dedup.line_dedup(docs_frame(spark, rows).coalesce(1))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {5: copied, 100: "", 900: ""}


def test_short_lines_are_compared(spark):
    rows = [(1, "a b c d e\none two\n\nx\np q r"), (2, "two one\na b c d\n\nx y\np q r s"), (3, "x\n \na b c\nd c b a\ntwo one two")]
    got = line_dedup.line_dedup(docs_frame(spark, rows))
    want = {1: rows[0][1], 2: "\nx y\np q r s", 3: " \na b c"}
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_word_hashes_tell_words_apart():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab \n\tc\xc3\xa9") for _ in range(20_000)) + b" "
    _, h = line_dedup.word_hashes(np.frombuffer(data, np.uint8))
    words = data.split()
    assert len(words) == len(h) and len(set(words)) == len(set(h.tolist())) == len(set(zip(words, h.tolist())))
