import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keyloom.llm import packing, quality, toxicity
from keyloom.llm.queries import vocabulary

from .conftest import docs_frame, prose


def brute_segments(values):
    """Maximal segments by definition: the best segment first, then the same on both sides of it."""
    best, at = 0.0, None
    for i in range(len(values)):
        for j in range(i, len(values)):
            s = sum(values[i : j + 1])
            if s > best + 1e-9:
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    return brute_segments(values[:i]) + [(i, j, best)] + [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(values[j + 1 :])]


def test_maximal_segments():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 25)
        positions = sorted(rng.sample(range(n), rng.randint(0, n)))
        values = [rng.uniform(0.5, 4) for _ in positions]  # no ties
        whole = [-0.75] * n
        for p, v in zip(positions, values):
            whole[p] = v
        got = toxicity.maximal_segments(positions, values, -0.75)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in brute_segments(whole)))
        assert max([0, *(s for *_, s in got)]) == pytest.approx(max([0, *(s for *_, s in brute_segments(whole))]))
        assert all(b < c for (_, b, _), (c, _, _) in zip(got, got[1:])) and all(sum(whole[a : b + 1]) == pytest.approx(s) for a, b, s in got)


def labelled(spark, n=300):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        text, toxic, good = prose(rng, 120), i % 5 == 1, i % 4 != 1
        if toxic:
            w = text.split()
            for k in range(4):
                w[10 + 7 * k] = rng.choice(["vileword", "hatefulone", "grimstem" + rng.choice(["a", "bo", "cu"])])
            text = " ".join(w)
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text))
        labels.append((i, int(good), int(toxic), "x"))
    return docs_frame(spark, [*rows, (n, None), (n + 1, ""), (None, "vileword"), (3, rows[3][1])]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_toxicity_and_quality(spark, no_docs):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    for column, run, parts, held in ((1, toxicity.toxicity, 5, 0), (0, quality.quality, 3, 1)):
        rows = run(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts == held) for r in rows)
        mine = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
        assert np.mean([r["predicted"] == truth[r["doc_id"]][column] for r in mine]) > 0.95
        assert run(no_docs, labels).count() == 0
        bare = run(docs, labels.limit(0)).select("score").distinct().collect()
        assert len(bare) == 1


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = labelled(spark, 150)
    held = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5 == 0]
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda r: repr((r["doc_id"], r["score"]))
    assert sorted(map(key, toxicity.toxicity(docs, labels).collect())) == sorted(map(key, toxicity.toxicity(docs, turned).collect()))


def test_token_table_and_law_match_their_formulas(spark):
    docs, labels = labelled(spark)
    known = labels.selectExpr("doc_id as id", "toxic as y")
    sample = docs.where("doc_id < 300").select("doc_id", "text").dropDuplicates(["doc_id"]).join(known, docs["doc_id"] == known["id"]).selectExpr("text", "y", "cast(0 as int) as half")
    rows = [(r["text"], r["y"]) for r in sample.collect()]
    counts = {0: {}, 1: {}}
    for text, y in rows:
        words = {w.lower() for w in toxicity._WORD.findall(text)}
        for t in words | {"~" + w[:k] for w in words for k in toxicity.STEMS if len(w) > k}:
            counts[y][t] = counts[y].get(t, 0) + 1
    n1, n0 = sum(counts[1].values()), sum(counts[0].values())
    want = {}
    for t in counts[0].keys() | counts[1].keys():
        y1, y0 = counts[1].get(t, 0), counts[0].get(t, 0)
        a1, a0, whole = y1 + 0.1 * (y1 + y0), y0 + 0.1 * (y1 + y0), 0.1 * (n1 + n0)
        odds = math.log(a1 / (n1 + whole - a1)) - math.log(a0 / (n0 + whole - a0))
        if abs(odds) >= toxicity.LEAST_Z * math.sqrt(1 / a1 + 1 / a0):
            want[t] = odds
    table = toxicity.token_table(toxicity.count_tokens(sample))
    assert table == pytest.approx(want) and "vileword" in table
    model = toxicity.with_law(sample, table)
    memo, clean, total = toxicity.Memo(table), 0, 0.0
    for text, y in rows:
        if y == 0:
            values = [model.other if s is None else s for s in toxicity.word_scores(toxicity._WORD.findall(text), memo)]
            best = max([0.0, *(s for *_, s in brute_segments(values))]) if any(v > 0 for v in values) else 0.0
            clean, total = clean + 1, total + len(values) * math.exp(-model.decay * best)
    assert model.factor == pytest.approx((clean + 0.5) / (total + 500))


def test_segments_count_together():
    model = toxicity.Model({}, -0.1, 1.5, 0.01, None)
    one, two = toxicity.tail(model, [6.0], 100), toxicity.tail(model, [6.0, 6.0], 100)
    t = 2 * (1.5 * 6 - math.log(0.01 * 100))
    assert one == pytest.approx(9.0) and two == pytest.approx(t - math.log(t) + math.log(2) - 2 * math.log(2)) and two > one
    assert toxicity.tail(model, [6.0, 0.1], 10_000) == toxicity.tail(model, [6.0], 10_000)


def test_negative_scores_part_segments():
    rng = random.Random(16)
    for _ in range(100):
        values = [rng.choice([-2.0, -0.5, rng.uniform(0.5, 3)]) for _ in range(rng.randint(1, 20))]
        got = toxicity.maximal_segments([i for i, v in enumerate(values) if v != -0.5], [v for v in values if v != -0.5], -0.5)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in brute_segments(values)))


def test_quality_is_the_difference_of_compressed_sizes(spark):
    import zstandard

    rng = random.Random(30)
    good, bad = prose(rng, 2_000).encode(), prose(rng, 2_000).upper().encode()
    measure = quality.Measure(good, bad)
    assert measure(good[3000:3900]) > 0.2 > -0.2 > measure(bad[3000:3900]) and measure(b"") == 0.0
    size = [0, 0]
    text = good[100:900] + bad[100:300]
    for k, content in enumerate((good, bad)):
        log = len(content).bit_length()
        how = zstandard.ZstdCompressionParameters.from_level(quality.LEVEL, window_log=max(17, log), hash_log=max(17, log), chain_log=max(17, log), write_content_size=False)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        for at in range(0, len(text), quality.BLOCK):
            size[k] += len(zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress(text[at : at + quality.BLOCK]))
    assert measure(text) == pytest.approx((size[1] - size[0]) / sum(size), abs=0.02)
    # The first and the last words of the sample are in the dictionaries alike.
    assert abs(measure(good[:900]) - measure(good[-900:])) < 0.2


def test_long_texts_are_scored_whole(spark):
    docs, labels = labelled(spark)
    rng = random.Random(31)
    long = prose(rng, 60_000)
    rows = docs_frame(spark, [(1, long), (2, long + " vileword hatefulone vileword hatefulone vileword"), (3, " ".join(w.upper() + "!!" for w in long.split()))])
    tox = {r["doc_id"]: r["passages"] for r in toxicity.score_toxicity(rows, toxicity.fit(docs, labels)).collect()}
    assert not tox[1] and tox[2] and tox[2][-1]["start"] >= len(long)
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(rows, quality.fit(docs, labels)).collect()}
    assert scores[1] > 0.5 > scores[3]


def test_passages_and_filter(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    text = prose(random.Random(1), 60)
    words = text.split()
    words[20:22] = ["vileword", "hatefulone"]
    text = "É " + " ".join(words)
    row = toxicity.score_toxicity(docs_frame(spark, [(1, text)]), model).first()
    start, end = text.index("vileword"), text.index("hatefulone") + len("hatefulone")
    assert any(p["start"] <= start and p["end"] >= end for p in row["passages"])
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= {i for i in range(300) if i % 5 != 1} and len(ids & {i for i in range(300) if i % 5 == 1}) < 3


def test_pack_round_trip(spark, odd_docs, no_docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, vocabulary()).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["sequence_id"] for r in rows} == set(range(len(rows)))
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 for r in rows)
    order = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in order] == sorted(r["length"] for r in rows)
    for r in docs.collect():
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for p in sorted(by[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert packing.pack(no_docs, vocabulary()).count() == 0
    assert packing.pack(odd_docs, vocabulary()).where("doc_id is null").count() == 3


def test_long_texts_are_cut_where_no_token_crosses():
    rng = random.Random(3)
    text = "".join(rng.choice(["a", "  ", " ", "\n", "wh", " 12", ", ", "don't", "é", " zu"]) for _ in range(3000))
    parts = list(packing.bounded(text, 50))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert "".join(parts) == text and len(parts) > 20
    assert sum((t.encode(p, add_special_tokens=False).ids for p in parts), []) == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_keep_their_ids():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.TextTokenizer(vocabulary())
    assert np.frombuffer(own.ids("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    for text in ("<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext|", " <|endoftext|>\n", "é <|endoftext|> " * 40_000):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
