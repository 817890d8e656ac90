"""Every stage of the pipeline, and the whole of it, against brute force."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from keyloom.llm import packing, toxicity
from keyloom.llm.queries import OP6_SQL
from keyloom.llm.shared import read_table

from .conftest import prose
from .test_scores_and_packing import brute_segments
from .test_similar import brute_lines

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("copies", pa.int64()), ("line_doc", pa.string())])
COPY, NEAR, TOXIC, EMPTY, LINES, CLEAN = range(6)


def wrapped(words, width):
    return "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))


def rows_and_kinds():
    rng = random.Random(41)
    rows, kinds = [], {}

    def add(text, kind, source=None):
        kinds[len(rows)] = kind
        rows.append((len(rows), text, source or rng.choice(["a", "b", "c"])))

    for i in range(140):
        words = prose(rng, 60).split()
        if i % 4 == 1:
            for k in range(5):
                words[10 + 7 * k] = rng.choice(["vileword", "hatefulone"])
        add(wrapped(words, 12), TOXIC if i % 4 == 1 else CLEAN)
    clean = [r for r in rows if kinds[r[0]] == CLEAN]
    for _, text, _ in clean[:6]:
        add(text, COPY)
    for _, text, _ in clean[10:16]:  # other lines, nearly the same shingles
        words = text.split()
        words[rng.randrange(60)] = "changed"
        add(wrapped(words, 7), NEAR)
    for _, text, _ in clean[20:26]:
        add(text.split("\n")[1] + "\n" + wrapped(prose(rng, 50).split(), 10) + "\nread more", LINES)
    for text in (None, "", " \n\t", wrapped(prose(rng, 3_000).split(), 15)):
        add(text, EMPTY if not (text or "").strip() else CLEAN)
    return rows, kinds


def brute_toxic(text, model):
    words = toxicity._WORD.findall(text or "")
    values = [model.other if s is None else s for s in toxicity.word_scores(words, toxicity.Memo(model.scores))]
    found = brute_segments(values) if len(words) <= 200 and any(v > 0 for v in values) else []
    return model.calibration(toxicity.tail(model, [s for *_, s in found], len(words))) >= 0.5


def brute_near(rows):
    """In order of id: what has five-word shingles of Jaccard 0.8 with a kept text's goes."""
    kept = []
    for i, text in sorted(rows.items()):
        w = (text or "").split()
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        if not any(5 * len(s & t) >= 4 * len(s | t) for _, t in kept):
            kept.append((i, s))
    return {i for i, _ in kept}


def brute_pieces(rows):
    tok, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text in rows:
        ids, at = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4"), 0
        for n in packing.pieces_of(len(ids)):
            out.append((i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    return sorted(out)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows, kinds = rows_and_kinds()
    rng = random.Random(5)
    rng.shuffle(rows)
    full = [(i, t, "en", s, len(t or ""), 1, "x") for i, t, s in rows]
    pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full), SCHEMA)], schema=SCHEMA), at / "documents.parquet")
    pq.write_table(SCHEMA.empty_table(), at / "none.parquet")
    known = {"doc_id": list(range(140)), "quality": [1] * 140, "toxic": [int(kinds[i] == TOXIC) for i in range(140)]}
    pq.write_table(pa.table(known), at / "labels.parquet")
    return at, kinds


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_and_run(spark, tables):
    at, kinds = tables
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "simhash", "mix", "packing"]
    docs = read_table(spark, str(at), "documents")
    columns, before = docs.columns, texts(docs)

    def after(name):
        out = stage[name](spark, docs, str(at))
        path = str(at / f"after_{name}.parquet")
        out.write.parquet(path)
        return spark.read.parquet(path)

    model = toxicity.fit(docs, read_table(spark, str(at), "labels"))
    docs = after("toxicity")
    want = {i: t for i, t in before.items() if not brute_toxic(t, model)}
    assert texts(docs) == want and docs.columns == columns
    assert {i for i in before if kinds[i] == TOXIC} & set(want) == set() and len(want) == sum(k != TOXIC for k in kinds.values())

    docs = after("line_dedup")
    want = brute_lines(sorted(want.items()))
    assert texts(docs) == want and docs.columns == columns
    assert all(not want[i] for i, k in kinds.items() if k == COPY) and sum("read more" in (t or "") for t in want.values()) == 1
    assert all(r["n_chars"] == len(r["text"] or "") for r in docs.collect())

    docs = after("simhash")
    left = brute_near({i: t for i, t in want.items()})
    want = {i: t for i, t in want.items() if i in left}
    assert texts(docs) == want and docs.columns == columns
    # Near copies go, clean documents stay, and one stands for all that are empty.
    assert not {i for i, k in kinds.items() if k == NEAR} & set(want) and {i for i, k in kinds.items() if k == CLEAN} <= set(want)
    assert sum(not (t or "").strip() for t in want.values()) == 1

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/after_simhash.parquet/*.parquet'")
    docs = after("mix")
    rows = con.execute(f"SELECT doc_id, taken, size FROM ({OP6_SQL}) x").fetchall()
    times = {i: taken // size for i, taken, size in rows if taken}
    assert Counter(r["doc_id"] for r in docs.collect()) == times and docs.columns == columns and max(times.values()) == 2

    pieces = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    want = brute_pieces([(i, want[i]) for i, n in times.items() for _ in range(n)])
    packed = after("packing")
    assert sorted(map(tuple, packed.select(*pieces).collect())) == want
    assert {r["sequence_id"] for r in packed.collect()} == set(range(len(want)))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(at)).select(*pieces).collect())) == want


def test_every_stage_of_no_rows(spark, tables):
    at, _ = tables
    docs = read_table(spark, str(at), "none")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(at))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(at)).count() == 0
