"""Toxicity by maximum-scoring segments of token log-odds.

Fitting counts the texts of a bounded labelled sample that hold each word, and each stem that words
begin with (four, five and six letters). A text counts once however often it repeats a word: words
come in bursts, and counts of occurrences would take a single text's theme for significant. Tokens whose
log-odds between toxic and clean text, under a Dirichlet prior in proportion to all counts, are
``LEAST_Z`` standard errors from zero, of either sign, carry them as scores. All other tokens, and
unseen words, say nothing for themselves and share the small negative log-odds of a word without
a hit. (Drawing all log-odds towards zero instead found fewer held-out toxic texts.) A linear-time
scan finds every maximal-scoring segment of a text.

Best segments of clean text follow an extreme-value law: lambda comes from the scores of clean
words, K is fitted to the best segments of clean sample texts. A segment is significant where its
expected number for the text's length is small. The segments of a text count together: of its r
best, for every r, the sum of normalised scores has a known tail, and the least likely r stands
for the text; a logistic calibration on sample rows that the counts have not seen makes it a score.

Defined cases: a null or empty text has no segment and the calibrated score of that; very long
texts are scanned whole; rows that repeat, and texts that tie, are scored each; without labels of
both kinds every score is one constant; an empty table gives an empty result; other columns,
whatever their names, are ignored, or pass through the filter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import Logistic, fit_logistic, known_labels, label_rate, labelled_sample
from .shared import fold, materialise

FOLDS, HELD_OUT = 5, 0
PER_CLASS = 10_000  # bound of the labelled sample, rows of each label
LEAST_Z = 3.0
PRIOR = 0.1  # weight of the prior, as a share of all counts
MEMO = 500_000  # words that a worker remembers at most
SIGNIFICANT = 0.05
STEMS = (6, 5, 4)
_WORD = re.compile(r"[^\W_]+")


class Model(NamedTuple):
    scores: dict[str, float]  # word, or "~" and stem: log-odds
    other: float  # log-odds of all other words
    decay: float  # lambda of the extreme-value law
    factor: float  # K of the extreme-value law
    calibration: Logistic


class Memo(dict):
    """The score of each word as written: its own, or its longest known stem's; None for words that say nothing."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> float | None:
        get, w = self.scores.get, word.lower()
        s = get(w)
        if s is None and len(w) > 4:
            s = next((x for n in STEMS if len(w) > n and (x := get("~" + w[:n])) is not None), None)
        self[word] = s
        return s


def word_scores(words: list[str], memo: Memo) -> list[float | None]:
    if len(memo) > MEMO:
        memo.clear()
    return [memo[w] for w in words]


def maximal_segments(positions: list[int], values: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence that is ``other`` but at ``positions``.

    One pass with a stack of candidates: each holds the cumulative sum before and after it. A new
    positive value joins back to the nearest candidate that starts lower, or stands alone.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # the last: the nearest one below that starts lower
    total, at = 0.0, 0
    for p, v in zip(positions, values, strict=True):
        total += other * (p - at)
        at = p + 1
        if v <= 0:
            total += v
            continue
        first, left, right = p, total, total + v
        total = right
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, p, left, right, j))
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def expectation(model: Model, score: float, words: int) -> float:
    """Expected number of segments of at least this score in clean text of so many words."""
    return model.factor * max(words, 1) * math.exp(-min(model.decay * score, 700.0))


def tail(model: Model, scores: list[float], words: int) -> float:
    """-log of the probability that the best segments of clean text of so many words are as high, for the most telling number of them."""
    base = math.log(model.factor * max(words, 1))
    best, total = -base, 0.0
    for r, score in enumerate(sorted(scores, reverse=True), 1):
        normal = model.decay * score - base
        total += normal
        if r == 1:
            best = normal
        elif normal <= 0 or total <= 0:
            break
        else:
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
    return best


def scan(text: str, model: Model, memo: Memo) -> tuple[float, float, int, list[tuple[int, int, float, float]]]:
    """(best score, -log tail probability, words, [(start, end, score, expectation)] of significant segments) with code-point offsets."""
    words = _WORD.findall(text)
    found = word_scores(words, memo)
    positions = [i for i, s in enumerate(found) if s is not None]
    segments = maximal_segments(positions, [found[i] for i in positions], model.other)
    if not segments:
        return 0.0, tail(model, [], len(words)), len(words), []
    scores = [s for *_, s in segments]
    out = [(a, b, s, e) for a, b, s in segments if (e := expectation(model, s, len(words))) <= SIGNIFICANT]
    if out:
        spans = [m.span() for m in _WORD.finditer(text)]
        out = [(spans[a][0], spans[b][1], s, e) for a, b, s, e in out]
    return max(scores), tail(model, scores, len(words)), len(words), out


def count_tokens(sample: DataFrame) -> DataFrame:
    """(token, half, y1, y0): texts of each label that hold the word or stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[tuple[int, int], Counter] = {(h, y): Counter() for h in (0, 1) for y in (0, 1)}
            for text, y, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = {w.lower() for w in _WORD.findall(text.as_py())}
                by[half, y].update(words)
                by[half, y].update({"~" + w[:n] for w in words for n in STEMS if len(w) > n})
            for h in (0, 1):
                tokens = list(by[h, 0].keys() | by[h, 1].keys())
                columns = [pa.array(tokens, pa.string()), pa.array([h] * len(tokens), pa.int32())]
                columns += [pa.array([by[h, y][t] for t in tokens], pa.int64()) for y in (1, 0)]
                yield pa.RecordBatch.from_arrays(columns, ["token", "half", "y1", "y0"])

    counts = sample.select("text", "y", "half").mapInArrow(run, "token string, half int, y1 long, y0 long")
    return counts.groupBy("token", "half").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def token_table(counts: DataFrame) -> dict[str, float]:
    """The log-odds of every token of (token, y1, y0) that is LEAST_Z standard errors from zero, of either sign."""
    counts = counts.groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    n1, n0 = (float(x or 0) for x in counts.agg(F.sum("y1"), F.sum("y0")).first())
    share = (F.col("y1") + F.col("y0")) * PRIOR
    a1, a0, whole = F.col("y1") + share, F.col("y0") + share, (n1 + n0) * PRIOR
    odds = F.log(a1 / (n1 + whole - a1)) - F.log(a0 / (n0 + whole - a0))
    z = odds / F.sqrt(1 / a1 + 1 / a0)
    # At most the words and stems of a sample of bounded rows.
    return {r["token"]: float(r["odds"]) for r in counts.select("token", odds.alias("odds"), z.alias("z")).where(F.abs("z") >= LEAST_Z).collect()}


_NONE = Logistic((0.0,), 0.0, (0.0,), (1.0,))


def with_law(sample: DataFrame, scores: dict[str, float]) -> Model:
    """The model of a token table: score of other words and extreme-value law, from sample rows that the table has not seen.

    What reaches the driver are counts of scores rounded to hundredths, and two sums.
    """
    hits = sample.select("text", "y").mapInArrow(_hits(scores), "y int, score int, n long").groupBy("y", "score").agg(F.sum("n").alias("n")).collect()
    by = {y: Counter({r["score"] / 100 if r["score"] is not None else None: r["n"] for r in hits if r["y"] == y}) for y in (0, 1)}
    words = {y: sum(by[y].values()) for y in (0, 1)}
    rate = {y: (sum(n for s, n in by[y].items() if s is not None and s > 0) + 0.5) / (words[y] + 1.0) for y in (0, 1)}
    other = min(math.log((1 - min(rate[1], 0.5)) / (1 - min(rate[0], 0.25))), -1e-3)
    decay = _decay(by[0], words[0], other, max([0.0, *scores.values()]))
    model = Model(scores, other, decay, 1.0, _NONE)
    clean = sample.where("y = 0").select("text", "y").mapInArrow(_weights(model), "n long, w double").agg(F.sum("n"), F.sum("w")).first()
    factor = (float(clean[0] or 0) + 0.5) / (float(clean[1] or 0.0) + 500.0)
    return model._replace(factor=factor)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``per_class`` rows of each label outside the held-out fold.

    Each half of the sample is scored with the token table of the other half; the law and the
    calibration come from those scores, the final table from both halves.
    """
    known = known_labels(labels, "toxic", FOLDS, HELD_OUT)
    sample = materialise(labelled_sample(docs, known, per_class, id_col, text_col), "sample")
    counts = materialise(count_tokens(sample), "tokens")
    rows, laws = [], []
    for half in (0, 1):
        unseen = sample.where(F.col("half") == 1 - half)
        model = with_law(unseen, token_table(counts.where(F.col("half") == half)))
        laws.append(model)
        rows += [(r["x"], r["y"]) for r in unseen.select("text", "y").mapInArrow(_features(model), "x double, y int").collect()]
    rows.sort()
    law = [sum(getattr(m, f) for m in laws) / 2 for f in ("other", "decay", "factor")]
    return Model(token_table(counts), *law, fit_logistic(np.array([x for x, _ in rows]), np.array([y for _, y in rows], dtype=int), label_rate(known)))


def _hits(scores: dict[str, float]):
    """Per batch, label and score in hundredths: the number of words; a null score for words that say nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(scores)
        for batch in batches:
            seen: Counter = Counter()
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen.update((y, None if s is None else round(s * 100)) for s in word_scores(_WORD.findall(text.as_py()), memo))
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["y", "score", "n"])

    return run


def _weights(model: Model):
    """Per batch: texts, and the sum of words times exp(-lambda best score), whose quotient is the likeliest K."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(model.scores)
        for batch in batches:
            found = [scan(t.as_py(), model, memo) for t in batch.column(0)]
            weights = [max(n, 1) * math.exp(-min(model.decay * best, 700.0)) for best, _, n, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64()), pa.array([math.fsum(weights)], pa.float64())], ["n", "w"])

    return run


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(model.scores)
        for batch in batches:
            x = [scan(t.as_py(), model, memo)[1] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1).cast(pa.int32())], ["x", "y"])

    return run


def _decay(hits: Counter, words: int, other: float, strongest: float) -> float:
    """Lambda: it solves sum p exp(lambda s) = 1 over the scores of clean words."""
    if not strongest:
        return 1.0
    # A clean sample without any hit still has one at the strongest score.
    hits = Counter({s: n for s, n in hits.items() if s is not None})
    hits[round(strongest, 2)] += 1
    values = np.array([*hits, other])
    p = np.array([*hits.values()], dtype=float) / (words + 1.0)
    p = np.append(p, 1 - p.sum())
    if float(p @ values) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while float(p @ np.exp(high * values)) < 1 and high < 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if float(p @ np.exp(mid * values)) < 1 else (low, mid)
    return max(high, 1e-3)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, segment_score, expectation_bits, passages<start,end,score,expectation> per row."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # words of a sample of bounded rows
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expectation", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        memo = Memo(m.scores)
        for batch in batches:
            score, best, bits, passages = [], [], [], []
            for text in batch.column(1):
                s, b, _, found = scan(text.as_py() or "", m, memo)
                score.append(m.calibration(b))
                best.append(s)
                bits.append(b)
                passages.append([dict(zip(("start", "end", "score", "expectation"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(best, pa.float64()), pa.array(bits, pa.float64()), pa.array(passages, passage)], ["doc_id", "score", "segment_score", "expectation_bits", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, score double, segment_score double, expectation_bits double, passages array<struct<start:int,end:int,score:double,expectation:double>>"
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, passages."""
    rows = score_toxicity(docs, fit(docs, labels))
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches one half; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        memo = Memo(m.scores)
        for batch in batches:
            yield batch.filter(pa.array([m.calibration(scan(t.as_py() or "", m, memo)[1]) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
