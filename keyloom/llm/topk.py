"""Exact top-k by inner product: ball trees per shard, branch and bound, a shared kth score.

Candidates are dealt to shards by id; each shard builds one ball tree, kept as a row in the
shared folder. Queries go in blocks; a task has one shard's tree and one block. It bounds every
node for every query (centre's product plus radius times the query's norm), drops nodes below
the query's kth score, and visits leaves best bound first. A first round looks only at each
query's best leaf per shard; the kth best of what all shards found is a score that every shard
then starts from, so most leaves are never opened. Shards are searched in waves, and each wave
starts from the kth score of all before it. Results reach the final ranking as at most k rows for
each query and shard. What moves is every tree once for each block of queries, and every query
once for each shard: quadratic in the table by nature, with blocks and shards of about one size.

Components become integers, floor(scale * x); scores are exact integers: products go through
double precision where every sum stays below 2^53 and through Python integers otherwise.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null
id, take no part; of rows that share an id, the one with the smallest integer components stands
for it, as query and as candidate; missing components count as zero, so an empty vector scores 0
with all; very long vectors are read whole; ties go to the smaller id; with fewer candidates than
k all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, shards_for

SCALE = 256
PER_SHARD = 8_192
LEAF = 128
QUERY_BLOCK = 8_192  # as large as a shard: trees and queries move alike often
WAVES = (1, 3)  # shares of the shards, searched one after the other
_EXACT = 2.0**53


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Quantized rows padded with zeros; float64 where that is exact, else Python integers."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as int64, saturated to its range where they leave it."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    if width == 0 or not len(q) or not len(c):
        return np.zeros((len(q), len(c)), dtype=np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * width < _EXACT:
        return (q @ c.T).astype(np.int64)
    big = np.array([[int(v) for v in r] for r in q], dtype=object) @ np.array([[int(v) for v in r] for r in c], dtype=object).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


class BallTree:
    """A binary tree over rows of ``data``: at each node the rows split at the median of the widest direction."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, leaf: int = LEAF):
        order, level = np.arange(len(ids)), [(0, len(ids))]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # centres, radii, spans
        while True:
            for a, b in level:
                if b - a > leaf:
                    rows = data[order[a:b]]
                    far = rows[((rows - rows.mean(0)) ** 2).sum(1).argmax()]
                    along = far - rows[((rows - far) ** 2).sum(1).argmax()]
                    order[a:b] = order[a:b][np.argsort(rows @ along, kind="stable")]
            self.levels.append(self._balls(data[order], level))
            if all(b - a <= leaf for a, b in level):
                break
            # A small node stays as its own only child, so every level covers all rows.
            level = [s for a, b in level for s in ([(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > leaf else [(a, b)])]
        self.levels[-1] = self._balls(data[order], level)
        self.ids, self.data = ids[order], data[order]

    @staticmethod
    def _balls(data: np.ndarray, level: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        centres = np.array([data[a:b].mean(0) if b > a else np.zeros(data.shape[1]) for a, b in level])
        radii = np.array([np.sqrt(((data[a:b] - c) ** 2).sum(1).max()) if b > a else 0.0 for (a, b), c in zip(level, centres, strict=True)])
        return centres, radii, np.array(level, dtype=np.int64)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        parts = {f"{n}{i}": x for i, l in enumerate(self.levels) for n, x in zip("crs", l, strict=True)}
        np.savez(out, ids=self.ids, data=self.data, **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> BallTree:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(blob)) as f:
            self.ids, self.data = f["ids"], f["data"]
            self.levels = [(f[f"c{i}"], f[f"r{i}"], f[f"s{i}"]) for i in range(sum(k[0] == "c" for k in f.files))]
        return self

    def leaf_bounds(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Upper bound of the product of each query with each leaf; -inf below pruned nodes."""
        norms = np.sqrt((q**2).sum(1))
        width = min(q.shape[1], self.data.shape[1])
        parents = np.zeros(1, dtype=np.int64)
        alive = np.ones((len(q), 1), dtype=bool)
        bound = np.empty((len(q), 0))
        spans = None
        for centres, radii, now in self.levels:
            if spans is not None:
                parents = np.searchsorted(spans[:, 1], now[:, 0], side="right")
            bound = q[:, :width] @ centres[:, :width].T + norms[:, None] * radii
            bound += 1e-9 * (np.abs(bound) + norms[:, None] * np.sqrt((centres**2).sum(1)) + norms[:, None] * radii) + 1e-6
            alive = alive[:, parents] & (bound >= floor[:, None])
            spans = now
        return np.where(alive, bound, -np.inf)

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, best_leaf_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), each len(q) x k by score down and id up; -1 and the least integer where fewer."""
        none = np.iinfo(np.int64).min
        top_s, top_i = np.full((len(q), k), none), np.full((len(q), k), np.iinfo(np.int64).max)
        if not len(self.ids) or not len(q):
            return top_i, top_s
        bound = self.leaf_bounds(q, floor)
        order = np.argsort(-bound, axis=1, kind="stable")
        spans = self.levels[-1][2]
        for r in range(1 if best_leaf_only else order.shape[1]):
            leaf = order[:, r]
            value = bound[np.arange(len(q)), leaf]
            going = np.nonzero((value > -np.inf) & (value >= np.maximum(floor, top_s[:, -1].astype(np.float64))))[0]
            if not len(going):
                break
            for j in np.unique(leaf[going]):
                mine = going[leaf[going] == j]
                a, b = spans[j]
                scores = _products(q[mine], self.data[a:b])
                ids = np.broadcast_to(self.ids[a:b], scores.shape)
                all_s = np.concatenate([top_s[mine], np.where(ids == q_ids[mine, None], none, scores)], axis=1)
                all_i = np.concatenate([top_i[mine], np.where(ids == q_ids[mine, None], np.iinfo(np.int64).max, ids)], axis=1)
                at = np.lexsort((all_i, ~all_s), axis=1)[:, :k]  # ~ orders integers downwards
                top_s[mine], top_i[mine] = np.take_along_axis(all_s, at, 1), np.take_along_axis(all_i, at, 1)
        return top_i, top_s


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): the usable vectors, each component floor(SCALE * x)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    # Beyond the range of long, where floor() ends, doubles are whole numbers anyway.
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    return rows.select("vec_id", whole.alias("v"))


def build_trees(candidates: DataFrame, shards: int) -> DataFrame:
    """(shard, tree): one ball tree per shard."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = [np.asarray(v, dtype=np.float64) for v in rows["v"]]
        first = sorted(range(len(vectors)), key=lambda i: (rows["vec_id"].iat[i], vectors[i].tolist()))
        ids = rows["vec_id"].to_numpy(np.int64)[first]
        keep = np.concatenate([[True], ids[1:] != ids[:-1]])
        data = _matrix([vectors[i] for i in first], max(len(v) for v in vectors))
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "tree": [BallTree(ids[keep], data[keep]).to_bytes()]})

    dealt = candidates.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, tree binary")


def _round(trees: DataFrame, blocks: DataFrame, k: int, best_leaf_only: bool) -> DataFrame:
    """(query_id, vec_id, score) found by every shard for every block of (block, query_id, v, floor)."""

    def search(key: tuple, tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(tree) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        t = BallTree.from_bytes(tree["tree"].iloc[0])
        q = [np.asarray(v, dtype=np.float64) for v in queries["v"]]
        ids = queries["query_id"].to_numpy(np.int64)
        found, scores = t.search(ids, _matrix(q, max(map(len, q))), queries["floor"].to_numpy(np.float64), k, best_leaf_only)
        some = found != np.iinfo(np.int64).max
        return pd.DataFrame({"query_id": np.repeat(ids, k)[some.ravel()], "vec_id": found[some], "score": scores[some]})

    left = trees.withColumn("block", F.explode(_numbers(blocks, "block")))
    right = blocks.withColumn("shard", F.explode(_numbers(trees, "shard")))  # a shard without a tree finds nothing
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score long")


def _numbers(df: DataFrame, column: str) -> Column:
    """The column's least to its greatest value."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return F.array().cast("array<int>") if low is None else F.sequence(F.lit(low), F.lit(high))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for each row where ``is_query`` holds."""
    rows = materialise(valid_vectors(vectors, id_col, vector_col), "vectors")
    shards = shards_for(rows.count(), PER_SHARD, 4)
    trees = materialise(build_trees(rows, shards), "trees")
    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    blocks = shards_for(asked.count(), QUERY_BLOCK, 1)
    asked = materialise(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "queries")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def started(found: DataFrame) -> DataFrame:
        """The queries with the kth score of what has been found, from which the next shards start."""
        kth = found.distinct().withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
        return materialise(asked.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "started")

    seed = materialise(_round(trees, asked.withColumn("floor", F.lit(float("-inf"))), k, True), "seed")
    found = None
    ends = sorted({shards * sum(WAVES[: w + 1]) // sum(WAVES) for w in range(len(WAVES))} - {0})
    for first, end in zip([0, *ends], ends, strict=False):
        wave = trees.where((F.col("shard") >= first) & (F.col("shard") < end))
        new = materialise(_round(wave, started(seed if found is None else found.unionByName(seed)), k, False), "found")
        found = new if found is None else found.unionByName(new)
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
