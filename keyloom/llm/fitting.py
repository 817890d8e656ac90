"""What the two text classifiers share: bounded labelled samples and a logistic calibration."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fold


class Logistic(NamedTuple):
    """Probability of label 1 from a few features, each held within the range seen in fitting."""

    weights: tuple[float, ...]
    bias: float
    center: tuple[float, ...]
    scale: tuple[float, ...]

    def __call__(self, *x: float) -> float:
        z = self.bias + sum(w * min(max((v - c) / s, -20.0), 20.0) for w, v, c, s in zip(self.weights, x, self.center, self.scale, strict=True))
        return 1 / (1 + math.exp(-min(max(z, -40.0), 40.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, rate: float, ridge: float = 1e-4, steps: int = 60) -> Logistic:
    """Newton's method on the lightly ridged likelihood, weighted so that label 1 has share ``rate``."""
    x = np.asarray(x, dtype=float)
    x = x[:, None] if x.ndim == 1 else x
    k = x.shape[1]
    if len(set(y.tolist())) < 2:
        p = min(max(rate, 0.01), 0.99)
        return Logistic((0.0,) * k, math.log(p / (1 - p)), (0.0,) * k, (1.0,) * k)
    center, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([(x - center) / scale, np.ones(len(y))]).clip(-20, 20)
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean())) / len(y)
    w = np.zeros(k + 1)
    penalty = ridge * np.append(np.ones(k), 0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ w).clip(-40, 40)))
        g = a.T @ (weight * (p - y)) + penalty * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty) + 1e-9 * np.eye(k + 1)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(tuple(w[:-1].tolist()), float(w[-1]), tuple(center.tolist()), tuple(scale.tolist()))


def known_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, y): one label of 0 or 1 for each id outside the held-out fold."""
    known = labels.where((fold(F.col("doc_id"), folds) >= 0) & (fold(F.col("doc_id"), folds) != held_out))
    return known.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def label_rate(known: DataFrame) -> float:
    """Share of label 1, pulled towards one half where labels are few."""
    n, ones = known.agg(F.count(F.lit(1)), F.sum("y")).first()
    return (float(ones or 0) + 1) / (float(n) + 2)


def labelled_sample(docs: DataFrame, known: DataFrame, per_class: int, id_col: str = "doc_id", text_col: str = "text", class_bytes: int | None = None) -> DataFrame:
    """(id, text, y, half): at most ``per_class`` of the known rows of each label, copies of a text once.

    With ``class_bytes`` a label's rows, whole texts in order of that hash, end with the one that reaches so many bytes.

    Rows are chosen by the smallest hash of their id; ``half`` splits them evenly for fitting
    and calibration. The chosen ids are few by construction, so they are broadcast.
    """
    known = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    chosen = [known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("chosen_id"), "y", F.pmod("h", F.lit(2)).cast("int").alias("half"))
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), text).join(F.broadcast(chosen), F.col("id") == F.col("chosen_id")).select("id", "text", "y", "half")
    first = Window.partitionBy(F.sha2(F.col("text").cast("binary"), 256)).orderBy(F.desc("y"), "id")
    rows = rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    if class_bytes is None:
        return rows
    # At most per_class rows of each label.
    before = Window.partitionBy("y").orderBy(F.xxhash64(F.col("id").cast("string")), "id", F.octet_length("text")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("b", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("b") < class_bytes).drop("b")
