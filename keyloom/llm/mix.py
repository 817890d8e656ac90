"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Each document, in its source's shuffled order, has the virtual finish time cumulative source
tokens divided by target; a second pass over the source goes on where the first ends. All
finish times are ranked globally and the mix takes them until the total budget is spent.

Running sums never gather a source or the whole table in one task: a first pass sums
per (source, slice of the shuffle order), the prefix of those few sums is taken, and the
windows then run within one slice. The global cut works alike: sums per slice of the
finish time, and only the slice in which the budget ends is sorted.

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
documents of size 0 and sources of size 0 take nothing; rows that repeat an id are counted
each; rows without id are told apart by text; finish times that tie are taken together or not at
all; a very long text counts like any other; an empty table gives an empty result; other columns
pass through, or are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, WORD_CLASS, materialise, unused

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
ROWS_PER_SLICE = 2_000
_HEX = 7


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-whitespace; null counts 0."""
    runs = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WORD_CLASS}+", "x"), f"{SPACE_CLASS}+", "")
    return F.octet_length(runs).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); the excess over ``most`` x size is reshared by weight.

    With sources in order of cap / weight, the first place at which an equal level for all later
    sources stays within the next cap gives the level; the rows here are sources, not documents.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", "place")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place"), F.lit(len(weights))) + 1)
    s = sizes.withColumn("place", (F.row_number().over(place) - 1).cast("int")).withColumn("weight", weight)
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("fill", F.col("cap").cast("double") / F.col("weight"))
    s = s.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(onward))
    s = s.withColumn("total", F.sum("source_size").over(every))
    s = s.withColumn("level", (F.col("total") * F.lit(float(budget)) - F.col("spent")) / F.col("open"))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(every))
    level = F.coalesce(F.col("level"), F.lit(float("inf")))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def mix_sizes(rows: DataFrame, seed: str = "", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """Add source_size, target and copies (times the document is taken) to rows of (doc_id, source, size, ...)."""
    rows = rows if "mark" in rows.columns else rows.withColumn("mark", F.lit(None).cast("string"))
    rows = materialise(rows.withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), "mark", F.lit("")))).substr(1, 16)), "sizes")
    n = rows.count()
    slices = max(1, n // ROWS_PER_SLICE)
    rows = rows.withColumn("slice", (F.conv(F.col("key").substr(1, _HEX), 16, 10).cast("long") * slices / (16**_HEX)).cast("long"))
    per_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    per_source = source_targets(per_slice.groupBy("source").agg(F.sum("n").alias("source_size")), weights, budget, most)
    back = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select("source", "slice", F.coalesce(F.sum("n").over(back), F.lit(0)).alias("start"))
    starts = materialise(_null_join(starts, per_source, ["source"]), "starts")
    order = ["key", F.col("doc_id").asc_nulls_last(), "size"]
    within = Window.partitionBy("source", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum("size").over(within))
    rows = _null_join(rows, starts, ["source", "slice"]).withColumn("end", F.col("start") + F.col("own"))
    rows = rows.drop("slice", "start", "own")
    # Finish times as a share of the target, one for each pass over the source.
    times = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (F.col("end") + i * F.col("source_size")) / F.col("target"))
    rows = materialise(rows.withColumn("times", F.when(F.col("size") > 0, times)), "times")
    cut = _cut(rows, n, F.col("size"), budget)
    copies = F.coalesce(F.size(F.filter("times", lambda t: t <= F.lit(cut))), F.lit(0)) if cut is not None else F.lit(0)
    copies = F.when(F.col("times").isNull(), 0).otherwise(copies).cast("int")
    return rows.withColumn("copies", copies).drop("times", "end", "key")


def _null_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    r = right.select([F.col(c).alias(f"r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    both = left.join(r, on[0] if len(on) == 1 else on[0] & on[1])
    return both.drop(*[f"r_{k}" for k in keys])


def _cut(rows: DataFrame, n: int, size: Column, budget: float) -> float | None:
    """The last finish time that the budget covers; None if it covers none. Only sums reach the driver."""
    slices = max(16, n // ROWS_PER_SLICE)
    items = rows.select(F.explode("times").alias("t"), size.alias("size"))
    items = items.withColumn("slice", F.least(F.col("t") * (slices // 2), F.lit(float(slices))).cast("long"))
    sums = items.groupBy("slice").agg(F.sum("size").alias("n"))
    budget = rows.agg((F.sum("size") * F.lit(float(budget))).alias("b")).first()["b"]
    if budget is None:
        return None
    run = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    over = sums.withColumn("upto", F.sum("n").over(run)).where(F.col("upto") > budget)
    edge = over.agg(F.min(F.struct("slice", "upto", "n")).alias("e")).first()["e"]
    if edge is None:
        return float("inf")
    inside = items.where(F.col("slice") == edge["slice"]).groupBy("t").agg(F.sum("size").alias("n"))
    run = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("upto", F.sum("n").over(run) + F.lit(edge["upto"] - edge["n"])).where(F.col("upto") <= budget)
    last = fits.agg(F.max("t").alias("t")).first()["t"]
    if last is not None:
        return last
    return items.where(F.col("slice") < edge["slice"]).agg(F.max("t").alias("t")).first()["t"]


def document_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, mark): where the id is null, mark tells rows apart by text."""
    mark = F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), mark.alias("mark"))


def mix(docs: DataFrame, seed: str = "") -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken."""
    rows = mix_sizes(document_sizes(docs), seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, seed: str = "", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as many times as the mix takes it; rows alike in id, source and size share one decision."""
    sizes = mix_sizes(document_sizes(docs, id_col, source_col, text_col), seed).where("copies > 0")
    i, s, n, m, copies, copy = unused(docs, "mix_id", "mix_source", "mix_size", "mix_mark", "copies", "copy")
    taken = sizes.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(n), F.col("mark").alias(m)).agg(F.max("copies").alias(copies))
    mark = F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    on = F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).eqNullSafe(F.col(s)) & (word_count(F.col(text_col)) == F.col(n)) & mark.eqNullSafe(F.col(m))
    both = docs.join(taken.hint("shuffle_hash"), on)
    return both.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)
