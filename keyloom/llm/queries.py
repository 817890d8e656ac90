"""The registered queries of this subpackage and their DuckDB SQL.

Each query is thin: it applies one operator, with production parameters, to a whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, license_scan, line_dedup, mix, packing, quality, secrets, simhash, topk, toxicity
from .shared import read_table, shared_dir


def vocabulary() -> packing.Vocabulary:
    import public_tokenizers

    return packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, 5)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments over one ledger: even ids first, then all others; the second scans only blobs that the first has not seen."""
    docs = read_table(spark, sf_dir, "documents")
    ledger = f"{shared_dir(spark)}/keyloom-{uuid.uuid4().hex}/ledger"
    even = F.coalesce(F.pmod("doc_id", F.lit(2)) == 0, F.lit(False))
    found = secrets.scan_into(docs.where(even), ledger).unionByName(secrets.scan_into(docs.where(~even), ledger))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>"))
    count = lambda kind: F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s.kind.isin(*secrets.BASE_KINDS))
    return found.select(F.col("path").alias("doc_id"), *map(count, secrets.BASE_KINDS), F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(spans).alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of four words, as this query's contract says."""
    rows = simhash.simhash_groups(read_table(spark, sf_dir, "documents"), shingle=4)
    return rows.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids stand for the history, the other rows arrive; all rows get their decision."""
    docs = read_table(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs, is_history=F.pmod("doc_id", F.lit(2)) == 0)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(read_table(spark, sf_dir, "documents")).drop("source")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read_table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())


_BARE = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_BARE}) AS h FROM documents),
w AS (SELECT *, first_value(doc_id) OVER p AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
      FROM d WINDOW p AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 16) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS place, 2 * source_size AS cap FROM s),
f AS (SELECT *, CAST(cap AS DOUBLE) / weight AS fill FROM p),
g AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             sum(weight) OVER (ORDER BY fill, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             sum(source_size) OVER () AS total FROM f),
l AS (SELECT *, (CAST(total AS DOUBLE) * CAST(1.5 AS DOUBLE) - CAST(spent AS DOUBLE)) / CAST(open AS DOUBLE) AS own_level FROM g),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(CASE WHEN own_level <= fill THEN own_level END) OVER () * weight) AS target FROM l),
c AS (SELECT d.*, t.source_size, t.target,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT size, CAST(fin AS DOUBLE) / target AS t FROM c WHERE size > 0
      UNION ALL SELECT size, CAST(fin + source_size AS DOUBLE) / target FROM c WHERE size > 0),
r AS (SELECT t, sum(size) OVER (ORDER BY t RANGE UNBOUNDED PRECEDING) AS upto FROM i),
cut AS (SELECT max(t) AS t FROM r WHERE upto <= (SELECT 1.5 * sum(size) FROM d))
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE size * (CAST(CAST(fin AS DOUBLE) / target <= cut.t AS INTEGER)
            + CAST(CAST(fin + source_size AS DOUBLE) / target <= cut.t AS INTEGER)) END AS taken
FROM c, cut"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_top_k, op2_secret_scan, op3_simhash, op4_exact_dedup, op5_quality, op6_mix, op7_toxicity, op8_line_dedup, op9_license_scan, op10_pack)}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op6_mix": OP6_SQL, "op9_license_scan": license_scan.oracle()}
