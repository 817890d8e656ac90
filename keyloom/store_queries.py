"""Registered queries over the stored database, each with its DuckDB SQL.

Each makes a database in the session's shared folder, changes it through its own operations, and
returns what the database then holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query, table
from .sources.db import DB, Tree
from .sources.journal import JournalAnchor, JournalEnvelope


def _loaded(spark: SparkSession, d: str, *names: str) -> DB:
    """A database with the named trees, each holding the nations by path."""
    db = DB.open(spark)
    for name in names:
        db.create_tree(name).put_many(_nations(spark, d))
    return db


def _nations(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation")
    key = F.concat(F.lit("n/"), F.col("n_regionkey").cast("string"), F.lit("/"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    return t.select(F.col("n_nationkey").cast("long").alias("idx"), key.cast("binary").alias("key"), F.col("n_name").cast("binary").alias("value"))


def _text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("string") for c in ("key", "value") if c in rows.columns})


def _requests(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events")
    key = F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 5).cast("string"))
    return t.select(F.col("event_id").alias("idx"), key.cast("binary").alias("key"), F.col("props").cast("binary").alias("value"))


S_NATIONS = "nations AS (SELECT n_nationkey AS idx, 'n/' || n_regionkey || '/' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS key, n_name AS value FROM nation)"
S_REQUESTS = "req AS (SELECT event_id AS idx, 'u/' || user_id || '/' || event_id % 5 AS key, props AS value FROM events)"


@query(f"WITH {S_REQUESTS} SELECT key, arg_max(value, idx) AS value, 1 + max(idx) AS version FROM req GROUP BY key")
def store_put_many(spark, d):
    """A bulk put; then the base that a checkpoint writes holds the same rows and versions."""
    t = Tree.open(spark)
    t.put_many(_requests(spark, d))
    t.checkpoint()
    return _text(t.rows())


@query(f"""WITH {S_REQUESTS}, half AS (SELECT max(idx) // 2 AS h FROM req), old AS (SELECT DISTINCT key FROM req, half WHERE idx <= h),
n AS (SELECT req.idx, req.key, row_number() OVER (PARTITION BY req.key ORDER BY req.idx) AS r FROM req, half WHERE idx > h)
SELECT n.idx, n.key, CASE WHEN old.key IS NULL AND r = 1 THEN 'created' ELSE 'already_exists' END AS outcome FROM n LEFT JOIN old ON old.key = n.key""")
def store_put_many_if_absent(spark, d):
    rows = _requests(spark, d)
    half = (rows.agg(F.max("idx")).first()[0] or 0) // 2
    t = Tree.open(spark)
    t.put_many(rows.where(F.col("idx") <= half))
    return _text(t.put_many_if_absent(rows.where(F.col("idx") > half)))


# What a batch of one of each operation makes of both trees; versions go on behind the 2 x 25 rows.
S_BATCH = f"""{S_NATIONS}, two AS (SELECT 'a' AS tree, key, value, 1 + idx AS version FROM nations UNION ALL SELECT 'b', key, value, 26 + idx FROM nations)"""
S_BATCH_DONE = """SELECT tree, key, value, version FROM two WHERE NOT (tree = 'a' AND key IN ('n/0/000', 'n/0/005', 'n/1/001')) AND NOT (tree = 'b' AND key IN ('n/1/002', 'n/1/003'))
UNION ALL VALUES ('a', 'n/1/001', 'changed', 52), ('a', 'new/1', 'one', 51), ('a', 'moved', (SELECT value FROM nations WHERE key = 'n/0/005'), 54), ('b', 'n/1/003', 'forced', 57), ('b', 'new/2', 'two', 55)"""


def _build(x):
    """Guards and writes on two trees; what it writes it sees itself."""
    a, b = x.tree("a"), x.tree("b")
    a.put(b"new/1", b"one").compare_and_put(b"n/1/001", 2, b"changed").delete(b"n/0/000")
    a.assert_absent(b"n/0/000").rename(b"n/0/005", b"moved").assert_version(b"moved", 54).assert_prefix_empty(b"gone/")
    b.put_if_absent(b"new/2", b"two").put(b"n/1/002", b"forced").rename(b"n/1/002", b"n/1/003", force=True)


@query(f"WITH {S_BATCH} {S_BATCH_DONE}")
def store_atomic_batch(spark, d):
    db = _loaded(spark, d, "a", "b")
    db.atomic(_build)
    return _text(db.live())


@query(f"WITH {S_BATCH} SELECT tree, key, value, version, false AS applied FROM two")
def store_atomic_guard_fails(spark, d):
    """One guard of one tree fails: nothing of any tree is written."""
    db = _loaded(spark, d, "a", "b")

    def build(x):
        _build(x)
        x.tree("b").assert_prefix_empty(b"n/2/")

    applied = db.atomic(build)
    return _text(db.live()).withColumn("applied", F.lit(applied))


@query(f"WITH {S_NATIONS} SELECT 'a' AS tree, key, value FROM nations WHERE starts_with(key, 'n/1/') UNION ALL SELECT 'b', key, value FROM nations")
def store_view(spark, d):
    """Two trees at one position, one of them scoped; later writes do not show."""
    db = _loaded(spark, d, "a", "b")
    view = db.view([("a", b"n/1/"), ("b", b"")])
    db.open_tree("a").put(b"n/1/zzz", b"late")
    parts = [view.tree(t).rows().select(F.lit(t).alias("tree"), "key", "value") for t in ("a", "b")]
    return _text(parts[0].unionByName(parts[1]))


@query(f"WITH {S_NATIONS} SELECT 'snapshot' AS seen, key, value FROM nations UNION ALL SELECT 'now', key, value FROM nations WHERE NOT starts_with(key, 'n/2/') UNION ALL SELECT 'now', 'n/2/008', 'again'")
def store_snapshot(spark, d):
    """A snapshot goes on reading what it saw, after rewrites and after old files are collected."""
    t = Tree.open(spark)
    t.put_many(_nations(spark, d))
    snapshot = t.snapshot()
    keys = [bytes(r["path"]) for r in t.scan_keys(b"n/2/").rows().collect()]  # the nations of one region
    t.atomic(lambda x: [x.delete(k) for k in keys])
    t.put(b"n/2/008", b"again")
    t.checkpoint()
    t.gc()
    parts = [rows.select(F.lit(name).alias("seen"), "key", "value") for name, rows in (("snapshot", snapshot.rows()), ("now", t.rows()))]
    return _text(parts[0].unionByName(parts[1]))


@query(f"WITH {S_NATIONS} SELECT t.tree, key, value FROM nations, (VALUES ('a'), ('b')) t(tree) UNION ALL SELECT 'own', key, value FROM nations")
def store_export_install(spark, d):
    """An image of two trees installed beside the trees of another database."""
    db, other = _loaded(spark, d, "a", "b"), _loaded(spark, d, "own")
    other.install_checkpoint(db.export_checkpoint(db.files.path("image")))
    return _text(other.live().select("tree", "key", "value"))


@query("SELECT * FROM (VALUES ('a', 'live'), ('c', 'dropping'), ('after', 'live'), ('before', 'live')) t(name, state)")
def store_catalog(spark, d):
    """A name that was dropped is free again after a checkpoint, not before."""
    db = DB.open(spark)
    for name in ("a", "before", "after", "c"):
        db.create_tree(name)
    db.drop_tree("after")
    db.checkpoint()
    db.create_tree("after")
    db.drop_tree("c")
    return db.catalog().where(F.col("name").isin([*db.list_trees(), "c"]))


@query("SELECT CAST(r_regionkey AS BIGINT) + 1 AS sequence, r_name AS payload, true AS has_more FROM region WHERE r_regionkey BETWEEN 2 AND 3 ORDER BY 1")
def store_journal_page(spark, d):
    """The envelopes after the second one, two at most, of one commit for each region."""
    db = DB.open(spark)
    db.create_tree("t")
    anchor = lambda i: JournalAnchor(i, bytes([i]) * 32)
    db.initialize_journal_stream(anchor(0))
    names = [r["r_name"] for r in table(spark, d, "region").orderBy("r_regionkey").collect()]  # five rows at any scale
    for i, name in enumerate(names):
        db.atomic_with_journal_envelope(JournalEnvelope(anchor(i), anchor(i + 1), name.encode()), lambda x, n=name: x.tree("t").put(n.encode(), b""))
    page = db.journal_envelopes_after(anchor(2), 2, 1 << 20)
    return spark.createDataFrame([(e.current.sequence, e.payload.decode(), page.has_more) for e in page.envelopes], "sequence long, payload string, has_more boolean")


@query(f"WITH {S_NATIONS} SELECT key, value FROM nations UNION ALL SELECT 'after', 'crash'")
def store_torn_commit(spark, d):
    """A writer dies between its segment and its manifest; the next one commits, and sees nothing of it."""
    db = _loaded(spark, d, "a")
    create, db.files.create = db.files.create, lambda *a: (_ for _ in ()).throw(OSError("gone"))
    kinds = []
    try:
        db.atomic(lambda x: x.tree("a").put(b"never", b"seen"))
    except Exception as error:
        kinds.append(getattr(error, "kind", None))
    db.files.create = create
    next_writer = DB.open(spark, db.files.root)
    if kinds == ["outcome_unknown"]:
        next_writer.atomic(lambda x: x.tree("a").put(b"after", b"crash"))
    return _text(next_writer.tree_rows("a").select("key", "value"))
