"""Join queries: nearest preceding row, anti joins, snapshots, pairing, resolution and presence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators import drift
from cartolith.operators import joins as op

from .registry import query, table
from .search_queries import micros


@query("""
    WITH o AS (SELECT o_custkey AS user_id, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2),
    e AS (SELECT event_id, user_id, ts - INTERVAL 25 YEAR AS at FROM events)
    SELECT e.event_id, o.o_orderkey FROM e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.at >= o.o_orderdate""")
def asof_symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 25 YEAR")).alias("at"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey")
    return op.asof(e, o, "user_id", "at", "o_orderdate", {"o_orderkey": "o_orderkey"}, "o_orderkey").select("event_id", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def stale_rows_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "orders").filter("o_orderdate >= TIMESTAMP_NTZ'1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return op.stale(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), recent, "c_custkey")


@query("SELECT DISTINCT l_suppkey AS node FROM lineitem WHERE l_suppkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def root_nodes_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    edges = rows.select(F.col("l_suppkey").alias("source"), F.when(F.col("l_quantity") > 48, F.col("l_partkey")).alias("target"))
    return op.roots(edges, "source", "target")


_SNAPSHOTS = """
    WITH b AS (SELECT o_custkey AS id, min(o_orderpriority) AS kind FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
    a AS (SELECT o_custkey AS id, min(o_orderpriority) AS kind FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    old = F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ'1996-01-01'")
    return tuple(orders.filter(c).groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("kind")) for c in (old, ~old))


@query(_SNAPSHOTS + """
    SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN b.id IS NULL THEN 'info' ELSE 'warning' END AS severity
    FROM b FULL JOIN a ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.kind <> b.kind""")
def snapshot_drift_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.compare_snapshots(*snapshots(spark, sf_dir), ["id"], "kind")


@query("""
    WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t, l_shipdate < TIMESTAMP '1996-01-01' AS old FROM lineitem)
    SELECT s, t, CASE WHEN bool_or(old) THEN 'removed' ELSE 'added' END AS change, CASE WHEN bool_or(old) THEN 'warning' ELSE 'info' END AS severity
    FROM e GROUP BY 1, 2 HAVING count(*) = 1""")
def edge_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    old = F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ'1996-01-01'")
    before, after = (rows.filter(c).select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("t")).distinct() for c in (old, ~old))
    return op.compare_snapshots(before, after, ["s", "t"], None)


@query(_SNAPSHOTS + """
    , d AS (SELECT CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change, b.id IS NULL AS info
        FROM b FULL JOIN a ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.kind <> b.kind)
    SELECT change, CASE WHEN info THEN 'info' ELSE 'warning' END AS severity, count(*) AS n, false AS blocking FROM d GROUP BY 1, 2""")
def drift_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.counts(op.compare_snapshots(*snapshots(spark, sf_dir), ["id"], "kind"), "change")


@query("""
    WITH e AS (SELECT *, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pair_no FROM events),
    s AS (SELECT user_id, pair_no, event_id FROM e WHERE event_type = 'view'),
    f AS (SELECT user_id, pair_no, min_by(event_id, (ts, event_id)) AS event_id FROM e WHERE event_type = 'purchase' AND pair_no > 0 GROUP BY 1, 2)
    SELECT s.user_id, s.pair_no::BIGINT AS pair_no, s.event_id AS start_event_id, f.event_id AS end_event_id FROM s LEFT JOIN f USING (user_id, pair_no)""")
def start_end_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return op.sequence_pairs(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "purchase", ["event_id"])


@query("""
    SELECT a.event_id AS start_id, min(b.event_id) AS end_id, min(epoch_us(b.ts)) - epoch_us(a.ts) AS micros
    FROM events a JOIN events b ON (b.props->>'$.k')::BIGINT = a.event_id AND b.event_type = 'error' WHERE a.event_type = 'click' GROUP BY a.event_id, a.ts""")
def payload_key_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    ends = rows.filter("event_type = 'error'").select(F.from_json("props", "k long")["k"].alias("start_id"), F.col("event_id").alias("end_id"), micros().alias("end_at"))
    starts = rows.filter("event_type = 'click'").select(F.col("event_id").alias("start_id"), micros().alias("start_at"))
    return starts.join(ends, "start_id").groupBy("start_id", "start_at").agg(F.min("end_id").alias("end_id"), F.min("end_at").alias("e")).select("start_id", "end_id", (F.col("e") - F.col("start_at")).alias("micros"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_events FROM customer")
def run_event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_events"))


@query("""
    WITH r AS (SELECT s_suppkey, 'NATION_' || (s_suppkey % 40)::VARCHAR AS c0, 'NATION_' || s_nationkey::VARCHAR AS c1 FROM supplier)
    SELECT s_suppkey, coalesce(a.n_nationkey, b.n_nationkey) AS target, CASE WHEN a.n_nationkey IS NOT NULL THEN 0 WHEN b.n_nationkey IS NOT NULL THEN 1 END AS rank,
        a.n_nationkey IS NOT NULL OR b.n_nationkey IS NOT NULL AS internal
    FROM r LEFT JOIN nation a ON a.n_name = c0 LEFT JOIN nation b ON b.n_name = c1""")
def candidate_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    names = [F.concat(F.lit("NATION_"), (F.col("s_suppkey") % 40).cast("string")), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))]
    return op.resolve(refs, table(spark, sf_dir, "nation"), names, "s_suppkey", "n_name", "n_nationkey").drop("s_nationkey")


@query("""
    WITH r AS (SELECT n_regionkey, n_nationkey FROM nation), h AS (SELECT DISTINCT s_nationkey FROM supplier)
    SELECT n_regionkey, count(s_nationkey) AS present, count(*) - count(s_nationkey) AS absent,
        coalesce(string_agg(CASE WHEN s_nationkey IS NULL THEN n_nationkey::VARCHAR END, ',' ORDER BY n_nationkey::VARCHAR), '') AS missing, bool_and(s_nationkey IS NOT NULL) AS complete
    FROM r LEFT JOIN h ON s_nationkey = n_nationkey GROUP BY 1""")
def required_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return op.presence(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey"), have, "n_regionkey", "n_nationkey")


@query("""
    SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.quality = 0 THEN 'failed' ELSE 'ok' END AS evidence
    FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.quality = 0""")
def evidence_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.evidence(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id", F.col("quality") == 0)


@query("SELECT l_orderkey, l_linenumber, p_name, p_type FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations with the names that their keys stand for."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey", "left").drop("l_partkey")


#: The reference's page of commits.
NEWEST = 50


@query(f"""
    WITH c AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS no FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT {NEWEST})),
    h AS (SELECT DISTINCT l_partkey, no FROM lineitem JOIN c ON o_orderkey = l_orderkey)
    SELECT l_partkey, count(h.no) AS commits, string_agg(CASE WHEN h.no IS NULL THEN '0' ELSE '1' END, '' ORDER BY c.no) AS mask
    FROM (SELECT DISTINCT l_partkey FROM h) p CROSS JOIN c LEFT JOIN h USING (l_partkey, no) GROUP BY 1""")
def timeline_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest commits, oldest of them first, and the files that they touch."""
    from cartolith.operators.events import timeline_matrix as matrix

    commits = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(NEWEST).select("o_orderkey", "o_orderdate")
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return matrix(commits, files, "o_orderkey", "l_partkey", ["o_orderdate", "o_orderkey"])
