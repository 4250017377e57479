"""Exports, counters and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions.text import base_type, is_pascal_case
from cartolith.operators import contracts, drift, review

from .registry import query, table
from .search_queries import micros


@query("SELECT n_regionkey, to_json({'n_nationkey': n_nationkey, 'n_name': n_name}) AS payload FROM nation")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_regionkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("payload"))


@query("""
    SELECT user_id, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) FILTER (event_type = 'click'), '') AS commands,
        coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) FILTER (event_type = 'error'), '') AS errors FROM events GROUP BY 1""")
def session_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(kind: str):
        rows = F.sort_array(F.collect_list(F.when(F.col("event_type") == kind, F.struct(micros().alias("at"), "event_id"))))
        return F.array_join(F.transform(rows, lambda x: x["event_id"].cast("string")), ",")

    return table(spark, sf_dir, "events").groupBy("user_id").agg(of("click").alias("commands"), of("error").alias("errors"))


@query("""
    SELECT CASE WHEN contains(url, '..') THEN 'error' WHEN contains(url, '?') THEN 'skipped' ELSE 'processed' END AS status, count(*) AS n FROM pages GROUP BY 1""")
def notify_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.contains("url", F.lit("..")), "error").when(F.contains("url", F.lit("?")), "skipped").otherwise("processed")
    return table(spark, sf_dir, "pages").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'Foo' WHEN 2 THEN 'A' ELSE 'list' END AS base, CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS pascal
    FROM customer""")
def type_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("c_custkey") % 4
    hint = F.when(r == 0, F.col("c_mktsegment")).when(r == 1, "Optional[Foo]").when(r == 2, "A | B").otherwise("list[int]")
    return table(spark, sf_dir, "customer").select("c_custkey", base_type(hint).alias("base"), is_pascal_case(base_type(hint)).alias("pascal"))


@query("""
    SELECT n_nationkey, 1 AS hunk, b AS block, r AS rank, no AS left_no, l AS left, no AS right_no, CASE b WHEN 2 THEN l ELSE lower(l) END AS right
    FROM (SELECT n_nationkey, 2 AS b, 0 AS r, 1 AS no, 'same' AS l FROM nation UNION ALL SELECT n_nationkey, 2, 1, 2, n_name FROM nation)""".replace("CASE b WHEN 2 THEN l ELSE lower(l) END", "CASE r WHEN 0 THEN l ELSE lower(l) END"))
def diff_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("@@ -1,2 +1,2 @@\n same\n-"), "n_name", F.lit("\n+"), F.lower("n_name")).alias("diff"))
    return contracts.side_by_side(rows, "n_nationkey", "diff")


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def status_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


_NOTICES = """n AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '../' ELSE 'src/' END || 'f' || user_id || CASE event_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' ELSE '.lock' END AS path,
        CASE event_type WHEN 'view' THEN 'modified' WHEN 'click' THEN 'created' WHEN 'error' THEN 'deleted' ELSE event_type END AS kind FROM events)"""


@query(f"""
    WITH {_NOTICES}
    SELECT event_id, CASE WHEN path LIKE '../%' THEN 'error' WHEN path LIKE '%.lock' OR kind NOT IN ('created', 'modified', 'deleted') THEN 'skipped' ELSE 'processed' END AS status,
        CASE WHEN path LIKE '../%' THEN 'path_outside_root' WHEN path LIKE '%.lock' THEN 'extension_not_followed' WHEN kind NOT IN ('created', 'modified', 'deleted') THEN 'unknown_change' END AS reason FROM n""")
def notify_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of changed files one by one: processed, or why not."""
    e = F.col("event_id")
    path = F.concat(F.when(e % 5 == 0, "../").otherwise("src/"), F.lit("f"), "user_id", F.when(e % 3 == 0, ".py").when(e % 3 == 1, ".TS").otherwise(".lock"))
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in (("view", "modified"), ("click", "created"), ("error", "deleted"))), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", path.alias("path"), kind.alias("kind"))
    return review.notified(rows, "path", "kind", [".py", ".ts"]).select("event_id", "status", "reason")


_ITEMS = """i AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'critical' WHEN 'O' THEN 'warning' ELSE 'info' END AS severity, o_orderpriority AS type, o_custkey::VARCHAR AS file_path FROM orders)"""


def _drift_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("o_orderstatus") == "F", "critical").when(F.col("o_orderstatus") == "O", "warning").otherwise("info")
    return table(spark, sf_dir, "orders").select("o_orderkey", severity.alias("severity"), F.col("o_orderpriority").alias("type"), F.col("o_custkey").cast("string").alias("file_path"))


@query(f"WITH {_ITEMS} SELECT o_orderkey, severity, type FROM i WHERE type IN ('1-URGENT', '2-HIGH') AND severity IN ('critical', 'warning') AND severity = 'critical'")
def drift_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking drift of two types."""
    return drift.selected(_drift_items(spark, sf_dir), ["1-URGENT", "2-HIGH"], ["critical", "warning"], blocking=True).select("o_orderkey", "severity", "type")


@query(f"WITH {_ITEMS} SELECT count(*) AS items, count(DISTINCT file_path) AS analyzed_files, bool_or(severity = 'critical') AS has_blocking FROM i")
def drift_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two detectors as one report, each file counted once."""
    items = _drift_items(spark, sf_dir)
    return drift.report([items.filter("severity = 'critical'"), items.filter("severity <> 'critical'")])
