"""Line differences between two versions of texts that are written from orders and their line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators import history

from .registry import query, table

_LINES = """l AS (SELECT l_orderkey AS k, 'part ' || l_partkey || ' line ' || l_linenumber || ' of ' || l_suppkey || ' times ' || l_quantity::INT || ' order ' || l_orderkey AS line, l_linenumber AS n, l_returnflag = 'R' AS goes, l_linestatus = 'O' AND l_linenumber % 2 = 0 AS comes FROM lineitem),
    o AS (SELECT *, row_number() OVER w AS old_line, count(*) FILTER (NOT goes) OVER w + count(*) FILTER (comes) OVER w - comes::INT AS kept, count(*) FILTER (NOT goes) OVER w + count(*) FILTER (comes) OVER w AS new_line FROM l WINDOW w AS (PARTITION BY k ORDER BY line ROWS UNBOUNDED PRECEDING))"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, before, after): an order's items as lines; afterwards returned ones are gone and some have a line after them."""
    line = F.concat(F.lit("part "), "l_partkey", F.lit(" line "), "l_linenumber", F.lit(" of "), "l_suppkey", F.lit(" times "), F.col("l_quantity").cast("int"), F.lit(" order "), "l_orderkey")
    goes, comes = F.col("l_returnflag") == "R", (F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 2 == 0)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct(line.alias("line"), goes.alias("goes"), comes.alias("comes")).alias("x"))
    items = rows.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # a few lines an order
    none = F.array().cast("array<string>")
    after = F.flatten(F.transform("xs", lambda x: F.concat(F.when(x["goes"], none).otherwise(F.array(x["line"])), F.when(x["comes"], F.array(F.concat(F.lit("new after "), x["line"]))).otherwise(none))))
    text = lambda parts: F.array_join(F.transform(parts, lambda s: F.concat(s, F.lit("\n"))), "")
    return items.select(F.col("k").alias("l_orderkey"), text(F.transform("xs", lambda x: x["line"])).alias("before"), text(after).alias("after"))


@query(f"""
    WITH {_LINES}
    SELECT k AS l_orderkey, '-' AS op, old_line::INT AS old_line, NULL::INT AS new_line, line AS text FROM o WHERE goes
    UNION ALL SELECT k, '+', NULL, new_line::INT, 'new after ' || line FROM o WHERE comes""")
def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order's text that go or come, by a shortest edit script."""
    return history.line_changes(versions(spark, sf_dir), ["l_orderkey"], "before", "after")


@query(f"WITH {_LINES} SELECT k AS l_orderkey, count(*) FILTER (comes) AS added, count(*) FILTER (goes) AS removed FROM o GROUP BY 1 HAVING count(*) FILTER (comes OR goes) > 0")
def line_change_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines added and removed in each order's text that changes."""
    return history.change_stats(line_changes(spark, sf_dir), ["l_orderkey"])
