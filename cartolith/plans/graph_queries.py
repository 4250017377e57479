"""Graph queries over edges between orders' customers and between suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.operators import graph as op
from cartolith.operators import joins

from .registry import query, table

#: The reference's depth of a call flow.
DEPTH = 5
_CALLS = """calls AS (SELECT DISTINCT source, target FROM (SELECT o_custkey AS source, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS target FROM orders) WHERE target IS NOT NULL AND source <> target)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse directed graph: consecutive customers of a day."""
    w = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.lead("o_custkey").over(w).alias("target"))
    return edges.filter("target is not null and source <> target").distinct()


@query("SELECT l_suppkey AS source, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS targets, count(DISTINCT l_partkey) AS n_targets FROM lineitem GROUP BY 1".replace("string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR)", "array_to_string(list_sort(list_distinct(list(l_partkey))), ',')"))
def adjacency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return op.adjacency(edges)


@query(f"""
    WITH RECURSIVE {_CALLS}, walk AS (SELECT 5::BIGINT AS node, 0 AS depth UNION SELECT c.target, w.depth + 1 FROM walk w JOIN calls c ON c.source = w.node WHERE w.depth < 5)
    SELECT node, min(depth) AS depth FROM walk GROUP BY 1""")
def reachable_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reachable(calls(spark, sf_dir), spark.sql("SELECT 5L AS node"), 5)


_WALK = f"""{_CALLS}, walk AS (
        SELECT NULL::BIGINT AS source, 6::BIGINT AS target, 0 AS depth, [6::BIGINT] AS path, false AS closes
        UNION ALL SELECT w.target, e.target, w.depth + 1, list_append(w.path, e.target), list_contains(w.path, e.target) FROM walk w JOIN calls e ON e.source = w.target WHERE NOT w.closes AND w.depth < {DEPTH})"""


@query(f"WITH RECURSIVE {_WALK} SELECT source, target, min(depth) AS depth FROM walk WHERE closes GROUP BY 1, 2")
def cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.paths(spark, calls(spark, sf_dir), spark.sql("SELECT 6L AS node"), DEPTH).filter("closes").groupBy("source", "target").agg(F.min("depth").alias("depth"))


@query(f"WITH RECURSIVE {_WALK} SELECT array_to_string(path, '>') AS chain, depth FROM walk WHERE NOT closes")
def call_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = op.paths(spark, calls(spark, sf_dir), spark.sql("SELECT 6L AS node"), DEPTH).filter("not closes")
    return walked.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("chain"), "depth")


@query("SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_partkey NOT IN (SELECT l_suppkey FROM lineitem)")
def chain_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts call their suppliers; the roots are the parts that no part calls."""
    return joins.roots(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")), "source", "target")


@query("SELECT l_returnflag AS type, count(*) AS n, count(DISTINCT l_suppkey) AS sources, count(DISTINCT l_partkey) AS targets FROM lineitem GROUP BY 1")
def edge_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.type_counts(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")))


@query("SELECT p_partkey AS node, p_size AS depth, p_size * 280 AS x, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) * 120 AS y FROM part")
def layout_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.layout(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("depth")))


@query("""
    SELECT n_regionkey AS parent, string_agg('  "' || n_name || '" -> "' || r_name || '";', chr(10) ORDER BY n_name) AS dot FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def dot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    line = F.concat(F.lit('  "'), "n_name", F.lit('" -> "'), "r_name", F.lit('";'))
    return n.groupBy(F.col("n_regionkey").alias("parent")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("dot"))


@query("""
    SELECT target, min(l_suppkey) AS caller, count(*) AS calls, min(depth) + 1 AS depth
    FROM (SELECT l_partkey AS target, l_suppkey, l_linenumber AS depth FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) GROUP BY 1""")
def external_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets outside the graph whose callers are in it, one level below the nearest caller."""
    inside = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").join(inside, "l_suppkey", "left_semi")
    return rows.groupBy(F.col("l_partkey").alias("target")).agg(F.min("l_suppkey").alias("caller"), F.count("*").alias("calls"), (F.min("l_linenumber") + 1).alias("depth"))



_SPARSE = f"{_CALLS}, e AS (SELECT source, target FROM calls WHERE (source * 31 + target * 17) % 11 < 2), v AS (SELECT source AS node FROM e UNION SELECT target FROM e), reach AS (SELECT node AS a, node AS b FROM v UNION SELECT r.a, e.target FROM reach r JOIN e ON e.source = r.b), comp AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1)"


def sparse_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About a fifth of the edges of `calls`, so that components of many sizes are left."""
    return calls(spark, sf_dir).filter((F.col("source") * 31 + F.col("target") * 17) % 11 < 2)


@query(f"WITH RECURSIVE {_SPARSE} SELECT node, component FROM comp")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that reach each other."""
    return op.strong_components(sparse_calls(spark, sf_dir))


@query(f"WITH RECURSIVE {_SPARSE} SELECT source, target, a.component FROM e JOIN comp a ON a.node = source JOIN comp b ON b.node = target WHERE a.component = b.component")
def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that lie on a cycle, by components and without walking any path twice."""
    edges = op.cut_lineage(sparse_calls(spark, sf_dir))
    return op.cyclic_edges(edges, op.strong_components(edges))
