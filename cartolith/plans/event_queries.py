"""Event, session, change and tree queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators import events as op
from cartolith.operators import graph

from .registry import query, table
from .search_queries import micros

#: Driver events standing in for changes of files.
_KINDS = {"signup": "created", "view": "modified", "click": "modified", "error": "deleted", "purchase": "moved"}
_CHANGES = """SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'modified' WHEN 'click' THEN 'modified' WHEN 'error' THEN 'deleted' ELSE 'moved' END AS event_type,
    'f' || (event_id % 97) AS src_path, CASE WHEN event_type = 'purchase' THEN 'f' || (event_id % 89) END AS dest_path FROM events"""


def changes(rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    mapped = F.coalesce(*(F.when(kind == k, v) for k, v in _KINDS.items()))
    return rows.select(F.col("event_id").alias("seq"), mapped.alias("event_type"), F.concat(F.lit("f"), (F.col("event_id") % 97).cast("string")).alias("src_path"), F.when(kind == "purchase", F.concat(F.lit("f"), (F.col("event_id") % 89).cast("string"))).alias("dest_path"))


COLLAPSE_SQL = f"""
    WITH c AS ({_CHANGES}), f AS (
        SELECT seq, 0 AS sub, CASE event_type WHEN 'moved' THEN 'deleted' ELSE event_type END AS kind, src_path AS path FROM c UNION ALL SELECT seq, 1, 'created', dest_path FROM c WHERE event_type = 'moved'),
    g AS (SELECT path, min(seq) AS first_seq, max_by(kind, (seq, sub)) AS last_kind, max(seq * 2 + sub) FILTER (kind = 'created') AS c, max(seq * 2 + sub) FILTER (kind = 'deleted') AS d FROM f GROUP BY 1)
    SELECT path, CASE WHEN c IS NOT NULL AND (d IS NULL OR c > d) THEN 'created' ELSE last_kind END AS event_type, first_seq FROM g"""


@query(COLLAPSE_SQL)
def change_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.collapse(changes(table(spark, sf_dir, "events")))


@query("""
    SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 7 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)
    UNION ALL SELECT p_partkey, 'new ' || p_name, p_size + 1 FROM part WHERE p_partkey % 7 = 0""")
def change_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    changed = part.filter("p_partkey % 7 = 0").select("p_partkey", F.concat(F.lit("new "), "p_name").alias("p_name"), F.col("p_size") + 1)
    deleted = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return op.upsert(part, changed.toDF(*part.columns), deleted, "p_partkey")


@query("""
    SELECT event_id, event_type FROM (SELECT *, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b, lag(event_type, 3) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE event_type IS DISTINCT FROM a AND event_type IS DISTINCT FROM b AND event_type IS DISTINCT FROM c""")
def duplicate_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return op.suppress_repeats(rows, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type")


@query("""
    SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, min(epoch_us(ts)) AS first_at, max(epoch_us(ts)) AS last_at, count(*) FILTER (event_type IN ('purchase', 'signup')) AS tests,
        coalesce(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('purchase', 'signup')), 0), 0.0) AS success_rate FROM events GROUP BY 1""")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.session_metrics(table(spark, sf_dir, "events"), "user_id", micros(), "event_type", ["error"], ["purchase"], ["purchase", "signup"])


@query("""
    WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events), n AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 7200000000, true) AS new FROM e)
    SELECT event_id, user_id, sum(new::INT) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS session FROM n""")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", micros().alias("us"))
    return op.sessionize(rows, "user_id", "us", 7200, "event_id").drop("us")


@query("""
    SELECT user_id, event_type, min(epoch_us(ts)) AS start_at, max(epoch_us(ts)) AS end_at, count(*) AS events, max_by(props, (epoch_us(ts), event_id)) AS last_status,
        greatest((max(epoch_us(ts)) - min(epoch_us(ts))) // 1000, 1000) AS duration_ms FROM events GROUP BY 1, 2""")
def phase_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("us", micros())
    return op.phase_blocks(rows, ["user_id"], "event_type", "us", ["us", "event_id"], "props")


@query("""
    SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS phase FROM events""")
def phase_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    value = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type"))
    return op.carry_forward(rows, ["user_id"], ["ts", "event_id"], value, "phase").select("event_id", "phase")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_number FROM conversations")
def running_line_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("line_number"))


@query("""
    SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders""")
def snapshot_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("previous"))


@query("""
    SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS last_five FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY 1""")
def last_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartolith.operators.search import cap

    top = cap(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    return top.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("last_five"))


@query("""
    SELECT array_to_string(parts[1:n], '/') AS node, array_to_string(parts[1:n-1], '/') AS parent, n AS depth, bool_or(n < len(parts)) AS is_dir, count(*) AS files
    FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages)) GROUP BY 1, 2, 3""")
def tree_prefix_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tree_nodes(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")), "path")


@query("""
    SELECT array_to_string(parts[1:n], '/') AS directory, bool_or(changed) AS modified, count(*) AS files
    FROM (SELECT parts, changed, unnest(range(1, len(parts))) AS n FROM (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS parts, page_id % 11 = 0 AS changed FROM pages)) GROUP BY 1""")
def tree_rollup_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"), (F.col("page_id") % 11 == 0).alias("changed"))
    return graph.roll_up(rows, "path", "changed")


@query("""
    SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS b, count(*) AS n FROM events GROUP BY 1, 2""".replace("time_bucket(INTERVAL 6 HOUR, ts) AS b", "epoch_us(ts) // 21600000000 AS bucket"))
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of six hours."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(micros() / 21600000000).alias("bucket")).agg(F.count("*").alias("n"))
