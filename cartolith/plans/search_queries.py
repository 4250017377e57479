"""Search, filter, scope, paging and set queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import text as tx
from cartolith.operators import search as op

from .registry import query, table


def micros(column: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(column))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'widget')")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.search(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "WIDGET", "p_name")


@query("SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE contains(lower(p_name), 'small') ORDER BY p_name, p_partkey LIMIT 50")
def symbol_search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.search_with_total(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "Small", 50, ["p_name", "p_partkey"], "p_name")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_brand = 'Brand#13'")
def symbols_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_brand = 'Brand#13'").select("p_partkey", "p_name", "p_size").orderBy("p_size", "p_partkey")


@query("""
    SELECT n_nationkey, n_name, coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey), '') AS members, count(s_suppkey) AS n_members
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.members(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "supplier"), ["n_nationkey"], ["s_nationkey"], "s_suppkey", "s_suppkey")


@query("SELECT event_id, user_id FROM events WHERE (CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END IS NULL) OR user_id = 7")
def scoped_null_or_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    return table(spark, sf_dir, "events").filter(op.in_scope(scope, 7)).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE user_id = 7")
def scoped_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("user_id = 7").select("event_id", "user_id")


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.after(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 500, 100, ["event_id"])


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return op.page(rows, [F.desc("ts"), F.desc("event_id")], 25, 50).drop("ts")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), [F.desc("ts"), F.desc("event_id")], 20).drop("ts")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.latest_per(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def event_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "event_type")


@query("SELECT n_nationkey, n_name FROM nation")
def prefix_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No nation has the prefix, so all stay."""
    return op.prefix_or_all(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", ["pkg.core"])


@query("SELECT p_partkey, replace(p_type, ' ', '.') AS module FROM part WHERE replace(p_type, ' ', '.') = 'ECONOMY' OR starts_with(replace(p_type, ' ', '.'), 'ECONOMY.')")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit(".")).alias("module"))
    return op.prefix_or_all(rows, "module", ["ECONOMY"])


@query("""
    SELECT l_orderkey, l_linenumber, CASE
        WHEN code = '??' THEN 'untracked' WHEN code = '!!' THEN 'ignored' WHEN contains(code, 'U') THEN 'conflict' WHEN contains(code, 'D') THEN 'deleted'
        WHEN contains(code, 'R') THEN 'renamed' WHEN contains(code, 'C') THEN 'copied' WHEN contains(code, 'A') THEN 'added' WHEN contains(code, 'M') THEN 'modified' ELSE 'modified' END AS label
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN '??' ELSE l_returnflag || l_linestatus END AS code FROM lineitem)""")
def status_label_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("l_quantity") > 45, "??").otherwise(F.concat("l_returnflag", "l_linestatus"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.status_label(code).alias("label"))


@query("SELECT o_orderkey, CASE WHEN lower(o_orderstatus) IN ('f', 'o') THEN lower(o_orderstatus) ELSE 'unknown' END AS severity FROM orders")
def severity_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.coerce_to(F.col("o_orderstatus"), ("f", "o"), "unknown").alias("severity"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)/[^/]*/1[^/]')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(F.col("url").rlike(tx.glob_to_regex("/*/1?"))).select("page_id", "url")


@query("""
    SELECT page_id, path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix,
        len(list_filter(string_split(path, '/'), lambda x: x IN ('es', 'node_modules', '__pycache__', 'build', 'dist', 'venv', 'env', 'out', 'target', 'test', 'tests', '_deps', 'vendor')
            OR starts_with(x, '.') OR starts_with(x, 'cmake-build-') OR starts_with(x, 'CMakeFiles'))) > 0 AS excluded
    FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)""")
def suffix_and_excluded_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", "path", tx.suffix(F.col("path")).alias("suffix"), tx.excluded(F.col("path"), ("es",)).alias("excluded"))


@query("""
    SELECT doc_id, CASE WHEN ext IN ('py', 'pyw', 'pyi') THEN 'python' WHEN ext IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN ext IN ('ts', 'tsx') THEN 'typescript'
        WHEN ext IN ('cpp', 'cc', 'cxx', 'hpp', 'hh', 'hxx') THEN 'cpp' WHEN ext IN ('c', 'h') THEN 'c' ELSE 'unknown' END AS language
    FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'tsx' WHEN 2 THEN 'hpp' WHEN 3 THEN 'h' WHEN 4 THEN 'mjs' ELSE lang END AS ext FROM documents)""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("doc_id") % 6
    ext = F.when(r == 0, ".PY").when(r == 1, "tsx").when(r == 2, ".hpp").when(r == 3, "h").when(r == 4, "mjs").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.language_of(ext).alias("language"))


@query("""
    SELECT doc_id, len(lines) AS total, len(list_filter(lines, lambda x: trim(x) = '')) AS blank, len(list_filter(lines, lambda x: starts_with(trim(x), '#'))) AS comment
    FROM (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS lines FROM documents)""")
def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(lines).alias("lines"))
    return rows.select("doc_id", F.size("lines").alias("total"), F.size(F.filter("lines", lambda x: F.trim(x) == "")).alias("blank"), F.size(F.filter("lines", lambda x: F.trim(x).startswith("#"))).alias("comment"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN text[1:57] || '...' ELSE text END AS excerpt FROM documents")
def truncate_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate(F.col("text"), 60).alias("excerpt"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN props->>'$.missing' IS NULL THEN 'none' ELSE props->>'$.missing' END AS missing FROM events")
def json_payload_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.from_json("props", "k long, missing string")
    return table(spark, sf_dir, "events").select("event_id", payload["k"].alias("k"), F.coalesce(payload["missing"], F.lit("none")).alias("missing"))


@query("""
    SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b(error|failed|exception)\\b') THEN 'error' WHEN regexp_matches(text, '\\?') THEN 'prompt'
        WHEN regexp_matches(text, '(?i)^(the|in|on|to)\\b') THEN 'reasoning' ELSE 'output' END AS family
    FROM conversations""")
def transcript_line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, edge = F.col("text"), "[0-9A-Za-z_]"  # a word ends before any other character, an accented letter too, where Java and RE2 differ
    family = F.when(t.rlike(rf"(?i)(?<!{edge})(error|failed|exception)(?!{edge})"), "error").when(t.rlike(r"\?"), "prompt").when(t.rlike(rf"(?i)^(the|in|on|to)(?!{edge})"), "reasoning").otherwise("output")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", family.alias("family"))


@query("SELECT conv_id, turn, length(text) AS n FROM conversations")
def ansi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coloured = F.concat(F.lit("\x1b[31;1m"), "text", F.lit("\x1b[0m"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(tx.strip_ansi(coloured)).alias("n"))


@query("""
    SELECT event_id, CASE WHEN ms < 1000 THEN ms::VARCHAR || 'ms' WHEN ms < 60000 THEN printf('%.1f', ms / 1000.0) || 's'
        WHEN ms < 3600000 THEN (ms // 60000)::VARCHAR || 'm ' || (ms // 1000 % 60)::VARCHAR || 's' ELSE (ms // 3600000)::VARCHAR || 'h ' || (ms // 60000 % 60)::VARCHAR || 'm' END AS shown
    FROM (SELECT event_id, event_id * 7919 AS ms FROM events)""")
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.format_duration(F.col("event_id") * 7919).alias("shown"))


@query("""
    SELECT o_orderkey, CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0) || ' MB'
        WHEN n < 1099511627776 THEN printf('%.1f', n / 1073741824.0) || ' GB' ELSE printf('%.1f', n / 1099511627776.0) || ' TB' END AS shown
    FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 1000 AS n FROM orders)""")
def byte_size_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.format_bytes(F.col("o_orderkey") * F.col("o_orderkey") * 1000).alias("shown"))


@query("""
    SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS name, replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '.') AS module
    FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '\\?.*$', '') || '/index.py' AS path FROM pages)""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"\?.*$", ""), F.lit("/index.py"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", tx.parent_path(F.col("path")).alias("parent"), F.substring_index("path", "/", -1).alias("name"), tx.module_name(F.col("path")).alias("module"))


@query("""
    SELECT s_suppkey, rel || ':' || s_suppkey || ':' || s_nationkey || ':function:' || s_name AS id, rel AS path, s_suppkey::INTEGER AS line, s_nationkey AS col, s_name AS name
    FROM (SELECT *, 'pkg/' || s_nationkey || '.py' AS rel FROM supplier)""")
def symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.concat(F.lit("pkg/"), F.col("s_nationkey").cast("string"), F.lit(".py"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", tx.symbol_id(rel, F.col("s_suppkey"), F.col("s_nationkey"), F.lit("function"), F.col("s_name")).alias("id"))
    parsed = rows.withColumn("p", tx.parsed_symbol_id(F.col("id")))
    return parsed.select("s_suppkey", "id", "p.path", "p.line", "p.col", "p.name")


@query("(SELECT l_partkey AS k, 'only parts' AS side FROM lineitem EXCEPT SELECT o_custkey, 'only parts' FROM orders) UNION ALL (SELECT o_custkey, 'only customers' FROM orders EXCEPT SELECT l_partkey, 'only customers' FROM lineitem)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of either set that the other lacks."""
    a, b = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return a.subtract(b).withColumn("side", F.lit("only parts")).unionByName(b.subtract(a).withColumn("side", F.lit("only customers")))


@query("SELECT DISTINCT l_partkey AS k FROM lineitem INTERSECT SELECT DISTINCT o_custkey FROM orders")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).intersect(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT s_nationkey AS k, 's' AS side FROM supplier UNION ALL SELECT c_nationkey, 'c' FROM customer")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side"))
    return a.unionByName(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")))


@query("SELECT l_suppkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1")
def distinct_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("first_order"))


@query("""
    SELECT 'order' AS kind, o_orderkey AS id, epoch_us(o_orderdate) AS at_us FROM orders UNION ALL SELECT 'event', event_id, epoch_us(ts) FROM events
    ORDER BY at_us DESC, kind, id LIMIT 100""")
def activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartolith.operators.events import activity_feed as feed

    a = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), micros("o_orderdate").alias("at_us"))
    b = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), micros().alias("at_us"))
    return feed([a, b], [F.desc("at_us"), "kind", "id"], 100)
