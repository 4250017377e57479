"""Metric, report, gate and drift queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import text as tx
from cartolith.operators import drift
from cartolith.operators import metrics as op

from .registry import query, table

_BAND = "CASE WHEN p_size <= 5 THEN 'low' WHEN p_size <= 10 THEN 'medium' WHEN p_size <= 25 THEN 'high' ELSE 'extreme' END"


@query(f"SELECT {_BAND} AS band, count(*) AS n FROM part GROUP BY 1")
def complexity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.complexity_histogram(table(spark, sf_dir, "part"), "p_size")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 5 ORDER BY p_size DESC, p_partkey LIMIT 5")
def complexity_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.problem_functions(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_size", "p_partkey", 5)


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 5 AND (contains(lower(p_name), 'cold') OR contains(lower(p_brand), 'cold'))")
def complexity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.contains(F.lower("p_name"), F.lit("cold")) | F.contains(F.lower("p_brand"), F.lit("cold"))
    return op.problem_functions(table(spark, sf_dir, "part").filter(hit), "p_size", "p_partkey").select("p_partkey", "p_name", "p_size")


@query("""
    SELECT count(DISTINCT p_name) AS files, count(DISTINCT p_brand) AS directories, sum(floor(p_retailprice)::BIGINT)::BIGINT AS loc, sum(p_size)::BIGINT AS complexity_total, max(p_size)::BIGINT AS complexity_max,
        coalesce(floor(sum(p_size) / nullif(sum((p_type IN ('ECONOMY', 'SMALL'))::INT), 0)), 0)::BIGINT AS complexity_avg FROM part""")
def project_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("lines", F.floor("p_retailprice"))
    return op.project_metrics(part, "p_name", F.col("p_brand"), "p_type", "p_size", "lines", ["ECONOMY", "SMALL"])


@query("""
    WITH m AS (SELECT p_brand, count(*) AS files, sum(p_size)::BIGINT AS loc, count(DISTINCT p_type) AS patterns, count(DISTINCT p_name) AS layers FROM part GROUP BY 1),
    s AS (SELECT *, (files <= 3)::INT + (loc < 500)::INT + (patterns <= 0)::INT + (layers <= 0)::INT AS s1, (files <= 20)::INT + (loc < 3000)::INT + (patterns <= 3)::INT + (layers <= 3)::INT AS s2 FROM m)
    SELECT p_brand, CASE WHEN s1 >= 3 THEN 1 WHEN s2 >= 3 THEN 2 ELSE 3 END AS stage,
        CASE WHEN s1 >= 3 THEN CASE s1 WHEN 4 THEN 'high' ELSE 'medium' END WHEN s2 >= 3 THEN CASE s2 WHEN 4 THEN 'high' ELSE 'medium' END ELSE 'high' END AS confidence FROM s""")
def stage_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(table(spark, sf_dir, "part"))


def _stages(files: DataFrame) -> DataFrame:
    m = files.groupBy("p_brand").agg(F.count("*").alias("files"), F.sum("p_size").alias("loc"), F.countDistinct("p_type").alias("patterns"), F.countDistinct("p_name").alias("layers"))
    four = [F.col(c) for c in ("files", "loc", "patterns", "layers")]
    return m.withColumn("stage", op.stage_of(*four)).select("p_brand", "stage", op.stage_confidence(*four, F.col("stage")).alias("confidence"))


@query("""
    SELECT pattern, count(DISTINCT url) AS paths FROM (
        SELECT url, unnest([CASE WHEN regexp_matches(lower(url), '/en(/|$)|en[^/]*') THEN 'english' END, CASE WHEN contains(lower(url), 'utm') OR contains(lower(url), 'feed') THEN 'tracking' END]) AS pattern FROM pages)
    WHERE pattern IS NOT NULL GROUP BY 1""")
def pattern_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keyword_patterns(table(spark, sf_dir, "pages"), "url", {"english": ["en"], "tracking": ["utm", "feed"]})


_ISSUE = """SELECT l_suppkey AS tool, CASE l_returnflag WHEN 'N' THEN 'pass' WHEN 'A' THEN 'warn' ELSE CASE WHEN l_quantity > 49 THEN 'fail' ELSE 'pass' END END AS status,
    CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 15 THEN 'medium' ELSE 'low' END AS severity, * FROM lineitem"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    status = F.when(F.col("l_returnflag") == "N", "pass").when(F.col("l_returnflag") == "A", "warn").when(q > 49, "fail").otherwise("pass")
    severity = F.when(q > 45, "critical").when(q > 30, "high").when(q > 15, "medium").otherwise("low")
    return table(spark, sf_dir, "lineitem").withColumns({"tool": F.col("l_suppkey"), "status": status, "severity": severity})


@query(f"""
    SELECT tool, count(*) AS issues, count(*) FILTER (severity = 'critical') AS critical_issues, count(*) FILTER (severity = 'high') AS high_issues, count(*) FILTER (severity = 'medium') AS medium_issues,
        count(*) FILTER (severity = 'low') AS low_issues, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS status FROM ({_ISSUE}) GROUP BY 1""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.report_summary(issues(spark, sf_dir), "tool", F.col("status"), F.col("severity"))


@query(f"SELECT l_orderkey % 50 AS run, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS status FROM ({_ISSUE}) GROUP BY 1")
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).groupBy((F.col("l_orderkey") % 50).alias("run")).agg(op.overall_status(F.col("status")).alias("status"))


@query("""
    SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem)
    WHERE r = 1 ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 5""")
def top_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.top_offenders(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber"])


@query("""
    SELECT doc_id, lines, CASE WHEN lines >= 1000 THEN 'critical' ELSE 'high' END AS severity
    FROM (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0B\\x0C]+')) AS lines FROM documents) WHERE lines > 500""")
def max_length_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words stand in for the lines of a source file."""
    words = F.regexp_count("text", F.lit(r"[^ \t\n\r\x0B\x0C]+"))
    return op.long_files(table(spark, sf_dir, "documents"), words, "doc_id")


@query("SELECT count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents")
def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.sum(F.size(F.split("text", "\n")).cast("long")).alias("lines"))


@query("""
    SELECT lang, count(*) AS items, sum(quality)::BIGINT AS passed, bool_and(quality = 1 OR toxic = 0) AS gate
    FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def gate_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return op.gate(rows, "lang", F.col("quality") == 1, F.col("toxic") != 0, F.col("doc_id").cast("string")).drop("blocking_crc")


@query("""
    SELECT level, count(*) AS n FROM (SELECT CASE WHEN p_size > 40 THEN 1 WHEN contains(p_name, 'small') THEN 2 WHEN p_retailprice > 905 THEN 4 ELSE 5 END AS level FROM part) GROUP BY 1""")
def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.first_level(
        (1, F.when(F.col("p_size") > 40, F.col("p_name"))), (2, F.when(F.contains("p_name", F.lit("small")), F.col("p_name"))), (4, F.when(F.col("p_retailprice") > 905, F.col("p_name")))
    )
    return table(spark, sf_dir, "part").groupBy(found["level"].alias("level")).agg(F.count("*").alias("n"))


@query("""
    WITH f AS (SELECT user_id, event_type, CASE event_type WHEN 'click' THEN 0.4 WHEN 'view' THEN 0.3 ELSE 0.2 END AS confidence, CASE WHEN event_id % 2 = 0 THEN 'dependency' ELSE 'lifecycle' END AS type FROM events)
    SELECT user_id, max(confidence) AS confidence, coalesce(array_to_string(list_sort(list_distinct(list(event_type) FILTER (type = 'dependency')))[1:5], ','), '') AS dependencies,
        coalesce(array_to_string(list_sort(list_distinct(list(event_type) FILTER (type = 'lifecycle'))), '; '), '') AS lifecycle, count(*) AS n_findings FROM f GROUP BY 1""")
def finding_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select("user_id", kind.alias("value"), F.when(kind == "click", 0.4).when(kind == "view", 0.3).otherwise(0.2).alias("confidence"), F.when(F.col("event_id") % 2 == 0, "dependency").otherwise("lifecycle").alias("type"))
    return drift.merge_findings(rows, "user_id")


@query("""
    SELECT doc_id, term FROM (SELECT d.doc_id, d.text, unnest(string_split(lower(b.text), ' ')) AS term FROM documents d JOIN benchmark b ON b.item_id = d.doc_id) WHERE NOT contains(text, term)""")
def contract_text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.split(F.lower("text"), " ").alias("terms"))
    return drift.text_checks(table(spark, sf_dir, "documents").select("doc_id", "text").join(b, "doc_id"), "terms", "text", "doc_id")


@query("SELECT NOT bool_or(o_orderpriority = '9-NONE') AS can_proceed, count(*)::VARCHAR || ' items: 0 critical, ' || count(*) FILTER (o_orderstatus = 'F') || ' warning, ' || count(*) FILTER (o_orderstatus <> 'F') || ' info' AS summary FROM orders")
def drift_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.can_proceed(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "warning").otherwise("info").alias("severity")))


@query("""
    SELECT tool, severity, n, n / max(n) OVER (PARTITION BY tool) AS share FROM (SELECT tool, severity, count(*) AS n FROM (""" + _ISSUE + """) GROUP BY 1, 2)""")
def severity_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = issues(spark, sf_dir).groupBy("tool", "severity").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy("tool")))


@query("""
    SELECT l_suppkey, count(*) AS total, string_agg(l_orderkey::VARCHAR || ':' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber) FILTER (r <= 25) AS sample
    FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) GROUP BY 1""")
def issue_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are of all issues, samples of the first 25 of a tool."""
    from cartolith.operators.search import cap

    rows = table(spark, sf_dir, "lineitem")
    total = rows.groupBy("l_suppkey").agg(F.count("*").alias("total"))
    first = cap(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber"], 25)
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("t")))), lambda x: x["t"]), ",")
    return total.join(first.groupBy("l_suppkey").agg(shown.alias("sample")), "l_suppkey")


@query("SELECT c_custkey, lower(trim(c_mktsegment)) IN ('1', 'true', 'yes', 'on', 'furniture') AS flag, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal)::BIGINT END AS cap FROM customer")
def env_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_mktsegment") == "FURNITURE", " Yes ").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.parse_flag(raw).alias("flag"), tx.parse_limit(F.floor("c_acctbal").cast("string")).alias("cap"))


@query("""
    WITH m AS (SELECT p_name, p_size % 3 + 1 AS stage, count(*) AS files, sum(p_size)::BIGINT AS loc, count(DISTINCT p_type) FILTER (p_type = 'SMALL') AS patterns FROM part GROUP BY 1, 2)
    SELECT p_name, stage, CASE WHEN stage = 2 THEN CASE WHEN files <= 8 AND loc < 1000 THEN 'early' WHEN files <= 15 AND loc < 2000 THEN 'mid' ELSE 'late' END END AS hint,
        CASE WHEN (files <= 5 AND loc > 1500) OR (files > 30 AND patterns = 0) THEN 'medium' ELSE 'high' END AS confidence FROM m""")
def stage_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where projects stand within the second stage, and how sure that is."""
    groups = table(spark, sf_dir, "part").withColumn("stage", F.col("p_size") % 3 + 1).groupBy("p_name", "stage")
    m = groups.agg(F.count("*").alias("files"), F.sum("p_size").alias("loc"), F.countDistinct(F.when(F.col("p_type") == "SMALL", F.col("p_type"))).alias("patterns"))
    return m.select("p_name", "stage", op.substage(F.col("files"), F.col("loc"), F.col("stage")).alias("hint"), op.warned_confidence(F.col("files"), F.col("loc"), F.col("patterns")).alias("confidence"))


@query("""
    SELECT marker, count(*) AS folders FROM (SELECT CASE s_suppkey % 6 WHEN 0 THEN 'models' WHEN 1 THEN 'api' WHEN 2 THEN 'handlers' WHEN 4 THEN 'api' WHEN 5 THEN 'services' END AS marker FROM supplier) WHERE marker IS NOT NULL GROUP BY 1""")
def architecture_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Architectural folders: a folder counts for the first marker in its own name, not for those of its parents."""
    names = F.array(*(F.lit(n) for n in ("UserModels", "core_api", "handlers", "misc", "DomainApi", "domain_services_core")))
    folder = F.concat(F.lit("views/n"), F.col("s_nationkey"), F.lit("/"), F.element_at(names, (F.col("s_suppkey") % 6 + 1).cast("int")), F.lit("_"), F.col("s_suppkey"))
    return op.architecture_folders(table(spark, sf_dir, "supplier").select(folder.alias("path")), "path")
