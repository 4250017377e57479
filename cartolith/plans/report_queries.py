"""Queries of reports, listings, working trees, tools and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import text as tx
from cartolith.functions.hashing import placeholder_hash
from cartolith.operators import clones, review
from cartolith.operators import search as op
from cartolith.sources import files, python_code

from .clone_queries import clone_classify as classified
from .clone_queries import region_table
from .parser_queries import projects
from .registry import ORACLE_SQL, query, table

_CLASSIFIED, _SPOTS = ORACLE_SQL["clone_classify"], ORACLE_SQL["clone_hotspots"]


@query(f"SELECT clone_type, count(*) AS clones FROM ({_CLASSIFIED}) GROUP BY 1")
def clone_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.clone_counts(classified(spark, sf_dir), "clone_type")


@query(f"SELECT * FROM ({_CLASSIFIED}) WHERE clone_type = 'exact' ORDER BY token_count DESC, file_a, file_b, start_a, start_b LIMIT 20")
def clones_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first clones of one type."""
    return classified(spark, sf_dir).filter("clone_type = 'exact'").orderBy(F.desc("token_count"), "file_a", "file_b", "start_a", "start_b").limit(20)


@query(f"""
    SELECT lang AS language, count(*) AS clones FROM (SELECT unnest(list_distinct([file_a, file_b])) AS doc_id FROM ({ORACLE_SQL["clone_islands"]})) JOIN documents USING (doc_id) GROUP BY 1""")
def clone_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    languages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("lang").alias("language"))
    return review.clones_by_language(region_table(spark, sf_dir), languages)


@query(f"SELECT * FROM ({_SPOTS}) ORDER BY score DESC, file LIMIT 20")
def clone_hotspots_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.regexp_count(F.lower("text"), F.lit("[a-z]+")).cast("long").alias("total"))
    return clones.hotspots(region_table(spark, sf_dir), sizes).orderBy(F.desc("score"), "file").limit(20)


@query("SELECT page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages)")
def file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of one path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.join(pages.agg(F.min("url").alias("url")), "url").select("page_id", "url")


@query("SELECT event_id, event_type, event_id % 2 = 0 AS read FROM events WHERE event_id % 2 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 50")
def unread_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 2 == 0).alias("read"), "ts")
    return op.page(rows.filter(~F.col("read")), [F.desc("ts"), F.desc("event_id")], 50).drop("ts")


_CODES = """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 49 THEN '?' WHEN l_quantity > 48 THEN '!' WHEN l_tax > 0.06 THEN ' ' WHEN l_tax > 0.04 THEN 'R' WHEN l_tax > 0.03 THEN 'D' WHEN l_tax > 0.02 THEN 'U' ELSE 'A' END AS staged,
    CASE WHEN l_quantity > 49 THEN '?' WHEN l_quantity > 48 THEN '!' WHEN l_linenumber % 2 = 0 THEN 'M' ELSE ' ' END AS unstaged, CASE WHEN l_suppkey % 2 = 0 THEN 'f' || l_partkey END AS rename_from, 'f' || l_suppkey || '/' || l_partkey AS path FROM lineitem"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, tax = F.col("l_quantity"), F.col("l_tax")
    head = lambda: F.when(q > 49, "?").when(q > 48, "!")
    staged = head().when(tax > 0.06, " ").when(tax > 0.04, "R").when(tax > 0.03, "D").when(tax > 0.02, "U").otherwise("A")
    part = F.concat(F.lit("f"), F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", staged.alias("staged"), head().when(F.col("l_linenumber") % 2 == 0, "M").otherwise(" ").alias("unstaged"),
        F.when(F.col("l_suppkey") % 2 == 0, part).alias("rename_from"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string"), F.lit("/"), F.col("l_partkey").cast("string")).alias("path"),
    )


_LABEL = """CASE WHEN staged || unstaged = '??' THEN 'untracked' WHEN staged || unstaged = '!!' THEN 'ignored' WHEN contains(staged || unstaged, 'U') THEN 'conflict' WHEN contains(staged || unstaged, 'D') THEN 'deleted'
    WHEN contains(staged || unstaged, 'R') THEN 'renamed' WHEN contains(staged || unstaged, 'A') THEN 'added' ELSE 'modified' END"""
_TOLD = f"""SELECT *, CASE label WHEN 'ignored' THEN 'Ignored file' WHEN 'untracked' THEN 'New file (not committed yet)' WHEN 'conflict' THEN 'Merge conflict in progress'
        WHEN 'deleted' THEN CASE WHEN scope = '' THEN 'Deleted locally' ELSE 'Deleted ' || scope END
        ELSE CASE WHEN label = 'renamed' AND rename_from IS NOT NULL THEN 'Renamed from ' || rename_from ELSE upper(label[1:1]) || label[2:] || CASE WHEN scope = '' THEN '' ELSE ' (' || scope || ')' END END END AS summary
    FROM (SELECT *, {_LABEL} AS label, CASE WHEN trim(staged) IN ('', '?', '!') THEN CASE WHEN trim(unstaged) IN ('', '?', '!') THEN '' ELSE 'working tree changes' END
        WHEN trim(unstaged) IN ('', '?', '!') THEN 'staged changes' ELSE 'staged + working tree changes' END AS scope FROM ({_CODES}))"""


@query(f"SELECT l_orderkey, l_linenumber, label, summary FROM ({_TOLD})")
def change_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _codes(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", tx.status_label(F.concat("staged", "unstaged")).alias("label"), tx.change_summary(F.col("staged"), F.col("unstaged"), F.col("rename_from")).alias("summary"))


@query(f"""
    WITH t AS (SELECT DISTINCT 'f' || s_suppkey || '/' || p_partkey AS path FROM part JOIN supplier ON s_suppkey = p_partkey % 10 + 1),
    c AS (SELECT path, label AS status, summary FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY l_orderkey DESC, l_linenumber DESC) AS r FROM ({_TOLD})) WHERE r = 1)
    SELECT coalesce(t.path, c.path) AS path, t.path IS NOT NULL AS indexed, status, summary FROM t FULL JOIN c ON c.path = t.path""")
def working_tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of parts under suppliers with the last change of each path, and changed paths that the tree lacks."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey")
    tree = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 10 + 1).alias("s_suppkey")).join(supplier, "s_suppkey")
    tree = tree.select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    last = op.latest_per(_codes(spark, sf_dir), ["path"], ["l_orderkey", "l_linenumber"])
    return review.working_tree(tree, last, "path")


@query("""
    SELECT DISTINCT array_to_string(parts[1:n], '/') AS directory, parts[n + 1] AS name, n < len(parts) - 1 AS is_dir
    FROM (SELECT parts, unnest(range(0, len(parts))) AS n FROM (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages)) WHERE NOT starts_with(parts[n + 1], '.') AND parts[n + 1] <> ''""")
def directory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.listing(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")), "path")


def _fnv(text: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('{text}', ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN {_fnv('$ID')} WHEN 'N' THEN {_fnv('$STR')} ELSE 0 END AS hash FROM lineitem")
def placeholder_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "identifier").when(F.col("l_returnflag") == "N", "string").otherwise("keyword")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", placeholder_hash(kind).alias("hash"))


_PATHS = """SELECT o_orderkey, repeat('../', (o_orderkey % 4)::INT) || repeat('a/', (o_custkey % 5)::INT) || repeat('../', (o_orderkey % 3)::INT) || 'x.py' AS path FROM orders"""


@query(f"""
    SELECT o_orderkey, path, list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))) >= 0 AS inside
    FROM (SELECT *, list_transform(string_split(path, '/'), lambda x: CASE x WHEN '..' THEN -1 ELSE 1 END) AS steps FROM ({_PATHS}))""")
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = lambda text, column, n: F.repeat(F.lit(text), (F.col(column) % n).cast("int"))
    path = F.concat(many("../", "o_orderkey", 4), many("a/", "o_custkey", 5), many("../", "o_orderkey", 3), F.lit("x.py"))
    return table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path")).withColumn("inside", tx.within_root(F.col("path")))


@query("SELECT n_nationkey, '--- a/' || n_name || '+++ b/' || n_name || '@@ -1,2 +1,2 @@ same' || chr(10) || '-' || n_name || '+' || lower(n_name) AS diff FROM nation")
def unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("same\n"), "n_name").alias("before"), F.concat(F.lit("same\n"), F.lower("n_name")).alias("after"))
    return review.unified_diffs(rows, "n_nationkey", "n_name", "before", "after")


@query("SELECT c_custkey, c_custkey % 9 || '.' || c_nationkey || '.0' AS version, c_name AS shown FROM customer")
def names_and_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("tool v"), (F.col("c_custkey") % 9).cast("string"), F.lit("."), F.col("c_nationkey").cast("string"), F.lit(".0 (of 2024)"))
    called = F.concat(F.lit("pkg.mod."), "c_name", F.lit("(a.b, c)"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.version_of(text).alias("version"), tx.display_name(called).alias("shown"))


@query("""
    WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'warning' ELSE 'info' END AS severity, o_orderpriority AS type, o_custkey FROM orders)
    SELECT 'Drift Analysis Report' || chr(10) || '=====================' || chr(10) || 'Duration: 12.5ms' || chr(10) || 'Files analyzed: ' || (SELECT count(DISTINCT o_custkey) FROM s) || chr(10) || chr(10) || 'Summary:' || chr(10)
        || '  Total items: ' || (SELECT count(*) FROM s) || chr(10) || '  Blocking: No' || chr(10)
        || chr(10) || 'By Severity:' || chr(10) || (SELECT string_agg('  ' || CASE severity WHEN 'warning' THEN '\U0001f7e1' ELSE '\U0001f535' END || ' ' || severity || ': ' || n, chr(10) ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM s GROUP BY 1)) || chr(10)
        || chr(10) || 'By Type:' || chr(10) || (SELECT string_agg('  - ' || type || ': ' || n, chr(10) ORDER BY type) FROM (SELECT type, count(*) AS n FROM s GROUP BY 1)) || chr(10) AS report""")
def drift_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "warning").otherwise("info").alias("severity"), F.col("o_orderpriority").alias("type"), F.col("o_custkey").cast("string").alias("file_path"),
        F.lit("wiring").alias("category"), F.col("o_orderkey").cast("string").alias("title"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("suggestion"),
    )
    return review.drift_text(items, 12.5)


@query("SELECT l_suppkey AS node, count(*) AS node_count FROM lineitem GROUP BY 1 HAVING count(*) >= 500")
def busy_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points with at least so many nodes."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("node_count")).filter("node_count >= 500")


def _program_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = projects(spark, sf_dir).filter("path like '%.py'")
    return review.entry_points(python_code.rows(code, python_code.symbols), python_code.rows(code, python_code.calls))


@query()
def entry_point_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _program_entries(spark, sf_dir)


@query()
def entry_points_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.by_class(_program_entries(spark, sf_dir))


@query("""
    SELECT s_suppkey::VARCHAR AS key, CASE WHEN n > 100000000 THEN 'skipped' ELSE 'run' END AS status, NULL::VARCHAR AS reason FROM supplier, (SELECT count(*) AS n FROM documents) WHERE s_suppkey IN (1, 3, 7)""")
def tool_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("size"))
    return review.guarded(review.select_tools(tools, ["1", "3", "7"]), files, 100_000_000, 1 << 60)


@query("""
    SELECT (SELECT string_agg(lang || ': ' || n, chr(10) ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)) || chr(10)
        || (SELECT string_agg(event_type || ' ' || event_id, chr(10) ORDER BY ts DESC, event_id DESC) FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)) AS context""")
def insight_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    head = n.select(F.concat("lang", F.lit(": "), F.col("n").cast("string")).alias("line"))
    recent = table(spark, sf_dir, "events")
    return review.insight_context(head, recent, [F.desc("ts"), F.desc("event_id")], F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")))


@query("""
    SELECT p_brand, to_json({'path': p_brand, 'total_functions': count(*), 'total_lines': sum(floor(p_retailprice)::BIGINT)::BIGINT, 'max_complexity': max(p_size)::BIGINT,
        'functions': list({'name': p_partkey::VARCHAR, 'lines': floor(p_retailprice)::BIGINT, 'complexity': p_size::BIGINT} ORDER BY p_partkey::VARCHAR)})::VARCHAR AS record FROM part GROUP BY 1""")
def project_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").cast("string").alias("name"), "p_size", F.floor("p_retailprice").alias("lines"))
    return review.project_record(rows, "p_brand", "name", "p_size", "lines")


@query("""
    SELECT DISTINCT l_partkey FROM lineitem JOIN (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50) ON o_orderkey = l_orderkey""")
def changed_files_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that any of the newest commits touches."""
    newest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(newest, "l_orderkey", "left_semi").select("l_partkey").distinct()


@query("""
    SELECT doc_id, media_type, CASE WHEN n_chars > 524288 THEN 'too_large' WHEN media_type = 'image/png' THEN 'binary' ELSE 'ok' END AS preview
    FROM (SELECT doc_id, n_chars, CASE doc_id % 5 WHEN 0 THEN 'application/toml' WHEN 1 THEN 'text/x-python' WHEN 2 THEN 'image/png' WHEN 3 THEN 'application/json' ELSE 'text/plain' END AS media_type FROM documents)""")
def file_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*(F.lit(x) for x in (".toml", ".py", ".PNG", ".json", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d/f"), F.col("doc_id"), suffix).alias("path"), F.col("n_chars").alias("size"))
    return files.previews(named).select("doc_id", "media_type", "preview")


@query("""
    SELECT key, string_agg(suffix, ',' ORDER BY suffix) AS extensions, key IN ('python', 'c') AS available, CASE WHEN key IN ('python', 'c') THEN '' ELSE string_agg(suffix, ',' ORDER BY suffix) END AS degraded
    FROM (SELECT DISTINCT CASE p_size % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.jsx' WHEN 3 THEN '.tsx' WHEN 4 THEN '.c' ELSE '.html' END AS suffix,
        CASE p_size % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'javascript' WHEN 3 THEN 'tsx' WHEN 4 THEN 'c' ELSE 'html' END AS key FROM part WHERE p_size % 7 < 6) GROUP BY key""")
def analyzer_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyzers of the extensions in use; .ts has one of its own and is left out."""
    suffix = F.element_at(F.array(*(F.lit(x) for x in (".py", ".js", ".jsx", ".tsx", ".c", ".html", ".ts"))), (F.col("p_size") % 7 + 1).cast("int"))
    paths = table(spark, sf_dir, "part").select(F.concat(F.lit("src/f"), F.col("p_partkey"), suffix).alias("path"))
    return review.capabilities(paths, "path", ("c",), (".TS",))
