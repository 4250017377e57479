"""Reports, listings and records: clone counts, working trees, drift texts, entry points, tools and insights."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import text as tx

#: Characters of a diff that an audit event keeps.
LONGEST_DIFF = 5000


def clone_counts(regions: DataFrame, by: str) -> DataFrame:
    """Regions of each value of a column, all of them counted."""
    return regions.groupBy(by).agg(F.count("*").alias("clones"))


def clones_by_language(regions: DataFrame, languages: DataFrame) -> DataFrame:
    """Clones by language: a clone counts once for each file that it involves. languages: (file, language)."""
    files = regions.select(F.explode(F.array_distinct(F.array("file_a", "file_b"))).alias("file"))
    return files.groupBy("file").agg(F.count("*").alias("n")).join(languages, "file").groupBy("language").agg(F.sum("n").alias("clones"))


def working_tree(tree: DataFrame, changes: DataFrame, path: str) -> DataFrame:
    """Files of the tree with their change, if any, and changed files that the tree lacks. changes: (path, staged, unstaged, rename_from)."""
    told = changes.select(path, tx.status_label(F.concat("staged", "unstaged")).alias("status"), tx.change_summary(F.col("staged"), F.col("unstaged"), F.col("rename_from")).alias("summary"))
    inside = tree.select(path).distinct().withColumn("indexed", F.lit(True))
    return inside.join(told, path, "full").withColumn("indexed", F.coalesce("indexed", F.lit(False)))


def listing(paths: DataFrame, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(directory, name, is_dir): direct children of each directory, hidden ones left out, files of the given suffixes."""
    parts = F.split(path, "/")
    rows = paths.select(F.col(path).alias("p"), F.posexplode(parts).alias("at", "name"), F.size(parts).alias("n"))
    rows = rows.withColumns({"directory": F.array_join(F.slice(F.split("p", "/"), F.lit(1), F.col("at")), "/"), "is_dir": F.col("at") < F.col("n") - 1})
    kept = F.col("is_dir") | F.lit(not suffixes)
    for s in suffixes:
        kept = kept | F.lower("name").endswith(s)
    return rows.filter(~F.col("name").startswith(".") & (F.col("name") != "") & kept).select("directory", "name", "is_dir").distinct()


#: Blocking items that a drift report shows in full.
MOST_BLOCKING = 200


def drift_text(items: DataFrame, duration_ms: float = 0.0, most: int = MOST_BLOCKING) -> DataFrame:
    """One row: a report of drift items (type, severity, category, title, file_path, line, suggestion) as text, after its date.

    Of the blocking ones the first `most` in order stand in full, and the rest are counted.
    """
    by = lambda c, icon: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("value", "n")))), lambda x: F.concat(icon(x["value"]), x["value"], F.lit(": "), x["n"].cast("string")))
    flat = items.select(F.explode(F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("value")), F.struct(F.lit("type").alias("kind"), F.col("type").alias("value")))).alias("e"))
    flat = flat.groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))
    icon = lambda v: F.concat(F.lit("  "), F.when(v == "critical", "\U0001f534").when(v == "warning", "\U0001f7e1").when(v == "info", "\U0001f535").otherwise("⚪"), F.lit(" "))
    counted = {"severities": flat.agg(by("severity", icon)).scalar(), "types": flat.agg(by("type", lambda v: F.lit("  - "))).scalar()}
    line = F.concat(F.lit("  ["), "category", F.lit("] "), "title", F.lit("\n    File: "), "file_path", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.coalesce(F.concat(F.lit("\n    Fix: "), "suggestion"), F.lit("")))
    total = items.agg(F.count("*").alias("total"), F.countDistinct("file_path").alias("files"), F.count_if(F.col("severity") == "critical").alias("n_blocking"))
    shown = items.filter("severity = 'critical'").select(line.alias("line")).orderBy("line").limit(most).agg(F.array_sort(F.collect_list("line")).alias("blocking")).scalar()
    rest = F.format_string("  ... and %d more", F.col("n_blocking") - most)
    total = total.withColumn("blocking", F.concat(shown, F.when(F.col("n_blocking") > most, F.array(rest)).otherwise(F.array().cast("array<string>"))))
    section = lambda head, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"\n{head}\n"), F.array_join(rows, "\n"), F.lit("\n"))).otherwise("")
    both = total.withColumns(counted)
    head = F.format_string(f"Drift Analysis Report\n=====================\nDuration: {duration_ms:.1f}ms\nFiles analyzed: %d\n\nSummary:\n  Total items: %d\n  Blocking: %s\n", "files", "total", F.when(F.size("blocking") > 0, "YES").otherwise("No"))
    return both.select(F.concat(head, section("By Severity:", F.col("severities")), section("By Type:", F.col("types")), section("BLOCKING ISSUES:", F.col("blocking"))).alias("report"))


def entry_points(symbols: DataFrame, calls: DataFrame, least: int = 0) -> DataFrame:
    """Functions, methods and classes of a program with the calls that they make, at least `least`.

    Private names (one leading underscore) are left out; a class counts the calls of its __init__.
    """
    made = calls.groupBy("path", F.col("caller").alias("qualified")).agg(F.count("*").alias("n"))
    qualified = F.when(F.col("kind") == "class", F.concat_ws(".", "name", F.lit("__init__"))).otherwise(F.concat_ws(".", "parent", "name"))
    named = symbols.filter(F.col("kind").isin("function", "method", "class") & ~(F.col("name").startswith("_") & ~F.col("name").startswith("__")))
    out = named.withColumn("qualified", qualified).join(made, ["path", "qualified"], "left")
    return out.select("path", "name", "kind", "parent", "lineno", F.coalesce("n", F.lit(0)).alias("node_count")).filter(F.col("node_count") >= least)


def by_class(entries: DataFrame) -> DataFrame:
    """Methods in order under their class, functions under none, with the largest node_count."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lineno", "name"))), lambda x: x["name"]), ",")
    return entries.filter("kind <> 'class'").groupBy("path", F.coalesce("parent", F.lit("")).alias("owner")).agg(names.alias("names"), F.max("node_count").alias("max_node_count"))


def select_tools(tools: DataFrame, wanted: list[str] | None) -> DataFrame:
    """Tools whose key is wanted, in any case; all without a wish."""
    return tools if wanted is None else tools.filter(F.lower("key").isin([w.lower() for w in wanted]))


def guarded(tools: DataFrame, files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Tools with status 'run', or 'skipped' and why if the project is larger than a limit. files: (path, size)."""
    sized = tools.withColumns({"files": files.agg(F.count("*")).scalar(), "bytes": files.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()})
    why = F.when(F.col("files") > max_files, F.format_string("%d files, limit %d", "files", F.lit(max_files))).when(F.col("bytes") > max_bytes, F.format_string("%d bytes, limit %d", "bytes", F.lit(max_bytes)))
    return sized.select(*tools.columns, F.when(why.isNull(), "run").otherwise("skipped").alias("status"), why.alias("reason"))


def capabilities(paths: DataFrame, path: str, available: tuple[str, ...], overrides: tuple[str, ...] = ()) -> DataFrame:
    """(key, extensions, available, degraded): the extensions in use of each analyzer, and those that lack theirs.

    The table is aggregated to its extensions first. Overridden ones are left out, but for .py, which always has its analyzer.
    """
    own = ["." + o.lower().removeprefix(".") for o in overrides]
    used = paths.select(tx.suffix(F.col(path)).alias("suffix")).distinct().filter((F.col("suffix") == ".py") | ~F.col("suffix").isin(own))
    keyed = used.select("suffix", F.when(F.col("suffix") == ".py", "python").when(F.col("suffix").isin(".tsx"), "tsx").when(F.col("suffix") == ".html", "html").otherwise(tx.language_of(F.col("suffix"))).alias("key"))
    grouped = keyed.filter("key <> 'unknown'").groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("suffix")), ",").alias("extensions"))
    present = F.col("key").isin("python", *available)
    return grouped.select("key", "extensions", present.alias("available"), F.when(present, "").otherwise(F.col("extensions")).alias("degraded"))


def insight_context(summary: DataFrame, recent: DataFrame, order: list, line: Column, most: int = 10) -> DataFrame:
    """One row: the lines of a summary (one column, line) and the first `most` recent items, joined by newlines."""
    rank = F.row_number().over(Window.orderBy(*order))
    items = recent.orderBy(*order).limit(most).select(F.struct(rank.alias("at"), line.alias("line")).alias("x")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("items"))
    head = summary.agg(F.array_sort(F.collect_list("line")).alias("head")).withColumn("items", items.scalar())
    return head.select(F.array_join(F.concat("head", "items"), "\n").alias("context"))


def notified(items: DataFrame, path: str, kind: str, extensions: list[str]) -> DataFrame:
    """items with `status` and `reason`: an error for a path that leaves the root, skipped for an extension or a kind of change
    that is not followed, else processed; the first reason counts."""
    outside = ~tx.within_root(F.col(path))
    followed = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(extensions)
    known = F.col(kind).isin("created", "modified", "deleted")
    reason = F.when(outside, "path_outside_root").when(~followed, "extension_not_followed").when(~known, "unknown_change")
    status = F.when(outside, "error").when(reason.isNotNull(), "skipped").otherwise("processed")
    return items.withColumns({"status": status, "reason": reason})


def project_record(functions: DataFrame, file: str, name: str, complexity: str, lines: str) -> DataFrame:
    """One JSON record for each file: totals, and its functions by name with lines and complexity."""
    item = F.struct(F.col(name).alias("name"), F.col(lines).cast("long").alias("lines"), F.col(complexity).cast("long").alias("complexity"))
    record = F.struct(F.col(file).alias("path"), F.count("*").alias("total_functions"), F.sum(F.col(lines).cast("long")).alias("total_lines"), F.max(F.col(complexity).cast("long")).alias("max_complexity"), F.array_sort(F.collect_list(item)).alias("functions"))
    return functions.groupBy(file).agg(F.to_json(record).alias("record"))


def unified_diffs(rows: DataFrame, key: str, path: str, before: str, after: str, most: int = LONGEST_DIFF) -> DataFrame:
    """(key, diff): unified diff text of two versions, cut after `most` characters; headers have no line ends of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, a, b in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                diff = "".join(difflib.unified_diff((a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True), fromfile=f"a/{p}", tofile=f"b/{p}", lineterm=""))
                out.append(diff if len(diff) <= most else diff[:most] + "\n\n... (diff truncated)")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "diff"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, path, before, after).mapInArrow(run, f"{key} {kind}, diff string")
