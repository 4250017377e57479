"""Sources and sinks: file scans, snapshots, commit logs, tool output and append-only tables."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.functions import text as tx

#: Media types of suffixes that go before the usual table, text types beside text/*, and the largest preview in bytes.
OWN_MEDIA_TYPES = {
    ".yml": "application/yaml", ".yaml": "application/yaml", ".toml": "application/toml", ".ini": "text/plain", ".env": "text/plain", ".cfg": "text/plain",
    ".json5": "application/json5", ".jsonc": "application/json",
}
TEXT_MEDIA_TYPES = [
    "application/javascript", "application/json", "application/xml", "application/yaml", "application/x-yaml", "application/toml", "application/x-toml", "application/json5",
]
LARGEST_PREVIEW = 512 * 1024

SYMBOL_SNAPSHOT = "path string, name string, kind string, lineno int, parent string, docstring string, loc int, complexity int"


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = tx.SOURCE_SUFFIXES, extra_dirs: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """(path, size, modified, text) of the files below root with a known suffix outside excluded directories.

    Paths are relative to root. Listing is distributed; contents are read only for files that pass the filters, and not at
    all without `with_text`.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{base}/", "")
    out = raw.withColumn("path", path)
    directory = tx.parent_path(F.col("path"))
    out = out.filter(tx.suffix(F.col("path")).isin(list(suffixes)) & ~tx.excluded(directory, extra_dirs))
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return out.select(*columns, *([F.decode("content", "UTF-8").alias("text")] if with_text else []))


def matching(files: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """Files that match none of the exclude patterns, by path."""
    out = files
    for p in patterns:
        out = out.filter(~F.col(path).rlike(tx.glob_to_regex(p)))
    return out


def listing(files: DataFrame) -> DataFrame:
    """One row: files and bytes."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def docs_listing(files: DataFrame, folder: str = "docs") -> DataFrame:
    """(path, name, size, modified) of the Markdown files below a folder, by path."""
    inside = files.filter(F.col("path").startswith(f"{folder}/") & F.col("path").endswith(".md"))
    return inside.select("path", F.substring_index("path", "/", -1).alias("name"), "size", "modified").orderBy("path")


def media_type(path: Column) -> Column:
    """The media type that a name's suffix tells; text/plain if it tells none."""
    usual = mimetypes.MimeTypes(filenames=()).types_map[True] | OWN_MEDIA_TYPES
    known = F.create_map(*(F.lit(x) for pair in sorted(usual.items()) for x in pair))
    return F.coalesce(F.try_element_at(known, tx.suffix(path)), F.lit("text/plain"))


def previews(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Files with media_type and preview: ok, too_large (told first) or binary."""
    out = files.withColumn("media_type", media_type(F.col(path)))
    readable = F.col("media_type").startswith("text/") | F.col("media_type").isin(TEXT_MEDIA_TYPES)
    return out.withColumn("preview", F.when(F.col(size) > LARGEST_PREVIEW, "too_large").when(readable, "ok").otherwise("binary"))


def slice_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last of a text, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def save_snapshot(symbols: DataFrame, path: str) -> None:
    """Symbols sorted by path and line, metrics included."""
    symbols.repartitionByRange("path", "lineno").sortWithinPartitions("path", "lineno").write.mode("overwrite").json(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A saved snapshot, empty if there is none; missing kinds are functions and missing lines 0."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], SYMBOL_SNAPSHOT)
    rows = spark.read.schema(SYMBOL_SNAPSHOT).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumns({"kind": F.coalesce("kind", F.lit("function")), "lineno": F.coalesce("lineno", F.lit(0))})


def commits_of_log(log: DataFrame, key: str = "log_id", text: str = "text") -> DataFrame:
    """Commits of `hash|author|date|message` logs with the files named below each; dates keep no offset.

    A line of four parts is a header; of a log, which is one row, each line belongs to the last header before it.
    """
    lines = log.select(key, F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("lines"))
    # Places of headers, and that after the last line; each commit's lines are cut out before there are rows, so none are sorted.
    places = F.filter(F.transform("lines", lambda x, i: F.when(F.size(F.split(x, r"\|", 4)) == 4, i)), lambda i: i.isNotNull())
    marked = lines.withColumn("at", F.concat(places, F.array(F.size("lines"))))
    ends = F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0)))
    begun = F.zip_with(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), ends, lambda i, j: F.struct(F.get("lines", i).alias("header"), F.slice("lines", i + 2, j - i - 1).alias("names")))
    out = marked.select(key, F.posexplode(begun).alias("no", "c")).select(
        key, (F.col("no") + 1).cast("long").alias("commit_no"), F.split("c.header", r"\|", 4).alias("p"), F.array_join(F.transform("c.names", lambda x: F.trim(x)), ",").alias("files"), F.size("c.names").cast("long").alias("n_files")
    )
    when = F.to_timestamp_ntz(F.substring(F.col("p")[2], 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return out.select(key, "commit_no", F.col("p")[0].alias("hash"), F.col("p")[1].alias("author"), when.alias("date"), F.col("p")[3].alias("message"), "files", "n_files")


def filter_commits(commits: DataFrame, since=None, until=None, author: str | None = None, path: str | None = None, limit: int = 100) -> DataFrame:
    out = commits
    if since is not None:
        out = out.filter(F.col("date") >= F.lit(since))
    if until is not None:
        out = out.filter(F.col("date") <= F.lit(until))
    if author is not None:
        out = out.filter(F.contains("author", F.lit(author)))
    if path is not None:
        out = out.filter(F.array_contains(F.split("files", ","), path))
    return out.orderBy(F.desc("date"), "hash").limit(limit)


def status_entries(status: DataFrame, key: str = "log_id", text: str = "text") -> DataFrame:
    """Entries of `status --porcelain -z` output: the path, where it was renamed from, both states and a label.

    Fields end with NUL. A rename's new path comes first and its old one is the field after it.
    """
    fields = status.select(key, F.posexplode(F.split(text, "\u0000")).alias("no", "field")).filter("field <> ''")
    w = Window.partitionBy(key).orderBy("no")
    code = F.substring("field", 1, 2)
    looks_old = F.coalesce(F.lag(code).over(w).rlike("^[RC]|^.[RC]"), F.lit(False))
    out = fields.withColumns({"old": looks_old, "following": F.lead("field").over(w)}).filter(~F.col("old")).withColumn("code", F.substring("field", 1, 2)).filter("code <> '!!'")
    renamed = F.col("code").rlike("[RC]")
    return out.select(
        key, F.expr("substring(field, 4)").alias("path"), F.when(renamed, F.col("following")).alias("rename_from"), "code", tx.status_label(F.col("code")).alias("label"),
        (~F.substring("code", 1, 1).isin(" ", "?")).alias("staged"), (~F.substring("code", 2, 1).isin(" ")).alias("unstaged"),
    )


_RUFF = "array<struct<filename:string,code:string,message:string,location:struct<row:int,column:int>>>"
_BANDIT = "struct<results:array<struct<filename:string,test_id:string,issue_text:string,issue_severity:string,line_number:int>>>"
SAMPLE = 25


def ruff_issues(outputs: DataFrame, key: str = "run_id", text: str = "text") -> DataFrame:
    """Issues of a JSON array; `total` counts all, rows are the first SAMPLE; severity is low."""
    parsed = outputs.select(key, F.from_json(text, _RUFF).alias("a")).withColumn("total", F.coalesce(F.size("a"), F.lit(0)))
    rows = parsed.select(key, "total", F.posexplode(F.slice("a", 1, SAMPLE)).alias("ord", "i"))
    return rows.select(key, "total", "ord", F.col("i.filename").alias("file"), F.col("i.location.row").alias("line"), F.col("i.code").alias("code"), F.col("i.message").alias("message"), F.lit("low").alias("severity"))


def bandit_issues(outputs: DataFrame, key: str = "run_id", text: str = "text") -> DataFrame:
    """Issues of a report's results; `total` counts all, rows are the first SAMPLE."""
    parsed = outputs.select(key, F.from_json(text, _BANDIT)["results"].alias("a")).withColumn("total", F.coalesce(F.size("a"), F.lit(0)))
    rows = parsed.select(key, "total", F.posexplode(F.slice("a", 1, SAMPLE)).alias("ord", "i"))
    severity = tx.coerce_to(F.col("i.issue_severity"), ("low", "medium", "high", "critical"), "medium")
    return rows.select(key, "total", "ord", F.col("i.filename").alias("file"), F.col("i.line_number").alias("line"), F.col("i.test_id").alias("code"), F.col("i.issue_text").alias("message"), severity.alias("severity"))


def text_issues(outputs: DataFrame, key: str = "run_id", out: str = "stdout", err: str = "stderr") -> DataFrame:
    """The first five lines of what a tool said, standard output before errors, as one issue; no row without lines."""
    said = F.when(F.trim(out) != "", F.trim(out)).otherwise(F.trim(err))
    lines = F.filter(F.split(F.coalesce(said, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    rows = outputs.select(key, F.size(lines).alias("total"), F.array_join(F.slice(lines, 1, 5), "\n").alias("message"))
    return rows.filter("total > 0").withColumn("severity", F.lit("medium"))


def coverage(reports: DataFrame, key: str = "run_id", xml: str = "xml") -> DataFrame:
    """Line and branch rates of coverage XML in percent, two decimals; null if the report has none."""
    rate = lambda name: F.round(F.try_to_number(F.nullif(F.xpath_string(xml, F.lit(f"/coverage/@{name}")), F.lit("")), F.lit("9.999999")).cast("double") * 100, 2)
    return reports.select(key, rate("line-rate").alias("line_percent"), rate("branch-rate").alias("branch_percent"))


def append(rows: DataFrame, path: str, payload: list[str] | None = None) -> None:
    """Append rows, some columns packed as JSON in `payload`."""
    if payload:
        rows = rows.withColumn("payload", F.to_json(F.struct(*payload))).drop(*payload)
    rows.write.mode("append").parquet(path)


def append_events(events: DataFrame, runs: DataFrame, path: str, key: str = "run_id") -> None:
    """Append events whose run exists; LookupError if one does not, and nothing is written."""
    lost = events.join(runs, key, "left_anti").select(key).limit(1).collect()
    if lost:
        raise LookupError(f"no such run: {lost[0][0]}")
    events.write.mode("append").parquet(path)


def mark_read(notifications: DataFrame, ident, read: bool = True) -> DataFrame:
    return notifications.withColumn("read", F.when(F.col("id") == ident, F.lit(read)).otherwise(F.col("read")))


def clear(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and one row with how many go."""
    return rows.filter(~F.coalesce(condition, F.lit(False))), rows.agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("cleared"))


def settings_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Changed columns of each key, by null-safe comparison."""
    columns = [c for c in before.columns if c != key]
    a = after.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    changed = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns)))
    return before.join(a, key).select(key, F.array_join(changed, ",").alias("changed")).filter("changed <> ''")
