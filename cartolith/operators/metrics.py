"""Project metrics, quality reports and gates as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the complexity bands; above the last is extreme.
COMPLEXITY_BANDS = (("low", 5), ("medium", 10), ("high", 25))
#: Most files, lines below, most patterns, most layers of the first stages; others are stage 3.
STAGE_LIMITS = ((1, 3, 500, 0, 0), (2, 20, 3000, 3, 3))
LAST_STAGE, STAGE_SCORE = 3, 3
#: Lines above which a file is long, and from which it is critical.
LONG_FILE, CRITICAL_FILE = 500, 1000


def complexity_band(value: Column) -> Column:
    out = F.lit("extreme")
    for name, most in reversed(COMPLEXITY_BANDS):
        out = F.when(value <= most, name).otherwise(out)
    return out


def complexity_histogram(symbols: DataFrame, complexity: str) -> DataFrame:
    return symbols.groupBy(complexity_band(F.col(complexity)).alias("band")).agg(F.count("*").alias("n"))


def problem_functions(symbols: DataFrame, complexity: str, tie: str, limit: int | None = None, above: int = 5) -> DataFrame:
    out = symbols.filter(F.col(complexity) > above).orderBy(F.desc(complexity), tie)
    return out if limit is None else out.limit(limit)


def project_metrics(symbols: DataFrame, path: str, directory: Column, kind: str, complexity: str, lines: str, callable_kinds: list[str]) -> DataFrame:
    """One row: files, directories, lines, complexity in all, at most and on average.

    Total and maximum are over all symbols, a missing complexity counting 1; the average divides by functions and methods.
    """
    c = F.coalesce(F.col(complexity), F.lit(1)).cast("long")
    functions = F.sum(F.col(kind).isin(callable_kinds).cast("long"))
    return symbols.agg(
        F.countDistinct(path).alias("files"), F.countDistinct(directory).alias("directories"), F.sum(F.col(lines).cast("long")).alias("loc"),
        F.sum(c).alias("complexity_total"), F.max(c).alias("complexity_max"), F.coalesce(F.floor(F.try_divide(F.sum(c), functions)), F.lit(0)).cast("long").alias("complexity_avg"),
    )


def stage_of(files: Column, loc: Column, patterns: Column, layers: Column) -> Column:
    """The first stage that passes at least three of its four limits (the limit of lines is strict)."""
    out = F.lit(LAST_STAGE)
    for stage, f, n, p, a in reversed(STAGE_LIMITS):
        score = (files <= f).cast("int") + (loc < n).cast("int") + (patterns <= p).cast("int") + (layers <= a).cast("int")
        out = F.when(score >= STAGE_SCORE, stage).otherwise(out)
    return out


def stage_confidence(files: Column, loc: Column, patterns: Column, layers: Column, stage: Column) -> Column:
    """high if the stage's four limits all hold, medium if three do, else low."""
    out = F.lit("high")
    for s, f, n, p, a in reversed(STAGE_LIMITS):
        score = (files <= f).cast("int") + (loc < n).cast("int") + (patterns <= p).cast("int") + (layers <= a).cast("int")
        out = F.when(stage == s, F.when(score == 4, "high").when(score == 3, "medium").otherwise("low")).otherwise(out)
    return out


#: Markers of architectural folders, in the order they are tried, and limits of hints and warnings.
ARCHITECTURE_FOLDERS = ("models", "views", "controllers", "services", "repositories", "middleware", "adapters", "interfaces", "handlers", "routers", "api", "core", "domain", "infrastructure", "application", "presentation")
EARLY_FILES, EARLY_LINES, MIDDLE_FILES, MIDDLE_LINES = 8, 1000, 15, 2000
FEW_FILES, MANY_LINES, MANY_FILES = 5, 1500, 30


def substage(files: Column, loc: Column, stage: Column) -> Column:
    """early, mid or late within the second stage; null elsewhere."""
    hint = F.when((files <= EARLY_FILES) & (loc < EARLY_LINES), "early").when((files <= MIDDLE_FILES) & (loc < MIDDLE_LINES), "mid").otherwise("late")
    return F.when(stage == 2, hint)


def warned_confidence(files: Column, loc: Column, patterns: Column, many: int = MANY_FILES) -> Column:
    """medium if a few files hold many lines, or more than `many` files show no pattern; else high."""
    return F.when((files <= FEW_FILES) & (loc > MANY_LINES), "medium").when((files > many) & (patterns == 0), "medium").otherwise("high")


def architecture_folders(folders: DataFrame, path: str) -> DataFrame:
    """(marker, folders): for each folder the first marker that its own name contains."""
    name = F.lower(F.substring_index(path, "/", -1))
    first = F.coalesce(*(F.when(F.contains(name, F.lit(m)), m) for m in ARCHITECTURE_FOLDERS))
    return folders.select(first.alias("marker"), path).filter("marker is not null").groupBy("marker").agg(F.countDistinct(path).alias("folders"))


def keyword_patterns(paths: DataFrame, path: str, keywords: dict[str, list[str]]) -> DataFrame:
    """Patterns any of whose keywords is in a path segment, with the number of such paths."""
    lowered = F.lower(F.col(path))

    def hit(words: list[str]) -> Column:
        return F.exists(F.split(lowered, "/"), lambda s: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(s, w)))

    hits = F.array_compact(F.array(*(F.when(hit(words), F.lit(name)) for name, words in keywords.items())))
    return paths.select(F.explode(hits).alias("pattern"), path).groupBy("pattern").agg(F.countDistinct(path).alias("paths"))


def overall_status(status: Column) -> Column:
    """Aggregate: fail over warn over pass; skipped only if everything is."""
    return F.when(F.bool_or(status.isin("fail", "error")), "fail").when(F.bool_or(status == "warn"), "warn").when(F.bool_and(status == "skipped"), "skipped").otherwise("pass")


def report_summary(issues: DataFrame, tool: str, status: Column, severity: Column) -> DataFrame:
    """Checks and issues by tool with severity counts."""
    counts = [F.sum((severity == s).cast("long")).alias(f"{s}_issues") for s in ("critical", "high", "medium", "low")]
    return issues.groupBy(tool).agg(F.count("*").alias("issues"), *counts, overall_status(status).alias("status"))


def top_offenders(issues: DataFrame, item: str, order: list[str], limit: int = 5) -> DataFrame:
    """The first distinct items in order of arrival."""
    return issues.groupBy(item).agg(F.min(F.struct(*order)).alias("__first")).orderBy("__first", item).limit(limit).select(item, *(F.col(f"__first.{c}").alias(c) for c in order))


def long_files(files: DataFrame, lines: Column, name: str) -> DataFrame:
    """Files above the limit of lines with their severity."""
    n = files.select(F.col(name), lines.alias("lines"))
    return n.filter(F.col("lines") > LONG_FILE).withColumn("severity", F.when(F.col("lines") >= CRITICAL_FILE, "critical").otherwise("high"))


def gate(results: DataFrame, group: str, passed: Column, required: Column, item: Column) -> DataFrame:
    """A gate passes iff no required item fails."""
    blocking = F.array_join(F.sort_array(F.collect_list(F.when(required & ~passed, item))), ",")
    return results.groupBy(group).agg(F.count("*").alias("items"), F.sum(passed.cast("long")).alias("passed"), F.bool_and(passed | ~required).alias("gate"), F.crc32(blocking.cast("binary")).alias("blocking_crc"))
