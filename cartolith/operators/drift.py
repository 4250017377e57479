"""Drift: counts, gates, evidence and text cross checks of contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(items: DataFrame, kind: str) -> DataFrame:
    """Items by kind and severity, and whether any is critical."""
    return items.groupBy(kind, "severity").agg(F.count("*").alias("n"), F.bool_or(F.col("severity") == "critical").alias("blocking"))


def selected(items: DataFrame, types: list[str] | None = None, severities: list[str] | None = None, file_path: str | None = None, blocking: bool = False) -> DataFrame:
    """Items of some types and severities, of one file, or only those that block; what is not given does not restrict."""
    out = items if types is None else items.filter(F.col("type").isin(types))
    out = out if severities is None else out.filter(F.col("severity").isin(severities))
    out = out if file_path is None else out.filter(F.col("file_path") == file_path)
    return out.filter(F.col("severity") == "critical") if blocking else out


def report(detectors: list[DataFrame]) -> DataFrame:
    """One row for all detectors' items (file_path, type, severity) together: items, distinct files, and whether any blocks."""
    out = detectors[0].select("file_path", "type", "severity")
    for d in detectors[1:]:
        out = out.unionByName(d.select("file_path", "type", "severity"))
    return out.agg(F.count("*").alias("items"), F.countDistinct("file_path").alias("analyzed_files"), F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("has_blocking"))


def can_proceed(items: DataFrame) -> DataFrame:
    """One row: whether nothing is critical, and the counts by severity in one line."""
    by = [F.sum((F.col("severity") == s).cast("long")).alias(s) for s in ("critical", "warning", "info")]
    out = items.agg(*by, F.count("*").alias("total"))
    return out.select(F.coalesce(F.col("critical") == 0, F.lit(True)).alias("can_proceed"), F.format_string("%d items: %d critical, %d warning, %d info", "total", *(F.coalesce(s, F.lit(0)) for s in ("critical", "warning", "info"))).alias("summary"))


def evidence(required: DataFrame, existing: DataFrame, key: str, failed: Column) -> DataFrame:
    """Required items that are missing or failed."""
    have = existing.select(key).distinct().withColumn("__have", F.lit(True))
    state = F.when(F.col("__have").isNull(), "missing").when(failed, "failed").otherwise("ok")
    return required.join(have, key, "left").select(key, state.alias("evidence")).filter("evidence <> 'ok'")


def text_checks(contracts: DataFrame, terms: str, source: str, key: str) -> DataFrame:
    """Terms of a contract that its source does not mention."""
    return contracts.select(key, source, F.explode(terms).alias("term")).filter(~F.contains(F.col(source), F.col("term"))).select(key, "term")


def first_level(*levels: tuple[int, Column]) -> Column:
    """The first level that found something: struct of level and value; level 5 and null if none did."""
    out = F.struct(F.lit(5).alias("level"), F.lit(None).cast("string").alias("value"))
    for level, value in reversed(levels):
        out = F.when(value.isNotNull() & (value != ""), F.struct(F.lit(level).alias("level"), value.alias("value"))).otherwise(out)
    return out


def merge_findings(findings: DataFrame, key: str) -> DataFrame:
    """Findings (type, value, confidence) of an item: the highest confidence, up to five dependencies, its lifecycle."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("value"))))
    return findings.groupBy(key).agg(
        F.max("confidence").alias("confidence"), F.array_join(F.slice(of("dependency"), 1, 5), ",").alias("dependencies"),
        F.array_join(of("lifecycle"), "; ").alias("lifecycle"), F.count("*").alias("n_findings"),
    )


def detected(context: DataFrame, detectors: dict[str, Callable[[DataFrame], DataFrame]], only: tuple[str, ...] | None = None) -> DataFrame:
    """Items of all detectors, or of those named, with the detector's name; items have the same columns."""
    out = None
    for name, detector in detectors.items():
        if only is None or name in only:
            found = detector(context).withColumn("detector", F.lit(name))
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no detector is chosen")
    return out
