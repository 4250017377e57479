"""Event streams in batch form: collapsing, sessions, phases, duplicate suppression and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse(changes: DataFrame) -> DataFrame:
    """One row per path of (seq, event_type, src_path, dest_path): what the events of a batch come to.

    A move is a deletion at its source and a creation at its target. A creation followed only by modifications stays a
    creation, otherwise the last event counts; first_seq keeps the order in which paths appeared.
    """
    moves = F.array(F.struct(F.lit("deleted").alias("kind"), F.col("src_path").alias("path"), F.lit(0).alias("sub")), F.struct(F.lit("created").alias("kind"), F.col("dest_path").alias("path"), F.lit(1).alias("sub")))
    plain = F.array(F.struct(F.col("event_type").alias("kind"), F.col("src_path").alias("path"), F.lit(0).alias("sub")))
    flat = changes.select("seq", F.explode(F.when((F.col("event_type") == "moved") & F.col("dest_path").isNotNull(), moves).otherwise(plain)).alias("e")).select("seq", "e.*")
    at = F.struct("seq", "sub")
    per = flat.groupBy("path").agg(
        F.min(at).alias("first"), F.max_by("kind", at).alias("last"),
        F.max(F.when(F.col("kind") == "created", at)).alias("created"), F.max(F.when(~F.col("kind").isin("created", "modified"), at)).alias("other"),
    )
    stays = F.col("created").isNotNull() & (F.col("other").isNull() | (F.col("created") > F.col("other")))
    return per.select("path", F.when(stays, "created").otherwise(F.col("last")).alias("event_type"), F.col("first.seq").alias("first_seq"))


def upsert(index: DataFrame, changed: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """The index without what was deleted or replaced, and what replaces it."""
    gone = changed.select(key).unionByName(deleted.select(key))
    return index.join(gone, key, "left_anti").unionByName(changed.select(*index.columns))


def carry_forward(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Rows with the last value that was not null so far."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def suppress_repeats(rows: DataFrame, key: list[str], order: list[str], value: str, within: int = 3) -> DataFrame:
    """Rows whose value none of the `within` rows before them has."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-within, -1)
    return rows.withColumn("__before", F.collect_list(value).over(w)).filter(~F.array_contains("__before", F.col(value))).drop("__before")


def session_metrics(rows: DataFrame, key: str, at: Column, kind: str, errors: list[str], passed: list[str], tests: list[str]) -> DataFrame:
    """Events, errors, duration and success rate of each session; the rate is 0 without tests."""
    ran, good = F.sum(F.col(kind).isin(tests).cast("long")), F.sum(F.col(kind).isin(passed).cast("long"))
    rate = F.coalesce(F.try_divide(good, ran), F.lit(0.0))
    return rows.groupBy(key).agg(F.count("*").alias("events"), F.sum(F.col(kind).isin(errors).cast("long")).alias("errors"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), ran.alias("tests"), rate.alias("success_rate"))


def sessionize(rows: DataFrame, key: str, at: str, gap_seconds: int, tie: str) -> DataFrame:
    """Rows with the number of their session: a new one begins after a gap."""
    w = Window.partitionBy(key).orderBy(at, tie)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def phase_blocks(rows: DataFrame, key: list[str], phase: str, at: str, order: list[str], status: str) -> DataFrame:
    """Start, end, duration, events and last status of each phase; blocks last at least a second."""
    out = rows.groupBy(*key, phase).agg(F.min(at).alias("start_at"), F.max(at).alias("end_at"), F.count("*").alias("events"), F.max_by(status, F.struct(*order)).alias("last_status"))
    return out.withColumn("duration_ms", F.greatest(F.floor((F.col("end_at") - F.col("start_at")) / 1000), F.lit(1000)))


def timeline_matrix(commits: DataFrame, files: DataFrame, commit: str, path: str, order: list[str] | None = None) -> DataFrame:
    """(path, commits, mask): for each file the commits, in order, that touch it, as a string of 0 and 1.

    Only the commits of a page come in, so the mask is short; membership is aggregated and no cross product is made.
    Commits are in the order of the columns `order`, or of their key.
    """
    by = order or [commit]
    numbered = commits.select(*dict.fromkeys([commit, *by])).distinct().select(commit, F.row_number().over(Window.orderBy(*by)).alias("__no"))
    touched = files.join(numbered, commit).groupBy(path).agg(F.collect_set("__no").alias("__hits"))
    total = numbered.agg(F.count("*")).scalar()
    mask = F.array_join(F.transform(F.sequence(F.lit(1), F.col("__n").cast("int")), lambda i: F.when(F.array_contains("__hits", i), "1").otherwise("0")), "")
    return touched.withColumn("__n", total).select(path, F.size("__hits").alias("commits"), mask.alias("mask"))


def activity_feed(sources: list[DataFrame], order: list, limit: int) -> DataFrame:
    """Newest items of several sources with the same columns."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy(*order).limit(limit)
