"""Joins of the data model: nearest preceding row, candidate resolution, anti joins, pairing and presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, left_by: str, right_by: str, take: dict[str, str], tie: str) -> DataFrame:
    """Each left row with the right row of its key that is nearest at or before it.

    Both sides are ordered once per key in one union and the last right row is carried forward, so no pair of rows is
    made; of right rows at one place the one with the smallest `tie` counts.
    """
    first = right.groupBy(F.col(on), F.col(right_by).alias("__at")).agg(F.min_by(F.struct(*(F.col(c).alias(n) for n, c in take.items())), tie).alias("__found"))
    both = left.withColumns({"__at": F.col(left_by), "__side": F.lit(1)}).unionByName(first.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    carried = F.last("__found", ignorenulls=True).over(Window.partitionBy(on).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumn("__found", carried).filter("__side = 1")
    return out.select(*left.columns, *(F.col(f"__found.{n}").alias(n) for n in take))


def resolve(references: DataFrame, definitions: DataFrame, candidates: list[Column], key: str, name: str, target: str) -> DataFrame:
    """Each reference with the first of its candidate names that is defined, and which one it was; null if none is.

    Candidates are exploded with their rank and joined by equality, and the lowest rank wins.
    """
    ranked = references.select("*", F.posexplode(F.array(*candidates)).alias("rank", "__name"))
    hits = ranked.filter("__name is not null").join(definitions.select(F.col(name).alias("__name"), F.col(target).alias("__target")), "__name")
    best = hits.groupBy(key).agg(F.min(F.struct("rank", "__target")).alias("__best"))
    out = references.join(best, key, "left")
    return out.select(*references.columns, F.col("__best.__target").alias("target"), F.col("__best.rank").alias("rank"), F.col("__best").isNotNull().alias("internal"))


def stale(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose key is gone."""
    return old.join(new.select(key), key, "left_anti")


def roots(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Sources that are no edge's target."""
    return edges.select(F.col(source).alias("node")).distinct().join(edges.select(F.col(target).alias("node")), "node", "left_anti")


def compare_snapshots(before: DataFrame, after: DataFrame, key: list[str], value: str | None) -> DataFrame:
    """added, removed and (with a value) changed keys between two snapshots, with their severity."""
    b = before.select(*key, *([F.col(value).alias("__b")] if value else []), F.lit(True).alias("__in_b"))
    a = after.select(*key, *([F.col(value).alias("__a")] if value else []), F.lit(True).alias("__in_a"))
    both = b.join(a, key, "full_outer")
    changed = F.lit(False) if value is None else (F.col("__in_a") & F.col("__in_b") & ~F.col("__a").eqNullSafe(F.col("__b")))
    kind = F.when(F.col("__in_b").isNull(), "added").when(F.col("__in_a").isNull(), "removed").when(changed, "changed")
    out = both.withColumn("change", kind).filter("change is not null")
    return out.select(*key, "change", F.when(F.col("change") == "added", "info").otherwise("warning").alias("severity"))


def sequence_pairs(rows: DataFrame, key: list[str], order: list[str], is_start: Column, is_end: Column, what: list[str]) -> DataFrame:
    """Each start with the first end after it and before the next start; nulls if there is none."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumns({"__s": is_start, "__e": is_end}).withColumn("__no", F.sum(F.col("__s").cast("int")).over(w)).filter("__no > 0 and (__s or __e)")
    order_struct = F.struct(*order)
    grouped = marked.groupBy(*key, "__no").agg(
        F.min_by(F.struct(*what), F.when(F.col("__s"), order_struct)).alias("__start"),
        F.min_by(F.struct(*what), F.when(F.col("__e") & ~F.col("__s"), order_struct)).alias("__end"),
    )
    return grouped.select(*key, F.col("__no").alias("pair_no"), *(F.col(f"__start.{c}").alias(f"start_{c}") for c in what), *(F.col(f"__end.{c}").alias(f"end_{c}") for c in what))


def presence(required: DataFrame, existing: DataFrame, group: str, item: str) -> DataFrame:
    """For each group, how many required items exist, which are missing, and whether all are there."""
    have = existing.select(F.col(item)).distinct().withColumn("__have", F.lit(True))
    r = required.join(have, item, "left")
    missing = F.array_join(F.sort_array(F.collect_list(F.when(F.col("__have").isNull(), F.col(item).cast("string")))), ",")
    return r.groupBy(group).agg(F.count("__have").alias("present"), F.sum(F.col("__have").isNull().cast("int")).alias("absent"), missing.alias("missing"), F.bool_and(F.col("__have").isNotNull()).alias("complete"))
