"""Search, lookups, scoped and paged reads over symbol and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(symbols: DataFrame, term: str, name: str = "name") -> DataFrame:
    """Rows whose name contains the term in any case; an empty term finds nothing."""
    return symbols.filter(F.contains(F.lower(name), F.lit(term.lower())) & F.lit(bool(term)))


def search_with_total(symbols: DataFrame, term: str, limit: int, order: list, name: str = "name") -> DataFrame:
    """The first `limit` (1 to 200) matches, each with the number of all."""
    found = search(symbols, term, name)
    return found.orderBy(*order).limit(min(max(limit, 1), 200)).withColumn("total", found.agg(F.count("*")).scalar())


def in_scope(column: Column, value) -> Column:
    """Null or equal: rows of no scope belong to every scope."""
    return column.isNull() | (column == value)


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    out = rows.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(max(1, limit))


def after(rows: DataFrame, key: str, last, limit: int, order: list) -> DataFrame:
    """Keyset page: rows whose key is above the last one seen."""
    return page(rows.filter(F.col(key) > last), order, limit)


def latest_per(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the largest `by` of each key, without sorting groups."""
    others = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*by)).alias("__top"))
    return top.select(*keys, *(F.col(f"__top.{c}").alias(c) for c in others))


def prefix_or_all(rows: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows equal to a prefix or below it (prefix and a dot); if no row matches, all rows."""
    match = F.lit(False)
    for p in prefixes:
        match = match | (F.col(column) == p) | F.col(column).startswith(f"{p}.")
    flagged = rows.withColumn("__hit", match)
    any_hit = flagged.agg(F.coalesce(F.bool_or("__hit"), F.lit(False))).scalar()
    return flagged.withColumn("__any", any_hit).filter("__hit or not __any").drop("__hit", "__any")


def members(owners: DataFrame, symbols: DataFrame, owner_key: list[str], member_key: list[str], order: str, what: str) -> DataFrame:
    """Owners with the texts of their members in order, an empty text for those without."""
    inside = symbols.groupBy(*member_key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(what).alias("w")))), lambda x: x["w"].cast("string")), ",").alias("members"), F.count("*").alias("n_members"))
    on = [owners[a] == inside[b] for a, b in zip(owner_key, member_key, strict=True)]
    return owners.join(inside, on, "left").drop(*(inside[b] for b in member_key)).withColumns({"members": F.coalesce("members", F.lit("")), "n_members": F.coalesce("n_members", F.lit(0))})


def cap(rows: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """The first `limit` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit)
