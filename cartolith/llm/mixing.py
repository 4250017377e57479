"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, documents in order of id, are packed into blocks of fixed length: BLOCK words, or a FINEST-th of
a source that is smaller than so many blocks, so what is taken of any source comes within a block of its target. A source
with target t gets t / size slots for each of its blocks. Every slot draws its output shard by a non-linear hash of source and slot, so the
counts of a source over the shards are multinomial, with the total held at the source's target. Slot i maps to block
perm(i mod blocks), a swap-or-not permutation keyed by source and epoch, and blocks are joined by index.

Defined cases: null or empty text has size 0 and nothing is taken of it; null sources are one source, ordered last;
null ids come first in their source; repeated rows are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions_for, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 128
#: Blocks that a source has at least, unless it has fewer words.
FINEST = 512
#: Rounds of the permutation.
ROUNDS = 12
#: Slots that one row expands to, and mean slots of a shard.
SEGMENT, SHARD_SLOTS = 4096, 8192
#: No target is above this many times its source's size.
MOST = 3
_PRIME = 2147483647


def _scramble(x: Column) -> Column:
    """Two steps of a multiplicative generator modulo a prime; the same arithmetic in any SQL."""
    return ((x % _PRIME) * 48271 % _PRIME) * 16807 % _PRIME


def drawn(x: Column) -> Column:
    """A value that is not linear in x: a scrambled square between two scrambles."""
    y = _scramble(x)
    return _scramble(y * y % _PRIME + 1)


def permuted(position: Column, n: Column, key: Column) -> Column:
    """Swap-or-not permutation of 0..n-1: in each round x and K - x change places if a bit of their larger one says so."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(_scramble(key + r * 1299709) % n - x, n)
        return F.when(_scramble(F.greatest(x, other) + key * 31 + r * 7919) % 1024 < 512, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), position, step)


def _targets(totals: DataFrame) -> DataFrame:
    """Targets by water-filling over one row a source: min(MOST * size, level * weight), with one level for all."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    t = totals.withColumn("src", F.row_number().over(order).cast("long") - 1).withColumn("weight", (1 + F.col("src") % 3).cast("double"))
    t = t.withColumn("cap", (MOST * F.col("source_size")).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    up = Window.orderBy("full_at", "src")
    everyone = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everyone).cast("double") - (F.sum("cap").over(up) - F.col("cap"))) / (F.sum("weight").over(everyone) - (F.sum("weight").over(up) - F.col("weight")))
    t = t.withColumn("level_here", level)
    t = t.withColumn("level", F.min(F.when(F.col("level_here") <= F.col("full_at"), F.struct("full_at", "src", "level_here"))).over(everyone)["level_here"])
    return t.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))


def mix(df: DataFrame, block: int = BLOCK, finest: int = FINEST, seed: int = 0, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", carry: bool = False) -> dict[str, DataFrame]:
    """`documents`: a row per input row with what the mix takes of it; `slots`: shard, source, slot and block of all output blocks.

    With carry, `documents` also has row_key, and `rows` has the input rows with the same row_key.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    n = partitions_for(spark)
    if carry:
        df = scratch.write(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    row = F.col("__row") if carry else F.lit(None).cast("long")
    sized = scratch.write(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"), row.alias("row_key")), "sized")
    # Range parts of (source, id): a large source spans many of them, and each is summed on its own.
    order = [F.asc_nulls_last("source"), F.asc_nulls_first("doc_id"), F.asc("size"), F.asc("row_key")]
    parts = scratch.write(sized.repartitionByRange(n, *order[:3]).withColumn("part", F.spark_partition_id()), "parts")
    scratch.drop(sized)
    per_part = parts.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    per_part = per_part.withColumn("part_start", F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sources = scratch.write(_targets(parts.groupBy("source").agg(F.sum("size").alias("source_size"))).select("source", "src", "source_size", "target"), "sources")
    sources = sources.withColumn("grain", F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.col("source_size") / finest)))).withColumn("blocks", F.ceil(F.col("source_size") / F.col("grain"))).withColumn("slots", F.coalesce(F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size"))), F.lit(0)).cast("long"))
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy(F.lit(1))) / SHARD_SLOTS)))
    within = Window.partitionBy("source", "part").orderBy(F.asc_nulls_first("doc_id"), "size", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _placed(parts, per_part, within)
    placed = placed.join(sources.select(F.col("source").alias("s2"), "src", "source_size", "target", "grain"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2", "source")

    span = sources.filter("slots > 0").select("src", "blocks", "slots", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SEGMENT))).alias("segment"))
    span = span.repartition(n, "src", "segment")
    slots = span.select("src", "blocks", "shards", F.explode(F.sequence(F.col("segment") * SEGMENT, F.least(F.col("slots"), (F.col("segment") + 1) * SEGMENT) - 1)).alias("slot"))
    key = F.col("src") * 7919 + F.floor(F.col("slot") / F.col("blocks")) * 104729 + seed
    slots = slots.select("src", "slot", (drawn(F.col("src") % _PRIME * 15485863 + F.col("slot") % _PRIME * 32452843 + seed + 1) % F.col("shards")).alias("shard"), permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), key).alias("block"))

    used = slots.groupBy("src", "block").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"))
    touched = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / F.col("grain")), F.floor((F.col("start") + F.col("size") - 1) / F.col("grain"))))
    pieces = placed.select("*", F.explode_outer(touched).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("grain")) - F.greatest(F.col("start"), F.col("block") * F.col("grain"))
    # Spark's estimate of exploded rows is far too low, so without a hint this grows into a broadcast.
    found = pieces.join(used.hint("merge"), ["src", "block"], "left")
    documents = (
        found.groupBy("src", "part", "nth").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "row_key")), F.coalesce(F.sum(overlap * F.coalesce("times", F.lit(0))), F.lit(0)).alias("taken"), F.min("first_shard").alias("first_shard"))
        .select("doc_id", "size", "source_size", "target", "taken", "first_shard", "row_key")
    )
    return {"documents": documents if carry else documents.drop("row_key"), "slots": slots, "sources": sources, "rows": df}


def _placed(parts: DataFrame, per_part: DataFrame, within) -> DataFrame:
    """Rows with the offset of their first word in their source's stream."""
    starts = per_part.select(F.col("source").alias("ps"), F.col("part").alias("pp"), "part_start")
    rows = parts.withColumn("upto", F.sum("size").over(within)).withColumn("nth", F.row_number().over(within))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("ps")) & (F.col("part") == F.col("pp")))
    return rows.withColumn("start", F.col("part_start") + F.col("upto") - F.col("size")).drop("ps", "pp", "part_start", "upto")


def remix(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", finest: int = 1, **options) -> DataFrame:
    """The rows of the mix: a row appears taken / size times, rounded up or down by a draw from a hash of its id and text.

    Blocks are not made finer for small sources unless `finest` says so, since whole rows are taken: a source of a few
    short rows is then taken whole, and not lost by a draw. A row without words appears once. Any id will do: none, a negative one or one that other rows have too.
    """
    parts = mix(df, carry=True, text_col=text_col, id_col=id_col, finest=finest, **options)
    share = parts["documents"].select("row_key", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1.0)).alias("__share"))
    rows = parts["rows"].join(share.filter("__share > 0"), parts["rows"]["__row"] == share["row_key"])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("long"), text_or_empty(text_col)), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor(F.col("__share") + draw).cast("int")
    return rows.withColumn("__copies", copies).filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*df.columns)
