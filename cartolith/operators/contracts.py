"""Contracts of symbols from their documentation and source: levels of discovery, and what patterns find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .drift import first_level

#: What opens a contract block, and words of documentation that count as one.
BLOCK_MARK = "@contract"
_THREADS = r"(?i)\b(thread[- ]safe|not thread[- ]safe|immutable|synchroni[sz]ed)\b"
MOST, LONGEST = 5, 100


def _squeezed(found: Column, distinct: bool = False) -> Column:
    clean = F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (x != "") & (F.length(x) < LONGEST))
    return F.slice(F.array_distinct(clean) if distinct else clean, 1, MOST)


def preconditions(source: Column) -> Column:
    """What asserts and "must" or "requires" sentences demand; at most five."""
    asserts = F.regexp_extract_all(source, F.lit(r"(?m)^\s*assert\s+([^,\n#]+)"), F.lit(1))
    words = F.regexp_extract_all(source, F.lit(r"(?i)\b(?:requires?|must be|preconditions?):?\s+([^.\n\"]+)"), F.lit(1))
    return _squeezed(F.concat(asserts, words))


def errors(source: Column) -> Column:
    """Exceptions that are raised or thrown, once each; at most five."""
    return _squeezed(F.concat(F.regexp_extract_all(source, F.lit(r"\braise\s+([A-Za-z_][\w.]*)"), F.lit(1)), F.regexp_extract_all(source, F.lit(r"\bthrow\s+(?:new\s+)?([A-Za-z_][\w:.]*)"), F.lit(1))), distinct=True)


def thread_safety(source: Column) -> Column:
    found = F.lower(F.regexp_extract(source, _THREADS, 1))
    return F.when(found == "", F.lit("unknown")).when(found.startswith("not"), "unsafe").when(found == "immutable", "immutable").otherwise("safe")


def doc_kind(source: Column) -> Column:
    """contract, doxygen, docstring, comment or none: what a quick look finds first."""
    return (
        F.when(F.contains(source, F.lit(BLOCK_MARK)), "contract").when(source.rlike(r"/\*\*|///|@param|@brief"), "doxygen")
        .when(source.rlike("\"\"\"|'''"), "docstring").when(source.rlike(r"(?m)^\s*(?:#|//)"), "comment").otherwise("none")
    )


def block_value(source: Column, key: str) -> Column:
    """The value of `key:` in the lines of a contract block; empty without a block."""
    inside = F.regexp_extract(source, rf"(?s){BLOCK_MARK}(.*?)(?:@end|\"\"\"|\*/|$)", 1)
    return F.trim(F.regexp_extract(inside, rf"(?m)^[\s#*/]*{key}:\s*(.+)$", 1))


def discover(symbols: DataFrame, key: str, source: str) -> DataFrame:
    """Thread safety, preconditions and errors of each symbol, and the level that gave them: block 1, documents 2, static 4, none 5."""
    s = F.col(source)
    block, documented = block_value(s, "thread_safety"), F.array_join(preconditions(s), "; ")
    level = first_level((1, block), (2, F.when(doc_kind(s).isin("doxygen", "docstring"), documented)), (4, F.array_join(F.concat(preconditions(s), errors(s)), "; ")))
    confidence = F.when(level["level"] == 1, 1.0).when(level["level"] == 2, 0.7).when(level["level"] == 4, 0.4).otherwise(0.0)
    threads = F.when(block != "", block).otherwise(thread_safety(s))
    return symbols.select(key, level["level"].alias("level"), level["value"].alias("value"), confidence.alias("confidence"), threads.alias("thread_safety"), F.array_join(errors(s), ",").alias("errors"))


_BLOCK = rf"(?s)\n?[ \t]*{BLOCK_MARK}.*?@end[ \t]*"


def without_block(source: Column) -> Column:
    """The source without its contract block."""
    return F.regexp_replace(source, _BLOCK, "")


def with_block(source: Column, block: Column) -> Column:
    """The source with a contract block (lines between its marks) in place of the one it has, or after its first line."""
    whole = F.concat(F.lit(f"    {BLOCK_MARK}\n"), block, F.lit("\n    @end"))
    bare = without_block(source)
    head = F.substring_index(bare, "\n", 1)
    return F.concat(head, F.lit("\n"), whole, F.substring(bare, F.length(head) + 1, F.length(bare)))


def side_by_side(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """Unified diffs as pairs of lines: removed and added lines of a block stand side by side by rank.

    Line numbers restart at each hunk header.
    """
    from pyspark.sql import Window

    lines = diffs.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line"))
    c = F.substring("line", 1, 1)
    meta = F.col("line").rlike(r"^(diff |index |--- |\+\+\+ )")
    kind = F.when(F.col("line").startswith("@@"), "hunk").when(meta, "meta").when(c == "-", "old").when(c == "+", "new").otherwise("same")
    w = Window.partitionBy(key).orderBy("no")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("kind", kind).filter("kind <> 'meta'")
    marked = marked.withColumn("hunk", F.sum((F.col("kind") == "hunk").cast("int")).over(upto)).withColumn("block", F.sum((~F.col("kind").isin("old", "new")).cast("int")).over(upto))
    head = F.first(F.when(F.col("kind") == "hunk", F.col("line")), ignorenulls=True).over(Window.partitionBy(key, "hunk").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = marked.withColumns({"a0": F.regexp_extract(head, r"@@ -(\d+)", 1).try_cast("int"), "b0": F.regexp_extract(head, r"@@ -\d+(?:,\d+)? \+(\d+)", 1).try_cast("int")}).filter("kind <> 'hunk' and hunk > 0")
    inside = Window.partitionBy(key, "hunk").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumns({"left_no": F.col("a0") - 1 + F.sum(F.col("kind").isin("old", "same").cast("int")).over(inside), "right_no": F.col("b0") - 1 + F.sum(F.col("kind").isin("new", "same").cast("int")).over(inside)})
    rank = F.row_number().over(Window.partitionBy(key, "hunk", "block", "kind").orderBy("no"))
    body = F.expr("substring(line, 2)")
    flat = marked.withColumn("rank", F.when(F.col("kind") == "same", 0).otherwise(rank))
    left, right = F.col("kind").isin("old", "same"), F.col("kind").isin("new", "same")
    return flat.groupBy(key, "hunk", "block", "rank").agg(
        F.max(F.when(left, F.col("left_no"))).alias("left_no"), F.max(F.when(left, body)).alias("left"), F.max(F.when(right, F.col("right_no"))).alias("right_no"), F.max(F.when(right, body)).alias("right")
    )
