"""Files of commits and what commits change, by joins over tables of trees; and lines that a change adds and removes.

Trees are walked level by level from the roots, all commits at once. A comparison only goes down where the two sides name
different trees, so its work follows what changed and not the size of the checkout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut_lineage

_FOLDER = "40000"


def _joined(path: str, name: str):
    return F.when(F.col(path) == "", F.col(name)).otherwise(F.concat_ws("/", path, name))


def files_of(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """(commit, path, mode, oid): the files of each commit; modules of other repositories are not files."""
    trees = cut_lineage(trees)
    frontier, out = commits.select("commit", F.lit("").alias("path"), "tree"), None
    while True:
        level = cut_lineage(frontier.join(trees, "tree").select("commit", _joined("path", "name").alias("path"), "mode", "oid"))
        here = level.filter(~F.col("mode").isin(_FOLDER, "160000"))
        out = here if out is None else out.unionByName(here)
        frontier = level.filter(F.col("mode") == _FOLDER).select("commit", "path", F.col("oid").alias("tree"))
        if frontier.isEmpty():
            return out


def changes_of(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """(commit, path, status, old_oid, new_oid): what each commit changes against its first parent; status A, M or D."""
    trees = cut_lineage(trees)
    roots = commits.select(F.col("commit").alias("parent"), F.col("tree").alias("old_tree"))
    pairs = commits.select("commit", F.try_element_at("parents", F.lit(1)).alias("parent"), F.col("tree").alias("new_tree")).join(roots, "parent", "left")
    frontier, out = pairs.select("commit", F.lit("").alias("path"), "old_tree", "new_tree").filter(~F.col("old_tree").eqNullSafe(F.col("new_tree"))), None
    while True:
        frontier = cut_lineage(frontier)
        side = lambda tree, c: frontier.join(trees, F.col(tree) == F.col("tree")).select("commit", "path", "name", F.struct("mode", "oid").alias(c))  # noqa: B023, E731
        both = side("old_tree", "old").join(side("new_tree", "new"), ["commit", "path", "name"], "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
        both = cut_lineage(both.select("commit", _joined("path", "name").alias("path"), "old", "new"))
        folder = lambda c: F.coalesce(F.col(f"{c}.mode") == _FOLDER, F.lit(False))
        file = lambda c: F.when(~folder(c) & (F.col(f"{c}.mode") != "160000"), F.col(f"{c}.oid"))
        here = both.select("commit", "path", file("old").alias("old_oid"), file("new").alias("new_oid")).filter("old_oid is not null or new_oid is not null")
        here = here.withColumn("status", F.when(F.col("old_oid").isNull(), "A").when(F.col("new_oid").isNull(), "D").otherwise("M")).select("commit", "path", "status", "old_oid", "new_oid")
        out = here if out is None else out.unionByName(here)
        frontier = both.filter(folder("old") | folder("new")).select("commit", "path", F.when(folder("old"), F.col("old.oid")).alias("old_tree"), F.when(folder("new"), F.col("new.oid")).alias("new_tree"))
        if frontier.isEmpty():
            return out


def with_texts(changes: DataFrame, objects: DataFrame) -> DataFrame:
    """changes with `before` and `after`, the blobs' texts; null for none and for what is no UTF-8 text."""
    content = F.when(F.is_valid_utf8(F.col("data").cast("string")) & (F.position(F.lit(b"\0"), F.col("data")) == 0), F.col("data").cast("string"))
    blobs = objects.filter("type = 'blob'").select("oid", content.alias("text"))
    for oid, name in (("old_oid", "before"), ("new_oid", "after")):
        changes = changes.join(blobs.withColumnsRenamed({"oid": oid, "text": name}), oid, "left")
    return changes


def edit_script(a: Sequence, b: Sequence) -> list[tuple[str, int, int]]:
    """(op, place in a, place in b) of a shortest script from a to b: `-` takes a's item away, `+` puts b's in.

    Myers' greedy search from both ends: the middle of a shortest path is found in space that grows with the number of
    differences, and the two halves are searched in turn. What both have at the ends is left out first.
    """
    out: list[tuple[str, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        low, high, left, right = todo.pop()
        while low < high and left < right and a[low] == b[left]:
            low, left = low + 1, left + 1
        while low < high and left < right and a[high - 1] == b[right - 1]:
            high, right = high - 1, right - 1
        if low == high or left == right:
            out += [("-", i, left) for i in range(low, high)] + [("+", low, j) for j in range(left, right)]
            continue
        x, y, u, v = _middle(a, b, low, high, left, right)
        todo += [(u, high, v, right), (low, x, left, y)]
    return sorted(out, key=lambda e: (e[1] + e[2], e[0] == "+", e[1], e[2]))


def _middle(a: Sequence, b: Sequence, low: int, high: int, left: int, right: int) -> tuple[int, int, int, int]:
    """Begin and end of the snake in the middle of a shortest path through a[low:high] and b[left:right]."""
    n, m = high - low, right - left
    delta, odd = n - m, (n - m) % 2
    ahead, back = {1: 0}, {1: 0}  # farthest places of paths, by diagonal, from either end
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1)) else ahead[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[low + x] == b[left + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if odd and -(d - 1) <= delta - k <= d - 1 and x + back.get(delta - k, -1) >= n:
                return low + x0, left + y0, low + x, left + y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[high - 1 - x] == b[right - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not odd and -d <= delta - k <= d and x + ahead.get(delta - k, -1) >= n:
                return high - x, right - y, high - x0, right - y0
    raise AssertionError("no path")


def _rows(df: DataFrame, key: list[str], before: str, after: str, schema: str, make: Callable[[list[str], list[str]], list[tuple]]) -> DataFrame:
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = [], []
            for k, (a, b) in enumerate(zip(batch.column(len(key)).to_pylist(), batch.column(len(key) + 1).to_pylist(), strict=True)):
                rows = make(lines(a), lines(b))
                found += rows
                of += [k] * len(rows)
            names = [part.split()[0] for part in schema.split(", ")]
            types = {"string": pa.string(), "int": pa.int32()}
            told = [pa.array([r[i] for r in found], types[part.split()[1]]) for i, part in enumerate(schema.split(", "))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of, pa.int64())) for c in range(len(key))), *told], names=[*key, *names])

    return df.select(*key, before, after).mapInArrow(run, f"{kinds}, {schema}")


def lines(text: str | None) -> list[str]:
    """Lines without their ends; a last line without an end counts."""
    if not text:
        return []
    parts = text.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def line_changes(df: DataFrame, key: list[str], before: str, after: str) -> DataFrame:
    """(key, op, old_line, new_line, text): each line that goes (`-`, its old number) or comes (`+`, its new number)."""

    def make(a: list[str], b: list[str]) -> list[tuple]:
        return [(op, i + 1 if op == "-" else None, j + 1 if op == "+" else None, a[i] if op == "-" else b[j]) for op, i, j in edit_script(a, b)]

    return _rows(df, key, before, after, "op string, old_line int, new_line int, text string", make)


def hunks(df: DataFrame, key: list[str], before: str, after: str, context: int = 3) -> DataFrame:
    """(key, old_start, old_count, new_start, new_count, body): stretches of changes with `context` lines around them."""

    def make(a: list[str], b: list[str]) -> list[tuple]:
        script = edit_script(a, b)
        out, at = [], 0
        while at < len(script):
            end = at + 1
            # The lines that both have between two changes; those more than twice the context apart are hunks of their own.
            while end < len(script) and script[end][1] - script[end - 1][1] - (script[end - 1][0] == "-") <= 2 * context:
                end += 1
            low, left = max(0, script[at][1] - context), script[at][2] - (script[at][1] - max(0, script[at][1] - context))
            i, j, body = low, left, []
            for op, x, y in script[at:end]:
                body += [f" {line}" for line in a[i:x]]
                i, j = x, y
                body.append(f"-{a[x]}" if op == "-" else f"+{b[y]}")
                i, j = i + (op == "-"), j + (op == "+")
            tail = min(context, len(a) - i)
            body += [f" {line}" for line in a[i : i + tail]]
            i, j = i + tail, j + tail
            out.append((low + (i > low), i - low, left + (j > left), j - left, "\n".join(body)))
            at = end
        return out

    return _rows(df, key, before, after, "old_start int, old_count int, new_start int, new_count int, body string", make)


def change_stats(changed: DataFrame, key: list[str]) -> DataFrame:
    """(key, added, removed): lines that come and go."""
    return changed.groupBy(*key).agg(F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("removed"))
