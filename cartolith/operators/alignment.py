"""Gap-tolerant alignment of token sequences: similarity, extension of exact regions, and their type."""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut_lineage

GAP, LOOKAHEAD, THRESHOLD = 5, 10, 0.7
#: Tokens of the slices of a region's ends that the first round walks over, and how many times as many each next round takes.
SLICE, FACTOR = 32, 4
#: Ends that are walked from at once in the first round; later rounds take as many tokens.
BLOCK = 4096


def agreeing(a: Sequence[int], i: int, b: Sequence[int], j: int, most: int) -> int:
    """How many of the next `most` tokens agree, runs of them compared at once."""
    n = 0
    for run in (64, 8, 1):
        while n + run <= most and a[i + n : i + n + run] == b[j + n : j + n + run]:
            n += run
    return n


def similarity(a: Sequence[int], b: Sequence[int], gap: int = GAP) -> float:
    """Matches of a greedy walk over the longer length; after a mismatch either side may skip up to `gap` tokens."""
    i = j = matched = 0
    while True:
        n = agreeing(a, i, b, j, min(len(a) - i, len(b) - j))
        i, j, matched = i + n, j + n, matched + n
        if i >= len(a) or j >= len(b):
            return matched / max(len(a), len(b), 1)
        next_b, next_a = b[j + 1 : j + 1 + gap], a[i + 1 : i + 1 + gap]
        if a[i] in next_b:
            j += 1 + next_b.index(a[i])
        elif b[j] in next_a:
            i += 1 + next_a.index(b[j])
        else:
            i, j = i + 1, j + 1


def reach(a: Sequence[int], i: int, b: Sequence[int], j: int, step: int) -> tuple[int, int]:
    """How far both sequences go on together from (i, j) in steps of 1 or -1, small gaps bridged; tokens gained on each side."""
    x, y = (a[i:], b[j:]) if step == 1 else (a[i::-1] if i >= 0 else [], b[j::-1] if j >= 0 else [])
    return walked(x, y, True, True)[:2]


def walked(a: Sequence[int], b: Sequence[int], a_ends: bool, b_ends: bool) -> tuple[int, int, int, int, bool]:
    """(tokens gained of a and b, place in a and b, whether more is needed) of a walk from the beginning of two slices.

    A slice that does not end with its file stops the walk where the next step could depend on what comes after it.
    """
    i = j = 0
    last = (0, 0)
    most_a, most_b = len(a) - (0 if a_ends else GAP), len(b) - (0 if b_ends else GAP)
    while True:
        n = agreeing(a, i, b, j, min(most_a - i, most_b - j))
        if n > 0:
            i, j = i + n, j + n
            last = (i, j)
        if (i >= most_a and not a_ends) or (j >= most_b and not b_ends):
            return *last, i, j, True
        if i >= len(a) or j >= len(b):
            return *last, i, j, False
        near_a, near_b = a[i : i + GAP + 1], b[j : j + GAP + 1]
        best = next(((da, db) for da, db in _STEPS if da < len(near_a) and db < len(near_b) and near_a[da] == near_b[db]), None) if not set(near_a).isdisjoint(near_b) else None
        if best is None:
            return *last, i, j, False
        i, j = i + best[0], j + best[1]


#: Steps over a gap, the shortest first.
_STEPS = [(da, total - da) for total in range(1, LOOKAHEAD + 1) for da in range(max(0, total - GAP), min(GAP, total) + 1)]
_KEY = ["file_a", "file_b", "start_a", "start_b", "token_count"]


def _sliced(rows: DataFrame, tokens: DataFrame, side: str, low: Column, high: Column, name: str) -> DataFrame:
    """rows with the tokens of the file of a side from `low` up to `high`, as far as the file goes; slices are cut inside the join."""
    file, first = f"file_{side}", F.greatest(F.lit(0), low)
    held = tokens.select(F.col("file").alias(file), F.col("tokens").alias("__tokens"))
    # Tokens come first: the join runs over them and keeps the rows of one file, which may lie on disk, and not copies of its tokens.
    return held.join(rows, file).select(*rows.columns, F.slice("__tokens", (first + 1).cast("int"), F.greatest(F.lit(0), high - first).cast("int")).alias(name))


def _lists(column: pa.Array) -> Iterator[array]:
    """The lists of a list column of integers."""
    offsets = column.offsets.to_pylist()
    values = array("q" if column.type.value_type == pa.int64() else "i", column.values[offsets[0] : offsets[-1]].to_numpy().tobytes())
    return (values[i - offsets[0] : j - offsets[0]] for i, j in itertools.pairwise(offsets))


_END = "gain_a int, gain_b int, at_a int, at_b int, open boolean"


def _ends(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Open ends (key, step, offsets, gains, slices of `size` tokens) to the same after the walk over their slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, n) for n in [max(1, BLOCK * SLICE // size)] for i in range(0, whole.num_rows, n)):
                out = []
                for step, ga, gb, oa, ob, a, b in zip(*(batch.column(c).to_pylist() for c in range(5, 10)), _lists(batch.column(10)), _lists(batch.column(11)), strict=True):
                    found = walked(a[::step], b[::step], len(a) < size, len(b) < size)
                    more = found[0] or found[1]
                    out.append((oa + found[0] if more else ga, ob + found[1] if more else gb, oa + found[2], ob + found[3], found[4]))
                columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], *columns], names=[*_KEY, "step", "gain_a", "gain_b", "at_a", "at_b", "open"])

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
            values = [similarity(a, b) for a, b in zip(_lists(batch.column(9)), _lists(batch.column(10)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:9], pa.array(values, pa.float64())], names=[*_GROWN, "alike"])


_GROWN = [*_KEY, "from_a", "from_b", "count_a", "count_b"]


def extend(regions: DataFrame, tokens: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Regions grown on both ends as far as they agree but for gaps, if what comes out is similar enough; else as they were.

    Files' tokens are dealt by file and written once; every join with them moves only the regions' ends, with slices of
    the tokens next to them. Most walks end within the first SLICE tokens; what goes on gets slices FACTOR times as long in
    another round, so rounds are as many as the logarithm of the longest walk. The similarity of what has grown is counted
    over those stretches alone, so a region moves as many tokens as it compares, however long the files.
    """
    n = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = cut_lineage(tokens.select("file", "tokens").repartition(n, "file").sortWithinPartitions("file"))
    types = ", ".join(f"{c} {regions.schema[c].dataType.simpleString()}" for c in _KEY)
    start = F.when(F.col("step") == 1, F.col("token_count")).otherwise(-1)
    zero = [F.lit(0).alias(c) for c in ("gain_a", "gain_b", "at_a", "at_b")]
    active = regions.select(*_KEY, F.explode(F.array(F.lit(1), F.lit(-1))).alias("step")).select(*_KEY, "step", *zero)
    done, size = None, SLICE
    while True:
        for side in ("a", "b"):
            at = F.col(f"start_{side}") + start + F.col("step") * F.col(f"at_{side}")
            low = F.when(F.col("step") == 1, at).otherwise(at - size + 1)
            active = _sliced(active, tokens, side, low, low + size, f"slice_{side}")
        active = cut_lineage(active.mapInArrow(_ends(size), f"{types}, step int, {_END}"))
        ended = active.filter("not open").drop("open", "at_a", "at_b")
        done = ended if done is None else done.unionByName(ended)
        active, size = active.filter("open").drop("open"), size * FACTOR
        if active.isEmpty():
            break
    gain = lambda side, step: F.max(F.when(F.col("step") == step, F.col(f"gain_{side}")))
    grown = done.groupBy(*_KEY).agg(gain("a", -1).alias("back_a"), gain("b", -1).alias("back_b"), gain("a", 1).alias("ahead_a"), gain("b", 1).alias("ahead_b"))
    grown = cut_lineage(grown.select(*_KEY, *((F.col(f"start_{s}") - F.col(f"back_{s}")).alias(f"from_{s}") for s in "ab"), *((F.col("token_count") + F.col(f"back_{s}") + F.col(f"ahead_{s}")).alias(f"count_{s}") for s in "ab")))
    longer = (F.col("count_a") > F.col("token_count")) | (F.col("count_b") > F.col("token_count"))
    compared = grown.filter(longer)
    for side in ("a", "b"):
        compared = _sliced(compared, tokens, side, F.col(f"from_{side}"), F.col(f"from_{side}") + F.col(f"count_{side}"), f"part_{side}")
    compared = compared.mapInArrow(_alike, f"{types}, from_a int, from_b int, count_a int, count_b int, alike double")
    out = compared.unionByName(grown.filter(~longer).withColumn("alike", F.lit(None).cast("double"))).withColumn("gapped", F.coalesce(F.col("alike") >= threshold, F.lit(False)))
    pick = lambda new, old: F.when(F.col("gapped"), F.col(new)).otherwise(F.col(old)).cast("int")
    return out.select(
        "file_a", "file_b", pick("from_a", "start_a").alias("start_a"), pick("from_b", "start_b").alias("start_b"), pick("count_a", "token_count").alias("count_a"), pick("count_b", "token_count").alias("count_b"),
        F.when(F.col("gapped"), F.col("alike")).otherwise(1.0).alias("similarity"), F.when(F.col("gapped"), "gapped").otherwise("exact").alias("clone_type"),
    )
