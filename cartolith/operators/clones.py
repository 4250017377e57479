"""Clone detection: window hashes joined on themselves, islands on diagonals, hotspots and totals.

Only hashes that two to MOST_LOCATIONS windows have are paired, which is part of the operator's definition. Windows are
dealt by hash, and of their pairs only those that begin or end a run of pairs on a diagonal leave the task.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions.hashing import FNV_MASK, FNV_OFFSET, FNV_PRIME, WINDOW, WINDOW_BASE, WINDOW_MODULUS, fnv1a_32, window_hashes

from cartolith.llm.common import Scratch

from .graph import cut_lineage

MOST_LOCATIONS, MIN_TOKENS, GAP = 500, 30, 5


def tokens(files: DataFrame, text: str, key: str) -> DataFrame:
    """(file, tokens): hashes of the words of lower-cased text, each distinct word hashed where it stands."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), F.lit(0))
    return files.select(F.col(key).alias("file"), F.transform(words, fnv1a_32).alias("tokens"))


def windows(token_table: DataFrame, width: int = WINDOW) -> DataFrame:
    """(file, pos, hash) of every window."""
    return token_table.select("file", F.posexplode(window_hashes(F.col("tokens"), width)).alias("pos", "hash"))


#: Kinds of tokens that take no part in similarity.
STRUCTURAL = ("newline", "indent", "dedent")


def code_windows(code: DataFrame, width: int = WINDOW) -> DataFrame:
    """(file, pos, hash, start_line, end_line) of every window over tokens (file, place, kind, hash, line).

    Structural tokens go first, so `pos` counts the others, and a window's lines are those of its first and last token.
    """
    kept = code.filter(~F.col("kind").isin(*STRUCTURAL))
    files = kept.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "hash", "line"))).alias("t"))
    # Lines are put to the windows before these are rows: a row that carried its file's lines would cost the file's length.
    line = lambda i: F.get(F.col("t.line"), i)
    found = F.transform(window_hashes(F.col("t.hash"), width), lambda h, i: F.struct(i.alias("pos"), h.alias("hash"), line(i).alias("start_line"), line(i + (width - 1)).alias("end_line")))
    return files.select("file", F.explode(found).alias("w")).select("file", "w.*")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FNV-1a of byte slices, all slices a byte further at each step."""
    out = np.full(len(starts), FNV_OFFSET, dtype=np.uint64)
    live, k = np.arange(len(starts)), 0
    while len(live):
        live = live[starts[live] + k < ends[live]]
        out[live] = ((out[live] ^ data[starts[live] + k]) * np.uint64(FNV_PRIME)) & np.uint64(FNV_MASK)
        k += 1
    return out


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of `width` values, by joining hashes of shorter runs."""
    modulus, have, out, done = np.uint64(WINDOW_MODULUS), values % np.uint64(WINDOW_MODULUS), None, 0
    size = 1
    while True:
        if width & size:
            if out is None:
                out, done = have, size
            else:  # the shorter runs hashed so far follow one of `size` values
                n = len(have) - done
                if n <= 0:
                    return np.zeros(0, np.uint64)
                m = min(n, len(out) - size)
                out, done = (have[:m] * np.uint64(pow(WINDOW_BASE, done, WINDOW_MODULUS)) + out[size : size + m]) % modulus, done + size
        size *= 2
        if size > width:
            return out
        half = size // 2
        if len(have) <= half:
            return np.zeros(0, np.uint64)
        have = (have[:-half] * np.uint64(pow(WINDOW_BASE, half, WINDOW_MODULUS)) + have[half:]) % modulus


#: Windows with the hashes of the windows one place before and after (-1: none).
_BESIDE = ["file", "pos", "hash", "before", "after"]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
#: Blocks of windows: so many buckets of hashes, and so many windows that a task deals out at once.
BUCKETS, DEALT = 2048, 1 << 21


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, first, hashes, lines) of (key, lower-cased text), some rows at a time: hashes of all words, the place of each
    row's first word among them and, at the end, of none; and the line of its text, from 1, that each word lies in."""
    for batch in batches:
        column = batch.column(1).fill_null("")
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, raw = column.buffers()
        offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        data, offs = data[offs[0] : offs[-1]] if len(offs) else data, offs - offs[0]
        for i in range(0, len(column), 512):
            j = min(i + 512, len(column))
            part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            letter = np.zeros(len(part) + 1, dtype=bool)
            letter[:-1] = (part >= 97) & (part <= 122)
            before = np.concatenate([[False], letter[:-1]])
            before[o] = False
            follows = np.concatenate([letter[1:], [False]])
            follows[o[1:][o[1:] > 0] - 1] = False
            starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~follows) + 1
            first = np.searchsorted(starts, o)
            breaks = np.flatnonzero(part == 10)
            lines = 1 + np.searchsorted(breaks, starts) - np.repeat(np.searchsorted(breaks, o[:-1]), np.diff(first))
            yield batch.column(0)[i:j], first, word_hashes(part, starts, ends), lines


def _hashed(batches: Iterator[pa.RecordBatch], width: int, beside: bool = False, lined: bool = False) -> Iterator[list[pa.Array]]:
    """Columns of the windows of (key, lower-cased text), whole batches hashed at once. beside: with the hashes of the windows
    one place before and after; lined: with the lines of the first and last word."""
    for keys, first, words, lines in _spelled(batches):
        hashes = rolled(words, width)
        doc = np.repeat(np.arange(len(keys)), np.diff(first))
        at = np.flatnonzero(doc[: len(hashes)] == doc[width - 1 : width - 1 + len(hashes)])
        out = [keys.take(pa.array(doc[at])), pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(hashes[at].astype(np.int64))]
        if beside:
            near, own = (np.full(len(hashes) + 2, -1, dtype=np.int64) for _ in range(2))
            near[at + 1], own[at + 1] = hashes[at], doc[at]
            out += [pa.array(np.where(own[at + d] == doc[at], near[at + d], -1).astype(np.int32)) for d in (0, 2)]
        if lined:
            out += [pa.array(lines[at + d].astype(np.int32)) for d in (0, width - 1)]
        yield out


def _of_text(files: DataFrame, text: str, key: str) -> tuple[DataFrame, str]:
    return files.select(key, F.lower(F.col(text)).alias("__text")), files.schema[key].dataType.simpleString()


def text_tokens(files: DataFrame, text: str, key: str) -> DataFrame:
    """(file, tokens): as `tokens`, whole Arrow batches hashed at once; the hashes are signed, so that a token has four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, first, words, _ in _spelled(batches):
            values = pa.array(words.astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)], names=["file", "tokens"])

    texts, key_type = _of_text(files, text, key)
    return texts.mapInArrow(run, f"file {key_type}, tokens array<int>")


def text_windows(files: DataFrame, text: str, key: str, width: int = WINDOW) -> DataFrame:
    """(file, pos, hash) of every window of words of lower-cased text.

    The same hashes as `windows(tokens(...))`; whole Arrow batches are hashed at once, which measured several times faster
    than the nested higher-order functions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _hashed(batches, width):
            yield pa.RecordBatch.from_arrays(columns, names=_BESIDE[:3])

    texts, key_type = _of_text(files, text, key)
    return texts.mapInArrow(run, f"file {key_type}, pos int, hash bigint")


def text_window_lines(files: DataFrame, text: str, key: str, width: int = WINDOW) -> DataFrame:
    """(file, pos, hash, start_line, end_line) of every window of words of lower-cased text: as `code_windows` of its words and
    line ends, but in one pass over the texts, which are neither dealt by file nor sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _hashed(batches, width, lined=True):
            yield pa.RecordBatch.from_arrays(columns, names=[*_BESIDE[:3], "start_line", "end_line"])

    texts, key_type = _of_text(files, text, key)
    return texts.mapInArrow(run, f"file {key_type}, pos int, hash bigint, start_line int, end_line int")


def _lists(bucket: np.ndarray, columns: list[pa.Array], order: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket with lists of its rows' values; order: rows by bucket."""
    if not len(order):
        return
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
    bounds = pa.array(np.append(cuts, len(order)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, c.take(pa.array(order))) for c in columns]
    whole = pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts].astype(np.int32)), *lists], names=["bucket", *names])
    yield from (whole.slice(i, 512) for i in range(0, len(cuts), 512))


def window_blocks(files: DataFrame, text: str, key: str, width: int = WINDOW) -> DataFrame:
    """(bucket, file, pos, hash, before, after), the last five lists: windows and those beside them, by bucket of their hash.

    A row holds what a task found of a bucket among some million windows, so few and compact rows travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt() -> Iterator[pa.RecordBatch]:
            columns = [pa.concat_arrays(c) for c in zip(*have, strict=True)]
            columns[2] = columns[2].cast(pa.int32())
            bucket = (columns[2].to_numpy() % BUCKETS).astype(np.int16)
            yield from _lists(bucket, columns, np.argsort(bucket, kind="stable"), _BESIDE)

        have, n = [], 0
        for columns in _hashed(batches, width, beside=True):
            have.append(columns)
            n += len(columns[0])
            if n >= DEALT:
                yield from dealt()
                have, n = [], 0
        if have:
            yield from dealt()

    texts, key_type = _of_text(files, text, key)
    return texts.mapInArrow(run, f"bucket int, file array<{key_type}>, pos array<int>, hash array<int>, before array<int>, after array<int>")


def index_stats(window_table: DataFrame) -> DataFrame:
    """Files, distinct hashes, locations, hashes seen more than once and the most locations of a hash."""
    per = window_table.groupBy("hash").agg(F.count("*").alias("n"))
    totals = per.agg(F.count("*").alias("hashes"), F.sum("n").alias("locations"), F.sum((F.col("n") > 1).cast("long")).alias("duplicate_hashes"), F.max("n").alias("max_per_hash"))
    return totals.withColumn("files", window_table.agg(F.countDistinct("file")).scalar())


def pairs(window_table: DataFrame, width: int = WINDOW, most: int = MOST_LOCATIONS) -> DataFrame:
    """(file_a, pos_a, file_b, pos_b) of equal windows, a before b, overlapping windows of one file left out."""
    # One exchange serves the count and both sides of the join.
    dealt = window_table.repartition("hash")
    shared = dealt.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n").between(2, most)).select("hash")
    kept = dealt.join(shared, "hash", "left_semi")
    a = kept.select("hash", F.col("file").alias("file_a"), F.col("pos").alias("pos_a"))
    b = kept.select("hash", F.col("file").alias("file_b"), F.col("pos").alias("pos_b"))
    later = (F.col("file_a") < F.col("file_b")) | ((F.col("file_a") == F.col("file_b")) & (F.col("pos_a") + (width - 1) < F.col("pos_b")))
    return a.join(b, "hash").filter(later).select("file_a", "pos_a", "file_b", "pos_b")


def _flat(group: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in group.column(name).chunks]) if group.num_rows else pa.array([], group.schema.field(name).type.value_type)


def _crowds(most: int) -> Callable[[pa.Table], pa.Table]:
    """Blocks of a bucket to (bucket, hash, crowd) lists: hashes beside windows of a hash that has too many, by their bucket."""

    def run(group: pa.Table) -> pa.Table:
        hashes = _flat(group, "hash").to_numpy()
        _, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
        many = np.flatnonzero(n[at] > most)
        beside = np.concatenate([_flat(group, c).to_numpy()[many] for c in ("before", "after")]).astype(np.int64)
        pairs = np.unique((beside << 32 | np.tile(hashes[many], 2))[beside >= 0])
        hit, crowd = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        bucket = (hit % BUCKETS).astype(np.int32)
        schema = pa.schema([("bucket", pa.int32()), ("hash", pa.list_(pa.int32())), ("crowd", pa.list_(pa.int32()))])
        out = [pa.Table.from_batches([b]) for b in _lists(bucket, [pa.array(hit), pa.array(crowd)], np.argsort(bucket, kind="stable"), ["hash", "crowd"])]
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return run


def _ends_of_runs(width: int, most: int) -> Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]:
    """A bucket's blocks, and the crowds beside its windows, to the ends of runs of pairs of its windows."""

    def run(group: pa.Table, crowds: pa.Table) -> Iterator[pa.RecordBatch]:
        hashes = _flat(group, "hash").to_numpy()
        _, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
        names = _flat(group, "file")  # windows of a null file count, but are paired with none
        rows = np.flatnonzero((n[at] > 1) & (n[at] <= most) & names.is_valid().to_numpy(zero_copy_only=False))
        hashes, pos, before, after = hashes[rows], *(_flat(group, c).to_numpy()[rows] for c in ("pos", "before", "after"))
        names = names.take(pa.array(rows))
        file = names.to_numpy() if pa.types.is_integer(names.type) else pc.rank(names, tiebreaker="dense").to_numpy()
        order = np.lexsort((pos, file, hashes))
        hashes, pos, before, after, file, names = hashes[order].astype(np.int64), pos[order], before[order], after[order], file[order], names.take(pa.array(order))
        if crowds.num_rows:
            crowded = _flat(crowds, "hash").to_numpy().astype(np.int64) << 32 | _flat(crowds, "crowd").to_numpy()
            before, after = (np.where(np.isin(hashes << 32 | side.astype(np.int64), crowded), -1, side) for side in (before, after))
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(hashes) != 0])) if len(hashes) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(cuts, len(hashes)))
        left = np.repeat(cuts + sizes, sizes) - np.arange(len(hashes)) - 1  # windows of the same hash that follow
        found, waiting, k, a = [], 0, 1, np.flatnonzero(left > 0)
        while len(a):
            b = a + k
            first = (before[a] < 0) | (before[a] != before[b])
            last = (after[a] < 0) | (after[a] != after[b])
            some = np.flatnonzero((first | last) & ((file[a] != file[b]) | (pos[a] + (width - 1) < pos[b])))
            found.append((a[some], b[some], first[some], last[some]))
            waiting, k = waiting + len(some), k + 1
            a = a[left[a] >= k]
            if waiting > 1 << 16 or not len(a):
                x, y, f, t = (np.concatenate(c) for c in zip(*found, strict=True))
                found, waiting = [], 0
                yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), pa.array(pos[x]), names.take(pa.array(y)), pa.array(pos[y]), pa.array(f), pa.array(t)], names=["file_a", "pos_a", "file_b", "pos_b", "first", "last"])

    return run


def run_ends(blocks: DataFrame, width: int = WINDOW, most: int = MOST_LOCATIONS) -> DataFrame:
    """(file_a, pos_a, file_b, pos_b, first, last): of `pairs`, those that begin or end a run of pairs one place apart.

    blocks: of `window_blocks`. Inside a run both windows before have equal hashes, and so have both after, so only pairs
    whose neighbours differ leave their task: a passage costs the ends of its runs, not a row a token. A neighbour whose hash
    has too many windows to be paired ends a run too; such hashes are told to the buckets of the hashes beside them.
    """
    file_type = blocks.schema["file"].dataType.elementType.simpleString()
    crowds = blocks.groupBy("bucket").applyInArrow(_crowds(most), "bucket int, hash array<int>, crowd array<int>")
    find = _ends_of_runs(width, most)
    schema = pa.schema([("file_a", _ARROW.get(file_type, pa.string())), ("pos_a", pa.int32()), ("file_b", _ARROW.get(file_type, pa.string())), ("pos_b", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])

    def run(group: pa.Table, beside: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(find(group, beside)), schema) if group.num_rows else schema.empty_table()

    return blocks.groupBy("bucket").cogroup(crowds.groupBy("bucket")).applyInArrow(run, f"file_a {file_type}, pos_a int, file_b {file_type}, pos_b int, first boolean, last boolean")


def pair_counts(ends: DataFrame) -> DataFrame:
    """(file_a, file_b, n): how many pairs of windows two files have, from `run_ends`."""
    length = F.when(F.col("last"), F.col("pos_a") + 1).otherwise(0) - F.when(F.col("first"), F.col("pos_a")).otherwise(0)
    return ends.groupBy("file_a", "file_b").agg(F.sum(length).alias("n"))


def islands(pair_table: DataFrame, width: int = WINDOW, gap: int = GAP, least: int = 0) -> DataFrame:
    """Regions: runs of window pairs on one diagonal whose starts are at most window + gap apart. Pairs are all of `pairs`, or `run_ends`."""
    diagonal = pair_table.withColumn("diagonal", F.col("pos_b") - F.col("pos_a"))
    key = ["file_a", "file_b", "diagonal"]
    w = Window.partitionBy(*key).orderBy("pos_a")
    apart = F.col("pos_a") - F.lag("pos_a").over(w) > width - 1 + gap
    if "first" in pair_table.columns:  # what follows the first pair of a run, up to the last, belongs to it
        apart = apart & F.col("first")
    new = F.coalesce(apart.cast("int"), F.lit(1))
    numbered = diagonal.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = numbered.groupBy(*key, "island").agg(F.min("pos_a").alias("start_a"), F.max("pos_a").alias("last_a"))
    out = out.withColumn("token_count", F.col("last_a") - F.col("start_a") + width)
    return out.filter(F.col("token_count") >= least).select("file_a", "file_b", "start_a", (F.col("start_a") + F.col("diagonal")).alias("start_b"), "token_count")


def classify(regions: DataFrame, words: DataFrame) -> DataFrame:
    """exact if the regions' words agree as written, else renamed. words: (file, words).

    Each end is cut from its file at once and only its digest travels on, so no file's words are carried to its regions.
    """
    key = regions.columns
    end = lambda side: F.struct(F.col(f"file_{side}").alias("file"), F.col(f"start_{side}").alias("start"))
    ends = regions.select(*key, F.explode(F.array(end("a"), end("b"))).alias("e"))
    cut = F.array_join(F.slice("words", F.col("start") + 1, F.col("token_count")), " ")
    digests = ends.select(*key, "e.*").join(words, "file").select(*key, F.sha2(cut, 256).alias("digest"))
    return digests.groupBy(*key).agg(F.when(F.min("digest") == F.max("digest"), "exact").otherwise("renamed").alias("clone_type"))


def classify_grown(regions: DataFrame, words: DataFrame) -> DataFrame:
    """As `classify`, for regions (file_a, file_b, start_a, start_b, count_a, count_b) whose ends may differ in length; those are renamed."""
    key = regions.columns
    end = lambda side: F.struct(F.col(f"file_{side}").alias("file"), F.col(f"start_{side}").alias("start"), F.col(f"count_{side}").alias("size"))
    same = regions.filter("count_a = count_b")
    ends = same.select(*key, F.explode(F.array(end("a"), end("b"))).alias("e"))
    cut = F.array_join(F.slice("words", F.col("start") + 1, F.col("size")), " ")
    digests = ends.select(*key, "e.*").join(words, "file").select(*key, F.sha2(cut, 256).alias("digest"))
    told = digests.groupBy(*key).agg(F.when(F.min("digest") == F.max("digest"), "exact").otherwise("renamed").alias("clone_type"))
    return told.unionByName(regions.filter("count_a <> count_b").withColumn("clone_type", F.lit("renamed")))


def hotspots(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per file: regions (a region within one file counts twice), distinct duplicated tokens and their share."""
    regions = cut_lineage(regions)  # read twice
    ends = regions.select(F.explode(F.array(F.struct(F.col("file_a").alias("file"), F.col("start_a").alias("start"), "token_count"), F.struct(F.col("file_b").alias("file"), F.col("start_b").alias("start"), "token_count"))).alias("e")).select("e.*")
    counts = ends.groupBy("file").agg(F.count("*").alias("clone_count"))
    merged = covered(ends)
    return counts.join(merged, "file").join(sizes, "file").select("file", "clone_count", "duplicated", "total", (F.col("duplicated") / F.col("total")).alias("score"))


def covered(spans: DataFrame) -> DataFrame:
    """(file, duplicated): length of the union of each file's spans, by a sweep that makes no row per token."""
    end = F.col("start") + F.col("token_count")
    w = Window.partitionBy("file").orderBy("start", "token_count").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(end).over(w), F.lit(0))
    fresh = F.greatest(end - F.greatest(F.col("start"), reach), F.lit(0))
    return spans.distinct().withColumn("fresh", fresh).groupBy("file").agg(F.sum("fresh").alias("duplicated"))


def multiset_jaccard(a: DataFrame, b: DataFrame, key_a: str, key_b: str, word: str) -> DataFrame:
    """Sum of the lesser counts of shared words over all words less that sum, for every pair that shares a word."""
    ca, cb = a.groupBy(key_a, word).agg(F.count("*").alias("na")), b.groupBy(key_b, word).agg(F.count("*").alias("nb"))
    ta, tb = a.groupBy(key_a).agg(F.count("*").alias("ta")), b.groupBy(key_b).agg(F.count("*").alias("tb"))
    shared = ca.join(cb, word).groupBy(key_a, key_b).agg(F.sum(F.least("na", "nb")).alias("shared"))
    return shared.join(ta, key_a).join(tb, key_b).select(key_a, key_b, "shared", (F.col("shared") / (F.col("ta") + F.col("tb") - F.col("shared"))).alias("jaccard"))


def _compared(key_a: str, key_b: str, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Two groups of (key, lower-cased text) to every pair that shares a word."""

    def counts(group: pa.Table, key: str) -> dict[object, Counter]:
        out: dict[object, Counter] = {}
        for k, text in zip(group.column(key).to_pylist(), group.column("words").to_pylist(), strict=True):
            out.setdefault(k, Counter()).update(re.findall("[a-z]+", text or ""))
        return out

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        items = counts(right, key_b)
        most = functools.reduce(operator.or_, items.values(), Counter())  # the greatest count of each word
        first = dict(zip(most, itertools.accumulate(most.values(), initial=0), strict=False))
        # A row for the first, second, ... token of a word, a column an item: shared tokens are sums of rows.
        has = np.zeros((most.total(), len(items)), dtype=np.uint8)
        for i, words in enumerate(items.values()):
            for w, n in words.items():
                has[first[w] : first[w] + n, i] = 1
        sizes = np.array([c.total() for c in items.values()], dtype=np.int64)
        keys, at, shared, jaccard = [], [], [], []
        for k, words in counts(left, key_a).items():
            rows = [r for w, n in words.items() if w in first for r in range(first[w], first[w] + min(n, most[w]))]
            both = has[rows].sum(0, dtype=np.int64)
            hit = np.flatnonzero(both)
            keys += [k] * len(hit)
            at.append(hit)
            shared.append(both[hit])
            jaccard.append(both[hit] / (words.total() + sizes[hit] - both[hit]))
        if not keys:
            return schema.empty_table()
        ids = pa.array(list(items), schema.field(key_b).type).take(pa.array(np.concatenate(at)))
        return pa.Table.from_arrays([pa.array(keys, schema.field(key_a).type), ids, pa.array(np.concatenate(shared)), pa.array(np.concatenate(jaccard))], schema=schema)

    return run


def text_jaccard(a: DataFrame, b: DataFrame, key_a: str, key_b: str, text: str, side: int = 1024) -> DataFrame:
    """`multiset_jaccard` of the words [a-z]+ of lower-cased texts: shared and jaccard of every pair that shares a word.

    Both sides are dealt into about `side` keys a group, and each group of one meets each of the other, so a text travels
    once for each group of the other side and no row is made for a word that two texts share.
    """
    na, nb = (max(1, -(-t.count() // side)) for t in (a, b))
    texts = lambda t, key: t.filter(F.col(key).isNotNull()).select(key, F.lower(text).alias("words"))
    part, every = lambda key, n: F.pmod(F.hash(key), F.lit(n)), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = texts(a, key_a).select("*", part(key_a, na).alias("x"), every(nb).alias("y"))
    right = texts(b, key_b).select("*", part(key_b, nb).alias("y"), every(na).alias("x"))
    kinds = [t.schema[k].dataType.simpleString() for t, k in ((a, key_a), (b, key_b))]
    schema = pa.schema([(key_a, _ARROW[kinds[0]]), (key_b, _ARROW[kinds[1]]), ("shared", pa.int64()), ("jaccard", pa.float64())])
    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(_compared(key_a, key_b, schema), f"{key_a} {kinds[0]}, {key_b} {kinds[1]}, shared bigint, jaccard double")


def _prefixes(counts: DataFrame, key: str, word: str, seldom: DataFrame, least: float) -> DataFrame:
    """(key, word, before, total) of the words of each prefix: the rarest words, as many tokens as a similar multiset can't all lack."""
    w = Window.partitionBy(key).orderBy("seldom", word)
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = counts.join(seldom, word).withColumns({"before": upto - F.col("n"), "total": F.sum("n").over(Window.partitionBy(key))})
    return rows.filter(F.col("before") < F.col("total") - F.ceil(F.col("total") * least - 1e-9) + 1).select(key, word, "before", "total")


def similar(a: DataFrame, b: DataFrame, key_a: str, key_b: str, word: str, least: float) -> DataFrame:
    """All pairs of multisets (key, word: a row a token) whose Jaccard similarity is `least` or more: shared, jaccard.

    Words are ordered by how many multisets have them, rarest first. Similar multisets share a word among the first
    size - ceil(least * size) + 1 tokens of each, so only these prefixes are joined, where frequent words seldom are. Sizes
    and the tokens left after a shared word bound the similarity and drop most candidates; the rest are counted in full.
    """
    ca, cb = a.groupBy(key_a, word).agg(F.count("*").alias("n")), b.groupBy(key_b, word).agg(F.count("*").alias("n"))
    seldom = ca.select(word).unionByName(cb.select(word)).groupBy(word).agg(F.count("*").alias("seldom"))
    pa, pb = _prefixes(ca, key_a, word, seldom, least), _prefixes(cb, key_b, word, seldom, least)
    pairs = pa.withColumnsRenamed({"before": "before_a", "total": "total_a"}).join(pb.withColumnsRenamed({"before": "before_b", "total": "total_b"}), word)
    if key_a == key_b:
        raise ValueError("the keys of both sides need different names")
    low = least - 1e-9
    sized = (F.col("total_b") >= F.col("total_a") * low) & (F.col("total_a") >= F.col("total_b") * low)
    enough = F.least(F.col("total_a") - F.col("before_a"), F.col("total_b") - F.col("before_b")) >= (F.col("total_a") + F.col("total_b")) * (low / (1 + low))
    pairs = pairs.filter(sized & enough).select(key_a, key_b, "total_a", "total_b").distinct()
    shared = pairs.join(ca.withColumnRenamed("n", "na"), key_a).join(cb.withColumnRenamed("n", "nb"), [key_b, word])
    shared = shared.groupBy(key_a, key_b, "total_a", "total_b").agg(F.sum(F.least("na", "nb")).alias("shared"))
    jaccard = F.col("shared") / (F.col("total_a") + F.col("total_b") - F.col("shared"))
    return shared.select(key_a, key_b, "shared", jaccard.alias("jaccard")).filter(F.col("jaccard") >= least)


def multiset_classes(tokens: DataFrame, key: str, word: str) -> DataFrame:
    """(key, class_id): the least key with the same multiset of words, told apart by four sums of hashes of (word, count)."""
    counts = tokens.groupBy(key, word).agg(F.count("*").alias("n"))
    hashes = [F.sum(part(F.xxhash64(word, "n", F.lit(seed)))).alias(f"h{k}") for k, (seed, part) in enumerate((s, p) for s in (1, 2) for p in (lambda h: F.shiftrightunsigned(h, 32), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))))]
    names = [f"h{k}" for k in range(4)]
    sums = counts.groupBy(key).agg(*hashes)
    classes = sums.groupBy(*names).agg(F.min(key).alias("class_id"))
    return sums.join(classes.hint("shuffle_hash"), names).select(key, "class_id")


#: Words that most rows of `similar_classes` have are ordered by how many have them: so many words at most.
FREQUENT = 1 << 19


def bags(tokens: DataFrame, key: str, word: str) -> DataFrame:
    """(key, hashes, counts): each multiset in one row, its words as 64-bit hashes in order."""
    counts = tokens.select(key, F.xxhash64(word).alias("h")).repartition(key).groupBy(key, "h").agg(F.count("*").cast("int").alias("n"))
    bag = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("h", "n"))).alias("bag"))
    return bag.select(key, F.col("bag.h").alias("hashes"), F.col("bag.n").alias("counts"))


def _rows_of(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    column = batch.column(name)
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return (values[i:j] for i, j in itertools.pairwise(offsets))


def _bag_prefixes(frequent: np.ndarray, seldom: np.ndarray, least: float, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bags to the words of their prefixes, with the bag's block, told by the first of these. frequent: hashes of frequent
    words in order, seldom: how many bags have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (hashes, n) in enumerate(zip(_rows_of(batch, "hashes"), _rows_of(batch, "counts"), strict=True)):
                rank = np.zeros(len(hashes), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
                    rank = np.where(frequent[at] == hashes, seldom[at], 0)
                order = np.lexsort((hashes, rank))
                total, before = int(n.sum()), np.cumsum(n[order]) - n[order]
                order = order[: np.searchsorted(before, total - math.ceil(total * least - 1e-9) + 1)]
                block = int(hashes[order[0]]) % blocks
                found.append((np.full(len(order), i), hashes[order], before[: len(order)], np.full(len(order), total), np.full(len(order), block)))
            if found:
                row, h, before, total, block = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(h), pa.array(before.astype(np.int32)), pa.array(total.astype(np.int32)), pa.array(block.astype(np.int32))], names=["id", "h", "before", "total", "block"])

    return run


def _bags_shared(least: float, kind: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pairs of a cell and the bags that it needs to those pairs that are similar enough."""
    schema = pa.schema([("a", _ARROW[kind]), ("b", _ARROW[kind]), ("jaccard", pa.float64())])

    def run(pairs: pa.Table, have: pa.Table) -> pa.Table:
        have = [b for b in have.combine_chunks().to_batches()]
        bag = {k: (h, n) for b in have for k, h, n in zip(b.column("id").to_pylist(), _rows_of(b, "hashes"), _rows_of(b, "counts"), strict=True)}
        size, out = {k: int(n.sum()) for k, (_, n) in bag.items()}, []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            (x, m), (y, n) = bag[a], bag[b]
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)  # both are in order
            both = y[at] == x
            shared = int(np.minimum(m[both], n[at[both]]).sum())
            jaccard = shared / (size[a] + size[b] - shared)
            if jaccard >= least:
                out.append((a, b, jaccard))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(3)], schema=schema)

    return run


#: Bags of `similar_classes` are dealt into blocks of about so many words; pairs of two blocks are a cell.
BLOCK_WORDS = 1 << 19


def similar_classes(tokens: DataFrame, key: str, word: str, least: float) -> DataFrame:
    """(key, class_id, n_links, best_id, jaccard): for every multiset its class of equal ones, how many other classes are
    similar to it, and the most similar of them, the least id among equals. Copies are never paired with each other.

    As `similar`, by prefixes, but a multiset is one row of 64-bit hashes of words, from which its prefix is cut where it
    lies. Any one order of words finds all pairs; only the most frequent words, at most FREQUENT however many there are, are
    ordered by how many multisets have them. Multisets are dealt into blocks by the rarest of their words, which similar ones
    mostly share; a multiset travels once to each pair of blocks that has candidates with it, not once a candidate.
    """
    scratch = Scratch(tokens.sparkSession, "similar")
    whole = scratch.write(bags(tokens, key, word))
    kind = whole.schema[key].dataType.simpleString()
    told = cut_lineage(whole.select(key, F.unhex(F.sha2(F.to_json(F.struct("hashes", "counts")), 256)).alias("told")))
    classes = told.join(told.groupBy("told").agg(F.min(key).alias("class_id")).hint("shuffle_hash"), "told").select(key, "class_id")
    one = scratch.write(whole.join(classes.filter(F.col(key) == F.col("class_id")).select(key).hint("merge"), key, "left_semi").select(F.col(key).alias("id"), "hashes", "counts"))
    scratch.drop(whole)
    words = one.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("n")).first()["n"]
    often, blocks = words / FREQUENT, -(-words // BLOCK_WORDS) or 1
    common = one.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > often).orderBy("h").toPandas()  # fewer than FREQUENT
    prefix = one.mapInArrow(_bag_prefixes(common["h"].to_numpy(np.int64), common["n"].to_numpy(np.int64), least, blocks), f"id {kind}, h bigint, before int, total int, block int")
    a, b = (prefix.select("h", *(F.col(c).alias(n) for c, n in (("id", x), ("before", f"before_{x}"), ("total", f"total_{x}"), ("block", y)))).hint("merge") for x, y in ("ax", "by"))
    low = least - 1e-9
    sized = (F.col("total_b") >= F.col("total_a") * low) & (F.col("total_a") >= F.col("total_b") * low)
    enough = F.least(F.col("total_a") - F.col("before_a"), F.col("total_b") - F.col("before_b")) >= (F.col("total_a") + F.col("total_b")) * (low / (1 + low))
    pairs = scratch.write(a.join(b, "h").filter((F.col("a") < F.col("b")) & sized & enough).select("a", "b", "x", "y").distinct())
    cell = [F.col("x").alias("u"), F.col("y").alias("v")]
    needed = pairs.select(F.col("a").alias("id"), *cell).unionByName(pairs.select(F.col("b").alias("id"), *cell)).distinct().join(one.hint("merge"), "id")
    links = scratch.write(pairs.groupBy("x", "y").cogroup(needed.groupBy("u", "v")).applyInArrow(_bags_shared(least, kind), f"a {kind}, b {kind}, jaccard double"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    best = both.groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("n_links"), F.min(F.struct((-F.col("jaccard")).alias("less"), "b")).alias("m"))
    out = classes.join(best.hint("shuffle_hash"), "class_id", "left")
    return out.select(key, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("m.b").alias("best_id"), (-F.col("m.less")).alias("jaccard"))
