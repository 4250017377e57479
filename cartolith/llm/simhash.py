"""SimHash components by tiled exact comparison.

A fingerprint has a bit set where more than half of a document's word shingles, repeats included, have it set in their
XXH64. Equal fingerprints are one class, named by its smallest id. Classes are dealt into blocks by the population count
of their fingerprint; two blocks meet in a cell, one task's work, if their counts differ by no more than the radius. In a
cell both blocks are sorted by the population counts of their halves, quarters and bytes and cut into tiles; a pair of
tiles is skipped if the counts of its parts, as intervals, differ by more than the radius in sum, since each differing bit
changes one part's count by one. All other pairs of tiles are compared in full: exclusive-or, then a bit count. What leaves
a cell is a spanning forest of its links, fewer rows than it has members, and stars are contracted over all forests.

No link is missed, and no bucket can grow hot. The comparisons grow with the square of the number of different
fingerprints, less what the counts skip; blocks have at most BLOCK members, so a cell's work and memory are bounded.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like any other; rows with a null id
have a fingerprint, link nothing, and are in no component (component_id null); rows of one id are one document, linked
with whatever any of its texts is linked with; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import Scratch, partitions_for, skewed_join, text_or_empty
from .components import components

WIDTH, RADIUS, SEED = 4, 4, 42
#: Members of a block at most, and about how many blocks a smaller set of fingerprints is dealt into.
BLOCK, BLOCKS, TILE = 1 << 16, 32, 512
_SHINGLES = 1 << 17

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # XXH64's primes


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each slice data[start:end]."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    sizes, at = ends - starts, starts.astype(np.int64)
    one = np.full(1, seed, dtype=np.uint64)  # arrays wrap around without warnings
    out = np.repeat(one + _P5, len(sizes))
    live = np.flatnonzero(sizes >= 32)
    if len(live):
        lanes = [np.repeat(x, len(live)) for x in (one + _P1 + _P2, one + _P2, one, one - _P1)]
        left, where, todo = sizes[live], at[live], np.arange(len(live))
        while len(todo):
            for k in range(4):
                lanes[k][todo] = _round(lanes[k][todo], eights[where[todo] + 8 * k])
            where[todo] += 32
            left[todo] -= 32
            todo = todo[left[todo] >= 32]
        total = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
        for lane in lanes:
            total = (total ^ _round(np.zeros_like(lane), lane)) * _P1 + _P4
        out[live], at[live] = total, where
    out += sizes.astype(np.uint64)
    left = ends - at
    live = np.flatnonzero(left >= 8)
    while len(live):
        out[live] = _rotated(out[live] ^ _round(np.zeros(len(live), np.uint64), eights[at[live]]), 27) * _P1 + _P4
        at[live] += 8
        live = live[ends[live] - at[live] >= 8]
    live = np.flatnonzero(ends - at >= 4)
    if len(live):
        out[live] = _rotated(out[live] ^ ((eights[at[live]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at[live] += 4
    live = np.flatnonzero(ends > at)
    while len(live):
        out[live] = _rotated(out[live] ^ ((eights[at[live]] & np.uint64(0xFF)) * _P5), 11) * _P1
        at[live] += 1
        live = live[ends[live] > at[live]]
    out ^= out >> np.uint64(33)
    out *= _P2
    out ^= out >> np.uint64(29)
    out *= _P3
    return out ^ (out >> np.uint64(32))


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One 64-bit fingerprint a document, of lower-cased A-Z words joined by one space."""
    data = tc.lower_ascii(data)
    starts, ends, first = tc.word_spans(data, offsets)
    n_docs, n_words, sizes = len(offsets) - 1, len(starts), ends - starts
    into = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.full(into[-1] + n_words, 0x20, dtype=np.uint8)
    letters = np.repeat(starts - into[:-1], sizes) + np.arange(into[-1])
    joined[np.arange(into[-1]) + np.repeat(np.arange(n_words), sizes)] = data[letters]
    starts = into[:-1] + np.arange(n_words)
    ends = starts + sizes
    words = np.diff(first)
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    upto = np.cumsum(count)
    doc = np.repeat(np.arange(n_docs), count)
    begin = first[doc] + np.arange(len(doc)) - (upto - count)[doc]
    end = begin + np.minimum(words[doc], width) - 1
    sums = np.zeros((n_docs, 64), dtype=np.int64)
    for low in range(0, len(doc), _SHINGLES):
        part = slice(low, low + _SHINGLES)
        hashes = xxh64(joined, starts[begin[part]], ends[end[part]])
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.concatenate([[True], doc[part][1:] != doc[part][:-1]]))
        sums[doc[part][new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > count[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _fingerprints(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.string_buffers(batch.column(1))
            for i, j in tc.groups(offsets):
                found = fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return run


def _parts(prints: np.ndarray) -> list[np.ndarray]:
    """Population counts of the bytes, quarters and halves of each fingerprint."""
    eighths = np.bitwise_count(prints.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    quarters = eighths[:, 0::2] + eighths[:, 1::2]
    return [eighths, quarters, quarters[:, 0::2] + quarters[:, 1::2]]


class Tiles:
    """Fingerprints sorted so that tiles of neighbours have like population counts, with the bounds of each tile."""

    def __init__(self, prints: np.ndarray):
        eighths, quarters, halves = _parts(prints)
        self.order = np.lexsort([*eighths[:, ::-1].T, *quarters[:, ::-1].T, *halves[:, ::-1].T])
        self.prints = prints[self.order]
        edges = np.arange(0, len(prints), TILE)
        self.low = [np.minimum.reduceat(x[self.order], edges, axis=0) for x in (eighths, quarters, halves)]
        self.high = [np.maximum.reduceat(x[self.order], edges, axis=0) for x in (eighths, quarters, halves)]

    def near(self, other: Tiles, radius: int) -> np.ndarray:
        """Pairs of tiles whose counts allow a pair within the radius."""
        out = np.ones((len(self.low[0]), len(other.low[0])), dtype=bool)
        for low, high, their_low, their_high in zip(self.low, self.high, other.low, other.high, strict=True):
            apart = np.maximum(low[:, None] - their_high[None], their_low[None] - high[:, None])
            out &= np.maximum(apart, 0).sum(axis=2) <= radius
        return np.argwhere(out)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within `radius` between a and b, or within a: index pairs into a followed by b."""
    left = Tiles(a)
    right = left if b is None else Tiles(b)
    parent = np.arange(len(a) + (0 if b is None else len(b)))
    links: list[tuple[int, int]] = []

    def roots(nodes: np.ndarray) -> np.ndarray:
        found = parent[nodes]
        while (parent[found] != found).any():
            found = parent[found]
        parent[nodes] = found
        return found

    def root(node: int) -> int:
        while parent[node] != node:
            node = parent[node]
        return node

    differing = np.empty((TILE, TILE), dtype=np.uint64)
    for i, j in left.near(right, radius).tolist():
        if b is None and j < i:
            continue
        x, y = left.prints[i * TILE : (i + 1) * TILE], right.prints[j * TILE : (j + 1) * TILE]
        xor = np.bitwise_xor(x[:, None], y[None, :], out=differing[: len(x), : len(y)])
        hits = np.bitwise_count(xor) <= radius
        if b is None and i == j:
            np.fill_diagonal(hits, False)
        if not hits.any():
            continue
        rows, columns = left.order[i * TILE : (i + 1) * TILE], right.order[j * TILE : (j + 1) * TILE] + (0 if b is None else len(a))
        while True:
            new = hits & (roots(rows)[:, None] != roots(columns)[None, :])
            some = np.flatnonzero(new.any(axis=1))
            if not len(some):
                break
            for r, c in zip(rows[some].tolist(), columns[new[some].argmax(axis=1)].tolist(), strict=True):
                p, q = root(r), root(c)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    links.append((r, c))
    return links


def _cells(radius: int) -> Callable:
    """Sorted (i, j, block, node, print): blocks i and j of a cell, to the links (a, b) of a spanning forest."""

    def linked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j, block, node, prints = (rows.column(k).to_numpy() for k in range(5))
        prints = np.ascontiguousarray(prints).view(np.uint64)
        cuts = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        found: list[np.ndarray] = []
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
            own = block[low:high] == i[low]
            if own.all() and i[low] != j[low]:
                continue  # the other block is empty
            nodes, here = node[low:high], prints[low:high]
            if i[low] == j[low]:
                pairs = forest(here, None, radius)
            elif own.any():
                pairs, nodes = forest(here[own], here[~own], radius), np.concatenate([nodes[own], nodes[~own]])
            else:
                continue
            found.append(nodes[np.array(pairs, dtype=np.int64).reshape(-1, 2)])
        a, b = np.concatenate(found or [np.zeros((0, 2), np.int64)]).T
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (i[0], j[0]):
                yield from linked(pa.Table.from_batches(held))
                held = []
            if len(new):
                cut = int(new[-1]) + 1
                yield from linked(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from linked(pa.Table.from_batches(held))

    return run


def near_links(classes: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(a, b): for all pairs of (node, print) within the radius, a spanning forest of each pair of blocks."""
    n = partitions_for(classes.sparkSession)
    counted = dict.fromkeys(range(65), 0) | {r["ones"]: r["c"] for r in classes.groupBy(F.bit_count("print").alias("ones")).agg(F.count("*").alias("c")).collect()}  # 65 rows at most
    size = min(BLOCK, max(1, sum(counted.values()) // BLOCKS))
    blocks = [-(-counted[p] // size) for p in range(65)]
    base = [sum(blocks[:p]) for p in range(66)]
    number = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.bit_count("print") + 1)
    dealt = classes.withColumn("block", (number(base[:65]) + F.pmod(F.xxhash64("print"), number(blocks))).cast("int"))
    lowest, highest = [base[max(0, p - radius)] for p in range(65)], [base[min(65, p + radius + 1)] - 1 for p in range(65)]
    cells = dealt.withColumn("other", F.explode(F.sequence(number(lowest), number(highest))))
    cells = cells.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "print")
    return cells.repartition(n, "i", "j").sortWithinPartitions("i", "j").mapInArrow(_cells(radius), "a long, b long")


def near_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    scratch = Scratch(df.sparkSession, "simhash")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    printed = scratch.write(docs.mapInArrow(_fingerprints(width), "doc_id long, print long"), "prints")
    held = printed.filter("doc_id is not null")
    classes = scratch.write(held.groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    # Classes that share an id are linked through their nodes.
    several = held.groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).filter("lo < hi").select("doc_id")
    same_id = held.join(several.hint("shuffle_hash"), "doc_id", "left_semi").distinct().join(classes.select("print", "node"), "print")
    same_id = same_id.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).filter("a < b").distinct()
    links = scratch.write(near_links(classes.select("node", "print"), scratch, radius).unionByName(same_id), "links")
    labels = components(links, scratch)
    scratch.drop(links)
    placed = classes.join(labels.withColumnRenamed("node", "its_node").hint("shuffle_hash"), F.col("node") == F.col("its_node"), "left")
    placed = scratch.write(placed.select("print", "copies", F.coalesce("component", "node").alias("component")), "placed")
    scratch.drop(labels)
    scratch.drop(classes)
    # A third of all rows may have one fingerprint.
    total = placed.agg(F.sum("copies").alias("n")).first()["n"] or 0
    out = skewed_join(printed, placed, ["print"], "copies", total)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), component.alias("component_id"))
