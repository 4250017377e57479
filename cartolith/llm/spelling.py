"""Spelling variants by two-dimensional range reporting on wavelet trees.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Words of one length are
points: their rank in forward order by their rank in reverse order. A word whose code point at position p was replaced
lies in the prefix interval of what stands before p, in forward order, and in the suffix interval of what stands after
it, in reverse order; so does a word with one more code point at p, among the words one longer. For each edit position
the two intervals are intersected by walking down a wavelet tree over the points, all queries of a task at once.

An edit in the second half of a word leaves its first half alone and the other way round. Words are therefore dealt by
their first half for edits in the second and by their second half for edits in the first, once as words of their length
and once as insertions into words one shorter. Halves that more than BLOCK words share are cut into blocks, each block of
words meeting each block of queries, so no task holds more than a bounded number of words. A pair is found at one
position, in one of the two dealings; what leaves a task is one row a word, its near words' count and the best of them.

Defined cases: null and empty texts have no words; rows with a null id hash the empty string in place of the id, and all
their runs count; repeated rows count again; runs are never cut, however long; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import Scratch, partitions_for, skewed_join, text_or_empty

#: Least length of a word, least number of occurrences, and how much more frequent a form must be than its variant.
LENGTH, OCCURRENCES, FACTOR = 5, 3, 2
#: Of so many runs of a document one, told by its hash, loses a code point.
MISPRINT = 97
#: Words and queries of one cell; rows that a task gathers before it builds a tree; queries that walk a tree at once.
BLOCK, GATHER, AT_ONCE = 1 << 16, 1 << 17, 1 << 20
_LONG_RUN = 256
_CRC = np.arange(256, dtype=np.uint32)  # the table of CRC-32 by its rule
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice data[start:end], continued from that of what goes before it."""
    state, sizes = ~before.astype(np.uint32), ends - starts
    live = np.flatnonzero((sizes > 0) & (sizes <= _LONG_RUN))
    step = 0
    while len(live):
        state[live] = _CRC[(state[live] ^ data[starts[live] + step]) & 0xFF] ^ (state[live] >> 8)
        step += 1
        live = live[sizes[live] > step]
    for k in np.flatnonzero(sizes > _LONG_RUN).tolist():
        state[k] = ~np.uint32(zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k])))
    return ~state


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to A-Z, a-z or U+00C0 to U+00FF; the latter are the lead byte C3 and whatever follows it."""
    low = data | 0x20
    wide = data == 0xC3
    out = ((low >= 97) & (low <= 122)) | wide
    out[1:] |= wide[:-1]
    return out


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs, and the document of each."""
    inside = letters(data)
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _cuts(data: np.ndarray, most: int) -> list[int]:
    """Bounds that cut one long text between runs, about every `most` bytes."""
    out, at = [0], most
    while at < len(data):
        while at < len(data):
            here = letters(data[at - 1 : at + 4096])[1:]  # whether a byte goes on with a run needs the one before it
            gap = np.flatnonzero(~here)
            if len(gap):
                at += int(gap[0])
                break
            at += len(here)
        if at < len(data):
            out.append(at)
            at += most
    return [*out, len(data)]


def _words(data: np.ndarray, offsets: np.ndarray, ids: list, misprint: int, least: int) -> tuple[list[str], list[int]]:
    """Distinct words of some documents with how often each occurs."""
    data = tc.lower_ascii(data)
    starts, ends, doc = _spans(data, offsets)
    wide = np.concatenate([[0], np.cumsum(data == 0xC3)])
    length = ends - starts - (wide[ends] - wide[starts])
    before = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids] or [0], dtype=np.uint32)
    h = crc32(data, starts, ends, before[doc] if len(doc) else np.zeros(0, np.uint32)).astype(np.int64)
    hit = h % misprint == 0
    words: list[str] = []
    for k in np.flatnonzero(hit & (length > least)).tolist():
        run, at = data[starts[k] : ends[k]].tobytes().decode(), int(h[k] % length[k])
        words.append(run[:at] + run[at + 1 :])
    counts = [1] * len(words)
    whole = np.flatnonzero(~hit & (length >= least))
    starts, ends = starts[whole], ends[whole]
    if len(whole):
        one, which = tc.distinct_slices(data, starts, ends)
        words += [data[a:b].tobytes().decode() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        counts += np.bincount(which, minlength=len(one)).tolist()
    return words, counts


def count_words(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", misprint: int = MISPRINT, least: int = LENGTH) -> DataFrame:
    """(word, n) over all texts; one of `misprint` runs of a document loses a code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.string_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in tc.groups(offsets):
                part = data[offsets[i] : offsets[j]]
                cuts = _cuts(part, 1 << 21) if j == i + 1 else [0, len(part)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    at = np.array([0, b - a]) if j == i + 1 else offsets[i : j + 1] - offsets[i]
                    words, counts = _words(part[a:b], at, ids[i:j], misprint, least)
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """A sequence of numbers below 2 ** bits, by levels from the highest bit: ones before each place, and all zeros."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones: list[np.ndarray] = []
        for b in reversed(range(self.bits)):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for each value at places left to right (exclusive) that is from low to high (exclusive)."""
        query = np.flatnonzero((left < right) & (low < high))
        left, right, value = left[query], right[query], np.zeros(len(query), dtype=np.int64)
        for level, ones in enumerate(self.ones):
            b = self.bits - level - 1
            zeros = len(ones) - 1 - ones[-1]
            a, z = ones[left], ones[right]
            query, value = np.concatenate([query, query]), np.concatenate([value * 2, value * 2 + 1])
            left, right = np.concatenate([left - a, zeros + a]), np.concatenate([right - z, zeros + z])
            some = np.flatnonzero((left < right) & (value << b < high[query]) & ((value + 1) << b > low[query]))
            query, value, left, right = query[some], value[some], left[some], right[some]
        return query, value


class _Order:
    """Rows sorted by cell and letters, and for each row the interval of targets that share its cell and first letters."""

    def __init__(self, cell: np.ndarray, matrix: np.ndarray, target: np.ndarray):
        keys = np.concatenate([cell.astype(">u4")[:, None], matrix.astype(">u4")], axis=1)
        wide = np.ascontiguousarray(keys if matrix.max(initial=0) > 255 else np.concatenate([keys[:, :1].copy().view(np.uint8).reshape(-1, 4), matrix.astype(np.uint8)], axis=1))
        self.order = np.argsort(wide.view(f"S{wide.shape[1] * wide.itemsize}").ravel(), kind="stable")
        self.rank = np.empty(len(cell), dtype=np.int64)
        self.rank[self.order] = np.arange(len(cell))
        ordered = keys[self.order]
        unlike = ordered[1:] != ordered[:-1]
        self.shared = np.where(unlike.any(axis=1), unlike.argmax(axis=1) - 1, keys.shape[1])  # letters, -1 for another cell
        self.upto = np.concatenate([[0], np.cumsum(target[self.order])])

    def interval(self, depth: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate([[0], np.flatnonzero(self.shared < depth) + 1])
        ends = np.concatenate([new[1:], [len(self.rank)]])
        group = np.searchsorted(new, self.rank[rows], side="right") - 1
        return self.upto[new[group]], self.upto[ends[group]]


def near_pairs(cell: np.ndarray, words: np.ndarray, longer_cell: np.ndarray, longer: np.ndarray, target: np.ndarray, query: np.ndarray, positions: range) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(word, near word, False) for replaced and (word, longer word, True) for inserted code points at some positions.

    words: code points of words of one length, a row each, with whether each may be found and whether each is a query.
    """
    n, length = words.shape
    asked = np.flatnonzero(query)
    for inserted in (False, True):
        if inserted:
            every = np.concatenate([cell, longer_cell])
            wide = np.zeros((n + len(longer), length + 1), dtype=np.uint32)
            wide[:n, :length], wide[n:] = words, longer
            back = np.zeros_like(wide)
            back[:n, :length], back[n:] = words[:, ::-1], longer[:, ::-1]
            found = np.concatenate([np.zeros(n, bool), np.ones(len(longer), bool)])
        else:
            every, wide, back, found = cell, words, words[:, ::-1], target
        if not found.any() or not len(asked):
            continue
        forward, reverse = _Order(every, wide, found), _Order(every, back, found)
        by_forward, by_reverse = forward.order[found[forward.order]], reverse.order[found[reverse.order]]
        in_reverse = np.empty(len(every), dtype=np.int64)
        in_reverse[by_reverse] = np.arange(len(by_reverse))
        tree = WaveletTree(in_reverse[by_forward])
        own = np.zeros(len(asked), dtype=np.int64) if inserted else found[asked].astype(np.int64)
        todo: list[tuple] = []

        def done(tree=tree, by_reverse=by_reverse, inserted=inserted) -> tuple[np.ndarray, np.ndarray, bool]:
            row, at, left, right, low, high = (np.concatenate(x) for x in zip(*todo, strict=True))
            todo.clear()
            which, value = tree.report(left, right, low, high)
            row, at, other = row[which], at[which], by_reverse[value]
            # An insertion is told at the last of the positions that give the same word.
            good = (at == length) | (wide[other, at] != words[row, np.minimum(at, length - 1)]) if inserted else row != other
            return row[good], other[good] - (n if inserted else 0), inserted

        for p in positions if not inserted or positions.stop < length else range(positions.start, length + 1):
            left, right = forward.interval(p, asked)
            low, high = reverse.interval(length - p - (not inserted), asked)
            some = np.flatnonzero((right - left > own) & (high - low > own))
            todo.append((asked[some], np.full(len(some), p), left[some], right[some], low[some], high[some]))
            if sum(len(x[0]) for x in todo) > AT_ONCE:
                yield done()
        if todo:
            yield done()


def _best(word: np.ndarray, other: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with near ones, how many, and the most frequent of those, the first in order among equals."""
    order = np.lexsort((rank[other], -n[other], word))
    word, other = word[order], other[order]
    new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    return word[new], np.diff(np.append(new, len(word))), other[new]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (length, side, half, x, y, word, n, found, asked) to (word, n_near, best_n, best), a row a word and search."""

    def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        length, front = rows.column(0).to_numpy(), rows.column(1).to_numpy(zero_copy_only=False)
        half, x, y = rows.column(2).combine_chunks().dictionary_encode().indices.to_numpy(), rows.column(3).to_numpy(), rows.column(4).to_numpy()
        keys = np.stack([length, front, half, x, y])
        cell = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
        text, n = rows.column(5).combine_chunks(), rows.column(6).to_numpy()
        found, asked = (rows.column(k).to_numpy(zero_copy_only=False) for k in (7, 8))
        size = pc.utf8_length(text).to_numpy()
        points = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), dtype="<u4")
        begin = np.cumsum(size) - size
        for size_here, side in sorted(set(zip(length.tolist(), front.tolist(), strict=True))):
            of = np.flatnonzero((length == size_here) & (front == side))
            short, long = of[size[of] == size_here], of[size[of] == size_here + 1]
            if not len(short):
                continue
            words, longer = (points[begin[r][:, None] + np.arange(w)] for r, w in ((short, size_here), (long, size_here + 1)))
            middle = size_here // 2
            got: dict[bool, list] = {False: [], True: []}
            for word, other, inserted in near_pairs(cell[short], words, cell[long], longer, found[short], asked[short], range(middle, size_here) if side else range(middle)):
                got[inserted].append((short[word], (long if inserted else short)[other]))
            for inserted, pairs in got.items():
                if not pairs:
                    continue
                a, b = (np.concatenate(z) for z in zip(*pairs, strict=True))
                ways = [(a, b), (b, a)] if inserted else [(a, b)]
                for word, other in ways:
                    if not len(word):
                        continue
                    names = np.unique(other)  # all of one length, so ranks among them order ties
                    rank = np.zeros(len(size), dtype=np.int64)
                    rank[names[np.argsort(np.array(text.take(pa.array(names)).to_pylist(), dtype=object), kind="stable")]] = np.arange(len(names))
                    w, count, best = _best(word, other, n, rank)
                    yield pa.RecordBatch.from_arrays([text.take(pa.array(w)), pa.array(count.astype(np.int64)), pa.array(n[best]), text.take(pa.array(best))], names=["word", "n_near", "best_n", "best"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHER:
            rows = pa.Table.from_batches(held)
            last = [rows.column(k)[-1].as_py() for k in range(5)]
            same = pc.and_kleene(*(pc.equal(rows.column(k), last[k]) for k in (0, 1)))
            for k in (2, 3, 4):
                same = pc.and_kleene(same, pc.equal(rows.column(k), last[k]))
            cut = pc.index(same, True).as_py()  # the last cell may go on
            if cut:
                yield from search(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
    if held:
        yield from search(pa.Table.from_batches(held))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n_near, best_n, best) of (word, n): words that have near ones, how many, and the most frequent of them."""
    size = F.char_length("word")
    ways = []
    for shorter in (0, 1):
        half = F.floor((size - shorter) / 2).cast("int")
        for front in (True, False):
            # What both words of a pair share: the first half, or what is after the first half of the shorter one.
            shared = F.substring("word", F.lit(1), half) if front else F.when(size - shorter == half, "").otherwise(F.right("word", size - shorter - half))
            ways.append(F.struct((size - shorter).alias("length"), F.lit(front).alias("front"), shared.alias("half")))
    rows = words.select("word", "n", F.explode(F.array(*ways)).alias("way")).select("way.*", "word", "n").filter("length > 0")
    key = ["length", "front", "half"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("members")).filter(F.col("members") > BLOCK)
    total = 4 * (words.count() or 1)
    rows = skewed_join(rows, scratch.write(sizes, "sizes"), key, "members", total)
    blocks = F.coalesce(F.ceil(F.col("members") / BLOCK).cast("int"), F.lit(1))
    own, every = F.pmod(F.xxhash64("word"), blocks).cast("int"), F.sequence(F.lit(0), blocks - 1)
    place = lambda x, y, found, asked: F.struct(x.alias("x"), y.alias("y"), found.alias("found"), asked.alias("asked"))
    no, yes = F.lit(False), F.lit(True)
    targets = F.transform(every, lambda y: place(own, y, yes, (size == F.col("length")) & (y == own)))
    queries = F.transform(F.filter(every, lambda x: x != own), lambda x: place(x, own, no, yes))
    rows = rows.withColumn("place", F.explode(F.concat(targets, F.when(size == F.col("length"), queries).otherwise(F.filter(queries, lambda _: no)))))
    rows = rows.select(*key, "place.x", "place.y", "word", "n", "place.found", "place.asked")
    order = [*key, "x", "y"]
    found = rows.repartition(partitions_for(words.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last by doubling; each form is more frequent, so chains end."""
    current = scratch.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        children = current.groupBy("root").agg(F.count("*").alias("children"))
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next")).join(children.hint("shuffle_hash"), "root")
        further = scratch.write(further, "further")
        if further.isEmpty():
            return current
        following = skewed_join(current, further, ["root"], "children", current.count())
        current, old = scratch.write(following.select("word", F.coalesce("next", "root").alias("root")), "roots"), current
        scratch.drop(old)
        scratch.drop(further)


def variants(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts."""
    scratch = Scratch(df.sparkSession, "spelling")
    words = scratch.write(count_words(df, text_col, id_col).filter(F.col("n") >= OCCURRENCES), "words")
    near = scratch.write(words.join(near_words(words, scratch), "word", "left"), "near")
    scratch.drop(words)
    formed = near.withColumn("form", F.when(F.col("best_n") >= FACTOR * F.col("n"), F.col("best")))
    known = roots(formed.filter("form is not null"), scratch)
    return formed.join(known, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")
    )
