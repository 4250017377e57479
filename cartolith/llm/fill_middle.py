"""Fill-in-the-middle transformation by a parallel automaton scan.

One automaton over bytes does both things a document needs: it counts units (code points, words or lines) and notices
markers that already stand in the text. A text is cut into pieces of PIECE bytes wherever the bytes fall. Each piece, on
whatever executor it lands, becomes a transition function, the state it leaves in for every state it may be entered in,
and the units that begin in it for each of those. Functions compose associatively: within a piece as a tree over leaves
of a few bytes, and over the pieces of a document as a segmented scan, which yields each piece's entry state and the
units before it. A cut is then selected twice: the piece that holds it from the counts alone, and the byte within that
piece by walking down the piece's tree. No task holds more of a giant document than a piece, except to read the row and
to write the output, which is one value.

A document is known by its id and the digest of its text, so rows that repeat both share one scan.

Defined cases: a null text counts as empty; an empty text has n 0 and is plain; a text that contains a marker is plain; a
row with a null id hashes the empty string in place of the id; repeated rows give repeated rows; an empty table gives an
empty result; further columns are ignored. Texts are valid UTF-8, as Spark's strings are.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import Scratch, partitions_for, text_or_empty

#: Bytes of a piece: the most of a document that one step of the scan looks at.
PIECE = 1 << 16
#: Markers before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many are transformed, and of 100 of those so many put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
_LEAF_TABLE = 1 << 16
_LEAVES = 1 << 18


def _char(state: int, byte: int) -> tuple[int, bool]:
    return 0, not 0x80 <= byte < 0xC0


def _line(state: int, byte: int) -> tuple[int, bool]:
    return int(byte != 0x0A), state == 0


def _word(state: int, byte: int) -> tuple[int, bool]:
    space = byte == 0x20 or 0x09 <= byte <= 0x0D
    return (2 if space else 1), state == 0 or (state == 2 and not space)


#: A unit's states and its step: the next state, and whether the byte begins a unit. A word holds the spaces after it.
UNITS: dict[str, tuple[int, Callable[[int, int], tuple[int, bool]]]] = {"char": (1, _char), "line": (2, _line), "word": (3, _word)}


def check_markers(markers: tuple[str, ...]) -> None:
    """No marker may overlap another or itself, so that texts without markers are rebuilt exactly."""
    for a in markers:
        for b in markers:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {a!r} and {b!r} are empty or overlap")
    if len(set(markers)) != 3:
        raise ValueError("three different markers are needed")


class Automaton:
    """The product of a unit counter and a marker finder, with tables for single bytes and for leaves of bytes."""

    def __init__(self, unit: str, markers: tuple[str, ...]):
        wanted = [m.encode() for m in markers]
        seen = sorted({m[:k] for m in wanted for k in range(len(m))}, key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(seen)}
        n_unit, step = UNITS[unit]
        self.found = len(seen)
        self.markers, self.states = len(seen) + 1, n_unit * (len(seen) + 1)
        following = np.zeros((self.states, 256), dtype=np.uint8)
        begins = np.zeros((self.states, 256), dtype=np.uint8)
        for u in range(n_unit):
            for m in range(self.markers):
                for byte in range(256):
                    to, begun = step(u, byte)
                    if m == self.found:
                        mark = m
                    else:
                        text = seen[m] + bytes([byte])
                        mark = self.found if any(text.endswith(w) for w in wanted) else max((number[text[i:]] for i in range(len(text) + 1) if text[i:] in number), default=0, key=lambda k: len(seen[k]))
                    following[u * self.markers + m, byte], begins[u * self.markers + m, byte] = to * self.markers + mark, begun
        # Bytes with the same column are one class; a last class stands for padding and changes nothing.
        columns, self.classes = np.unique(np.concatenate([following, begins]).T, axis=0, return_inverse=True)
        self.classes = self.classes.ravel().astype(np.uint16)
        self.pad = len(columns)
        identity = np.arange(self.states, dtype=np.uint8)
        self.step = np.concatenate([columns[:, : self.states], identity[None]])  # (class, state)
        self.begins = np.concatenate([columns[:, self.states :], np.zeros((1, self.states), np.uint8)])
        self.leaf = 4 if (self.pad + 1) ** 4 <= _LEAF_TABLE else 2
        moves, counts = self.step, self.begins
        for _ in range(self.leaf.bit_length() - 1):  # pairs of classes, then pairs of pairs
            n = len(moves)
            first, second = np.repeat(moves, n, axis=0), np.tile(moves, (n, 1))
            counts = np.repeat(counts, n, axis=0) + np.take_along_axis(np.tile(counts, (n, 1)), first.astype(np.intp), axis=1)
            moves = np.take_along_axis(second, first.astype(np.intp), axis=1)
        self.leaf_moves, self.leaf_counts = moves, counts.astype(np.int32)

    def trees(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """For groups of pieces of like size: which they are, their classes, and levels of (functions, counts), leaves first."""
        sizes = np.diff(offsets)
        leaves = np.maximum(1, -(-sizes // self.leaf))
        width = np.int64(1) << np.ceil(np.log2(leaves)).astype(np.int64)
        codes = self.classes[data]
        for w in np.unique(width).tolist():
            chosen = np.flatnonzero(width == w)
            for low in range(0, len(chosen), max(1, _LEAVES // w)):
                some = chosen[low : low + max(1, _LEAVES // w)]
                padded = np.full((len(some), w * self.leaf), self.pad, dtype=np.int64)
                inside = np.arange(w * self.leaf) < sizes[some][:, None]
                padded[inside] = codes[np.repeat(offsets[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some]) + np.arange(sizes[some].sum())]
                index = padded[:, :: self.leaf]
                for k in range(1, self.leaf):
                    index = index * (self.pad + 1) + padded[:, k :: self.leaf]
                levels = [(self.leaf_moves[index], self.leaf_counts[index])]
                while levels[-1][0].shape[1] > 1:
                    levels.append(composed(*(x[:, i::2] for i in (0, 1) for x in levels[-1])))
                yield some, padded, levels

    def functions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, states): the state left in, and the units begun, for each state entered in."""
        n = len(offsets) - 1
        moves, counts = np.empty((n, self.states), np.uint8), np.empty((n, self.states), np.int32)
        for some, _, levels in self.trees(data, offsets):
            moves[some], counts[some] = levels[-1][0][:, 0], levels[-1][1][:, 0]
        return moves, counts

    def select(self, data: np.ndarray, offsets: np.ndarray, state: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The byte at which unit `rank` (from 0) of each piece begins, the piece being entered in `state`."""
        out = np.empty(len(offsets) - 1, dtype=np.int64)
        for some, padded, levels in self.trees(data, offsets):
            row, at, s, left = np.arange(len(some)), np.zeros(len(some), np.int64), state[some], rank[some]
            for moves, counts in levels[-2::-1]:
                at = at * 2
                here = counts[row, at, s]
                right = left >= here
                s = np.where(right, moves[row, at, s], s)
                left = left - np.where(right, here, 0)
                at = at + right
            at, done = at * self.leaf, np.zeros(len(some), dtype=bool)
            for k in range(self.leaf):
                code = padded[row, at + k]
                begun = self.begins[code, s].astype(bool)
                hit = begun & (left == 0) & ~done
                out[some[hit]] = at[hit] + k
                done |= hit
                left, s = left - (begun & ~done), self.step[code, s]
            if not done.all():
                raise ValueError("a rank beyond the units of its piece")
        return out


@functools.lru_cache(maxsize=8)
def automaton(unit: str, markers: tuple[str, ...]) -> Automaton:
    return Automaton(unit, markers)


def composed(first: np.ndarray, first_counts: np.ndarray, second: np.ndarray, second_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The function and counts of one stretch followed by another; the last axis is the state entered in."""
    via = first.astype(np.intp)
    return np.take_along_axis(second, via, axis=-1), first_counts + np.take_along_axis(second_counts, via, axis=-1)


def scanned(moves: np.ndarray, counts: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive scan of composition within segments; head[i] is the first row of i's segment."""
    counts = counts.astype(np.int64)
    far, row = 1, np.arange(len(head))
    while len(row := row[row - far >= head[row]]):
        moves_now, counts_now = composed(moves[row - far], counts[row - far], moves[row], counts[row])
        moves, counts = moves.copy(), counts.copy()
        moves[row], counts[row] = moves_now, counts_now
        far *= 2
    return moves, counts


def _functions(unit: str, markers: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(unit, markers)
        for batch in batches:
            data, offsets = tc.string_buffers(batch.column(4))
            for i, j in tc.groups(offsets):
                moves, counts = machine.functions(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in range(4)), pa.array([x.tobytes() for x in moves], pa.binary()), pa.array([x.tobytes() for x in counts], pa.binary())],
                    names=["doc_id", "digest", "k", "last", "moves", "counts"],
                )

    return run


def _entries(unit: str, markers: tuple[str, ...]) -> Callable:
    """Sorted functions of pieces to each piece's entry state, the units before it and in it, and whether a marker was met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(unit, markers)
        before_key, state, units = None, 0, 0  # of the piece before this batch
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            fresh = [i for i, key in enumerate(keys) if key != (keys[i - 1] if i else before_key)]
            if not fresh:
                continue
            part = batch.take(pa.array(fresh, pa.int64()))
            keys = [keys[i] for i in fresh]
            head = np.array([0, *(i if keys[i][:2] != keys[i - 1][:2] else 0 for i in range(1, len(keys)))])
            head = np.maximum.accumulate(head)
            goes_on = before_key is not None and keys[0][:2] == before_key[:2]
            start = np.where(head == 0, state if goes_on else 0, 0)
            base = np.where(head == 0, units if goes_on else 0, 0)
            moves = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(-1, machine.states)
            counts = np.frombuffer(b"".join(part.column(5).to_pylist()), np.int32).reshape(-1, machine.states)
            moves, counts = scanned(moves, counts, head)
            row = np.arange(len(head))
            left, upto = moves[row, start], base + counts[row, start]
            first = row == head
            entry = np.where(first, start, np.roll(left, 1))
            before = np.where(first, base, np.roll(upto, 1))
            before_key, state, units = keys[-1], int(left[-1]), int(upto[-1])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in range(4)), pa.array(entry.astype(np.int32)), pa.array(before), pa.array(upto), pa.array(left % machine.markers == machine.found)],
                names=["doc_id", "digest", "k", "last", "state", "before", "upto", "marked"],
            )

    return run


def _selector(unit: str, markers: tuple[str, ...]) -> Callable[..., Column]:
    @F.arrow_udf("long")
    def select(piece: pa.Array, state: pa.Array, rank: pa.Array) -> pa.Array:
        wanted = np.flatnonzero(np.asarray(state.is_valid()))
        out = np.full(len(state), -1, dtype=np.int64)
        data, offsets = tc.string_buffers(piece.take(pa.array(wanted)))
        if len(wanted):
            ranks = (x.take(pa.array(wanted)).to_numpy(zero_copy_only=False).astype(np.int64) for x in (state, rank))
            out[wanted] = automaton(unit, markers).select(data, offsets, *ranks)
        return pa.array(out)

    return select


def _pieces(text: Column) -> Column:
    """Slices of PIECE bytes with their numbers; an empty text has one, which is empty."""
    raw = text.cast("binary")
    last = F.greatest(F.lit(0), F.floor((F.octet_length(text) - 1) / PIECE)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("k"), (k == last).alias("last"), F.substring(raw, k * PIECE + 1, F.lit(PIECE)).alias("piece")))


def hashed(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits from the seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", unit: str = "char", seed: int = 1, markers: tuple[str, str, str] = MARKERS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) for every row; form is plain, psm or spm."""
    check_markers(markers)
    spark = df.sparkSession
    scratch = Scratch(spark, "middle")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    pieces = scratch.write(docs.select("doc_id", "digest", F.explode(_pieces(F.col("text"))).alias("p")).select("doc_id", "digest", "p.*"), "pieces")
    functions = pieces.mapInArrow(_functions(unit, markers), "doc_id long, digest binary, k int, last boolean, moves binary, counts binary")
    functions = functions.repartition(partitions_for(spark), "doc_id", "digest").sortWithinPartitions("doc_id", "digest", "k")
    entries = functions.mapInArrow(_entries(unit, markers), "doc_id long, digest binary, k int, last boolean, state int, before long, upto long, marked boolean")

    whole = Window.partitionBy("doc_id", "digest")
    h1, h2, h3, h4 = hashed(F.col("doc_id"), seed)
    ends = entries.withColumns({"n": F.max(F.when(F.col("last"), F.col("upto"))).over(whole), "marked": F.max(F.when(F.col("last"), F.col("marked"))).over(whole)})
    ends = ends.withColumns({"c1": F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)), "c2": F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))})
    held = {c: F.max(F.when((F.col("before") <= F.col(c)) & (F.col(c) < F.col("upto")), F.struct("k", "state", (F.col(c) - F.col("before")).alias("rank")))) for c in ("c1", "c2")}
    places = ends.groupBy("doc_id", "digest").agg(*(F.first(c).alias(c) for c in ("n", "marked", "c1", "c2")), *(x.alias(f"in_{c}") for c, x in held.items()))
    plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= rate)
    places = places.withColumn("form", F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm"))
    places = scratch.write(places.withColumnsRenamed({"doc_id": "its_id", "digest": "its_digest"}), "places")
    scratch.drop(pieces)

    found = docs.join(places.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest")))
    select, raw, changed = _selector(unit, markers), F.col("text").cast("binary"), F.col("form") != "plain"
    for c in ("c1", "c2"):
        at = F.when(changed, F.col(f"in_{c}"))
        found = found.withColumn(f"piece_{c}", F.substring(raw, at["k"] * PIECE + 1, F.lit(PIECE))).withColumn(f"at_{c}", select(F.col(f"piece_{c}"), at["state"], at["rank"]))
    byte = {c: F.when(F.col(f"in_{c}").isNull(), F.octet_length("text")).otherwise(F.col(f"in_{c}.k") * PIECE + F.col(f"at_{c}")).cast("int") for c in ("c1", "c2")}
    prefix, middle, suffix = F.substring(raw, F.lit(1), byte["c1"]), F.substring(raw, byte["c1"] + 1, byte["c2"] - byte["c1"]), F.substring(raw, byte["c2"] + 1, F.octet_length("text"))
    p, s, m = (F.lit(x).cast("binary") for x in markers)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(raw)
    return found.select(
        "doc_id", "n", "form", F.when(changed, F.col("c1")).alias("prefix_units"), F.when(changed, F.col("c2") - F.col("c1")).alias("middle_units"), output.cast("string").alias("output")
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of `transform` was made from."""
    parts = F.split(output, "|".join(re.escape(m) for m in markers), -1)
    prefix, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))
