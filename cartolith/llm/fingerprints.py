"""Document fingerprints by content-defined chunking.

A rolling gear hash over the bytes of a text (each byte adds a table value, older bytes shift out after 32) marks cut
candidates. Chunking is normalised: until the normal chunk size a hard mask must match, after it an easy one, and no
chunk is shorter than SMALLEST or longer than LARGEST. A cut depends on the last bytes alone, so an insertion shifts the
chunks around it and no others. The fingerprint is the set of distinct chunk digests, each weighted by its chunk's
length; the weight that two fingerprints share, over that of the smaller one, measures containment.

Defined cases: null counts as empty; an empty text has the empty fingerprint, likeness 1 to an empty one and 0 to any
other; ties of id are ordered by text; null ids come last in descending order; with one row, the next document is the
row itself; repeated rows follow each other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import partitions_for, small_batches, text_or_empty

SMALLEST, NORMAL, LARGEST = 8, 32, 128
#: Bits that must be zero in the gear hash before and after the normal size.
HARD_BITS, EASY_BITS = 6, 4
#: Hexadecimal digits of a chunk digest.
DIGITS = 12
_NO_ID = -(1 << 63)


def _gear() -> np.ndarray:
    return (tc.mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gear values of the last 32 bytes, each shifted left by its age."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        older = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += older
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of all chunks.

    Candidates within the first 32 bytes of a document see bytes of the one before it; those are masked by hashing each
    document apart from its neighbours with 32 zero bytes between them.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    gap = 32
    padded = np.zeros(len(data) + gap * n, dtype=np.uint8)
    base = offsets[:-1] + gap * np.arange(1, n + 1)  # where documents start when padded
    padded[np.arange(len(data)) + np.repeat(base - offsets[:-1], sizes)] = data
    h = gear_hashes(padded)
    easy = np.flatnonzero(h < np.uint32(1 << (32 - EASY_BITS))) + 1
    hard = easy[h[easy - 1] < np.uint32(1 << (32 - HARD_BITS))]
    end = base + sizes
    live = np.flatnonzero(sizes > 0)
    at = base[live].copy()
    starts, ends, docs = [], [], []
    while len(live):
        stop = end[live]
        near, far = at + SMALLEST, np.minimum(at + LARGEST, stop)
        middle = np.minimum(at + NORMAL, far)
        k = np.searchsorted(hard, near)
        first = np.where(k < len(hard), hard[np.minimum(k, len(hard) - 1)], len(padded) + 1) if len(hard) else np.full(len(at), len(padded) + 1)
        k = np.searchsorted(easy, middle)
        second = np.where(k < len(easy), easy[np.minimum(k, len(easy) - 1)], len(padded) + 1) if len(easy) else np.full(len(at), len(padded) + 1)
        cut = np.where(first <= middle, first, np.minimum(second, far))
        cut = np.minimum(cut, stop)
        starts.append(at)
        ends.append(cut)
        docs.append(live)
        go = cut < stop
        live, at = live[go], cut[go]
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none
    starts, ends, docs = (np.concatenate(x) for x in (starts, ends, docs))
    order = np.argsort(starts, kind="stable")
    starts, ends, docs = starts[order], ends[order], docs[order]
    back = base[docs] - offsets[docs]
    return starts - back, ends - back, docs


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct chunk digests (48 bits) and their weights, side by side, and n+1 offsets."""
    starts, ends, docs = cuts(data, offsets)
    digest = tc.slice_hashes(data, starts, ends) >> np.uint64(64 - 4 * DIGITS)
    order = np.lexsort((ends - starts, digest, docs))
    digest, weight, docs = digest[order], (ends - starts)[order], docs[order]
    new = np.ones(len(digest), dtype=bool)
    new[1:] = (digest[1:] != digest[:-1]) | (docs[1:] != docs[:-1])
    return digest[new], weight[new], np.searchsorted(docs[new], np.arange(len(offsets)))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared weight over the weight of the smaller fingerprint."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    x, y = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    shared = x[1][y[0][at] == x[0]].sum()
    return float(min(1.0, shared / min(a[1].sum(), b[1].sum())))


def _shown(digest: np.ndarray, weight: np.ndarray) -> str:
    """digest:weight in hexadecimal, joined by commas."""
    return ",".join([f"{d:0{DIGITS}x}:{w:x}" for d, w in zip(digest.tolist(), weight.tolist(), strict=True)])


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many code points from the start of the next one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _many(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    data, offsets = tc.string_buffers(pa.array(texts, pa.string()))
    for i, j in tc.groups(offsets):
        digest, weight, at = fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out += [(digest[a:b], weight[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (bucket, doc_id, text, ghost) to results; a row waits until the row after it has come."""
    held: tuple | None = None
    for batch in batches:
        data, offsets = tc.string_buffers(batch.column(2))
        for i, j in tc.groups(offsets, 4 << 20):
            rows = list(zip(batch.column(0)[i:j].to_pylist(), batch.column(1)[i:j].to_pylist(), batch.column(2)[i:j].to_pylist(), batch.column(3)[i:j].to_pylist(), strict=True))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if a[0] == b[0] and not a[3]]
            if pairs:
                own = _many([a[2] for a, _ in pairs] + [pairs[-1][1][2]])
                # The next document of a pair is the first of the pair after it, if they are neighbours.
                after = [own[k + 1] if k + 1 == len(pairs) or pairs[k + 1][0] is b else None for k, (_, b) in enumerate(pairs)]
                lone = [k for k, x in enumerate(after) if x is None]
                for k, x in zip(lone, _many([pairs[k][1][2] for k in lone]), strict=True):
                    after[k] = x
                changed = [edited(a[2], b[2]) for a, b in pairs]
                other = _many(changed)
                columns = (
                    [a[1] for a, _ in pairs], [len(a[2]) for a, _ in pairs], [hashlib.sha256(x.encode()).hexdigest() for x in changed],
                    [_shown(*x) for x in own[:-1]], [_shown(*x) for x in other],
                    [likeness(x, y) for x, y in zip(own, other, strict=False)], [likeness(x, y) for x, y in zip(own, after, strict=False)],
                )
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_COLUMNS)


def compare(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness, with the next document by descending id.

    Splitters are ids of the table, so each range starts with the rows of its splitter; those rows are sent to the range
    before it as well, as the next document of its last row. The text is shuffled once and no range is one task's all.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    n = 4 * partitions_for(spark)
    found = docs.select("doc_id").agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n).alias("some"), F.max("doc_id").alias("top")).first()
    if found["top"] is None:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    splitters = sorted({*found["some"], found["top"]}, reverse=True)  # range k: from splitters[k] down to above splitters[k + 1]
    ascending = np.array(splitters[::-1], dtype=np.int64)
    last = len(splitters) - 1

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            k = last - np.searchsorted(ascending, ids, side="left")  # the splitter at or above the id
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), *batch.columns, pa.array(np.zeros(len(ids), np.int32))], names=["bucket", "doc_id", "text", "ghost"])
            heads = np.flatnonzero(ascending[last - k] == ids)
            if len(heads):
                before = (k[heads] - 1) % (last + 1)
                yield pa.RecordBatch.from_arrays([pa.array(before.astype(np.int32)), *batch.take(pa.array(heads)).columns, pa.array(np.ones(len(heads), np.int32))], names=["bucket", "doc_id", "text", "ghost"])

    rows = docs.mapInArrow(ranged, "bucket int, doc_id long, text string, ghost int")
    rows = rows.repartition(partitions_for(spark), "bucket").sortWithinPartitions("bucket", "ghost", F.desc("doc_id"), "text")
    out = rows.mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))
