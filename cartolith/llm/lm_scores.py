"""Cross-entropy difference: a target and a background bigram model over one vocabulary.

The vocabulary is all words (A-Z lower-cased) of all documents, plus one entry for unseen ones. The target's documents
make one model and all other documents the other. The models are matched: same vocabulary, order and smoothing, and the
larger one's counts are scaled down to the size of the smaller one, so that smoothing weighs alike in both. A bigram's
probability is (count + WEIGHT * p(word)) / (count of the first word + WEIGHT), a word's (count + ADD) / (words + ADD *
vocabulary). No document is scored by itself: its own counts are left out of the model that it belongs to. A
document's score is its loss per token under the background model less that under the target model: above zero, it is
more like the target.

All words and bigrams of the corpus are counted, nothing of them goes to the driver, and the tables grow with the input.
Documents are laid out in chunks. A chunk sends each of its distinct words and bigrams once, with its counts, to a range
of the hash space (a bucket); a bucket adds up what the chunks sent and answers each chunk with the sums in the order in
which it asked; the chunk then scores its documents. So a frequent word costs one entry a chunk, and no key is a group
of rows. Words and bigrams are told apart by 64-bit mixed hashes.

Defined cases: null, empty and wordless texts have no token, and losses and score 0; if the target or the background
has no token, both models are that of all documents and scores are 0; repeated rows count as often as they appear and
score alike; null ids are in the background; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import Scratch, partitions_for, text_or_empty

#: Smoothing: what a bigram's backoff and a word's uniform part weigh, in tokens.
WEIGHT, ADD = 4.0, 0.5
CHUNK_BYTES = 2 << 20
#: Buckets at least, and bytes of text for each bucket, so that what a task adds up does not grow with the input.
BUCKETS, BUCKET_BYTES = 96, 8 << 20
START = np.uint64(0x5CA1AB1E0DDBA11)
#: Counts of a word: as a token in the background and the target, as the first of a bigram in either. Of a bigram: two.
_WORD, _BIGRAM = 4, 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token, of the word before it and of both, and the index of each document's first token."""
    data = tc.lower_ascii(data)
    starts, ends, first = tc.word_spans(data, offsets)
    words = tc.slice_hashes(data, starts, ends)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1][np.diff(first) > 0]] = START
    return words, before, tc.mix(before * np.uint64(0x9E3779B97F4A7C15) + tc.mix(words)), first


def _asked(words: np.ndarray, before: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct words and bigrams of a chunk, and for each token its word, first word and bigram among them."""
    keys, at = np.unique(np.concatenate([words, before]), return_inverse=True)
    bigrams, of = np.unique(pairs, return_inverse=True)
    return keys, at[: len(words)], at[len(words) :], bigrams, of


def _pack(*columns: np.ndarray) -> bytes:
    """Counts as planes of bytes: the leading ones are zeros and cost nothing."""
    planes = [np.ascontiguousarray(c.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(n, 4, -1)
    return [np.ascontiguousarray(c.T).view("<u4").ravel() for c in raw]


def _keys(keys: np.ndarray) -> bytes:
    steps = np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0))).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(steps.T.tobytes())


def _unkeys(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def _layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, target, text) to chunks: one row of ids (0 for null), which are known, marks, sizes in bytes and joined texts each."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        data, offsets = tc.string_buffers(batch.column(2))
        for i, j in tc.groups(offsets, CHUNK_BYTES):
            sizes = np.diff(offsets[i : j + 1])
            ids = batch.column(0)[i:j]
            lists = [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), x) for x in (pc.fill_null(ids, 0), ids.is_valid(), batch.column(1)[i:j], pa.array(sizes))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([data[offsets[i] : offsets[j]].tobytes()], pa.binary())], names=["chunk", "ids", "known", "marks", "sizes", "text"])
            number += 1


_CHUNK = "chunk long, ids array<long>, known array<boolean>, marks array<boolean>, sizes array<long>, text binary"


def _edges(buckets: int) -> np.ndarray:
    """First hashes of the buckets: equal ranges of the hash space."""
    return np.array([(k << 64) // buckets for k in range(buckets)], dtype=np.uint64)


def _entries(buckets: int):
    """(chunk, marks, sizes, text) to (bucket, chunk, words, word_counts, bigrams, bigram_counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(buckets)
        for batch in batches:
            for k in range(batch.num_rows):
                marks = batch.column(1)[k].values.to_numpy(zero_copy_only=False).astype(bool)
                offsets = np.concatenate([[0], np.cumsum(batch.column(2)[k].values.to_numpy())]).astype(np.int64)
                words, before, pairs, first = tokens(np.frombuffer(batch.column(3)[k].as_buffer(), np.uint8), offsets)
                if not len(words):
                    continue
                keys, own, head, bigrams, of = _asked(words, before, pairs)
                marked = np.repeat(marks, np.diff(first))
                counts = [np.bincount(at[some], minlength=len(kinds)) for at, kinds in ((own, keys), (head, keys), (of, bigrams)) for some in (~marked, marked)]
                one, two = (np.append(np.searchsorted(x, edges), len(x)).tolist() for x in (keys, bigrams))
                rows: list[tuple] = []
                for b in range(buckets):
                    w, p = slice(one[b], one[b + 1]), slice(two[b], two[b + 1])
                    if w.start < w.stop or p.start < p.stop:
                        rows.append((b, _keys(keys[w]), _pack(*(c[w] for c in counts[:_WORD])), _keys(bigrams[p]), _pack(*(c[p] for c in counts[_WORD:]))))
                bucket, *blobs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([batch.column(0)[k].as_py()] * len(rows)), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "chunk", "words", "word_counts", "bigrams", "bigram_counts"])

    return run


_ENTRY = "bucket int, chunk long, words binary, word_counts binary, bigrams binary, bigram_counts binary"


def _sums(keys: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    """For each list of keys the sums over all lists, and the sums of the distinct keys."""
    order, ends = np.concatenate(keys), np.cumsum([len(k) for k in keys])[:-1]
    _, at = np.unique(order, return_inverse=True)
    n = int(at.max()) + 1 if len(at) else 0
    totals = [np.bincount(at, weights=np.concatenate(c), minlength=n).astype(np.int64) for c in zip(*counts, strict=True)]
    return list(zip(*(np.split(t[at], ends) for t in totals), strict=True)), totals


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries to what each chunk asked of each bucket: (bucket, chunk, word_sums, bigram_sums); with chunk null
    the bucket's distinct words and tokens: (vocabulary, background, target)."""
    names = ["bucket", "chunk", "word_sums", "bigram_sums", "vocabulary", "background", "target"]
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        n, bucket = rows.num_rows, rows.column(0)[0].as_py()
        blobs = [rows.column(k).to_pylist() for k in range(2, 6)]
        words, totals = _sums([_unkeys(x) for x in blobs[0]], [_unpack(x, _WORD) for x in blobs[1]])
        answered = [pa.array([_pack(*x) for x in words], pa.binary())]
        pairs, _ = _sums([_unkeys(x) for x in blobs[2]], [_unpack(x, _BIGRAM) for x in blobs[3]])
        answered.append(pa.array([_pack(*x) for x in pairs], pa.binary()))
        nothing = [pa.nulls(n, pa.int64()) for _ in range(3)]
        yield pa.RecordBatch.from_arrays([rows.column(0).combine_chunks().cast(pa.int32()), rows.column(1).combine_chunks(), *answered, *nothing], names=names)
        seen = [int((totals[0] + totals[1] > 0).sum()), int(totals[0].sum()), int(totals[1].sum())]
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.binary()) for _ in range(2)), *(pa.array([x], pa.int64()) for x in seen)], names=names)

    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(0)[-1].as_py() != bucket[low]:
                yield from done()
                held.clear()
            held.append(batch.slice(low, high - low))
    if held:
        yield from done()


def losses(words: np.ndarray, before: np.ndarray, pairs: np.ndarray, first: np.ndarray, marks: np.ndarray, word_sums: list[np.ndarray], bigram_sums: list[np.ndarray], size: tuple[int, int, int]) -> list[np.ndarray]:
    """Loss per token of each document under the background and the target, its own counts left out.

    Sums are those of the sorted distinct words and bigrams; size: distinct words, tokens of the background, of the target.
    """
    vocabulary, *total = size
    keys, own, head, bigrams, of = _asked(words, before, pairs)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    mine = []
    for at, kinds in ((own, keys), (head, keys), (of, bigrams)):  # counts of each token's word, first word and bigram in its document
        _, inverse, count = np.unique(doc * max(len(kinds), 1) + at, return_inverse=True, return_counts=True)
        mine.append(count[inverse])
    pooled = not all(total)  # one model of all documents stands for both
    if pooled:
        word_sums = [x for k in (0, 2) for x in [word_sums[k] + word_sums[k + 1]] * 2]
        bigram_sums, total = [bigram_sums[0] + bigram_sums[1]] * 2, [sum(total)] * 2
    whole = [np.where((marks == bool(side)) | pooled, n, 0) for side in (0, 1)]
    least, out = min(total), []
    for side in (0, 1):
        left = total[side] - whole[side]  # tokens of the others
        scale = (np.minimum(1.0, least / np.maximum(left, 1)))[doc]
        inside = (whole[side] > 0)[doc]
        c_word, c_head = (word_sums[k + side][at] - np.where(inside, m, 0) for k, at, m in ((0, own, mine[0]), (2, head, mine[1])))
        c_pair = bigram_sums[side][of] - np.where(inside, mine[2], 0)
        of_word = (scale * c_word + ADD) / (scale * left[doc] + ADD * (vocabulary + 1))
        loss = -np.log((scale * c_pair + WEIGHT * of_word) / (scale * c_head + WEIGHT))
        out.append(np.bincount(doc, weights=loss, minlength=len(n)) / np.maximum(n, 1))
    return out


def _scored(size: tuple[int, int, int]):
    def run(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        parts = []
        answers = answers.sort_values("bucket")
        sums = [[np.concatenate(x) for x in zip(*(_unpack(b, n) for b in answers[name]), strict=True)] if len(answers) else [np.zeros(0, np.int64)] * n for name, n in (("word_sums", _WORD), ("bigram_sums", _BIGRAM))]
        for row in chunks.itertuples(index=False):
            offsets = np.concatenate([[0], np.cumsum(row.sizes)]).astype(np.int64)
            words, before, pairs, first = tokens(np.frombuffer(row.text, np.uint8), offsets)
            background, target = losses(words, before, pairs, first, np.asarray(row.marks, dtype=bool), *([x.astype(np.int64) for x in s] for s in sums), size)
            ids = pd.arrays.IntegerArray(np.asarray(row.ids, dtype=np.int64), ~np.asarray(row.known, dtype=bool))
            parts.append(pd.DataFrame({"doc_id": ids, "n_tokens": np.diff(first), "target_loss": target, "background_loss": background, "score": background - target}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("doc_id", "n_tokens", "target_loss", "background_loss", "score")})

    return run


def score(df: DataFrame, target_ids: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row; target_ids: (doc_id) of the target documents."""
    spark = df.sparkSession
    scratch = Scratch(spark, "lm")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    marks = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("target", F.lit(True))
    marked = docs.join(marks.hint("shuffle_hash"), "doc_id", "left").select("doc_id", F.coalesce("target", F.lit(False)).alias("target"), "text")
    chunks = scratch.write(marked.mapInArrow(_layout, _CHUNK), "chunks")
    n_bytes = chunks.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    n, buckets = partitions_for(spark), max(BUCKETS, -(-n_bytes // BUCKET_BYTES))
    entries = chunks.select("chunk", "marks", "sizes", "text").mapInArrow(_entries(buckets), _ENTRY)
    placed = entries.repartitionById(min(n, buckets), F.pmod("bucket", F.lit(min(n, buckets))))
    answers = scratch.write(placed.sortWithinPartitions("bucket", "chunk").mapInArrow(_answers, "bucket int, chunk long, word_sums binary, bigram_sums binary, vocabulary long, background long, target long"), "answers")
    size = answers.filter("chunk is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("vocabulary", "background", "target"))).first()
    asked = answers.filter("chunk is not null").select("chunk", "bucket", "word_sums", "bigram_sums")
    scored = chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInPandas(_scored(tuple(size)), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
    out = scratch.write(scored, "scores")
    scratch.drop(chunks)
    scratch.drop(answers)
    return out
