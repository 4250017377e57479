"""Substring deduplication with a log-structured index of window fingerprints.

Documents enter in batches of ascending id. A batch's windows are cut into hash ranges (buckets); in each bucket they are
sorted and merge-joined with the index, which holds immutable sorted runs of the windows of all earlier batches, so what
is found there starts in a document with a smaller id. A match is verified by a second hash of CHECK_BITS bits, made of
the words' letters with another seed and so independent of the 64-bit fingerprint: only windows that agree in both count
as equal. Runs are read one after another. What is new becomes a run; a compaction merges the runs of a bucket when there
are FAN of them, and cuts buckets finer as the index grows. `SubstringIndex` keeps the runs as tables in the shared
folder, and further batches may be added later.

Within a chunk of a map task only the first document's use of a window is sent, since its other documents are repeats
whatever else exists; so a passage that most documents share sends one entry per chunk.

Defined cases: null, empty and short texts have no window and lose nothing; rows with one id are one document as far as
"smaller id" goes, and each is judged by its own text; null ids come before all others; repeated rows get equal results;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import Scratch, text_or_empty

WIDTH = 13
BATCHES, BUCKETS, FAN = 4, 96, 4
CHUNK_BYTES = 4 << 20
#: Bytes of text for each bucket, so that what a task merges does not grow with the input.
BUCKET_BYTES = 16 << 20
#: Bits of the second hash. Of n windows about n ** 2 / 2 ** (65 + CHECK_BITS) are expected to be taken for another's.
CHECK_BITS = 24
#: Bytes of a bucket's runs above which a compaction cuts the buckets finer.
RUN_BYTES = 32 << 20
_NO_ID = -(1 << 63)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of like rank side by side: the leading bytes of sorted differences are zeros and cost nothing."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplane(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).view(dtype).ravel() if raw else np.zeros(0, dtype)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes; the first is sorted uint64 and stored as differences."""
    first = columns[0]
    parts = [_planes(np.diff(first, prepend=first[:1] * 0)), *map(_planes, columns[1:])]
    return len(first).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueeze(blob: bytes, *dtypes) -> list[np.ndarray]:
    n, raw, out, at = int.from_bytes(blob[:8], "little"), zstandard.ZstdDecompressor().decompress(blob[8:]), [], 0
    for k, dtype in enumerate((np.uint64, *dtypes)):
        size = n * np.dtype(dtype).itemsize
        column = _unplane(raw[at : at + size], dtype)
        out.append(np.cumsum(column, dtype=np.uint64) if k == 0 else column)
        at += size
    return out


def windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, check, document and word position of every window of `width` words; no window crosses documents."""
    starts, ends, first = tc.word_spans(data, offsets)
    prints = tc.joined_hashes(tc.slice_hashes(data, starts, ends), width)
    checks = (tc.joined_hashes(tc.slice_hashes(data, starts, ends, 1), width, 1) >> np.uint64(64 - CHECK_BITS)).astype(np.uint32)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not len(prints):
        none = np.zeros(0, np.int64)
        return prints, checks, none, none
    inside = doc[: len(prints)] == doc[width - 1 :]
    at = np.flatnonzero(inside)
    return prints[at], checks[at], doc[at], at - first[doc[at]]


def _chunked(width: int, buckets: int):
    """(doc_id, row_hash, text) of a batch to index entries by bucket, repeats within the chunk, and the chunk's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, bucket: list[int], chunk: str, blobs: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(blobs), pa.int32()), pa.array(bucket, pa.int32()), pa.array([chunk] * len(blobs)), pa.array(blobs, pa.binary())], names=["kind", "bucket", "chunk", "blob"])

        for batch in batches:
            data, offsets = tc.string_buffers(batch.column(2))
            ids, hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in tc.groups(offsets, CHUNK_BYTES):
                fp, check, doc, pos = (np.concatenate(x) for x in zip(*(_shifted(windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width), a - i) for a, b in _within(offsets, i, j)), strict=True))
                if not len(fp):
                    continue
                own = ids[i:j]
                # Entries by fingerprint, smallest id first.
                rank = np.empty(j - i, dtype=np.int64)
                rank[np.argsort(own, kind="stable")] = np.arange(j - i)
                order = np.argsort(fp, kind="stable")
                fp, check, doc, pos = fp[order], check[order], doc[order], pos[order]
                head = np.ones(len(fp), dtype=bool)
                head[1:] = (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])
                # Where a fingerprint's checks differ, equal ones must stand together.
                clash = np.flatnonzero((fp[1:] == fp[:-1]) & (check[1:] != check[:-1]))
                if len(clash):
                    order = np.lexsort((check, fp))
                    fp, check, doc, pos = fp[order], check[order], doc[order], pos[order]
                    head[1:] = (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])
                group = np.cumsum(head) - 1
                least = np.minimum.reduceat(own[doc], np.flatnonzero(head))[group]
                repeat = own[doc] > least
                table = np.concatenate([own, hashes[i:j]]).astype("<i8").tobytes()
                chunk = hashlib.blake2b(table, digest_size=16).hexdigest()  # the same if the task runs again
                home = int(chunk[:8], 16) % buckets
                places = (doc.astype(np.uint64) << np.uint64(32)) | pos.astype(np.uint64)
                yield rows(2, [home], chunk, [table])
                if repeat.any():
                    yield rows(1, [home], chunk, [squeeze(np.sort(places[repeat]))])
                fp, check, doc, pos = fp[~repeat], check[~repeat], doc[~repeat], pos[~repeat]
                used, local = np.unique(doc, return_inverse=True)
                cut = np.searchsorted(fp, _edges(buckets))
                cut = np.append(cut, len(fp))
                blobs, at = [], []
                for k in range(buckets):
                    a, b = int(cut[k]), int(cut[k + 1])
                    if a < b:
                        mine, of = np.unique(local[a:b], return_inverse=True)
                        body = squeeze(fp[a:b], check[a:b], of.astype(np.uint32), pos[a:b].astype(np.uint32))
                        names = zstandard.ZstdCompressor(level=1).compress(_planes(used[mine].astype(np.uint32)) + _planes(own[used[mine]]))
                        blobs.append(len(mine).to_bytes(4, "little") + len(names).to_bytes(4, "little") + names + body)
                        at.append(k)
                yield rows(0, at, chunk, blobs)

    return run


def _within(offsets: np.ndarray, i: int, j: int) -> Iterator[tuple[int, int]]:
    for a, b in tc.groups(offsets[i : j + 1] - offsets[i], 2 << 20):
        yield a + i, b + i


def _shifted(found, by: int):
    fp, check, doc, pos = found
    return fp, check, doc + by, pos


def _edges(buckets: int) -> np.ndarray:
    """First fingerprints of the buckets: equal ranges of the hash space."""
    return np.array([(k << 64) // buckets for k in range(buckets)], dtype=np.uint64)


def _entries(blob: bytes) -> tuple[np.ndarray, ...]:
    """Fingerprints, checks, ids, places (document of the chunk and position)."""
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    names = zstandard.ZstdDecompressor().decompress(blob[8 : 8 + size])
    docs, ids = _unplane(names[: 4 * n], np.uint32), _unplane(names[4 * n :], np.int64)
    fp, check, of, pos = unsqueeze(blob[8 + size :], np.uint32, np.uint32, np.uint32)
    return fp, check, ids[of], (docs[of].astype(np.uint64) << np.uint64(32)) | pos.astype(np.uint64)


def _member(fp: np.ndarray, check: np.ndarray, run: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether a sorted run holds (fp, check); runs are sorted by both."""
    keys, checks = run
    out = np.zeros(len(fp), dtype=bool)
    at = np.searchsorted(keys, fp, side="left")
    live = np.flatnonzero(at < len(keys))
    live = live[keys[at[live]] == fp[live]]
    while len(live):
        hit = checks[at[live]] == check[live]
        out[live[hit]] = True
        live = live[~hit]
        at[live] += 1
        live = live[at[live] < len(keys)]
        live = live[keys[at[live]] == fp[live]]
    return out


def _merge(new: pd.DataFrame, runs: pd.DataFrame) -> Iterator[tuple]:
    """Rows (kind, bucket, chunk, blob) of one bucket: its entries (0) become repeats by chunk (1) and a new run (3)."""
    for row in new[new["kind"] > 0].itertuples(index=False):
        yield row.kind, row.bucket, row.chunk, row.blob
    new = new[new["kind"] == 0]
    if not len(new):
        return
    bucket = int(new["bucket"].iloc[0])
    chunks = new["chunk"].tolist()
    parts = [_entries(b) for b in new["blob"]]
    fp, check, ids, places = (np.concatenate(x) for x in zip(*parts, strict=True))
    chunk = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    del parts
    order = np.argsort(fp, kind="stable")
    same = fp[order[1:]] == fp[order[:-1]]
    if (same & (check[order[1:]] != check[order[:-1]])).any():
        order = np.lexsort((check, fp))
    fp, check, ids = fp[order], check[order], ids[order]
    head = np.ones(len(fp), dtype=bool)
    head[1:] = (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])
    firsts = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    known = np.zeros(len(firsts), dtype=bool)
    for blob in runs["blob"]:
        known |= _member(fp[firsts], check[firsts], tuple(unsqueeze(blob, np.uint32)))
    repeat = known[group] | (ids > np.minimum.reduceat(ids, firsts)[group])
    hit = order[repeat]
    hit = hit[np.argsort(chunk[hit], kind="stable")]
    bounds = np.searchsorted(chunk[hit], np.arange(len(chunks) + 1))
    for k, name in enumerate(chunks):
        if bounds[k] < bounds[k + 1]:
            yield 1, bucket, name, squeeze(np.sort(places[hit[bounds[k] : bounds[k + 1]]]))
    fresh = firsts[~known]
    if len(fresh):
        yield 3, bucket, "", squeeze(fp[fresh], check[fresh])


def _merge_group(new: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(list(_merge(new, runs)), columns=["kind", "bucket", "chunk", "blob"])


def _compact(times: int):
    """One sorted run of a bucket's runs, which share nothing, cut into `times` buckets."""

    def run(runs: pd.DataFrame) -> pd.DataFrame:
        fp, check = (np.concatenate(x) for x in zip(*(unsqueeze(b, np.uint32) for b in runs["blob"]), strict=True))
        order = np.argsort(fp, kind="stable")
        if (fp[order[1:]] == fp[order[:-1]]).any():
            order = np.lexsort((check, fp))
        fp, check = fp[order], check[order]
        old, every = int(runs["bucket"].iloc[0]), int(runs["buckets"].iloc[0]) * times
        cut = [*np.searchsorted(fp, _edges(every)[old * times : (old + 1) * times]).tolist(), len(fp)]
        parts = [(old * times + k, squeeze(fp[a:b], check[a:b])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
        return pd.DataFrame([(3, k, "", blob) for k, blob in parts], columns=["kind", "bucket", "chunk", "blob"])

    return run


def _spans(repeats: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of a chunk as (first, count) stretches by document: doc_id, row_hash, spans."""
    names = ["doc_id", "row_hash", "spans"]
    if not len(repeats) or not len(chunks):
        return pd.DataFrame({n: [] for n in names})
    ids, hashes = np.frombuffer(chunks["blob"].iloc[0], "<i8").reshape(2, -1)
    places = np.unique(np.concatenate([unsqueeze(b)[0] for b in repeats["blob"]]))
    new = np.ones(len(places), dtype=bool)
    new[1:] = places[1:] != places[:-1] + np.uint64(1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(places)))
    doc, pos = (places[first] >> np.uint64(32)).astype(np.int64), (places[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    pairs = np.stack([pos, count], axis=1).astype("<u4")
    spans = [pairs[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(doc)], strict=True)]
    return pd.DataFrame({"doc_id": ids[doc[cut]], "row_hash": hashes[doc[cut]], "spans": spans})


_ROWS = "kind int, bucket int, chunk string, blob binary"


class SubstringIndex:
    """Runs of window fingerprints of all documents added so far, sorted within buckets."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.width, self.buckets, self.fan = spark, width, buckets, fan
        self.scratch = Scratch(spark, "substring")
        self.runs: list[DataFrame] = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds (doc_id, row_hash, text), whose ids are above those added before; returns the repeated windows as
        (doc_id, row_hash, spans), spans being pairs of uint32: first window, number of windows."""
        if len(self.runs) >= self.fan:
            self.compact()
        entries = docs.select("doc_id", "row_hash", "text").mapInArrow(_chunked(self.width, self.buckets), _ROWS)
        history = self.spark.createDataFrame([], "bucket int, blob binary")
        for run in self.runs:
            history = history.unionByName(run.filter("kind = 3").select("bucket", "blob"))
        merged = self.scratch.write(entries.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInPandas(lambda a, b: _merge_group(a, b), _ROWS), "run")
        repeats, chunks = (merged.filter(f"kind = {k}").select("chunk", "blob").groupBy("chunk") for k in (1, 2))
        spans = self.scratch.write(repeats.cogroup(chunks).applyInPandas(lambda a, b: _spans(a, b), "doc_id long, row_hash long, spans binary"), "spans")
        self.runs.append(merged)
        return spans

    def compact(self) -> None:
        """Merges all runs into one, its buckets finer if they hold more than RUN_BYTES."""
        old = self.runs
        rows = old[0]
        for run in old[1:]:
            rows = rows.unionByName(run)
        rows = rows.filter("kind = 3").withColumn("buckets", F.lit(self.buckets))
        most = rows.groupBy("bucket").agg(F.sum(F.octet_length("blob")).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        times = -(-most // RUN_BYTES) or 1
        self.runs = [self.scratch.write(rows.groupBy("bucket").applyInPandas(_compact(times), _ROWS), "compacted")]
        self.buckets *= times
        for run in old:
            self.scratch.drop(run)

    def drop(self) -> None:
        for run in self.runs:
            self.scratch.drop(run)
        self.runs = []


def _removed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans list) to the digest columns and, last, the text that stays."""
    for batch in batches:
        data, offsets = tc.string_buffers(batch.column(1))
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for i, j in tc.groups(offsets):
            part = data[offsets[i] : offsets[j]]
            starts, ends, first = tc.word_spans(part, offsets[i : j + 1] - offsets[i])
            raw = part.tobytes()
            for d in range(j - i):
                a, b = int(first[d]), int(first[d + 1])
                spans = batch.column(2)[i + d].as_py()
                gone = np.zeros(b - a + 1, dtype=np.int64)
                for blob in spans or ():
                    for at, count in np.frombuffer(blob, "<u4").reshape(-1, 2).tolist():
                        gone[at] += 1
                        gone[min(at + count + width - 1, b - a)] -= 1
                keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + a
                text = b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                n_words.append(b - a)
                n_removed.append(b - a - len(keep))
                digests.append(hashlib.sha256(text).hexdigest())
                kept_texts.append(text.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def dedup(df: DataFrame, batches: int = BATCHES, width: int = WIDTH, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row, the documents entering in `batches` of ascending id."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    key = F.coalesce("doc_id", F.lit(_NO_ID))
    cuts = F.percentile_approx(key, [k / batches for k in range(1, batches)], 1000) if batches > 1 else F.lit(None)
    about = docs.agg(cuts.alias("bounds"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    bounds = sorted(set(about["bounds"] or []))
    rows = docs.withColumn("row_hash", F.xxhash64("text"))
    index = SubstringIndex(spark, width, max(BUCKETS, -(-(about["bytes"] or 0) // BUCKET_BYTES)))
    found = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        batch = rows.withColumn("doc_id", key)
        batch = batch if low is None else batch.filter(F.col("doc_id") > low)
        batch = batch if high is None else batch.filter(F.col("doc_id") <= high)
        spans = index.add(batch)
        found = spans if found is None else found.unionByName(spans)
    index.drop()
    # A document has spans from a few chunks at most: one for each of its repeated rows.
    stretches = found.groupBy("doc_id", "row_hash").agg(F.first("spans").alias("spans")).withColumnRenamed("doc_id", "__id").withColumnRenamed("row_hash", "__hash")
    joined = rows.join(stretches.hint("shuffle_hash"), (key == F.col("__id")) & (F.col("row_hash") == F.col("__hash")), "left")
    return joined.select("doc_id", "text", F.when(F.col("spans").isNotNull(), F.array("spans")).alias("spans")).mapInArrow(lambda it: _removed(it, width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
