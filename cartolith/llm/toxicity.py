"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of the letters (bytes) of words, given up to ORDER - 1 letters before them in the word. It
discounts its own counts and backs off to one chain of lower orders, whose continuation counts both classes share. So a
rare expression that a class has not seen gets the same backoff from both, and only what a class has counted tells them
apart. A toxic text is taken as ordinary words with toxic expressions strewn in: each word comes from the toxic model
with chance STREWN and from the ordinary one otherwise. The log-likelihood of that less that under the ordinary model,
per word of the document, is the only thing that a logistic fit on documents the models have not seen turns into a
probability.

n-grams of up to ORDER letters are packed into one number with their length, so none are confused. Models are fitted on
a bounded sample: at most ROWS_PER_CLASS labelled rows of each class, the first by a hash of their id, of those with at
most LONGEST bytes of text. Their n-grams are counted by all executors and fitted in one task. All documents are scored
over their whole text.

Defined cases: null text counts as empty; an empty text has ratio 0 and gets the score of that; with labels of one class
only, all scores are that class; without labels, all are 0; several labels of one id count as toxic if any is; null
ids are never labelled; repeated rows score alike; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import Scratch, text_or_empty

ORDER = 6
DISCOUNT = 0.75
ROWS_PER_CLASS = 3_000
#: Of the sample, one part in this many calibrates and the others fit the models.
FOLDS = 4
LONGEST = 1 << 16
GROUP_BYTES = 1 << 20
_START, _END = 1, 2
#: Share of a toxic text's words that are toxic expressions.
STREWN = 0.01


@dataclass
class Model:
    """Sorted n-grams and contexts with their log ratios, and the logistic fit of a ratio per word."""

    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    weights: np.ndarray  # intercept and slope; empty before the fit


def _framed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with start and end marks, side by side, and n+1 offsets."""
    sizes = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], dtype=np.uint8)
    inner = np.ones(at[-1], dtype=bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[at[:-1]], out[at[1:] - 1] = _START, _END
    out[inner] = data[np.arange(int((ends - starts).sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts)]
    return out, at


def _events(framed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all letters but the start marks, and where their context begins."""
    begin = np.repeat(at[:-1], np.diff(at))
    where = np.flatnonzero(np.arange(len(framed)) != begin)
    return where, np.maximum(begin[where], where - (ORDER - 1))


def _packed(framed: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Letters of each slice, the first in the lowest byte, and its length in the highest; at most seven letters."""
    size = end - begin
    return tc.heads(framed, begin, size) | (size.astype(np.uint64) << np.uint64(56))


_LETTERS = np.uint64((1 << 56) - 1)


def _tail(grams: np.ndarray) -> np.ndarray:
    """The n-grams without their first letter."""
    return ((grams & _LETTERS) >> np.uint64(8)) | (((grams >> np.uint64(56)) - np.uint64(1)) << np.uint64(56))


def _context(grams: np.ndarray) -> np.ndarray:
    """The n-grams without their last letter."""
    size = (grams >> np.uint64(56)) - np.uint64(1)
    return (grams & ((np.uint64(1) << (np.uint64(8) * size)) - np.uint64(1))) | (size << np.uint64(56))


def _find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray, default: np.ndarray | float) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(np.asarray(default, dtype=np.float64), wanted.shape).copy()
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def word_ratios(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each word: the sum over its letters."""
    if not len(starts):
        return np.zeros(0)
    framed, at = _framed(data, starts, ends)
    where, begin = _events(framed, at)
    grams = _packed(framed, begin, where + 1)
    ratio = _find(model.grams, grams, model.gram_ratio, np.nan)
    missing = np.flatnonzero(np.isnan(ratio))
    ratio[missing] = _find(model.contexts, _context(grams[missing]), model.context_ratio, 0.0)
    return np.add.reduceat(ratio, at[:-1] - np.arange(len(starts)))


def shared_chances(grams: np.ndarray) -> np.ndarray:
    """Shared Kneser-Ney probability of each n-gram's last letter given all of its context but the first letter.

    `grams`: the sorted distinct n-grams that occur. The continuation count of a shorter one is the number of distinct
    letters before it.
    """
    sizes = (grams >> np.uint64(56)).astype(np.int64)
    after: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    longer = grams[sizes == ORDER]
    for k in range(ORDER - 1, 0, -1):
        after[k] = np.unique(_tail(longer), return_counts=True)
        longer = np.union1d(grams[sizes == k], after[k][0])
    chances = {0: (np.zeros(1, np.uint64), np.full(1, 1 / 256))}
    for k in range(1, ORDER):
        found, count = after[k]
        _, of = np.unique(_context(found), return_inverse=True)
        total, kinds = np.bincount(of, weights=count), np.bincount(of)
        lower = np.full(len(found), 1 / 256) if k == 1 else _find(chances[k - 1][0], _tail(found), chances[k - 1][1], 0.0)
        chances[k] = found, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds[of] * lower) / total[of]
    out = np.full(len(grams), 1 / 256)
    for k in range(1, ORDER):
        some = sizes == k + 1
        out[some] = _find(chances[k][0], _tail(grams[some]), chances[k][1], 1 / 256)
    return out


def fit_ratios(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram and context log ratios from the sorted distinct n-grams and their counts in either class."""
    if not len(grams):
        return np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(0, np.uint64), np.zeros(0, np.float32)
    shared = shared_chances(grams)
    contexts, of = np.unique(_context(grams), return_inverse=True)
    logs, backoffs = [], []
    for c in (toxic, ordinary):
        total = np.bincount(of, weights=c, minlength=len(contexts))
        kinds = np.bincount(of, weights=c > 0, minlength=len(contexts))
        backoff = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1)[of] + backoff[of] * shared))
        backoffs.append(np.log(backoff))
    gram_ratio, context_ratio = logs[0] - logs[1], backoffs[0] - backoffs[1]
    keep = np.abs(gram_ratio - context_ratio[of]) > 0.01
    return grams[keep], gram_ratio[keep].astype(np.float32), contexts, context_ratio.astype(np.float32)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic, ordinary) to the rows of both tables of log ratios."""
    rows = [[b.column(k).to_numpy() for k in range(3)] for b in batches]
    keys, toxic, ordinary = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    order = np.argsort(keys.astype(np.uint64))
    grams, gram_ratio, contexts, context_ratio = fit_ratios(keys.astype(np.uint64)[order], toxic[order].astype(np.float64), ordinary[order].astype(np.float64))
    for is_context, found, ratio in ((False, grams, gram_ratio), (True, contexts, context_ratio)):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), is_context)), pa.array(found.astype(np.int64)), pa.array(ratio.astype(np.float32))], names=["context", "key", "ratio"])


def _half(got: pa.Table, contexts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and ratios of one of the tables."""
    some = got.filter(pa.compute.equal(got["context"], contexts))
    keys, ratio = some["key"].to_numpy().astype(np.uint64), some["ratio"].to_numpy()
    order = np.argsort(keys)
    return keys[order], ratio[order]


def ratios(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio per word of each document, its toxic expressions strewn among ordinary words."""
    data = tc.lower_ascii(data)
    starts, ends, first = tc.word_spans(data, offsets)
    out = np.zeros(len(offsets) - 1)
    if len(starts):
        one, inverse = tc.distinct_slices(data, starts, ends)
        ratio = np.logaddexp(np.log(1 - STREWN), np.log(STREWN) + word_ratios(model, data, starts[one], ends[one]))[inverse]
        some = np.flatnonzero(np.diff(first))
        out[some] = np.add.reduceat(ratio, first[:-1][some]) / np.diff(first)[some]
    return out


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each document to be toxic."""
    intercept, slope = model.weights
    return 1 / (1 + np.exp(-np.clip(intercept + slope * ratios(model, data, offsets), -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Intercept and slope of a weighted ridge logistic regression, by Newton steps that are halved until they help."""
    centre, scale = x.mean(), x.std() if x.std() > 1e-9 else 1.0
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    ridge = np.array([1e-6, 1e-2])
    cost = lambda b: float((w * np.logaddexp(0, -(2 * y - 1) * (z @ b))).sum() + (ridge * b * b).sum() / 2)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (w * (y - p)) - ridge * beta)
        while cost(beta + step) > cost(beta) and np.abs(step).max() > 1e-10:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return np.array([beta[0] - beta[1] * centre / scale, beta[1] / scale])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (gram, toxic count, ordinary count), summed over groups of documents."""
    for batch in batches:
        data, offsets = tc.string_buffers(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in tc.groups(offsets, GROUP_BYTES):
            part = tc.lower_ascii(data[offsets[i] : offsets[j]])
            starts, ends, first = tc.word_spans(part, offsets[i : j + 1] - offsets[i])
            if not len(starts):
                continue
            toxic = np.repeat(label[i:j], np.diff(first))
            one, inverse = tc.distinct_slices(part, starts, ends)
            framed, at = _framed(part, starts[one], ends[one])
            where, begin = _events(framed, at)
            word = np.repeat(np.arange(len(one)), np.diff(at) - 1)
            grams, of = np.unique(_packed(framed, begin, where + 1), return_inverse=True)
            counts = [np.bincount(of, weights=np.bincount(inverse[some], minlength=len(one))[word], minlength=len(grams)).astype(np.int64) for some in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), *(pa.array(c) for c in counts)], names=["gram", "toxic", "ordinary"])


def _ratios(model):
    """(doc_id, ratio) of (doc_id, text); `model` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.string_buffers(batch.column(1))
            for i, j in tc.groups(offsets, GROUP_BYTES):
                found = ratios(model.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(found)], names=["doc_id", "ratio"])

    return run


def _scorer(model):
    """(doc_id, score) of (doc_id, text); `model` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.string_buffers(batch.column(1))
            for i, j in tc.groups(offsets, GROUP_BYTES):
                found = scores(model.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(found)], names=["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, held_out_every: int = 5, rows_per_class: int = ROWS_PER_CLASS) -> Model | None:
    """The model of a bounded sample of labelled rows outside the held-out fold; docs: (doc_id, text)."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % held_out_every != 0)
    sizes = {int(r["toxic"] > 0): r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.filter("toxic > 0").orderBy(*order).limit(rows_per_class).unionByName(known.filter("toxic <= 0").orderBy(*order).limit(rows_per_class))
    scratch = Scratch(spark, "toxicity")
    picked = picked.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)) == 0)
    # At most 2 * rows_per_class ids of eight bytes; rows of one id and text count once.
    sample = docs.join(F.broadcast(picked), "doc_id").filter(F.octet_length("text") <= LONGEST).dropDuplicates(["doc_id", "text"])
    sample = scratch.write(sample, "sample")
    counts = sample.filter("not calibrates").select("text", F.col("toxic") > 0).mapInArrow(_gram_counts, "gram long, toxic long, ordinary long")
    grams = counts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    # The bounded sample's n-grams are fitted in one task, which spares the driver the work.
    got = grams.repartition(1).mapInArrow(_fitted, "context boolean, key long, ratio float").toArrow()
    bare = Model(*_half(got, False), *_half(got, True), np.zeros(0))
    shipped = spark.sparkContext.broadcast(bare)
    found = sample.filter("calibrates").select("doc_id", "text").mapInArrow(_ratios(shipped), "doc_id long, ratio double").join(F.broadcast(picked), "doc_id").orderBy("doc_id", "ratio").toArrow()
    scratch.drop(sample)
    x, y = found["ratio"].to_numpy(), (found["toxic"].to_numpy() > 0).astype(np.float64)
    if len(set(y)) < 2:
        share = sizes.get(1, 0) / sum(sizes.values())
        bare.weights = np.array([np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30), 0.0])
        return bare
    # The sample holds more of the rarer class than the labels do.
    weight = np.where(y > 0, sizes.get(1, 0) / y.sum(), sizes.get(0, 0) / (1 - y).sum())
    bare.weights = fit_logistic(x, y, weight * len(y) / weight.sum())
    return bare


def score(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", held_out_every: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    model = train(docs, labels, held_out_every)
    if model is None:
        scored = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        scored = docs.mapInArrow(_scorer(df.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % held_out_every == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", held_out_every: int = 5) -> DataFrame:
    """The rows of df that are not predicted toxic, with all their columns."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    model = train(docs, labels, held_out_every)
    if model is None:
        return df
    shipped, names, schema = df.sparkSession.sparkContext.broadcast(model), df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.string_buffers(batch.column(names.index(text_col)))
            keep = [scores(shipped.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) < 0.5 for i, j in tc.groups(offsets, GROUP_BYTES)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return df.mapInArrow(run, schema)
