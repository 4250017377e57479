"""Secret scan: base patterns, and a character convolutional network over every other candidate.

Base findings are the leftmost non-overlapping matches of three patterns; they always stay. All maximal runs of at least
CANDIDATE token characters outside them are candidates; of a run that a finding covers in part, what is left on either
side is a run. The network sees the whole candidate and its document's bytes around it, zeros beyond the document:
embedding, one convolution, maximum over positions, logistic output, all in numpy.

The base patterns say nothing about what they do not match, so the network learns from three kinds of labelled findings
of a bounded sample: values of base findings as they stand; the same values with the text before them blanked, so that a
trigger word cannot be all it goes by; and secrets of known formats planted in place of ordinary runs of real documents.
Other runs, as they stand and in capitals, are the negatives, except those that a first network takes for findings with a chance of UNLABELLED or more:
they count as unlabelled and the final network is fitted without them.

The labelled examples have three parts: one fits, one calibrates (Platt scaling by damped Newton steps), and on the third
the threshold is the highest that still recalls RECALL of the findings there. Candidates at or above it become spans.

The sample is documents by a hash, SAMPLE_DOCUMENTS in expectation, and at most EXAMPLES runs of each kind, twice as many of other runs; the scan
itself covers whole texts of all documents. Runs over LONGEST_EXAMPLE bytes are scored whole, but not trained on. Without
other runs in the sample nothing is added.

Defined cases: null and empty texts have no span; equal texts get equal spans, whatever stands beside them; null ids are
kept; an empty table gives an empty result; further columns are ignored. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import Scratch, text_or_empty

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
#: Runs are maximal, so a least length in the pattern drops the same matches as a test afterwards.
_ACCESS, _HEX = re.compile(rb"AKIA[A-Z0-9]{12,}"), re.compile(rb"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
CANDIDATE, ORDINARY = 12, 8
BEFORE, INSIDE, AFTER = 24, 40, 8
SPAN = BEFORE + INSIDE + AFTER
LONGEST_EXAMPLE = 4096
SAMPLE_DOCUMENTS, EXAMPLES = 20_000, 2_000
#: Plants in a group of sampled documents at most.
PLANTS = 64
RECALL, UNLABELLED = 0.98, 0.9
WIDTH, CHANNELS, EMBED, EPOCHS, BATCH, RATE = 5, 16, 6, 25, 128, 0.01

_RUN = np.zeros(256, dtype=bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True


@dataclass
class Network:
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0


def base_findings(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns in bytes; documents are kept apart by newlines, which no pattern matches."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(*m.span(), 1) for m in _ACCESS.finditer(raw)]
    found += [(*m.span(), 2) for m in _HEX.finditer(raw)]
    return sorted(found)


def runs_of(data: np.ndarray, least: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """(n, 2) maximal runs of token characters outside the findings."""
    cover = np.zeros(len(data) + 1, dtype=np.int32)
    for place, step in ((0, 1), (1, -1)):
        np.add.at(cover, np.array([f[place] for f in found], dtype=np.int64), step)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _RUN[data] & (np.cumsum(cover)[:-1] == 0)
    change = np.diff(inside)
    spans = np.stack([np.flatnonzero(change == 1), np.flatnonzero(change == -1)], axis=1)
    return spans[spans[:, 1] - spans[:, 0] >= least]


def views(data: np.ndarray, spans: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of SPAN bytes that cover each span and the context on both sides, and the first row of each span.

    Rows of a span overlap, so that each position of the convolution is in one; bytes beyond the span's document are 0.
    `begin`: where each document begins; a newline ends it.
    """
    if not len(spans):
        return np.zeros((0, SPAN), dtype=np.uint8), np.zeros(0, dtype=np.int64)
    beyond = np.maximum(spans[:, 1] - spans[:, 0] - INSIDE, 0)
    count = 1 - (-beyond // (SPAN - WIDTH + 1))
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(spans)), count)
    left = spans[owner, 0] - BEFORE + np.minimum((np.arange(len(owner)) - first[owner]) * (SPAN - WIDTH + 1), beyond[owner])
    document = (np.searchsorted(begin, spans[:, 0], side="right") - 1)[owner]
    low, high = begin[document], np.append(begin[1:], len(data))[document] - 1
    at = left[:, None] + np.arange(SPAN)[None, :]
    seen = np.minimum(data[np.clip(at, 0, len(data) - 1)], 127)
    return np.where((at >= low[:, None]) & (at < high[:, None]), seen, 0).astype(np.uint8), first


def _best(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each row, and for each row and channel the place of the maximum and its value."""
    e = net.embed[x]  # n, SPAN, EMBED
    n = len(x)
    columns = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, SPAN - WIDTH + 1, WIDTH * EMBED)
    z = columns @ net.kernel + net.bias
    top = z.argmax(axis=1)
    return columns, top, np.take_along_axis(z, top[:, None, :], axis=1)[:, 0, :]


def _forward(net: Network, x: np.ndarray, first: np.ndarray) -> tuple:
    """As _best, with the row that holds the maximum for each candidate and channel, the pooled values and the output."""
    columns, top, best = _best(net, x)
    most = np.maximum.reduceat(best, first, axis=0)
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    row = np.minimum.reduceat(np.where(best == most[owner], np.arange(len(x))[:, None], len(x)), first, axis=0)
    pooled = np.maximum(most, 0)
    return columns, np.take_along_axis(top, row, axis=0), row, pooled, pooled @ net.out + net.intercept


def logits(net: Network, x: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Output for each candidate; without `first`, each row is one."""
    if not len(x):
        return np.zeros(0, np.float32)
    best = np.concatenate([_best(net, x[i : i + 512])[2] for i in range(0, len(x), 512)])
    return np.maximum(best if first is None else np.maximum.reduceat(best, first, axis=0), 0) @ net.out + net.intercept


def probabilities(net: Network, x: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.slope * logits(net, x, first) + net.shift, -30, 30)))


def _rows_of(some: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of some candidates, and where each one's begin among them."""
    start = np.cumsum(count[some]) - count[some]
    return np.repeat(first[some] - start, count[some]) + np.arange(count[some].sum()), start


def _calibrated(z: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Platt's intercept and slope by Newton steps, each halved until the loss falls."""
    design = np.column_stack([np.ones(len(z)), z])
    goal = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))  # Platt's targets
    cost = lambda b: float((np.logaddexp(0, design @ b) - goal * (design @ b)).sum()) + 1e-6 * float(b @ b)
    beta = np.array([0.0, 1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        change = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 2e-6 * np.eye(2), design.T @ (goal - p) - 2e-6 * beta)
        while cost(beta + change) > cost(beta) and np.abs(change).max() > 1e-10:
            change = change / 2
        beta = beta + change
        if np.abs(change).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def train(x: np.ndarray, y: np.ndarray, seed: int = 0, first: np.ndarray | None = None) -> Network:
    """Adam on logistic loss over three fifths, Platt calibration on a fifth, the recall-constrained threshold on the last."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (128, EMBED)).astype(np.float32), rng.normal(0, 0.2, (WIDTH * EMBED, CHANNELS)).astype(np.float32), np.zeros(CHANNELS, np.float32), rng.normal(0, 0.2, CHANNELS).astype(np.float32), 0.0)
    first = np.arange(len(x)) if first is None else first
    count = np.diff(np.append(first, len(x)))
    order = rng.permutation(len(y))
    fifth = len(y) // 5
    calibrates, decides, rest = order[:fifth], order[fifth : 2 * fifth], order[2 * fifth :]
    names = ("embed", "kernel", "bias", "out", "intercept")
    moments = {k: [np.zeros_like(np.asarray(getattr(net, k), dtype=np.float32)) for _ in range(2)] for k in names}
    weight = np.where(y > 0, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (1 - y).sum(), 1))
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(rest)
        for i in range(0, len(rest), BATCH):
            some = rest[i : i + BATCH]
            rows, start = _rows_of(some, first, count)
            columns, top, row, pooled, raw = _forward(net, x[rows], start)
            error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) * weight[some] / len(some)).astype(np.float32)
            d_pool = error[:, None] * net.out[None, :] * (pooled > 0)
            chosen = columns[row, top]  # n, CHANNELS, WIDTH * EMBED
            d_columns = d_pool[:, :, None] * net.kernel.T[None, :, :]
            d_embed = np.zeros_like(net.embed)
            where = top[:, :, None] + np.arange(WIDTH)[None, None, :]
            np.add.at(d_embed, x[rows][row[:, :, None], where], d_columns.reshape(len(some), CHANNELS, WIDTH, EMBED))
            grads = {"embed": d_embed, "kernel": np.einsum("nc,nck->kc", d_pool, chosen), "bias": d_pool.sum(axis=0), "out": pooled.T @ error, "intercept": error.sum()}
            step += 1
            for k in names:
                m, v = moments[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, getattr(net, k) - (float(change) if k == "intercept" else change))
    raw = logits(net, x, first).astype(np.float64)
    if 0 < y[calibrates].sum() < len(calibrates) and y[decides].sum():
        net.shift, net.slope = _calibrated(raw[calibrates], y[calibrates])
        scores = np.sort(1 / (1 + np.exp(-np.clip(net.slope * raw + net.shift, -30, 30)))[decides][y[decides] > 0])
        net.threshold = float(scores[int(np.floor((1 - RECALL) * len(scores)))])
    return net


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Formats of planted secrets: what stands before, the letters, least and most of them, parts joined by dots.
FORMATS = {
    "hex": ("", _DIGITS + "abcdef", 20, 64, 1),
    "letters and digits": ("", _LOWER + _UPPER + _DIGITS, 20, 48, 1),
    "base64": ("", _LOWER + _UPPER + _DIGITS + "+/", 32, 88, 1),
    "capitals and digits": ("", _UPPER + _DIGITS, 20, 32, 1),
    "small letters and digits": ("", _LOWER + _DIGITS, 20, 40, 1),
    "prefixed": ("key_", _LOWER + _UPPER + _DIGITS, 20, 40, 1),
    "dotted": ("ey", _LOWER + _UPPER + _DIGITS + "_-", 16, 48, 3),
}


def planted(seed: int, formats: tuple[str, ...] = tuple(FORMATS)) -> bytes:
    """A random secret of one of the formats."""
    rng = np.random.default_rng(seed)
    prefix, letters, least, most, parts = FORMATS[formats[int(rng.integers(len(formats)))]]
    return (prefix + ".".join("".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(least, most + 1))) for _ in range(parts))).encode()


def plant(data: np.ndarray, spans: np.ndarray, begin: np.ndarray, formats: tuple[str, ...] = tuple(FORMATS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each span with its surroundings as a text of its own in which a secret stands for it: bytes, spans, begins."""
    texts, out, at, low = [], [], [], 0
    keys = tc.slice_hashes(data, np.maximum(spans[:, 0] - BEFORE, 0), spans[:, 1])
    ends = np.append(begin[1:], len(data)) - 1
    for (a, b), key in zip(spans.tolist(), keys.tolist(), strict=True):
        d = int(np.searchsorted(begin, a, side="right")) - 1
        left, secret, right = data[max(int(begin[d]), a - SPAN) : a].tobytes(), planted(key, formats), data[b : min(int(ends[d]), b + SPAN)].tobytes()
        texts.append(left + secret + right + b"\n")
        out.append((low + len(left), low + len(left) + len(secret)))
        at.append(low)
        low += len(texts[-1])
    return np.frombuffer(b"".join(texts), np.uint8), np.array(out, dtype=np.int64).reshape(-1, 2), np.array(at, dtype=np.int64)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the documents with a newline after each, where each begins, and the code points before each byte."""
    data, offsets = tc.string_buffers(column)
    n = len(offsets) - 1
    out = np.full(len(data) + n, 10, dtype=np.uint8)
    begin = offsets[:-1] + np.arange(n)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    return out, begin, points


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    _, offsets = tc.string_buffers(batch.column(1))
    for i, j in tc.groups(offsets):
        yield batch.slice(i, j - i)


def _example_views(data: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, rows, first rows) of training views; kinds: 0 other runs, 1 findings as they stand, 2 without what is before, 3 planted, 4 other runs in capitals."""
    found = base_findings(data.tobytes())
    # A finding's own run: the value, not the name before it.
    good = np.array([[max(a, b - _value_length(data, a, b)), b] for a, b, _ in found], dtype=np.int64).reshape(-1, 2)
    ordinary = runs_of(data, ORDINARY, found)
    places = ordinary[tc.slice_hashes(data, np.maximum(ordinary[:, 0] - BEFORE, 0), ordinary[:, 1]) % np.uint64(16) == 0][:PLANTS]
    short = lambda spans: spans[spans[:, 1] - spans[:, 0] <= LONGEST_EXAMPLE]
    rows, first = views(data, short(runs_of(data, CANDIDATE, found)), begin)
    yield 0, rows, first
    yield 4, np.where((rows >= 97) & (rows <= 122), rows - 32, rows).astype(np.uint8), first
    yield 1, *views(data, short(good), begin)
    rows, first = views(data, short(good), begin)
    blank = rows.copy()
    blank[first, :BEFORE] = 0
    yield 2, blank, first
    own, spans, at = plant(data, places, begin)
    yield 3, *views(own, spans, at)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training views (kind, key, view) of a sample's documents."""
    for batch in batches:
        for part in _groups(batch):
            data, begin, _ = _joined(part.column(1))
            for kind, x, first in _example_views(data, begin):
                if len(first):
                    starts, ends = first * SPAN, np.append(first[1:], len(x)) * SPAN
                    keys, raw = tc.slice_hashes(x.ravel(), starts, ends), x.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(first), pa.int32()), pa.array(keys.view(np.int64)), pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["kind", "key", "view"])


def _value_length(data: np.ndarray, a: int, b: int) -> int:
    inside = _RUN[data[a:b]]
    return int(np.argmin(inside[::-1])) if not inside.all() else b - a


def learn(examples: list[tuple[int, bytes]]) -> Network:
    """The network of (kind, view) examples, kinds 0 and 4 being negative: fitted twice, the second time without unlabelled runs."""
    rows = [np.frombuffer(view, np.uint8).reshape(-1, SPAN) for _, view in examples]
    y = np.array([float(0 < kind < 4) for kind, _ in examples])
    count = np.array([len(x) for x in rows])
    x, first = np.concatenate(rows), np.cumsum(count) - count
    chance = probabilities(train(x, y, first=first), x, first)
    sure = np.flatnonzero((y > 0) | (chance < UNLABELLED))
    if len(sure) == len(y):
        sure = np.arange(len(y))
    some, start = _rows_of(sure, first, count)
    return train(x[some], y[sure], seed=1, first=start)


def fit(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, examples: int = EXAMPLES) -> Network | None:
    """The network of a bounded sample; None if it has no findings or no other runs."""
    scratch, share = Scratch(docs.sparkSession, "secrets"), 1 << 20
    least = min(share, -(-sample_documents * share // max(docs.count(), 1)))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) < least)
    seen = scratch.write(some.mapInArrow(_examples, "kind int, key long, view binary").distinct(), "examples")
    got = [seen.filter(F.col("kind") == k).orderBy("key", "view").limit(examples * (2 if k == 0 else 1)).collect() for k in range(5)]
    scratch.drop(seen)
    if not got[0] or not any(got[1:4]):
        return None
    return learn([(r["kind"], bytes(r["view"])) for rows in got for r in rows])


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans) for every row."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    net = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"]
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for part in _groups(batch):
                data, begin, points = _joined(part.column(1))
                found = base_findings(data.tobytes())
                more = np.zeros((0, 2), dtype=np.int64)
                if net is not None:
                    more = runs_of(data, CANDIDATE, found)
                    more = more[probabilities(net, *views(data, more, begin)) >= net.threshold]
                counts = np.zeros((len(KINDS), part.num_rows), dtype=np.int64)
                shas, shown = [nothing] * part.num_rows, [""] * part.num_rows
                rows: dict[int, list[tuple[int, int, int]]] = {}
                for a, b, kind in [*found, *((a, b, 3) for a, b in more.tolist())]:
                    d = int(np.searchsorted(begin, a, side="right")) - 1
                    zero = points[begin[d]]
                    rows.setdefault(d, []).append((int(points[a] - zero), kind, int(points[b] - zero)))
                    counts[kind, d] += 1
                for d, spans in rows.items():
                    spans.sort()
                    shas[d] = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < 3).encode()).hexdigest()
                    shown[d] = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in counts), pa.array(shas), pa.array(shown)], names=names)

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")
