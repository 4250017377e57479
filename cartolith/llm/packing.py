"""Best-fit packing of token sequences with a swap-based local search.

Documents are tokenised in parallel, only those longer than a sequence are cut, and the pieces are counted by length.
That histogram has at most one entry for each length, whatever the number of documents, and is all the driver sees. Best
fit decreasing packs it as patterns (the lengths of one bin) with multiplicities; the local search moves and exchanges
items between underfull bins, whole classes of equal bins at a time, as long as the squared fill grows and a bin may
empty. Executors then give each piece the slot of its rank among the pieces of its length.

Token ids are those of the tokenizer file. Text below U+0250 is split into pre-tokens by the pattern of that file with
array operations, and each distinct pre-token is merged once, those of one hash being compared in full; other documents go through the tokenizer itself.

Defined cases: null text counts as empty and gives one piece, the closing id alone; repeated rows are packed as rows of
their own; a null id is kept as null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import Scratch, text_or_empty

LENGTH, CLOSING = 2048, 0
_LIMIT = 0x250
_CACHE_MOST = 150_000
GROUP_BYTES = 2 << 20
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: White space below U+0250.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0]


def _classes() -> np.ndarray:
    out = np.full(_LIMIT, _OTHER, dtype=np.uint8)
    for c in range(_LIMIT):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    out[_SPACES] = _SPACE
    return out


_CLASS = _classes()


def pre_token_starts(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in code points below U+0250; offsets: n+1 bounds of the texts.

    A space joins the run of letters, numbers or others after it; other white space before a run stands alone, the last
    one apart; after a lone apostrophe that no space precedes, s, t, re, ve, m, ll and d are its own pre-token.
    """
    n = len(code)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _CLASS[code]
    start = np.ones(n + 1, dtype=bool)
    start[1:n] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start |= edge
    # The last white space of a run, if text follows it.
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~edge[1:n])
    start[last] = True
    joined = last[code[last] == 0x20]
    start[joined + 1] = False
    at = np.flatnonzero((code == 0x27) & start[:n])
    at = at[(at + 1 < n)]
    at = at[~edge[at + 1] & (kind[at + 1] == _LETTER)]
    if len(at):
        second = code[at + 1]
        third = np.where((at + 2 < n) & ~edge[np.minimum(at + 2, n)], code[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(second, [ord(c) for c in "stmd"])
        two = ((second == ord("r")) & (third == ord("e"))) | ((second == ord("v")) & (third == ord("e"))) | ((second == ord("l")) & (third == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        start[at + 1 + size] = True
    return np.flatnonzero(start[:n])


class TokenIds:
    """Token ids of texts by a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["id"] for x in spec.get("added_tokens", [])}
        # Byte-level files write each byte as a printable character.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        to_byte = {c: b for b, c in as_char.items()}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        self.merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, bytes] = {}  # ids as four bytes each

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids side by side, and n+1 offsets."""
        code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        odd = np.concatenate([[0], np.cumsum(code >= _LIMIT)])
        if not odd[-1]:
            return self._plain("".join(texts), code, offsets)
        plain = np.diff(odd[offsets]) == 0
        ids, at = self.of([x for x, p in zip(texts, plain, strict=True) if p])
        mine = iter([ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        parts = [next(mine) if p else np.array(self.whole.encode(x, add_special_tokens=False).ids, dtype=np.uint32) for x, p in zip(texts, plain, strict=True)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def _plain(self, text: str, code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = pre_token_starts(code, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(code))
        one, inverse = tc.distinct_slices(code.astype(np.uint8 if code.max() < 256 else np.uint16), starts, ends)
        if len(self.known) > _CACHE_MOST:
            self.known.clear()
        known, merge, ids = self.known, self.merge, []
        for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True):
            token = text[a:b]
            found = known.get(token)
            if found is None:
                found = known[token] = array("I", merge(token.encode())).tobytes()
            ids.append(found)
        sizes = np.array([len(x) for x in ids], dtype=np.int64) // 4
        flat = np.frombuffer(b"".join(ids), dtype=np.uint32)
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        each = sizes[inverse]
        upto = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.arange(upto[-1]) + np.repeat(begin[inverse] - upto[:-1], each)]
        return out, upto[np.searchsorted(starts, offsets)]


_tokenizers: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    if path not in _tokenizers:
        _tokenizers[path] = TokenIds(path)
    return _tokenizers[path]


def _cut(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            _, offsets = tc.string_buffers(batch.column(1))
            for i, j in tc.groups(offsets, GROUP_BYTES):
                ids, at = token_ids(path).of(batch.column(1)[i:j].to_pylist())
                rows: list[tuple] = []
                for doc, a, b in zip(batch.column(0)[i:j].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    whole = np.append(ids[a:b], np.uint32(CLOSING)).astype("<u4")
                    first = len(whole) % length or length
                    bounds = [0, *range(first, len(whole) + 1, length)]
                    rows += [(doc, k, x, y - x, zlib.crc32(whole[x:y])) for k, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:]), pa.array([part] * len(rows), pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "part"])

    return run


Pattern = tuple[int, ...]


def best_fit(histogram: dict[int, int], length: int) -> dict[Pattern, int]:
    """Best fit decreasing on counts: patterns (descending lengths) with how many bins have them."""
    open_bins: dict[int, dict[Pattern, int]] = defaultdict(dict)  # by room left
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = min((r for r in open_bins if r >= size and open_bins[r]), default=None)
            if room is None:
                room, pattern, bins = length, (), left
            else:
                pattern = min(open_bins[room])
                bins = open_bins[room].pop(pattern)
            each = min(room // size, left)
            full = min(bins, left // each)
            for grown, many in (((*pattern, *(size,) * each), full), (pattern, bins - full)):
                if many and grown:
                    to = open_bins[length - sum(grown)]
                    to[grown] = to.get(grown, 0) + many
            left -= full * each
        for room in [r for r in open_bins if not open_bins[r]]:
            del open_bins[room]
    out: dict[Pattern, int] = defaultdict(int)
    for patterns in open_bins.values():
        for pattern, many in patterns.items():
            out[pattern] += many
    return dict(out)


def _exchange(giver: Pattern, taker: Pattern, length: int) -> tuple[Pattern, Pattern] | None:
    """The move, one-for-one or two-for-one exchange that fills the taker most; None if none adds to it."""
    room = length - sum(taker)
    best, found = 0, None
    givers, takers = sorted(set(giver), reverse=True), sorted(set(taker))
    for b in givers:
        if best < b <= room:
            best, found = b, ((b,), ())
    for b in givers:
        for a in takers:
            if best < b - a <= room:
                best, found = b - a, ((b,), (a,))
    if best < room and len(giver) > 1:
        for i, b in enumerate(giver):
            for c in giver[i + 1 :]:
                if b + c > best and b + c <= room:
                    best, found = b + c, ((b, c), ())
                for a in takers:
                    if best < b + c - a <= room:
                        best, found = b + c - a, ((b, c), (a,))
    if found is None:
        return None
    out, back = found
    giver_left, taker_left = list(giver), list(taker)
    for x in out:
        giver_left.remove(x)
    for x in back:
        taker_left.remove(x)
    return tuple(sorted([*giver_left, *back], reverse=True)), tuple(sorted([*taker_left, *out], reverse=True))


class _Takers:
    """Underfull patterns by what they can take: one entry for each item that they may give back, and one for none.

    A giver is tried against all entries at once.
    """

    def __init__(self, length: int):
        self.length, self.number, self.patterns = length, {}, []
        self.alive, self.fill = np.zeros(64, bool), np.zeros(64, np.int64)
        self.owner, self.back = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.entries = 0

    def _grown(self, name: str, size: int) -> None:
        old = getattr(self, name)
        if size > len(old):
            new = np.zeros(2 * size, old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def put(self, pattern: Pattern, there: bool) -> None:
        k = self.number.get(pattern)
        if k is None:
            k = self.number[pattern] = len(self.patterns)
            self.patterns.append(pattern)
            items = [0, *sorted(set(pattern))]
            for name, size in (("alive", k + 1), ("fill", k + 1), ("owner", self.entries + len(items)), ("back", self.entries + len(items))):
                self._grown(name, size)
            self.fill[k] = sum(pattern)
            self.owner[self.entries : self.entries + len(items)] = k
            self.back[self.entries : self.entries + len(items)] = items
            self.entries += len(items)
        self.alive[k] = there

    def best(self, giver: Pattern, several: bool) -> Pattern | None:
        """The pattern that the giver fills most, or that empties it; of equal ones the fullest. `several`: it may be its own."""
        owner, back = self.owner[: self.entries], self.back[: self.entries]
        fits = self.alive[owner] & (self.fill[owner] >= sum(giver))
        if not several:
            fits &= owner != self.number[giver]
        some = np.flatnonzero(fits)
        owner, back = owner[some], back[some]
        fill = self.fill[owner]
        room = self.length - fill + back
        best, found = (False, 0, -1), None
        gives = {b: 1 for b in giver} | {b + c: 2 for i, b in enumerate(giver) for c in giver[i + 1 :]}
        for size, items in gives.items():
            gain = np.where((back < size) & (size <= room), size - back, 0)
            whole = items == len(giver) and size == sum(giver)
            if whole and ((gain > 0) & (back == 0)).any():
                gain = np.where(back == 0, gain, 0)
            else:
                whole = False
            if len(gain):
                k = int((gain * (self.length + 1) + fill).argmax())
                if gain[k] and (whole, int(gain[k]), int(fill[k])) > best:
                    best, found = (whole, int(gain[k]), int(fill[k])), self.patterns[owner[k]]
        return found


def local_search(packed: dict[Pattern, int], length: int, steps: int | None = None) -> dict[Pattern, int]:
    """Empties bins: the least filled gives to fuller ones, and each exchange raises the sum of squared fills.

    Underfull patterns take their turn from the least filled up, each as long as an exchange is left for it; the search
    ends after a round without any, or when the lower bound is met. `steps` bounds the tries, if given.
    """
    bins, takers = dict(packed), _Takers(length)
    fewest, count, tries, moved = -(-sum(sum(p) * n for p, n in bins.items()) // length), sum(bins.values()), 0, True
    for pattern in bins:
        if sum(pattern) < length:
            takers.put(pattern, True)
    while moved and count > fewest:
        moved = False
        for giver in sorted((p for p in bins if sum(p) < length), key=lambda p: (sum(p), p)):
            while bins.get(giver) and count > fewest:
                if steps is not None and tries >= steps:
                    return bins
                tries += 1
                taker = takers.best(giver, bins[giver] > 1)
                if taker is None:
                    break
                rest, filled = _exchange(giver, taker, length)
                many = min(bins[giver], bins[taker]) if taker != giver else bins[giver] // 2
                for pattern, change in ((giver, -many), (taker, -many), (rest, many), (filled, many)):
                    bins[pattern] = bins.get(pattern, 0) + change
                for pattern in {giver, taker, rest, filled}:
                    if not bins[pattern] or not pattern:
                        del bins[pattern]
                    if pattern and sum(pattern) < length:
                        takers.put(pattern, pattern in bins)
                count -= 0 if rest else many
                moved = True
    return bins


def pack(df: DataFrame, tokenizer: str, length: int = LENGTH, text_col: str = "text", id_col: str = "doc_id", steps: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    spark = df.sparkSession
    scratch = Scratch(spark, "pack")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    pieces = scratch.write(docs.mapInArrow(_cut(tokenizer, length), "doc_id long, piece int, start long, length long, ids_crc32 long, part int"), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    full = histogram.pop(length, 0)
    patterns = sorted(local_search(best_fit(histogram, length), length, steps).items(), reverse=True)
    if full:
        patterns.append(((length,), full))
    slots = _slots(patterns)

    # Rank of a piece among those of its length: by part, then within the part, so no length is one group.
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start")) - 1)
    ranked = ranked.join(per_part.withColumn("before", before).select("length", "part", "before"), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                upto, first, each, places = slots[int(size)]
                k = np.searchsorted(upto, ranks[rows], side="right") - 1
                rest = ranks[rows] - upto[k]
                sequence[rows] = first[k] + rest // each[k]
                offset[rows] = [places[c][r] for c, r in zip(k.tolist(), (rest % each[k]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _slots(patterns: list[tuple[Pattern, int]]) -> dict[int, tuple]:
    """For each length: first ranks, first sequences, uses per bin and offsets within the bin of the patterns that hold it."""
    rows: dict[int, list[tuple]] = defaultdict(list)
    sequence = 0
    for pattern, bins in patterns:
        places: dict[int, list[int]] = defaultdict(list)
        at = 0
        for size in pattern:
            places[size].append(at)
            at += size
        for size, where in places.items():
            rows[size].append((bins * len(where), sequence, len(where), where))
        sequence += bins
    out = {}
    for size, uses in rows.items():
        many, first, each, where = zip(*uses, strict=True)
        out[size] = (np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64), np.array(first), np.array(each), where)
    return out
