"""Vectorised text primitives on Arrow string columns: word spans, slice hashes, shingles and windows.

Everything here works on the UTF-8 bytes of a group of documents at once, so no per-word Python runs.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 equals the same rule on code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Slices longer than this many bytes are hashed one by one.
_LONG = 256
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def groups(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most about `most` bytes each; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (n+1 values)."""
    w = ~_SPACE[data]
    before = np.zeros_like(w)
    before[1:] = w[:-1]
    after = np.zeros_like(w)
    after[:-1] = w[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte, zeros beyond the end, as little-endian numbers; a view."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def _head(eights: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first `size` bytes (at most eight) at each place."""
    spare = (np.int64(8) - np.minimum(size, 8)).astype(U64) << U64(3)  # a shift by 64 leaves 0
    return (eights[at] << spare) >> spare


def heads(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first `sizes` bytes (at most eight) at each place as a number, the first byte lowest."""
    return _head(_eights(data), starts, sizes)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each slice data[start:end]; equal slices have equal hashes wherever they stand.

    Eight bytes at a time enter a chain of mixing steps that starts from the length, so no pattern of letters cancels
    out; slices of one length up to eight bytes never collide. Longer ones than _LONG bytes are hashed by BLAKE2.
    """
    if data.dtype != np.uint8:
        starts, ends, data = starts * data.itemsize, ends * data.itemsize, np.ascontiguousarray(data).view(np.uint8)
    eights, sizes = _eights(data), ends - starts
    out = mix(sizes.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x9E3779B97F4A7C15) * U64(seed + 1))
    live = np.flatnonzero((sizes > 0) & (sizes <= _LONG))
    at, left = starts[live], sizes[live]
    while len(live):
        out[live] = mix(out[live] ^ _head(eights, at, left))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(sizes > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def same_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each slice equals the other one byte for byte."""
    eights = _eights(data)
    same = ends - starts == other_ends - other_starts
    live = np.flatnonzero(same & (starts != other_starts))
    at, to, left = starts[live], other_starts[live], (ends - starts)[live]
    while len(live):
        equal = _head(eights, at, left) == _head(eights, to, left)
        same[live[~equal]] = False
        more = equal & (left > 8)
        live, at, to, left = live[more], at[more] + 8, to[more] + 8, left[more] - 8
    return same


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one slice of each distinct content, and for every slice which of those it equals; compared in full."""
    if data.dtype != np.uint8:
        starts, ends, data = starts * data.itemsize, ends * data.itemsize, np.ascontiguousarray(data).view(np.uint8)
    _, one, inverse = np.unique(slice_hashes(data, starts, ends), return_index=True, return_inverse=True)
    chosen = one[inverse]
    unlike = np.flatnonzero(~same_slices(data, starts, ends, starts[chosen], ends[chosen]))
    if len(unlike):  # slices of one hash that differ
        raw, known, extra = data.tobytes(), {}, []
        for k in unlike.tolist():
            text = raw[starts[k] : ends[k]]
            if text not in known:
                known[text] = len(one) + len(extra)
                extra.append(k)
            inverse[k] = known[text]
        one = np.concatenate([one, extra])
    return one, inverse


def joined_hashes(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of `width` consecutive values (len(values)-width+1 of them).

    Hashes of runs of 1, 2, 4, ... values are each mixed from two of half the length; a run is mixed from those that
    the binary digits of its width name.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    first, second = U64(0x9E3779B97F4A7C15 + 2 * seed), U64(0xC2B2AE3D27D4EB4F)
    out, at, size, piece = np.full(n, U64(width * 0x9E3779B1 + seed)), 0, 1, values
    while size <= width:
        if width & size:
            out = mix(out * first + piece[at : at + n] + second)
            at += size
        if 2 * size <= width:
            piece = mix(piece[:-size] * first + piece[size:] * second)
        size *= 2
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document's `width`-word shingles (lower-cased A-Z), and n+1 offsets.

    A document of fewer words has one shingle, the whole sequence; without words it has none.
    """
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets)
    words = slice_hashes(data, starts, ends)
    count = np.diff(first)
    full = joined_hashes(words, width)
    sizes = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], dtype=U64)
    big = count >= width
    if big.any():
        take = np.repeat(first[:-1][big] - at[:-1][big], sizes[big]) + np.flatnonzero(np.repeat(big, sizes))
        out[np.repeat(big, sizes)] = full[take]
    for k in range(1, width):
        some = np.flatnonzero(count == k)
        if len(some):
            short = joined_hashes(words, k)
            out[at[some]] = short[first[some]]
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[at]
