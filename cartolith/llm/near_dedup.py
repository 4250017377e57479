"""Near-duplicate components by HyperMinHash.

A document's set holds its distinct word shingles. The hash space is split into REGISTERS buckets; a register keeps of
its bucket's least hash the count of leading zeros and the next MANTISSA bits. Empty registers borrow a full one for
banding only. Documents that share a band are candidates; a collision-corrected estimate from the registers drops far
pairs, and the full sets confirm the rest.

Equal sets are one class with one representative. Band buckets are never expanded into rows of their pairs:

- Buckets with the same members count once.
- Every representative is paired with the smallest member of all its buckets, one row each; the estimate and the full
  sets decide. That settles most groups.
- Where a bucket still spans components, its members carry their full sets into cells. A cell holds a block of members
  outside the bucket's largest component and a block of any members; blocks are bounded by rows and by bytes. Within a
  cell the sizes of all intersections are one exact sparse product over the shingles that its members share, which is
  cheaper there than an estimate and drops nothing. Pairs of one component are skipped, and only a spanning forest of
  the confirmed links comes out: fewer rows than the cell has members.

So each pair of a bucket is compared on full sets or already connected, however large the bucket, and what leaves a
bucket grows in proportion to its members. The work in cells is quadratic in the members that no link connects to the
bucket's largest component.

A pair at the threshold of 0.75 shares no band with a chance of about (1 - 0.75 ** ROWS) ** BANDS = 1e-6; the estimate
drops it with a chance below 1e-6. Sets are compared as 64-bit shingle hashes, mixed word by word.

Defined cases: null, empty and wordless texts have size 0, are linked with nothing and are kept; rows with a null id are
in no component (component_id null) and are kept; rows with one id are one document, linked with whatever any of its
texts is linked with; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import Scratch, partitions_for, text_or_empty
from .components import components

WIDTH, THRESHOLD = 5, 75
REGISTERS, MANTISSA, BANDS, ROWS = 256, 10, 51, 5
EMPTY = 0xFFFF
#: The estimate must fall short of the threshold by this many standard deviations for a pair to be dropped.
SIGMAS = 5.0
#: Members of a block and bytes of their sets; a member with a larger set is a block of its own or shares one.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Cells of a dense slice of the incidence of shingles in members.
_SLICE = 1 << 21
#: Share of unequal least hashes whose registers collide, times 2 ** MANTISSA.
COLLISION = 0.1699
_ATTEMPTS = 512
_BITS = 8  # log2(REGISTERS)


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, REGISTERS) uint16 of sorted distinct hashes per document: leading zeros and mantissa of each least hash."""
    n = len(offsets) - 1
    out = np.full((n, REGISTERS), EMPTY, dtype=np.uint16)
    if len(hashes):
        doc = np.repeat(np.arange(n), np.diff(offsets))
        bucket = (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
        key = doc * REGISTERS + bucket
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        rest = hashes[first] << np.uint64(_BITS)  # the bucket's bits are gone, the rest stands on top
        width = np.frexp((rest >> np.uint64(12)).astype(np.float64))[1]
        zeros = np.minimum(52 - width, 62)
        mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out.ravel()[key[first]] = (zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)
    return out


_borrow: list[np.ndarray] = []


def densified(sketch: np.ndarray) -> np.ndarray:
    """Empty registers take the value of a full one, tried in a fixed pseudorandom order that is the same for all documents."""
    if not _borrow:
        _borrow.append((tc.mix(np.arange(REGISTERS * _ATTEMPTS, dtype=np.uint64) + np.uint64(12345)) >> np.uint64(64 - _BITS)).astype(np.int64).reshape(REGISTERS, _ATTEMPTS))
    out = sketch.copy()
    rows, cols = np.nonzero(sketch == EMPTY)
    for attempt in range(_ATTEMPTS):
        if not len(rows):
            return out
        got = sketch[rows, _borrow[0][cols, attempt]]
        full = got != EMPTY
        out[rows[full], cols[full]] = got[full]
        rows, cols = rows[~full], cols[~full]
    if len(rows):
        some = sketch.argmin(axis=1)  # EMPTY is the largest value
        out[rows, cols] = sketch[rows, some[rows]]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys; two documents share a key if all ROWS registers of the band are equal."""
    parts = densified(sketch)[:, : BANDS * ROWS].reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sketch), BANDS)).copy()
    for r in range(ROWS):
        key = tc.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r] + np.uint64(1))
    return key.astype(np.int64)


def allowed(equal: np.ndarray, used: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sizes and the collision-corrected estimate of pairs allow the threshold.

    Of the union's elements, `used` registers hold some; what they leave out of a finite union sets the deviation.
    """
    t = THRESHOLD / 100
    chance = COLLISION / (1 << MANTISSA)
    estimate = (equal / np.maximum(used, 1) - chance) / (1 - chance)
    left_out = np.clip(1 - used * (1 + t) / np.maximum(na + nb, 1), 0.02, 1)
    sigma = np.sqrt(t * (1 - t) * left_out / np.maximum(used, 1))
    return (estimate >= t - SIGMAS * sigma - 0.5 / np.maximum(used, 1)) & (100 * np.minimum(na, nb) >= THRESHOLD * np.maximum(na, nb))


def near_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """`allowed` for row-wise pairs of sketches."""
    used = (a != EMPTY) | (b != EMPTY)
    return allowed(((a == b) & used).sum(axis=1), used.sum(axis=1), na, nb)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "digest", "sketch"]
    for batch in batches:
        data, offsets = tc.string_buffers(batch.column(1))
        for i, j in tc.groups(offsets):
            hashes, at = tc.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WIDTH)
            sketch = registers(hashes, at)
            digests = [hashlib.blake2b(hashes[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(at)), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())], names=names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, digest) to the full set, of the rows whose set has that digest."""
    for batch in batches:
        data, offsets = tc.string_buffers(batch.column(1))
        for i, j in tc.groups(offsets):
            hashes, at = tc.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WIDTH)
            sets = [hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            right = pa.array([hashlib.blake2b(x, digest_size=16).digest() == d.as_py() for x, d in zip(sets, batch.column(2)[i:j], strict=True)], pa.bool_())
            columns = batch.column(0)[i:j], batch.column(2)[i:j], pa.array(sets, pa.binary())
            yield pa.RecordBatch.from_arrays([c.filter(right) for c in columns], names=["doc_id", "digest", "shingles"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            for i in range(0, len(sketch), 1024):
                keys = band_keys(sketch[i : i + 1024])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0)[i : i + 1024].to_numpy(), BANDS))], names=["key", "doc_id"])


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column of sets, and n+1 offsets."""
    parts = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def _enough(both: np.ndarray | int, na: np.ndarray | int, nb: np.ndarray | int) -> np.ndarray | bool:
    return 100 * both >= THRESHOLD * (na + nb - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, set of a, set of b) to those that the registers' estimate allows and the full sets confirm."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            (x, at), (y, to) = _joined(part.column(2)), _joined(part.column(3))
            good = near_pairs(registers(x, at), registers(y, to), np.diff(at), np.diff(to))
            for k in np.flatnonzero(good).tolist():
                few, many = sorted((x[at[k] : at[k + 1]], y[to[k] : to[k + 1]]), key=len)
                found = np.minimum(np.searchsorted(many, few), max(len(many) - 1, 0))
                good[k] = bool(len(few)) and bool(_enough(int((many[found] == few).sum()), len(few), len(many)))
            yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(good)) for c in (0, 1)], names=["a", "b"])


def _common(hashes: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets `first` with all sets, exactly: a product of incidence matrices.

    Shingles of a single member add nothing to it; the others are taken in slices of bounded size.
    """
    n = len(offsets) - 1
    out = np.zeros((len(first), n), dtype=np.float32)
    _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    some = np.flatnonzero(times[column] > 1)
    row, column = np.repeat(np.arange(n), np.diff(offsets))[some], number[column[some]]
    if not len(some):
        return out
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, _SLICE // n)
    for low in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [low, low + width])
        dense = np.zeros((n, width), dtype=np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        out += dense[first] @ dense.T
    return out


def _cell(node: np.ndarray, comp: np.ndarray, first: np.ndarray, second: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between members `first` and `second` that join different components."""
    _, label = np.unique(comp, return_inverse=True)
    sizes, links = np.diff(offsets), []
    for low in range(0, len(first), BLOCK):
        some = first[low : low + BLOCK]
        linked = _enough(_common(hashes, offsets, some), sizes[some][:, None], sizes[None, :]) & second[None, :] & (comp[some][:, None] != comp[None, :])
        for k in np.flatnonzero(linked.any(axis=1)).tolist():
            row = some[k]
            others = np.flatnonzero(linked[k])
            labels, at = np.unique(label[others], return_index=True)
            new = labels != label[row]
            if new.any():
                links += [(int(node[row]), int(node[x])) for x in others[at[new]]]
                label[np.isin(label, labels)] = label[row]
    return links


def _in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, i, j, block, main, doc_id, comp, shingles) to links of different components.

    The rows of one (key, i, j) are those of blocks i and j of a bucket; pairs lie across the blocks and, if j is the
    first block of the largest component, within block i.
    """
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [rows.column(k).to_numpy() for k in range(3)]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        block, within, node, comp = (rows.column(k).to_numpy() for k in range(3, 7))
        links: list[tuple[int, int]] = []
        for low, high in zip([0, *new.tolist()], [*new.tolist(), rows.num_rows], strict=True):
            if comp[low] == comp[low:high].min() == comp[low:high].max():
                continue
            hashes, offsets = _joined(rows.column(7).slice(low, high - low).combine_chunks())
            first = np.flatnonzero(block[low:high] == keys[1][low])
            second = (block[low:high] == keys[2][low]) | bool(within[low])
            links += _cell(node[low:high], comp[low:high], first, second, hashes, offsets)
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(3)]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        if held and all(held[-1].column(k)[-1].as_py() == keys[k][0] for k in range(3)) and not len(new):
            held.append(batch)
            continue
        cut = int(new[-1]) + 1 if len(new) else 0
        ready = [*held, batch.slice(0, cut)] if cut else held
        if ready:
            yield from done(pa.Table.from_batches(ready))
        held = [batch.slice(cut)]
    if held:
        yield from done(pa.Table.from_batches(held))


def near_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "near")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sketched = scratch.write(docs.mapInArrow(_sketches, "doc_id long, n long, digest binary, sketch binary"), "sketches")
    linkable = sketched.filter("n > 0 and doc_id is not null")
    held = linkable.select("doc_id", "digest").distinct()
    # A class of equal sets is a node, named by its smallest id; classes that share an id are linked.
    classes = scratch.write(held.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = linkable.join(classes.select("digest", F.col("rep").alias("doc_id")).hint("shuffle_hash"), ["digest", "doc_id"], "left_semi")
    reps = scratch.write(reps.dropDuplicates(["doc_id", "digest"]), "reps")
    several = held.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id")
    named = held.join(several, "doc_id").join(classes.select("digest", "rep").hint("shuffle_hash"), "digest")
    same_id = named.select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).filter("a < b").distinct()

    bands = reps.select("doc_id", "sketch").mapInArrow(_bands, "key long, doc_id long")
    # Buckets with the same members count once: four sums of 32 bits of the members' hashes tell them apart.
    parts = [f(F.xxhash64("doc_id", F.lit(seed))) for seed in (1, 2) for f in (lambda h: F.shiftrightunsigned(h, 32), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    buckets = bands.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("pivot"), *(F.sum(x).alias(f"s{k}") for k, x in enumerate(parts))).filter("c > 1")
    buckets = buckets.groupBy("c", "pivot", "s0", "s1", "s2", "s3").agg(F.min("key").alias("key")).select("key", "pivot")
    members = scratch.write(bands.join(buckets.hint("shuffle_hash"), "key"), "members")
    wanted = reps.select("doc_id", "digest").join(members.select("doc_id").distinct(), "doc_id", "left_semi").hint("shuffle_hash")
    sets = scratch.write(docs.join(wanted, "doc_id").select("doc_id", "text", "digest").mapInArrow(_sets, "doc_id long, digest binary, shingles binary").dropDuplicates(["doc_id", "digest"]).drop("digest"), "sets")

    labels = _linked(members, sets, scratch.write(same_id, "same"), scratch)
    for used in (reps, members, sets):
        scratch.drop(used)
    # Only documents of a class that is linked or has several documents need a label; others are alone.
    placed = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").filter("component is not null or copies > 1").select("digest", F.coalesce("component", "rep").alias("component"))
    placed = held.join(placed, "digest").groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sketched.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _linked(members: DataFrame, sets: DataFrame, same_id: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of representatives that are linked to a smaller one. members: (key, doc_id, pivot)."""
    n = partitions_for(members.sparkSession)
    # Every member with the smallest member of all its buckets.
    pairs = members.groupBy("doc_id").agg(F.min("pivot").alias("a")).filter("a < doc_id").select("a", F.col("doc_id").alias("b"))
    for end in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    links = scratch.write(pairs.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed, "a long, b long").unionByName(same_id), "links")
    labels = components(links, scratch)

    # Buckets that still span components, in cells.
    sized = sets.groupBy("doc_id").agg(F.sum(F.octet_length("shingles")).alias("bytes"))
    placed = members.join(labels, members["doc_id"] == labels["node"], "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    placed = placed.join(sized, "doc_id")
    per_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes"))
    mixed = per_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("all_c"), F.sum("bytes").alias("all_bytes"), F.max(F.struct("c", "bytes", "comp")).alias("top")).filter("comps > 1")
    blocks = lambda c, size: F.ceil(F.greatest(c / BLOCK, size / BLOCK_BYTES)).cast("int")
    mixed = mixed.select("key", F.col("top.comp").alias("most"), blocks(F.col("all_c") - F.col("top.c"), F.col("all_bytes") - F.col("top.bytes")).alias("out"), blocks(F.col("top.c"), F.col("top.bytes")).alias("in"))
    placed = placed.join(mixed.hint("shuffle_hash"), "key").withColumn("main", F.col("comp") == F.col("most"))
    place = F.pmod(F.xxhash64("doc_id"), F.when(F.col("main"), F.col("in")).otherwise(F.col("out"))).cast("int")
    placed = placed.withColumn("block", F.when(F.col("main"), F.col("out") + place).otherwise(place))
    # Blocks of other components are 0 .. out - 1, those of the largest component out .. out + in - 1.
    every = F.sequence(F.lit(0), F.when(F.col("main"), F.col("out")).otherwise(F.col("out") + F.col("in")) - 1)
    other = F.filter(every, lambda x: F.col("main") | (x != F.col("block")))
    placed = placed.withColumn("other", F.explode(other)).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    placed = placed.select("key", "i", "j", "block", (F.col("j") == F.col("out")).alias("within"), "doc_id", "comp").join(sets, "doc_id")
    placed = placed.select("key", "i", "j", "block", F.col("within").cast("int").alias("within"), "doc_id", "comp", "shingles")
    more = scratch.write(placed.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_in_cells, "a long, b long"), "links")
    out = components(links.unionByName(more), scratch)
    for used in (links, more, labels):
        scratch.drop(used)
    return out


def survivors(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of df that stay: one document of each component, and whatever is linked with nothing."""
    found = near_components(df, text_col, id_col).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return df.join(found.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
