"""Exact deduplication by content sort.

Sampled splitters range-partition the rows by the first PREFIX characters of the normalised text, its digest and the id,
so one group of copies may span many partitions, and the sample that the driver gets holds no whole texts. Each partition
is sorted externally, equal texts stand side by side, and a scan compares neighbours in full. Only the first and last run of a partition can continue elsewhere; those (two per partition) are joined by text.

Defined cases: null text counts as empty and all empty texts are equal; null ids come before all others, so a row
with an id wins over one without; repeated rows (same id and text) form one group of which one row is kept; an empty
table gives an empty result; further columns are ignored by `decide` and carried by `survivors`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions_for, text_or_empty

#: Ways to normalise a text before it is compared.
NORMALISERS = {
    "none": lambda c: c,
    "case": lambda c: F.lower(c),
    "space": lambda c: F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " ")),
    "case_space": lambda c: F.lower(F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " "))),
}


#: Characters of a text that its splitters hold; texts that agree in them are ordered by digest.
PREFIX = 32


def _sorted(df: DataFrame, text: Column, id_col: str, keep: str) -> DataFrame:
    """Rows range-partitioned and sorted so that the row to keep is the last of its run."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    id_order = (F.asc_nulls_first if keep == "largest" else F.desc_nulls_first)("__id")
    rows = df.withColumns({"__norm": text, "__id": F.col(id_col).cast("long")}).withColumns({"__head": F.substring("__norm", 1, PREFIX), "__sha": F.unhex(F.sha2("__norm", 256))})
    n = partitions_for(df.sparkSession)
    return rows.repartitionByRange(n, "__head", "__sha", id_order).sortWithinPartitions("__head", "__sha", "__norm", id_order).drop("__head")


def _same_as_before(texts: pa.Array, last: bytes | None) -> np.ndarray:
    same = np.zeros(len(texts), dtype=bool)
    if len(texts) > 1:
        same[1:] = pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
    same[0] = last is not None and texts[0].as_buffer().to_pybytes() == last
    return same


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_DECISIONS = "doc_id long, run long, n long, keep long, sha string, last boolean, edge boolean, edge_text string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per input row; the rows of an open run wait as bare ids (8 bytes each) until the run ends."""
    base = TaskContext.get().partitionId() << 40
    schema = pa.schema([("doc_id", pa.int64()), ("run", pa.int64()), ("n", pa.int64()), ("keep", pa.int64()), ("sha", pa.string()), ("last", pa.bool_()), ("edge", pa.bool_()), ("edge_text", pa.string())])
    waiting: list[pa.Array] = []
    last: bytes | None = None
    number = 0
    digest = ""

    def emit(ids: pa.Array, sizes: np.ndarray, first: int, shas: list[str], edge: bool, text: bytes | None) -> pa.RecordBatch:
        ends = np.cumsum(sizes)
        is_last = np.zeros(len(ids), dtype=bool)
        is_last[ends - 1] = True
        of = np.repeat(np.arange(len(sizes)), sizes)
        edge_text = pa.array([None] * (len(ids) - 1) + [text.decode()], pa.string()) if edge else pa.nulls(len(ids), pa.string())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(base + first + of), pa.array(sizes[of]), ids.take(pa.array(ends - 1)).take(pa.array(of)), pa.array(shas, pa.string()).take(pa.array(of)), pa.array(is_last), pa.array(np.full(len(ids), edge)), edge_text], schema=schema
        )

    def emit_waiting(edge: bool) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(waiting)
        yield emit(ids, np.array([len(ids)]), number, [digest], edge, last)

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, ids, shas_of = _column(batch, "__norm"), _column(batch, "__id").cast(pa.int64()), _column(batch, "__sha")
        starts = np.flatnonzero(~_same_as_before(texts, last))
        if not len(starts):
            waiting.append(ids)
            continue
        if starts[0]:
            waiting.append(ids[: starts[0]])
        if waiting:
            yield from emit_waiting(edge=number == 0)
            number += 1
        shas = [x.hex() for x in shas_of.take(pa.array(starts)).to_pylist()]
        if len(starts) > 1:
            sizes = np.diff(starts)
            at = int(starts[0])
            if number == 0:  # the first run of the partition is an edge
                yield emit(ids[at : at + int(sizes[0])], sizes[:1], 0, shas[:1], True, texts[at].as_buffer().to_pybytes())
                at, sizes, number = at + int(sizes[0]), sizes[1:], 1
                inner = shas[1:-1]
            else:
                inner = shas[:-1]
            if len(sizes):
                yield emit(ids[at : int(starts[-1])], sizes, number, inner, False, None)
                number += len(sizes)
        waiting, last, digest = [ids[int(starts[-1]) :]], texts[int(starts[-1])].as_buffer().to_pybytes(), shas[-1]
    if waiting:
        yield from emit_waiting(edge=True)


def decide(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", normalise: str = "none", keep: str = "largest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row, dropped ones too."""
    spark = df.sparkSession
    scratch = Scratch(spark, "exact")
    rows = _sorted(df.select(id_col, text_col), NORMALISERS[normalise](text_or_empty(text_col)), id_col, keep).select("__norm", "__id", "__sha")
    scanned = scratch.write(rows.mapInArrow(_scan, _DECISIONS), "runs")
    # At most two edge runs a partition: those with one text are one group.
    edges = scanned.filter(F.col("edge_text").isNotNull())
    joined = edges.groupBy("edge_text").agg(F.sum("n").alias("n_all"), F.max(F.struct("run", "keep")).alias("top"))
    fixes = edges.select("run", "edge_text").join(joined, "edge_text").select("run", "n_all", F.col("top.run").alias("top_run"), F.col("top.keep").alias("top_keep"))
    inner = scanned.filter(~F.col("edge")).select("doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("last").alias("kept"), F.col("sha").alias("text_sha256"))
    outer = (
        scanned.filter("edge").join(fixes, "run")
        .select("doc_id", F.col("top_keep").alias("keep_id"), F.col("n_all").alias("group_size"), (F.col("last") & (F.col("run") == F.col("top_run"))).alias("kept"), F.col("sha").alias("text_sha256"))
    )
    return inner.unionByName(outer)


def survivors(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", normalise: str = "none", keep: str = "largest") -> DataFrame:
    """The rows to keep, with all their columns: the last row of each run, one for each group."""
    spark = df.sparkSession
    scratch = Scratch(spark, "exact")
    rows = _sorted(df, NORMALISERS[normalise](text_or_empty(text_col)), id_col, keep).drop("__id", "__sha")
    schema = rows.schema

    def last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held = TaskContext.get().partitionId() << 40, 0, None

        def out(rows: pa.RecordBatch, runs: np.ndarray, edge: bool) -> pa.RecordBatch:
            names = rows.schema.names
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(base + runs), pa.array(np.full(rows.num_rows, edge))], names=[*names, "__run", "__edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = _column(batch, "__norm")
            before = None if held is None else _column(held, "__norm")[0].as_buffer().to_pybytes()
            starts = np.flatnonzero(~_same_as_before(texts, before))
            if held is not None and len(starts):
                ended = held if starts[0] == 0 else batch.slice(int(starts[0]) - 1, 1)
                yield out(ended, np.array([number]), number == 0)
                number += 1
            if len(starts) > 1:
                ends = starts[1:] - 1
                if number == 0:
                    yield out(batch.slice(int(ends[0]), 1), np.array([0]), True)
                    number, ends = 1, ends[1:]
                if len(ends):
                    yield out(batch.take(pa.array(ends)), number + np.arange(len(ends)), False)
                    number += len(ends)
            held = batch.slice(batch.num_rows - 1, 1)
        if held is not None:
            yield out(held, np.array([number]), True)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    scanned = scratch.write(rows.mapInArrow(last_rows, f"{fields}, __run long, __edge boolean"), "last")
    edges = scanned.filter("__edge")
    winners = edges.groupBy("__norm").agg(F.max("__run").alias("__run")).select("__run")
    kept = scanned.filter("not __edge").unionByName(edges.join(winners, "__run", "left_semi"))
    return kept.select(*df.columns)
