"""An index table that follows a change stream, as a log of runs: what a batch writes follows the batch, not the index.

Each micro-batch writes one run, a folder of Parquet files in buckets of the key: the rows of changed keys, and marks of
deleted ones. Reading merges all runs, the newest row of a key counting. When FAN runs of a level stand, they are merged
into one run of the next level, so each row is written again once a level, and a read meets at most FAN runs a level.

A run is named by the batches that it covers, a-b, and is complete once its _SUCCESS stands. Complete runs that cover
others hide them, so a merge that fails or runs again changes nothing, and a batch that runs again writes its own run
again, or nothing if a merge has taken it in. A hidden run is deleted one merge later. A batch's number follows that of the
one before; a gap among the runs is an error, not an empty index.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

BUCKETS, FAN = 32, 4
_BATCH, _GONE, _BUCKET = "__batch", "__gone", "__bucket"


class LogIndex:
    """A table of one row a key in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.path, self.key, self.buckets, self.fan = spark, path.rstrip("/"), key, buckets, fan
        self.schema = spark.createDataFrame([], schema).schema
        self._stored = StructType([*self.schema.fields]).add(_BATCH, LongType()).add(_GONE, BooleanType()).add(_BUCKET, IntegerType())

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def complete(self) -> list[tuple[int, int]]:
        """All complete runs (first batch, last batch), hidden ones included."""
        where, system = self._files(self.path)
        if not system.exists(where):
            return []
        names = [s.getPath().getName() for s in system.listStatus(where)]
        runs = [tuple(map(int, n.split("=")[1].split("-"))) for n in names if n.startswith("run=")]
        return sorted(r for r in runs if system.exists(self._files(f"{self._folder(r)}/_SUCCESS")[0]))

    def runs(self) -> list[tuple[int, int]]:
        """The runs that count, oldest first, without a gap."""
        out: list[tuple[int, int]] = []
        for run in sorted(self.complete(), key=lambda r: (r[0], -r[1])):
            if not out or run[0] > out[-1][1]:
                out.append(run)
        if [a for a, _ in out] != [0, *(b + 1 for _, b in out[:-1])][: len(out)]:
            raise ValueError(f"runs of {self.path} have a gap: {out}")
        return out

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run={run[0]}-{run[1]}"

    def _rows(self, runs: list[tuple[int, int]]) -> DataFrame:
        parts = [self.spark.read.schema(self._stored).option("basePath", self._folder(r)).parquet(self._folder(r)) for r in runs]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self._stored)

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (self.key, _BUCKET)]
        newest = F.max_by(F.struct(*others), F.struct(_BATCH, ~F.col(_GONE))).alias("r")
        return rows.groupBy(_BUCKET, self.key).agg(newest).select(self.key, _BUCKET, *(F.col(f"r.{c}").alias(c) for c in others))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The index as it stands; of some buckets only if these are given, and then only their files are read."""
        rows = self._rows(self.runs())
        rows = rows if buckets is None else rows.filter(F.col(_BUCKET).isin(buckets))
        return self._newest(rows).filter(~F.col(_GONE)).select(*self.schema.names)

    def lookup(self, key) -> DataFrame:
        """The row of one key: only its bucket's files are read."""
        return self.read([self.bucket_of(key)]).filter(F.col(self.key) == F.lit(key))

    def bucket_of(self, key) -> int:
        kind = self.schema[self.key].dataType
        return self.spark.range(1).select(self._bucket(F.lit(key).cast(kind))).first()[0]

    def _bucket(self, key) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        # One task a bucket and no more files than buckets.
        dealt = rows.repartition(min(self.buckets, max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))), _BUCKET)
        dealt.write.mode("overwrite").partitionBy(_BUCKET).parquet(self._folder(run))

    def apply(self, changed: DataFrame, deleted: DataFrame, number: int) -> None:
        """Batch `number`: rows of changed keys, and (key) of deleted ones; a key in both is changed."""
        if any(a <= number <= b and (a, b) != (number, number) for a, b in self.complete()):
            return  # taken in by a merge
        if number > max((b for _, b in self.complete()), default=-1) + 1:
            raise ValueError(f"batch {number} would leave a gap among the runs of {self.path}")
        gone = deleted.select(F.col(self.key)).join(changed.select(self.key), self.key, "left_anti").distinct()
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != self.key]
        rows = changed.select(*self.schema.names, F.lit(False).alias(_GONE)).unionByName(gone.select(self.key, *nothing, F.lit(True).alias(_GONE)))
        self._write(rows.withColumns({_BATCH: F.lit(number).cast("long"), _BUCKET: self._bucket(F.col(self.key))}), (number, number))
        self._merge()

    def _merge(self) -> None:
        """Merges the newest runs as long as FAN of one level stand, and drops what earlier merges hid."""
        hidden = [r for r in self.complete() if r not in self.runs()]
        while True:
            runs = self.runs()
            size = runs[-1][1] - runs[-1][0] + 1
            last = [r for r in runs[-self.fan :] if r[1] - r[0] + 1 == size]
            if len(last) < self.fan:
                break
            whole = (last[0][0], last[-1][1])
            rows = self._newest(self._rows(last))
            self._write(rows if whole[0] else rows.filter(~F.col(_GONE)), whole)  # nothing older is left to hide
        for run in hidden:
            where, system = self._files(self._folder(run))
            system.delete(where, True)


def index_sink(index: LogIndex, rows_of: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for collapsed changes (path, event_type): created and modified paths are indexed anew by `rows_of`."""

    def run(batch: DataFrame, number: int) -> None:
        deleted = batch.filter("event_type = 'deleted'").select(F.col("path").alias(index.key))
        index.apply(rows_of(batch.filter("event_type in ('created', 'modified')")), deleted, number)

    return run
