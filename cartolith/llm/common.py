"""Tables, shared scratch space and Arrow plumbing used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a finished SQL execution go at once when this is on.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that a batch of rows may have on its way to Python, which bounds a worker's memory whatever the texts.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: Keys with more than this share of all rows are joined by broadcast, since one task can't take them.
HOT = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session without one gets a default."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    old = spark.conf.get(key, None)
    try:
        spark.conf.set(key, value)
    except Exception:  # a static setting on other versions
        yield
        return
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def small_batches(spark: SparkSession) -> None:
    """Batches of rows that go to Python in this session have at most BATCH_BYTES, unless it asks for less."""
    now = spark.conf.get(_BATCH, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def _remove(where, filesystem) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        filesystem.delete(where, True)


class Scratch:
    """Written tables in the shared folder: they cut lineage and outlive lost executors.

    Tables that nothing reads again are dropped by the operators; the rest goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cartolith-{label}-{uuid.uuid4().hex}"
        self._n = 0
        small_batches(spark)
        where = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        atexit.register(_remove, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))

    def write(self, df: DataFrame, tag: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{tag}"
        with _setting(self.spark, _CLEANUP, "true"):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cartolith_path = path
        return out

    def all_of(self, tables: list[DataFrame]) -> DataFrame:
        """The rows of tables of one schema, read at once: small files share tasks, which a union would not let them."""
        return self.spark.read.schema(tables[0].schema).parquet(*(t._cartolith_path for t in tables))

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        path = getattr(df, "_cartolith_path", None)
        if path:
            jvm, sc = self.spark._jvm, self.spark.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def skewed_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """left, outer joined with right, which has one row a key and in `weight` how many rows of left have it.

    A key that holds more than HOT of the `total` rows is joined by broadcast, and there are fewer than 1 / HOT of these;
    the others are shuffled. No key is null.
    """
    often = F.col(weight) > total * HOT
    hot = F.broadcast(right.filter(often))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.filter(~often).hint("shuffle_hash"), keys, "left")
    return left.join(hot, keys).unionByName(rest)


def arrow_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
