"""A streaming source of changes under a folder tree: created, modified, deleted and moved files, across restarts.

    spark.dataSource.register(FolderChanges)
    spark.readStream.format("folder_changes").option("path", root).option("state", shared).load()

A batch is planned in shards, one for each of `shards` residues of a hash of the first folder's name, so executors list
subtrees side by side and no listing reaches the driver. A shard writes its listing to the shared state folder under the
batch's number and gives the difference from the listing before; a task that runs again finds the listing written and
gives the same rows. Listings are kept as long as Spark may ask for their batch again. Offsets are batch numbers, which
the query's checkpoint keeps, so after a restart the difference is that from the last batch before it.

Links are not followed and excluded folders are not entered. The tree and the state folder are paths that all executors
mount; `moves` pairs deletions and creations of one file.
"""

from __future__ import annotations

import json
import os
import tempfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cartolith.functions.text import EXCLUDED_DIRS, EXCLUDED_PREFIXES

SCHEMA = "batch long, event_type string, path string, size long, mtime long, inode long"
SHARDS = 8


class Shard(InputPartition):
    def __init__(self, number: int, start: int, end: int):
        super().__init__(number)
        self.number, self.start, self.end = number, start, end


def _listed(root: str, shard: int, shards: int) -> dict[str, tuple[int, int, int]]:
    """path -> (size, mtime in nanoseconds, inode) of the files of one shard."""
    out: dict[str, tuple[int, int, int]] = {}
    todo = [root]
    while todo:
        folder = todo.pop()
        try:
            entries = list(os.scandir(folder))
        except FileNotFoundError:  # gone since its parent was listed
            continue
        for entry in entries:
            if folder == root and zlib.crc32(entry.name.encode("utf-8", "surrogateescape")) % shards != shard:
                continue
            try:
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in EXCLUDED_DIRS and not entry.name.startswith(EXCLUDED_PREFIXES):
                        todo.append(entry.path)
                elif entry.is_file(follow_symlinks=False):
                    s = entry.stat(follow_symlinks=False)
                    out[os.path.relpath(entry.path, root).replace(os.sep, "/")] = (s.st_size, s.st_mtime_ns, s.st_ino)
            except FileNotFoundError:
                continue
    return out


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state = os.path.abspath(options["path"]), os.path.abspath(options["state"])
        self.shards = int(options.get("shards", SHARDS))
        self.newest: int | None = None

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        """One after the newest batch that Spark has begun; known from the listings' folders after a restart."""
        if self.newest is None:
            names = os.listdir(self.state) if os.path.isdir(self.state) else []
            self.newest = max((int(n) for n in names if n.isdigit()), default=0)
        self.newest += 1
        return {"batch": self.newest}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(k, start["batch"], end["batch"]) for k in range(self.shards)]

    def _file(self, batch: int, shard: int) -> str:
        return os.path.join(self.state, str(batch), f"{shard}.json")

    def _snapshot(self, batch: int, shard: int) -> dict[str, tuple[int, int, int]]:
        """The listing of a batch: that written by an earlier attempt, or a new one, put in place whole."""
        path = self._file(batch, shard)
        if not os.path.exists(path):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path), delete=False) as out:
                json.dump(_listed(self.root, shard, self.shards), out)
            try:
                os.link(out.name, path)  # fails if another attempt was first
            except FileExistsError:
                pass
            finally:
                os.unlink(out.name)
        with open(path) as f:
            return {p: tuple(v) for p, v in json.load(f).items()}

    def read(self, partition: Shard) -> Iterator[tuple]:
        if partition.start == 0:
            before = {}
        else:
            with open(self._file(partition.start, partition.number)) as f:  # a listing that is missing is an error
                before = {p: tuple(v) for p, v in json.load(f).items()}
        after = self._snapshot(partition.end, partition.number)
        for path, now in sorted(after.items()):
            if path not in before:
                yield partition.end, "created", path, *now
            elif before[path] != now:
                yield partition.end, "modified", path, *now
        for path in sorted(before.keys() - after.keys()):
            yield partition.end, "deleted", path, *before[path]

    def commit(self, end: dict) -> None:
        """Listings before the one that the next batch starts from are not asked for again."""
        for name in os.listdir(self.state):
            if name.isdigit() and int(name) < end["batch"]:
                folder = os.path.join(self.state, name)
                for file in os.listdir(folder):
                    os.unlink(os.path.join(folder, file))
                os.rmdir(folder)


class FolderChanges(DataSource):
    """Options: path, the root; state, a folder that driver and executors share; shards."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def moves(changes: DataFrame) -> DataFrame:
    """Changes with a deletion and a creation of one file (inode, size and time) in a batch as one `moved` row: src_path, dest_path.

    Links to one file are paired in order of their paths; what is left over stays as it is.
    """
    same = ["batch", "inode", "size", "mtime"]
    order = Window.partitionBy(*same, "event_type").orderBy("path")
    rows = changes.withColumn("nth", F.row_number().over(order))
    pair = Window.partitionBy(*same, "nth")
    one = rows.filter("event_type in ('created', 'deleted')").withColumns({"gone": F.max(F.when(F.col("event_type") == "deleted", F.col("path"))).over(pair), "come": F.max(F.when(F.col("event_type") == "created", F.col("path"))).over(pair)})
    both = F.col("gone").isNotNull() & F.col("come").isNotNull()
    told = one.filter(~(both & (F.col("event_type") == "deleted"))).select("batch", F.when(both, "moved").otherwise(F.col("event_type")).alias("event_type"), F.when(both, F.col("gone")).otherwise(F.col("path")).alias("src_path"), F.when(both, F.col("come")).alias("dest_path"))
    return told.unionByName(changes.filter("event_type = 'modified'").select("batch", "event_type", F.col("path").alias("src_path"), F.lit(None).cast("string").alias("dest_path")))
