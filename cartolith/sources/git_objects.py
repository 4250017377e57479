"""A source of the objects of a Git repository, loose and packed, and tables of its commits, trees and files.

    spark.dataSource.register(GitObjects)
    spark.read.format("git_objects").option("path", "/shared/project/.git").load()

The folder is read where executors run; no `git` program is needed. Loose objects are planned by the first digits of their
names, a pack by ranges of its index, so packs of any size are read side by side. An object stored as a delta is made from
its base, found by offset in the same pack or by name anywhere, along its whole chain; a task keeps the bases it used last.
Object names are SHA-1; a pack index is of version 2.
"""

from __future__ import annotations

import collections
import glob
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "oid string, type string, size long, data binary"
#: Objects that one task reads from a pack, bytes of bases that it keeps, and groups of loose folders.
RANGE, KEPT_BYTES, LOOSE_GROUPS = 20_000, 64 << 20, 16
_TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}


class Loose(InputPartition):
    def __init__(self, group: int):
        super().__init__(group)
        self.group = group


class Packed(InputPartition):
    def __init__(self, pack: str, low: int, high: int):
        super().__init__((pack, low))
        self.pack, self.low, self.high = pack, low, high


def applied(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: pieces copied from it and pieces of its own."""
    at, sizes = 0, []
    for _ in range(2):
        size = shift = 0
        while True:
            byte = delta[at]
            at, size, shift = at + 1, size | (byte & 0x7F) << shift, shift + 7
            if byte < 0x80:
                break
        sizes.append(size)
    if len(base) != sizes[0]:
        raise ValueError("a delta for another base")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            offset = size = 0
            for k in range(7):
                if op >> k & 1:
                    offset, size = (offset | delta[at] << 8 * k, size) if k < 4 else (offset, size | delta[at] << 8 * (k - 4))
                    at += 1
            size = size or 0x10000
            out += base[offset : offset + size]
        else:
            out += delta[at : at + op]
            at += op
    if len(out) != sizes[1]:
        raise ValueError("a delta of another size")
    return bytes(out)


class Pack:
    """A pack and its index, read by seeking."""

    def __init__(self, path: str, repository: Repository):
        self.path, self.repository = path, repository
        self.file, self.index = open(path, "rb"), open(path[:-5] + ".idx", "rb")
        magic, version = struct.unpack(">4sI", self.index.read(8))
        if magic != b"\xfftOc" or version != 2:
            raise ValueError(f"an index of an unknown version: {path}")
        self.fanout = struct.unpack(">256I", self.index.read(1024))
        self.count = self.fanout[-1]
        self.kept: collections.OrderedDict[int, tuple[int, bytes]] = collections.OrderedDict()
        self.bytes = 0

    def _at(self, place: int, size: int) -> bytes:
        self.index.seek(place)
        return self.index.read(size)

    def name(self, k: int) -> str:
        return self._at(1032 + 20 * k, 20).hex()

    def offset(self, k: int) -> int:
        low = struct.unpack(">I", self._at(1032 + 24 * self.count + 4 * k, 4))[0]
        return low if low < 1 << 31 else struct.unpack(">Q", self._at(1032 + 28 * self.count + 8 * (low & 0x7FFFFFFF), 8))[0]

    def find(self, oid: str) -> int | None:
        """The offset of a named object."""
        first = int(oid[:2], 16)
        low, high = self.fanout[first - 1] if first else 0, self.fanout[first]
        while low < high:
            middle = (low + high) // 2
            here = self.name(middle)
            if here == oid:
                return self.offset(middle)
            low, high = (middle + 1, high) if here < oid else (low, middle)
        return None

    def _inflated(self, size: int) -> bytes:
        out, unzip = bytearray(), zlib.decompressobj()
        while not unzip.eof:
            part = self.file.read(max(4096, min(size, 1 << 20)))
            if not part:
                raise ValueError(f"{self.path} ends within an object")
            out += unzip.decompress(part)
        return bytes(out)

    def read(self, offset: int) -> tuple[int, bytes]:
        """(type, content) of the object at an offset; its chain of deltas is walked to the base and back."""
        chain: list[tuple[int, bytes]] = []
        at: int | None = offset
        while True:
            if at in self.kept:
                self.kept.move_to_end(at)
                kind, data = self.kept[at]
                break
            self.file.seek(at)
            byte = self.file.read(1)[0]
            kind, size, shift = byte >> 4 & 7, byte & 15, 4
            while byte & 0x80:
                byte = self.file.read(1)[0]
                size, shift = size | (byte & 0x7F) << shift, shift + 7
            if kind == 6:
                byte = self.file.read(1)[0]
                back = byte & 0x7F
                while byte & 0x80:
                    byte = self.file.read(1)[0]
                    back = (back + 1) << 7 | byte & 0x7F
                chain.append((at, self._inflated(size)))
                at -= back
            elif kind == 7:
                oid = self.file.read(20).hex()
                chain.append((at, self._inflated(size)))
                at = self.find(oid)
                if at is None:
                    kind, data = self.repository.read(oid)
                    break
            else:
                data = self._inflated(size)
                self._keep(at, kind, data)
                break
        for at, delta in reversed(chain):
            data = applied(data, delta)
            self._keep(at, kind, data)
        return kind, data

    def _keep(self, at: int, kind: int, data: bytes) -> None:
        self.kept[at] = kind, data
        self.bytes += len(data)
        while self.bytes > KEPT_BYTES and len(self.kept) > 1:
            self.bytes -= len(self.kept.popitem(last=False)[1][1])

    def close(self) -> None:
        self.file.close()
        self.index.close()


class Repository:
    def __init__(self, path: str):
        self.objects = os.path.join(path, "objects")
        self.packs: dict[str, Pack] = {}

    def pack_files(self) -> list[str]:
        return sorted(p for p in glob.glob(os.path.join(self.objects, "pack", "*.pack")) if os.path.exists(p[:-5] + ".idx"))

    def pack(self, path: str) -> Pack:
        if path not in self.packs:
            self.packs[path] = Pack(path, self)
        return self.packs[path]

    def loose(self, oid: str) -> tuple[int, bytes]:
        with open(os.path.join(self.objects, oid[:2], oid[2:]), "rb") as f:
            head, _, data = zlib.decompress(f.read()).partition(b"\0")
        name, size = head.split()
        if int(size) != len(data):
            raise ValueError(f"object {oid} has another size")
        return next(k for k, v in _TYPES.items() if v == name.decode()), data

    def read(self, oid: str) -> tuple[int, bytes]:
        if os.path.exists(os.path.join(self.objects, oid[:2], oid[2:])):
            return self.loose(oid)
        for path in self.pack_files():
            at = self.pack(path).find(oid)
            if at is not None:
                return self.pack(path).read(at)
        raise KeyError(f"no object {oid}")

    def close(self) -> None:
        for pack in self.packs.values():
            pack.close()


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range = int(options.get("range", RANGE))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = [Loose(k) for k in range(LOOSE_GROUPS)]
        repository = Repository(self.path)
        for path in repository.pack_files():
            count = repository.pack(path).count
            out += [Packed(path, low, min(low + self.range, count)) for low in range(0, count, self.range)]
        repository.close()
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        repository = Repository(self.path)
        try:
            if isinstance(partition, Loose):
                for first in range(partition.group, 256, LOOSE_GROUPS):
                    folder = os.path.join(repository.objects, f"{first:02x}")
                    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
                        if len(name) == 38:
                            kind, data = repository.loose(f"{first:02x}{name}")
                            yield f"{first:02x}{name}", _TYPES[kind], len(data), data
            else:
                pack = repository.pack(partition.pack)
                for k in range(partition.low, partition.high):
                    kind, data = pack.read(pack.offset(k))
                    yield pack.name(k), _TYPES[kind], len(data), data
        finally:
            repository.close()


class GitObjects(DataSource):
    """Options: path, a repository's .git folder; range, objects of a pack for one task."""

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


def objects(spark: SparkSession, path: str, per_task: int = RANGE) -> DataFrame:
    """(oid, type, size, data), an object that is stored twice once."""
    spark.dataSource.register(GitObjects)
    return spark.read.format("git_objects").option("path", path).option("range", per_task).load().dropDuplicates(["oid"])


def commits(found: DataFrame) -> DataFrame:
    """(commit, tree, parents, author, email, at, offset, message) of commit objects."""
    text = F.decode("data", "UTF-8")
    head, message = F.substring_index(text, "\n\n", 1), F.expr("substring(decode(data, 'UTF-8'), instr(decode(data, 'UTF-8'), '\n\n') + 2)")
    who = lambda part: F.regexp_extract(head, r"(?m)^author (.*) <([^>]*)> (\d+) ([+-]\d{4})$", part)
    return found.filter("type = 'commit'").select(
        F.col("oid").alias("commit"), F.regexp_extract(head, r"^tree ([0-9a-f]{40})", 1).alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]{40})$"), F.lit(1)).alias("parents"),
        who(1).alias("author"), who(2).alias("email"), F.timestamp_seconds(who(3).try_cast("long")).alias("at"), who(4).alias("offset"), F.regexp_replace(message, r"\s+$", "").alias("message"),
    )


def _entries(data: bytes) -> list[tuple[str, str, str]]:
    at, out = 0, []
    while at < len(data):
        space, end = data.index(b" ", at), data.index(b"\0", at)
        out.append((data[at:space].decode(), data[space + 1 : end].decode("utf-8", "replace"), data[end + 1 : end + 21].hex()))
        at = end + 21
    return out


def trees(found: DataFrame) -> DataFrame:
    """(tree, mode, name, oid) of the entries of tree objects."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [(oid, *entry) for oid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for entry in _entries(data)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["tree", "mode", "name", "oid"])

    return found.filter("type = 'tree'").select("oid", "data").mapInArrow(run, "tree string, mode string, name string, oid string")
