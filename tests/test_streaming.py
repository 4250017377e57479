"""Streams run to their end over small files, against the batch form, plain loops or files on disk."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from cartolith.operators import events
from cartolith.sources import folder
from cartolith.streaming import changes, state
from cartolith.streaming.index import LogIndex, index_sink

SCHEMA = "seq int, event_type string, src_path string, dest_path string"
ROWS = [(0, "created", "a", None), (1, "modified", "a", None), (2, "moved", "a", "b"), (3, "created", "c", None), (4, "deleted", "c", None), (5, "modified", "d", None)]


def run_all(stream, mode, name, where):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(where)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_collapse_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.coalesce(1).write.json(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    q = changes.collapsed(stream, lambda batch, n: got.extend(map(tuple, batch.collect())), str(tmp_path / "checkpoint"), available_now=True)
    q.awaitTermination()
    assert sorted(got) == sorted(map(tuple, events.collapse(df).collect()))


def test_fan_out_reaches_all_handlers(spark):
    seen = []

    def bad(batch, n):
        raise ValueError("no")

    with pytest.raises(ValueError):
        changes.fan_out([bad, lambda batch, n: seen.append((n, batch.count()))])(spark.range(3), 7)
    assert seen == [(7, 3)]


def test_windowed_counts(spark, tmp_path):
    schema = "at timestamp, event_type string"
    spark.createDataFrame([("2024-01-01 01:00:00", "x"), ("2024-01-01 05:00:00", "x"), ("2024-01-01 07:00:00", "y")], "t string, event_type string").selectExpr("cast(t as timestamp) as at", "event_type").coalesce(1).write.json(str(tmp_path / "in"))
    run_all(changes.windowed_counts(spark.readStream.schema(schema).json(str(tmp_path / "in")), "at"), "complete", "windows", tmp_path / "c")
    assert sorted((r["event_type"], r["n"]) for r in spark.table("windows").collect()) == [("x", 2), ("y", 1)]


def in_batches(spark, tmp_path, parts, schema, stream_of):
    """Rows of a stream that gets one file a micro-batch; the files' times are their order."""
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"part{n}"))
    (tmp_path / "in").mkdir()
    for n in range(len(parts)):
        (source,) = (tmp_path / f"part{n}").glob("*.json")
        os.utime(source, (1_000_000 + n, 1_000_000 + n))
        os.rename(source, tmp_path / "in" / f"{n}.json")
    got = []
    stream = stream_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    stream.writeStream.foreachBatch(lambda batch, n: got.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return got


def test_content_changes_over_batches(spark, tmp_path):
    schema = "seq int, path string, event_type string, digest string, lines int"
    rows = [(0, "a", "modified", "x", 5), (1, "a", "modified", "x", 5), (2, "a", "modified", "y", 8), (3, "a", "deleted", None, None), (4, "b", "deleted", None, None), (5, "a", "created", "z", 2), (6, "a", "modified", "w", 1)]
    want = sorted([("a", "created", 5, 0), ("a", "modified", 3, 0), ("a", "deleted", 0, 8), ("a", "created", 2, 0), ("a", "modified", 0, 1)])
    for cut in (3, 6):
        (tmp_path / str(cut)).mkdir()
        got = in_batches(spark, tmp_path / str(cut), [rows[:cut], rows[cut:]], schema, lambda s: state.keyed(s, "path", state.Contents(), state.CONTENTS))
        assert sorted(got) == want


def kept(rows, within=5, same=3):
    """The rows that stay, by a plain loop."""
    out = []
    for row in rows:
        kind, text = row[2], row[3]
        if kind == "thinking":
            before = [r[2] for r in out[-within:] if r[2] in ("thinking", "done", "ready")]
            if before and before[-1] == "thinking":
                continue
        if kind == "ask" and any(r[2:] == ("ask", text) for r in out[-same:]):
            continue
        out.append(row)
    return out


def test_suppression_looks_at_what_was_kept(spark, tmp_path):
    rng = random.Random(1)
    some = [(k, seq, rng.choice(["thinking", "thinking", "x", "done", "ready", "ask"]), rng.choice("pq")) for k in ("s", "t") for seq in range(60)]
    # Thinking, four others, thinking, one other, thinking: the third is the first of its kind among the last five kept.
    some += [("u", n, k, "p") for n, k in enumerate(["thinking", *"abcd", "thinking", "e", "thinking"])]
    want = sorted(x for k in "stu" for x in kept([r for r in some if r[0] == k]))
    assert [r[1] for r in want if r[0] == "u"] == [0, 1, 2, 3, 4, 6, 7]
    parts = [[r for r in some if r[1] % 60 < 25], [r for r in some if r[1] % 60 >= 25]]
    schema = "k string, seq int, kind string, text string"
    processor = state.Suppressor(["seq"], "kind", "text", "thinking", ("done", "ready"), "ask")
    assert sorted(in_batches(spark, tmp_path, parts, schema, lambda s: state.keyed(s, "k", processor, schema))) == want


def runs_of(times, interval):
    out, last = [], None
    times = sorted(times)
    while times:
        due = times[0] if last is None or times[0] - last >= interval else last + interval
        out.append((due, sum(t <= due for t in times)))
        times, last = [t for t in times if t > due], due
    return out


def test_jobs_by_timers_over_batches(spark, tmp_path):
    rng = random.Random(2)
    asked = sorted((rng.randrange(200) * 1000, k) for k in ("p", "q") for _ in range(25)) + [(10_000_000, "end")]
    asked = [(k, t) for t, k in asked]
    parts = [asked[:20], asked[20:40], asked[40:]]
    make = lambda s: state.keyed(s.withColumn("at", F.timestamp_micros("us")).withWatermark("at", "0 seconds"), "k", state.Jobs("k", "us", 20_000), "k string, run_at long, requests long", timers=True)
    got = in_batches(spark, tmp_path, parts, "k string, us long", make)
    for key in "pq":
        assert sorted(r[1:] for r in got if r[0] == key) == runs_of([t for k, t in asked if k == key], 20_000)


def test_feed_tells_rows_once_and_keepalives(spark, tmp_path):
    rows = [("r", 1, 1000), ("r", 2, 1500), ("r", 2, 1500), ("r", 3, 9000), ("end", 1, 20_500)]
    make = lambda s: state.keyed(s.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", "0 seconds"), "k", state.Feed("k", "id", "ms", 3000), "k string, kind string, at long, ref long", timers=True)
    got = in_batches(spark, tmp_path, [rows[:2], rows[2:4], rows[4:]], "k string, id long, ms long", make)
    assert sorted((r for r in got if r[0] == "r"), key=lambda r: r[2]) == [("r", "row", 1000, 1), ("r", "row", 1500, 2), ("r", "heartbeat", 4500, None), ("r", "heartbeat", 7500, None), ("r", "row", 9000, 3), ("r", "heartbeat", 12_000, None), ("r", "heartbeat", 15_000, None), ("r", "heartbeat", 18_000, None)]


def test_sessions_end_when_quiet(spark, tmp_path):
    rows = [("s", 0, "agent_planning", 5), ("s", 1, "command_start", 10), ("t", 2, "error", 20), ("s", 3, "command_end", 30), ("s", 4, "error", 40), ("s", 5, "test_start", 50), ("s", 6, "agent_thinking", 5000), ("end", 7, "x", 90_000)]
    make = lambda s: state.keyed(s.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", "0 seconds"), "k", state.Sessions("k", "kind", "ms", "seq", 1000), state.SESSIONS.format(key="k string"), timers=True)
    got = in_batches(spark, tmp_path, [rows[:3], rows[3:6], rows[6:]], "k string, seq long, kind string, ms long", make)
    assert sorted(r for r in got if r[-1] and r[0] != "end") == [("s", 1, 0, 0, "thinking", False, 5000, True), ("s", 5, 1, 1, "testing", False, 50, True), ("t", 1, 1, 0, None, False, 20, True)]
    assert ("s", 2, 0, 1, "executing", True, 10, False) in got


def test_index_equals_a_dict_and_writes_little(spark, tmp_path):
    rng = random.Random(3)
    index, want = LogIndex(spark, f"{tmp_path}/index", "path string, version long", "path", buckets=4, fan=3), {}
    sink = index_sink(index, lambda batch: batch.selectExpr("path", "version"))
    step = lambda rows: spark.createDataFrame(rows, "path string, event_type string, version long")
    written = 0
    for n in range(20):
        rows = {f"f{rng.randrange(30)}": rng.choice(["created", "modified", "deleted"]) for _ in range(5)} if n else {f"f{k}": "created" for k in range(30)}
        batch = step([(p, kind, n) for p, kind in rows.items()])
        for _ in range(1 + (n % 4 == 1)):  # some batches run again
            sink(batch, n)
        want = {p: v for p, v in (want | {p: n for p, k in rows.items() if k != "deleted"}).items() if rows.get(p) != "deleted"}
        written += spark.read.option("basePath", str(tmp_path / "index")).parquet(str(tmp_path / "index" / f"run={n}-{n}")).count() if (tmp_path / "index" / f"run={n}-{n}").exists() else 0
        if n in (1, 2, 3, 8, 9, 19):
            assert dict(map(tuple, index.read().collect())) == want
        assert len(index.runs()) <= 3 * 3
    for p in ("f1", "f2", "f3", "none"):
        assert [tuple(r) for r in index.lookup(p).collect()] == ([(p, want[p])] if p in want else [])
    assert written <= 30 + 19 * 5
    sink(step([("f1", "deleted", 5)]), 5)  # long taken in by a merge
    assert dict(map(tuple, index.read().collect())) == want


def test_index_stops_on_a_gap_or_a_broken_file(spark, tmp_path):
    index = LogIndex(spark, f"{tmp_path}/index", "path string, n int", "path", buckets=1)
    rows = lambda name: spark.createDataFrame([(name, 1)], "path string, n int")
    none = rows("x").limit(0).select("path")
    index.apply(rows("a"), none, 0)
    index.apply(rows("b"), none, 1)
    for part in (tmp_path / "index" / "run=1-1").rglob("*.parquet"):
        part.write_bytes(b"broken")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="(?i)parquet|corrupt|magic|footer"):
        index.read().collect()
    with pytest.raises(ValueError, match="gap"):
        index.apply(rows("c"), none, 3)
    (tmp_path / "index" / "run=0-0" / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="gap"):
        index.read()


def test_folder_changes_across_restarts(spark, tmp_path):
    root, shared = tmp_path / "root", tmp_path / "state"
    for name in ("a/x.py", "a/y.py", "b/z.py", "top.txt", "node_modules/skip.js", ".git/skip"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    os.symlink(root / "top.txt", root / "link.txt")
    spark.dataSource.register(folder.FolderChanges)

    def run():
        got = []
        stream = spark.readStream.format("folder_changes").option("path", str(root)).option("state", str(shared)).option("shards", 3).load()
        q = stream.writeStream.foreachBatch(lambda batch, n: got.extend(map(tuple, folder.moves(batch).collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
        return sorted(r[1:] for r in got)

    assert run() == [("created", n, None) for n in ("a/x.py", "a/y.py", "b/z.py", "top.txt")]
    (root / "a/x.py").write_text("longer than before")
    (root / "a/y.py").unlink()
    (root / "b/new.py").write_text("new")
    os.rename(root / "b/z.py", root / "moved.py")
    assert run() == [("created", "b/new.py", None), ("deleted", "a/y.py", None), ("modified", "a/x.py", None), ("moved", "b/z.py", "moved.py")]
    assert run() == []


def test_folder_shards_give_the_same_rows_again(tmp_path):
    """A task that runs again reads the listing that its first run wrote, whatever has changed since."""
    root = tmp_path / "root"
    for k in range(20):
        (root / f"d{k}").mkdir(parents=True)
        (root / f"d{k}" / "f").write_text(str(k))
    reader = folder.FolderReader({"path": str(root), "state": str(tmp_path / "state"), "shards": "4"})
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    first = [list(reader.read(p)) for p in parts]
    assert sorted(r[2] for rows in first for r in rows) == sorted(f"d{k}/f" for k in range(20)) and sum(bool(rows) for rows in first) > 1
    (root / "d0" / "f").unlink()
    assert [list(reader.read(p)) for p in parts] == first
    after = reader.latestOffset()
    assert [r[1:3] for p in reader.partitions(end, after) for r in reader.read(p)] == [("deleted", "d0/f")]
    reader.commit(after)
    assert sorted(os.listdir(tmp_path / "state")) == [str(after["batch"])]
    assert json.loads((tmp_path / "state" / str(after["batch"]) / "0.json").read_text()) is not None
