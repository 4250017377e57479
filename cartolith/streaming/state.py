"""Keyed state with timers: suppression of repeats, coalesced jobs, feeds with keepalives, sessions and contents of files.

Each is a processor of `transformWithStateInPandas`: Spark keeps a key's state in its state store, checkpointed with the
stream, hands over a key's new rows of a micro-batch, and calls back when a timer is due by the watermark. Rows of a key
are taken in order within a micro-batch; only those are held, and state is a few values a key. Rows later than the
watermark are Spark's to drop.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cartolith.sources.transcripts import PHASES

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Keyed(StatefulProcessor):
    """A processor with one value of state and at most one timer a key. Subclasses give `state`, `order` and `step`."""

    state = "value string"
    ttl_ms: int | None = None

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state, self.ttl_ms)

    def close(self) -> None:
        pass

    def read(self, *nothing: Any) -> tuple:
        return tuple(self.value.get()) if self.value.exists() else nothing

    def timer(self, at: int | None) -> None:
        """The key's only timer, in milliseconds."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def rows(self, parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(parts)).sort_values(self.order, kind="stable")


class Suppressor(_Keyed):
    """Rows without repeated states, judged by the rows that were kept.

    A `thinking` row goes if one of the last `within` kept rows is one and none of `ends` was kept since; a `permission`
    row goes if one of the last `same` kept rows is one with its text.
    """

    def __init__(self, order: list[str], kind: str, text: str, thinking: str, ends: tuple[str, ...], permission: str, within: int = 5, same: int = 3):
        super().__init__(order)
        self.kind, self.text, self.thinking, self.ends, self.permission, self.within, self.same = kind, text, thinking, ends, permission, within, same

    def repeats(self, kept: list[list], kind: str, text: str | None) -> bool:
        if kind == self.thinking:
            for k, _ in reversed(kept[-self.within :]):
                if k == self.thinking or k in self.ends:
                    return k == self.thinking
        if kind == self.permission:
            return [kind, text] in kept[-self.same :]
        return False

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.read("[]")[0])
        all_rows, stays = self.rows(rows), []
        for kind, text in zip(all_rows[self.kind], all_rows[self.text], strict=True):
            keep = not self.repeats(kept, kind, text)
            stays.append(keep)
            if keep:
                kept = [*kept, [kind, text if kind == self.permission else None]][-max(self.within, self.same) :]
        self.value.update((json.dumps(kept),))
        if any(stays):
            yield all_rows[stays]


class Jobs(_Keyed):
    """Runs of a job that requests of a key ask for, at least `interval` microseconds apart: (key, run_at, requests).

    A request runs at once if the last run is far enough back; otherwise a timer is set for when it is, and requests until
    then share that run.
    """

    state = "last long, due long, requests long"

    def __init__(self, key: str, at: str, interval: int):
        super().__init__([at])
        self.key, self.at, self.interval = key, at, interval

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, due, requests = self.read(None, None, 0)
        runs = []
        for t in self.rows(rows)[self.at].tolist():
            if requests and t > due:
                runs.append((due, requests))
                last, requests = due, 0
            if not requests:
                due = t if last is None or t - last >= self.interval else last + self.interval
            requests += 1
        self.value.update((last, due, requests))
        self.timer(-(-due // 1000))
        if runs:
            yield self.told(key, runs)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, due, requests = self.read(None, None, 0)
        if requests:
            self.value.update((due, due, 0))
            yield self.told(key, [(due, requests)])

    def told(self, key: Any, runs: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(runs), "run_at": [r[0] for r in runs], "requests": [r[1] for r in runs]})


class Feed(_Keyed):
    """A feed of a key's rows with keepalives: (key, kind, at, ref), kind `row` or `heartbeat`.

    A heartbeat follows `quiet` milliseconds after the last row or heartbeat, so a reader knows that the feed is alive.
    Rows at or below the last one told are repeats of the source and are not told again.
    """

    state = "told long, at long"

    def __init__(self, key: str, ident: str, at: str, quiet: int):
        super().__init__([ident])
        self.key, self.ident, self.at, self.quiet = key, ident, at, quiet

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        told, last = self.read(None, None)
        out = []
        for ident, at in self.rows(rows)[[self.ident, self.at]].itertuples(index=False):
            if told is not None and ident <= told:
                continue
            while last is not None and last + self.quiet < at:
                last += self.quiet
                out.append(("heartbeat", last, None))
            told, last = int(ident), max(int(at), last or int(at))
            out.append(("row", int(at), told))
        self.value.update((told, last))
        self.timer(last + self.quiet)
        if out:
            yield self.frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        told, last = self.read(None, None)
        now, out = timerValues.getCurrentWatermarkInMs(), []
        while last + self.quiet <= now:
            last += self.quiet
            out.append(("heartbeat", last, None))
        self.value.update((told, last))
        self.handle.registerTimer(last + self.quiet)
        if out:
            yield self.frame(key, out)

    def frame(self, key: Any, out: list[tuple]) -> pd.DataFrame:
        refs = pd.array([r for _, _, r in out], dtype="Int64")
        return pd.DataFrame({self.key: [key[0]] * len(out), "kind": [k for k, _, _ in out], "at": [at for _, at, _ in out], "ref": refs})


class Sessions(_Keyed):
    """States of sessions: events, errors and commands so far, the phase, and whether a command is open.

    One row a touched session and micro-batch; a session that is quiet for `idle` milliseconds is told as ended and
    forgotten. The phase stays until an event begins another one.
    """

    state = "events long, errors long, commands long, phase string, open boolean, at long"

    def __init__(self, key: str, kind: str, at: str, tie: str, idle: int):
        super().__init__([at, tie])
        self.key, self.kind, self.at, self.idle = key, kind, at, idle

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events, errors, commands, phase, is_open, at = self.read(0, 0, 0, None, False, None)
        out = []
        for kind, now in self.rows(rows)[[self.kind, self.at]].itertuples(index=False):
            if at is not None and now - at > self.idle:
                out.append((events, errors, commands, phase, is_open, at, True))
                events, errors, commands, phase, is_open = 0, 0, 0, None, False
            events, errors, commands = events + 1, errors + (kind == "error"), commands + (kind == "command_start")
            phase, at = PHASES.get(kind, phase), int(now)
            is_open = kind == "command_start" or (is_open and kind != "command_end")
        self.value.update((events, errors, commands, phase, is_open, at))
        self.timer(at + self.idle + 1)
        yield self.frame(key, [*out, (events, errors, commands, phase, is_open, at, False)])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            ended = (*self.read(), True)
            self.value.clear()
            yield self.frame(key, [ended])

    def frame(self, key: Any, out: list[tuple]) -> pd.DataFrame:
        names = ("events", "errors", "commands", "phase", "open", "at", "ended")
        return pd.DataFrame({self.key: [key[0]] * len(out)} | {n: [r[k] for r in out] for k, n in enumerate(names)})


class Contents(_Keyed):
    """Changes of files' contents: created, modified with the lines added and removed, deleted; repeats give nothing."""

    state = "digest string, lines long"

    def __init__(self, seq: str = "seq"):
        super().__init__([seq])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        digest, lines = self.read(None, 0)
        out = []
        for kind, new, n in self.rows(rows)[["event_type", "digest", "lines"]].itertuples(index=False):
            new, n = (None, 0) if kind == "deleted" else (new, int(n))
            if new != digest:
                out.append((key[0], "created" if digest is None else "deleted" if new is None else "modified", max(0, n - lines), max(0, lines - n)))
            digest, lines = new, n
        if digest is None:
            self.value.clear()
        else:
            self.value.update((digest, lines))
        if out:
            yield pd.DataFrame(out, columns=["path", "event_type", "added", "removed"])


SESSIONS = "{key}, events long, errors long, commands long, phase string, open boolean, at long, ended boolean"
CONTENTS = "path string, event_type string, added long, removed long"


def keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, timers: bool = False) -> DataFrame:
    """The processor's rows over a stream; with timers, the stream has a watermark. Sets the state store that this needs."""
    use_state_store(stream.sparkSession)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime" if timers else "None")


def use_state_store(spark: SparkSession) -> None:
    if spark.conf.get(_PROVIDER, None) != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)


def closed(stream: DataFrame, at: str, closing: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The stream with a watermark on `at` that ends at the one row (at) of the stream `closing`, which is not passed on.

    After the closing time all timers up to it are due; a stream over finished files is run to its end this way.
    """
    marked = stream.withColumn("__closing", F.lit(None).cast("timestamp")).unionByName(closing.select(at, F.col(at).alias("__closing")), allowMissingColumns=True).withWatermark(at, late)
    # One condition on the watermark's column: a part without it would be pushed below the watermark, which would not see the row.
    return marked.filter(F.col(at) != F.coalesce("__closing", F.timestamp_micros(F.lit(-1)))).drop("__closing")
