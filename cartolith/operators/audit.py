"""Audit runs and events: a run opens and closes, and tracked work leaves an event at its start and one at its end."""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.sources import files

RUN = "run_id long, name string, root_path string, status string, notes string, at timestamp, version long"
EVENT = "event_id long, run_id long, type string, title string, detail string, actor string, phase string, status string, ref string, payload string, created_at timestamp"

#: Status and title of the events of tracked work.
STARTED, COMPLETED, FAILED = ("running", "started"), ("ok", "completed"), ("error", "failed")
#: Characters of arguments and of a returned value that an event keeps.
LONGEST_ARGS, LONGEST_VALUE = 200, 500


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each run of an append-only table."""
    table = spark.read.schema(RUN).parquet(path)
    newest = F.max_by(F.struct(*table.columns), F.col("version"))
    return table.groupBy("run_id").agg(newest.alias("r")).select("r.*")


def create_run(spark: SparkSession, path: str, name: str, root_path: str | None = None, notes: str | None = None) -> int:
    """The id of a new open run."""
    ident = uuid.uuid4().int >> 65
    files.append(spark.createDataFrame([(ident, name, root_path, "open", notes, _now(), 0)], RUN), path)
    return ident


def close_run(spark: SparkSession, path: str, run_id: int, status: str = "closed", notes: str | None = None) -> None:
    """A later version of the run, with its notes kept unless new ones are given; LookupError if there is no such run."""
    found = runs(spark, path).filter(F.col("run_id") == run_id).collect()
    if not found:
        raise LookupError(f"no such run: {run_id}")
    old = found[0]
    kept = old.notes if notes is None else notes
    files.append(spark.createDataFrame([(run_id, old.name, old.root_path, status, kept, _now(), old.version + 1)], RUN), path)


def event_log(spark: SparkSession, runs_path: str, path: str, run_id: int) -> Callable[..., int]:
    """A function that appends one event of a run and returns its id; LookupError if there is no such run."""

    def append(type: str, title: str, status: str, payload: dict, detail: str | None = None, actor: str = "agent", phase: str | None = None, ref: str | None = None) -> int:
        ident = uuid.uuid4().int >> 65
        row = (ident, run_id, type, title, detail, actor, phase, status, ref, json.dumps(payload), _now())
        files.append_events(spark.createDataFrame([row], EVENT), runs(spark, runs_path), path)
        return ident

    return append


@contextmanager
def tracked(append: Callable[..., int], title: str, type: str = "operation", detail: str | None = None, payload: dict | None = None, **fields) -> Iterator[dict]:
    """Work between a start and an end event; what it puts into the dict it gets joins the payload of the end.

    An error is told in the end event and raised again.
    """

    def tell(state: tuple[str, str], said: str | None, told: dict) -> int:
        return append(type=type, title=f"{title} ({state[1]})", status=state[0], detail=said, payload=told, **fields)

    began, found = time.time(), {}
    first = tell(STARTED, detail, (payload or {}) | {"started_at": began})

    def end() -> dict:
        return {"duration_ms": int((time.time() - began) * 1000), "start_event_id": first}

    try:
        yield found
    except BaseException as e:
        kind = e.__class__.__name__
        said = f"Error: {kind}: {e}"
        tell(FAILED, f"{detail}\n\n{said}" if detail else said, end() | {"error_type": kind, "error_message": str(e)})
        raise
    tell(COMPLETED, detail, end() | found)


def audited(type: str = "operation", keep_value: bool = False, **fields) -> Callable[[Callable], Callable]:
    """Decorates a function so that a call with `audit=` (an event log's function) is tracked under its name; others run as they are."""

    def decorate(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, audit: Callable[..., int] | None = None, **named):
            if audit is None:
                return f(*args, **named)
            with tracked(audit, f.__name__, type, payload={"args": str(args)[:LONGEST_ARGS]}, **fields) as found:
                value = f(*args, **named)
                if keep_value and value is not None:
                    found["return_value"] = str(value)[:LONGEST_VALUE]
            return value

        return call

    return decorate
