"""Streams over the tables' files, run to their end: collapsing, keyed state and timers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.streaming import changes as stream
from cartolith.streaming import state

from .event_queries import COLLAPSE_SQL, changes
from .registry import query, table
from .search_queries import micros

HOUR = 3_600_000
#: Kinds that driver events stand for.
_KINDS = {"view": "agent_thinking", "click": "command_start", "signup": "agent_planning", "purchase": "command_end", "error": "error"}


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ("file:///tmp/checkpoints" if spark.sparkContext.master.startswith("local") else None)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; a table may be one file or a folder of them."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def _ended(out: DataFrame, where: str) -> DataFrame:
    """A stream's rows after it has run to its end."""
    out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{where}/out")


def _events(spark: SparkSession, sf_dir: str, where: str, after_hours: float) -> DataFrame:
    """Events with their time in microseconds, as a stream with a watermark that ends some hours after the last one."""
    last = table(spark, sf_dir, "events").agg((F.max(micros()) + int(after_hours * 1000 * HOUR)).alias("us")).select(F.timestamp_micros("us").alias("at"))
    last.write.parquet(f"{where}/closing")
    rows = _source(spark, sf_dir, "events").withColumn("us", micros()).withColumn("at", F.timestamp_micros("us"))
    return state.closed(rows, "at", spark.readStream.schema(last.schema).parquet(f"{where}/closing"))


@query(COLLAPSE_SQL)
def stream_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change stream run to its end in one micro-batch; equals change_collapse."""
    where = _folder(spark)
    q = stream.collapsed(changes(_source(spark, sf_dir, "events")), lambda batch, n: batch.write.mode("overwrite").parquet(f"{where}/out/{n}"), f"{where}/checkpoint", available_now=True)
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{where}/out")


@query("""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (
        SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS event_type, true AS keeps, []::VARCHAR[] AS kinds, []::VARCHAR[] AS texts FROM e WHERE n = 1
        UNION ALL
        SELECT user_id, n, event_id, event_type, keeps, CASE WHEN keeps THEN list_append(kinds, event_type)[-5:] ELSE kinds END, CASE WHEN keeps THEN list_append(texts, CASE WHEN event_type = 'click' THEN props ELSE '' END)[-3:] ELSE texts END
        FROM (SELECT r.user_id, e.n, e.event_id, e.event_type, e.props, r.kinds, r.texts, NOT CASE e.event_type
                WHEN 'view' THEN coalesce(list_filter(list_reverse(r.kinds), lambda x: x IN ('view', 'purchase', 'signup'))[1] = 'view', false)
                WHEN 'click' THEN list_contains(r.texts, e.props) ELSE false END AS keeps
            FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT event_id, event_type FROM r WHERE keeps AND n > 0""")
def thinking_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated states go, judged by what was kept: views stand for thinking, purchases and sign-ups for ends, clicks for permissions."""
    rows = _source(spark, sf_dir, "events").select("user_id", micros().alias("us"), "event_id", "event_type", "props")
    processor = state.Suppressor(["us", "event_id"], "event_type", "props", "view", ("purchase", "signup"), "click")
    return _ended(state.keyed(rows, "user_id", processor, rows.schema.simpleString()[7:-1].replace(":", " ")), _folder(spark)).select("event_id", "event_type")


@query("""
    WITH RECURSIVE e AS (SELECT user_id, list_sort(list(epoch_us(ts))) AS ts FROM events GROUP BY 1),
    r AS (
        SELECT user_id, ts, ts[1] AS run_at, list_filter(ts, lambda x: x > ts[1]) AS later, len(list_filter(ts, lambda x: x <= ts[1])) AS requests FROM e
        UNION ALL
        SELECT user_id, ts, run_at, list_filter(later, lambda x: x > run_at), len(list_filter(later, lambda x: x <= run_at))
        FROM (SELECT user_id, ts, greatest(later[1], run_at + 3600000000) AS run_at, later FROM r WHERE len(later) > 0))
    SELECT user_id, run_at, requests FROM r""")
def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a job that events of a user ask for, an hour apart at least, by timers."""
    where = _folder(spark)
    rows = _events(spark, sf_dir, where, 2).select("user_id", "at", "us")
    return _ended(state.keyed(rows, "user_id", state.Jobs("user_id", "us", 1000 * HOUR), "user_id long, run_at long, requests long", timers=True), where)


@query(f"""
    WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS "at" FROM events),
    n AS (SELECT *, coalesce(lead("at") OVER (PARTITION BY user_id ORDER BY event_id), (SELECT epoch_us(max(ts) + INTERVAL 63000 SECONDS) // 1000 FROM events)) AS next FROM e)
    SELECT user_id, 'row' AS kind, "at", event_id AS ref FROM e
    UNION ALL SELECT user_id, 'heartbeat', "at" + k * {5 * HOUR}, NULL FROM (SELECT *, unnest(range(1, (next - "at" - 1) // {5 * HOUR} + 1)) AS k FROM n)""")
def feed_keepalive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a feed, with a heartbeat after every five quiet hours."""
    where = _folder(spark)
    rows = _events(spark, sf_dir, where, 17.5).select("user_id", "at", "event_id", F.floor(F.col("us") / 1000).alias("ms"))
    return _ended(state.keyed(rows, "user_id", state.Feed("user_id", "event_id", "ms", 5 * HOUR), "user_id long, kind string, at long, ref long", timers=True), where)


_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"


@query(f"""
    WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS "at", {_KIND} AS kind FROM events), n AS (SELECT *, coalesce("at" - lag("at") OVER w > {6 * HOUR}, false) AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY "at", event_id)),
    s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY "at", event_id) AS session FROM n)
    SELECT user_id, count(*) AS events, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'command_start') AS commands,
        arg_max(CASE kind WHEN 'agent_thinking' THEN 'thinking' WHEN 'command_start' THEN 'executing' WHEN 'agent_planning' THEN 'planning' END, ("at", event_id)) FILTER (kind IN ('agent_thinking', 'command_start', 'agent_planning')) AS phase,
        coalesce(arg_max(kind, ("at", event_id)) FILTER (kind IN ('command_start', 'command_end')) = 'command_start', false) AS open, max("at") AS "at" FROM s GROUP BY user_id, session""")
def session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users as they end, after six quiet hours: counts, last phase, and whether a command was left open."""
    where = _folder(spark)
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in _KINDS.items()))
    rows = _events(spark, sf_dir, where, 7).select("user_id", "at", "event_id", F.floor(F.col("us") / 1000).alias("ms"), kind.alias("kind"))
    schema = state.SESSIONS.format(key="user_id long")
    return _ended(state.keyed(rows, "user_id", state.Sessions("user_id", "kind", "ms", "event_id", 6 * HOUR), schema, timers=True), where).filter("ended").drop("ended")
