"""Event-time aggregates, which run on batches and on streams alike. Extensions: the original has no event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Schema of event lines.
ENVELOPE = "id string, time timestamp, workspace string, type string, data string"


def timed(events: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Events with a zoned time, which watermarks need, and, on streams, a watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late) if late and rows.isStreaming else rows


def tumbling(events: DataFrame, width: str = "1 day", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    w = timed(events, ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "events", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    w = timed(events, ts, late).groupBy(F.window(ts, width, step)).agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users") if events.isStreaming else F.countDistinct("user_id").alias("users"))
    return w.select(F.col("window.start").alias("start"), "events", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions of each user; streams need the user as a key besides the window."""
    s = timed(events, ts, late).groupBy("user_id", F.session_window(ts, gap)).agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def once(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """One event of each key; on streams, of those within the watermark."""
    rows = timed(events, ts, late)
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def tail_jsonl(spark: SparkSession, folder: str, schema: str = ENVELOPE) -> DataFrame:
    """Event lines as files appear."""
    return spark.readStream.schema(schema).json(folder)


def payload(events: DataFrame, kind: str, schema: str) -> DataFrame:
    """Events of one type with their data parsed."""
    return events.where(F.col("type") == kind).withColumn("data", F.from_json("data", schema)).select("id", "time", "workspace", "data.*")


def expiring(beats: DataFrame, key: str, seconds: int) -> DataFrame:
    """``(key, status, beats)`` of a stream of signs of life: alive with each batch that has one, expired once none came for so long.

    The state is one number a key and goes when it expires.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "status": ["expired"], "beats": [n]})
            return
        n += sum(len(b) for b in batches)
        state.update((n,))
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({key: [k[0]], "status": ["alive"], "beats": [n]})

    return beats.groupBy(key).applyInPandasWithState(update, f"`{key}` string, status string, beats long", "beats long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(snapshots: DataFrame, known, checkpoint: str, handle) -> object:
    """Runs ``handle(diff)`` for each batch of a stream of file snapshots against what ``known()`` returns; ends when all are read."""
    from mnemora.operators.corpus import diff

    return snapshots.writeStream.foreachBatch(lambda batch, _: handle(diff(batch, known()))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
