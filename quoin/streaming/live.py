"""Job status and query statistics over a stream, in update mode, in windows that the watermark ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_job_status(events: DataFrame) -> DataFrame:
    """T04 over a table. Latest status and percentage of each job; over a stream its state stays for ever."""
    last = F.max_by(F.struct("status", "percentage"), F.struct("ts", "seq"))
    return events.groupBy("job_id").agg(last.alias("l"), F.count("*").alias("n_events")).select("job_id", "l.status", "l.percentage", "n_events")


def stream_query_statistics(log: DataFrame) -> DataFrame:
    """T05 over a table. Counts, mean time and hits of each key of ``(key, ms, hit)``; over a stream its state stays for ever."""
    return log.groupBy("key").agg(F.count("*").alias("executions"), F.avg("ms").alias("mean_ms"), F.count_if("hit").alias("hits"))


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def job_status_windows(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """T04. ``(job_id, begun, at, status, percentage, n_events)``: the last event of each job in each window of
    ``events(job_id, ts, seq, status, percentage)``. A window's state goes once the watermark, ``late`` behind
    the newest event, has passed its end. Events without ``ts`` are left out, as are those later than that."""
    order = F.struct("ts", "seq")
    found = _timed(events, late).groupBy("job_id", F.window("ts", every).alias("w")).agg(F.max_by(F.struct("status", "percentage"), order).alias("l"), F.max(order).alias("at"), F.count("*").alias("n_events"))
    return found.select("job_id", F.col("w.start").alias("begun"), "at", "l.status", "l.percentage", "n_events")


def latest_job_status(windows: DataFrame) -> DataFrame:
    """``stream_job_status`` of all rows that ``job_status_windows`` emitted, in whatever order they were kept."""
    last = windows.groupBy("job_id", "begun").agg(F.max("n_events").alias("n_events"), F.max("at").alias("at"), F.max_by(F.struct("status", "percentage"), "at").alias("l"))
    return last.groupBy("job_id").agg(F.max_by("l", "at").alias("l"), F.sum("n_events").alias("n_events")).select("job_id", "l.status", "l.percentage", "n_events")


def query_statistics_windows(log: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """T05. ``(key, begun, executions, timed, total_ms, hits)`` of each key in each window of ``log(key, ts, ms, hit)``;
    state, late rows and rows without ``ts`` as in ``job_status_windows``."""
    found = _timed(log, late).groupBy("key", F.window("ts", every).alias("w")).agg(F.count("*").alias("executions"), F.count("ms").alias("timed"), F.sum("ms").alias("total_ms"), F.count_if("hit").alias("hits"))
    return found.select("key", F.col("w.start").alias("begun"), "executions", "timed", "total_ms", "hits")


def query_statistics(windows: DataFrame) -> DataFrame:
    """``stream_query_statistics`` of all rows that ``query_statistics_windows`` emitted: of each window the last ones, added up."""
    last = windows.groupBy("key", "begun").agg(F.max_by(F.struct("executions", "timed", "total_ms", "hits"), "executions").alias("l")).select("key", "l.*")
    return last.groupBy("key").agg(F.sum("executions").alias("executions"), (F.sum("total_ms") / F.nullif(F.sum("timed"), F.lit(0))).alias("mean_ms"), F.sum("hits").alias("hits"))


def stream_expire(messages: DataFrame, hours: int = 24) -> DataFrame:
    """T02. Messages of an event-time stream by session window; a session ends when none came for some hours."""
    marked = messages.withWatermark("ts", f"{hours} hours")
    return marked.groupBy("session", F.session_window("ts", f"{hours} hours")).agg(F.count("*").alias("messages"))
