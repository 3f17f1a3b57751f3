"""Conversations and ingestion jobs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prune_history(messages: DataFrame, limit: int = 20) -> DataFrame:
    """W02. System messages stay, and of the others the newest up to the rest of the limit."""
    of = Window.partitionBy("conv_id")
    system = F.count_if(F.col("role") == "system").over(of)
    newest = F.row_number().over(Window.partitionBy("conv_id", F.col("role") == "system").orderBy(F.col("turn").desc()))
    rows = messages.withColumns({"s": system, "n": newest})
    return rows.where((F.col("role") == "system") | (F.col("n") <= limit - F.col("s"))).drop("s", "n")


def history(messages: DataFrame, last: int = 6) -> DataFrame:
    """W03. System messages and the last n others."""
    newest = F.row_number().over(Window.partitionBy("conv_id", F.col("role") == "system").orderBy(F.col("turn").desc()))
    return messages.withColumn("n", newest).where((F.col("role") == "system") | (F.col("n") <= last)).drop("n")


def history_text(messages: DataFrame, last: int = 6, most: int = 500) -> DataFrame:
    """W04. The last messages of a session as ``role: text`` lines in order, texts cut."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    rows = messages.withColumn("n", newest).where(F.col("n") <= last)
    line = F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, most))
    return rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).getField("line"), "\n").alias("history"))


def conversation_list(messages: DataFrame) -> DataFrame:
    """A17."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def delete_sessions(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """S15."""
    return messages.join(ids.select("conv_id").distinct(), "conv_id", "left_anti")


def age_hours(created: Column, now: Column) -> Column:
    """F28. Whole hours since a timestamp in text; what cannot be read counts as a year."""
    return F.coalesce(F.timestamp_diff("HOUR", F.try_to_timestamp(created), now), F.lit(8760))


def latest_nonzero(value: str, order: str) -> Column:
    return F.coalesce(F.max_by(value, F.when(F.coalesce(F.col(value), F.lit(0)) != 0, F.col(order))), F.lit(0))


def merge_job_metrics(updates: DataFrame, metrics: list[str], order: str = "seq") -> DataFrame:
    """A12. Each metric's last value that is neither zero nor null."""
    return updates.groupBy("job_id").agg(*[latest_nonzero(m, order).alias(m) for m in metrics])


def job_latest(events: DataFrame) -> DataFrame:
    """A13. Last status and its percentage, the highest percentage so far, and whether it may be cancelled."""
    last = F.max_by(F.struct("status", "percentage"), F.struct("ts", "seq"))
    out = events.groupBy("job_id").agg(last.alias("l"), F.max("percentage").alias("highest"), F.count("*").alias("n_events"))
    return out.select("job_id", F.col("l.status").alias("status"), F.col("l.percentage").alias("percentage"), "highest", "n_events")


def retain_latest_jobs(jobs: DataFrame, most: int) -> DataFrame:
    """W11. The newest jobs; a top-n by creation, ties by id."""
    return jobs.orderBy(F.col("created").desc(), "job_id").limit(most)


def query_statistics(log: DataFrame, hit: Column) -> DataFrame:
    """A14. ``log(key, ms)`` by normalised key: executions, mean time, hits, misses and hit rate."""
    key = F.md5(F.trim(F.regexp_replace(F.lower("key"), r"\s+", " ")))
    return log.groupBy(key.alias("query_hash")).agg(F.count("*").alias("executions"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(F.count_if(hit) / F.count("*"), 6).alias("hit_rate"))


def page_of(rows: DataFrame, page: int, size: int, order: list) -> DataFrame:
    """S14. One page and the total, by a top-n and a row number over that top alone."""
    top = rows.orderBy(*order).limit(page * size)
    numbered = top.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > (page - 1) * size)
    return numbered.crossJoin(rows.agg(F.count("*").alias("total")))
