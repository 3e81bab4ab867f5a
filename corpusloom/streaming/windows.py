"""Windowed aggregates over job events; each works on a batch and on a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LATE = "1 hour"


def throughput(events: DataFrame, size: str = "1 day") -> DataFrame:
    """(window_start, event_type, n) per tumbling window."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n")


def failure_windows(events: DataFrame, size: str = "10 minutes", slide: str | None = None, share: float = 0.5) -> DataFrame:
    """(window_start, failed, completed, hot): whether failures pass their share of the window."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    failed, done = F.count_if(F.col("event_type") == "stage.failed"), F.count_if(F.col("event_type") == "stage.completed")
    g = e.groupBy(F.window("ts", size, slide or size).alias("w")).agg(failed.alias("failed"), done.alias("completed"))
    return g.select(F.col("w.start").alias("window_start"), "failed", "completed", (F.col("failed") > share * (F.col("failed") + F.col("completed"))).alias("hot"))


def alert_states(windows: DataFrame, hold: dict[str, int], step: str) -> DataFrame:
    """The batch twin of the stream's alert states: windows (rule, w, bad, good, hot) with the state of their rule.

    Windows of a rule are one row per time step, few beside the events.
    """
    rule = Window.partitionBy("rule").orderBy("w.start")
    step_us = int(pd.Timedelta(step).total_seconds() * 1_000_000)
    us = F.unix_micros(F.col("w.start"))
    w = windows.withColumn("us", us)
    goes_on = F.col("hot") & F.coalesce(F.lag("hot").over(rule) & (F.lag("us").over(rule) == F.col("us") - step_us), F.lit(False))
    w = w.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(rule))
    needed = F.element_at(F.create_map(*[F.lit(x) for kv in hold.items() for x in kv]), F.col("rule"))
    fires = F.col("hot") & (F.row_number().over(Window.partitionBy("rule", "run").orderBy("us")) >= needed)
    w = w.withColumn("fires", fires).withColumn("before", F.coalesce(F.lag("fires").over(rule), F.lit(False)))
    state = F.when(F.col("fires"), "firing").when(F.col("hot"), "pending").when(F.col("before"), "resolved").otherwise("inactive")
    return w.select("rule", F.col("us").alias("window_us"), "bad", "good", "hot", state.alias("state"))


def late_events(events: DataFrame, late: str = LATE) -> DataFrame:
    """(event_type, n) of a table's events that came more than `late` behind the newest event before them, by event_id as the order of arrival.

    A stream drops such events from its windows; the count says how many a batch run has to add.  Newest times run up
    within blocks of arrival first, and over the blocks then.
    """
    e = events.select("event_type", "event_id", "ts", F.floor(F.col("event_id") / 10_000).alias("block"))
    blocks = e.groupBy("block").agg(F.max("ts").alias("newest"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.max("newest").over(earlier).alias("before"))
    inside = Window.partitionBy("block").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("seen", F.max("ts").over(inside)).join(blocks, "block")
    behind = F.col("ts") < F.greatest("seen", "before") - F.expr(f"INTERVAL {late}")
    return e.filter(behind).groupBy("event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """(job_id, session_start, session_end, n): activity without a gap."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    g = e.groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("job_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def progress(events: DataFrame, life: str = "1 day") -> DataFrame:
    """(job_id, day, done, total, percent) of chunk progress in each `life` of a job, which is forgotten after it; in update mode on a stream."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    done = F.count_if(F.col("event_type") == "stage.completed")
    g = e.groupBy("job_id", F.window("ts", life).alias("w")).agg(done.alias("done"), F.count("*").alias("total"))
    g = g.select("job_id", F.col("w.start").alias("day"), "done", "total")
    return g.withColumn("percent", (F.lit(60) + F.floor(F.lit(19) * F.col("done") / F.greatest("total", F.lit(1)))).cast("long"))


def first_deliveries(events: DataFrame, keys: list[str], within: str = "24 hours") -> DataFrame:
    """Each key once within the time of its first delivery."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)
