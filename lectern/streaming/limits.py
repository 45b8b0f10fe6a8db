"""Stateful operators over a request log: batch replays, and the same as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def token_bucket(log: DataFrame, rate: float, burst: float) -> DataFrame:
    """(event_id, allowed): an ordered fold per namespace and user; state is (tokens, last time). Rows pass in order,
    batch by batch, so that a user's log is never gathered, however long it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = None, burst, 0
        for batch in batches:
            allowed = []
            for now, t in zip(zip(batch["namespace"], batch["user_id"]), batch["t"].tolist()):
                if now != key:
                    key, tokens, last = now, burst, t
                tokens = min(burst, tokens + (t - last) / 1e6 * rate)
                allowed.append(tokens >= 1)
                tokens, last = tokens - allowed[-1], t
            yield pd.DataFrame({"event_id": batch["event_id"], "allowed": allowed})

    keyed = log.select("namespace", F.col("user_id").cast("string").alias("user_id"), "event_id", micros().alias("t"))
    ordered = keyed.repartition("namespace", "user_id").sortWithinPartitions("namespace", "user_id", "t", "event_id")
    return ordered.mapInPandas(run, "event_id long, allowed boolean")


def local(ts: Column | str, hours: int = -4) -> Column:
    """A UTC time without zone as the clock of a fixed offset shows it."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz") + F.expr(f"interval {hours} hours")


def fresh(ts: Column | str, now: Column) -> Column:
    """Whether a cached answer is of the month of `now`, months changing at midnight of UTC-4."""
    return local(ts) >= F.date_trunc("month", local(now))


def negative_expiry(ts: Column | str) -> Column:
    """When a confirmed negative ends: the next Monday or first of a month after it, at midnight of UTC-4, as UTC."""
    day = local(ts).cast("date")
    ends = F.least(F.next_day(day, "Mon"), F.add_months(F.trunc(day, "month"), 1))
    return ends.cast("timestamp_ntz") + F.expr("interval 4 hours")


def sessions(log: DataFrame, gap: str) -> DataFrame:
    return log.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "n")


def windowed(log: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts by namespace and window; the same plan for a stream, with a watermark."""
    if late:
        log = log.withWatermark("ts", late)
    return log.groupBy("namespace", F.window("ts", size, slide or size).alias("w")).agg(F.count("*").alias("n")).select("namespace", "w.start", "n")


def negative_runs(log: DataFrame, confirmations: int = 3) -> DataFrame:
    """(event_id, streak, confirmed): negatives in a row per namespace and user; a positive starts anew."""
    order = W.partitionBy("namespace", "user_id").orderBy("ts", "event_id")
    island = F.sum(F.col("ok").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = log.withColumn("island", island)
    streak = F.sum((~F.col("ok")).cast("int")).over(W.partitionBy("namespace", "user_id", "island").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return marked.select("event_id", streak.alias("streak")).withColumn("confirmed", F.col("streak") >= confirmations)
