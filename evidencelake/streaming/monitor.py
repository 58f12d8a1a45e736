"""Living reviews as streams: new records against a baseline, running contradictions, event windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.layout import exists


def new_records(stream: DataFrame, baseline: DataFrame, key: str = "paper_id", time: str = "seen_at", late: str = "1 day") -> DataFrame:
    """Records of a stream that the baseline lacks, each key once within ``late`` of event time."""
    fresh = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return fresh.join(baseline.select(key).distinct(), key, "left_anti")


def running_contradictions(claims: DataFrame, least_ratio: float = 5.0) -> DataFrame:
    """Update mode: quantities with their papers and ratio so far. Papers are counted approximately, as state must be bounded."""
    groups = claims.groupBy("quantity", "unit").agg(F.approx_count_distinct("paper_key").alias("n_papers"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return groups.where((F.col("n_papers") >= 2) & (F.col("lo") > 0) & (F.col("hi") / F.col("lo") >= least_ratio)).withColumn("ratio", F.col("hi") / F.col("lo"))


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    s = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(s.alias("s"), by).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen(stream: DataFrame, key: str, time: str, idle: str = "1 day") -> DataFrame:
    """(key, n, first): how often each key came, as state that is dropped when a key has been idle in event time."""

    def update(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, first = state.get if state.exists else (0, None)
        for b in batches:
            n += len(b)
            earliest = b[time].min().value // 1000
            first = earliest if first is None else min(first, earliest)
        state.update((n, first))
        state.setTimeoutTimestamp(max(first // 1000, state.getCurrentWatermarkMs()) + int(pd.Timedelta(idle).total_seconds() * 1000) + 1)
        yield pd.DataFrame({key: [k[0]], "n": [n], "first": [first]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.withWatermark(time, idle).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, first long", "n long, first long", "update", GroupStateTimeout.EventTimeTimeout)


def merge_batch(path: str, key: str = "paper_id"):
    """A foreachBatch sink that appends to a Parquet baseline what it lacks: safe to replay. A null key is one of its own."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if exists(spark, path):  # the first batch finds no baseline; one that was broken off left a folder without rows
            known = spark.read.schema(batch.select(key).schema).parquet(path).select(F.col(key).alias("__known")).distinct()
            batch = batch.join(known, F.col(key).eqNullSafe(F.col("__known")), "left_anti")
        batch.dropDuplicates([key]).write.mode("append").parquet(path)

    return write
