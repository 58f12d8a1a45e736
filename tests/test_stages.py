"""Stages under a budget: what is stopped, what stays readable, what is taken up again."""

from __future__ import annotations

import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidencelake.operators import stages


def slow(spark, seconds):
    @F.pandas_udf("long")
    def wait(x: pd.Series) -> pd.Series:
        time.sleep(seconds)
        return x

    return spark.range(0, 8, 1, 8).select(wait("id").alias("id"))


def small(n):
    return lambda spark, done: spark.range(n)


def after(spark, done):
    return done["first"].where("id % 2 = 0")


def states(run):
    return [(r.stage, r.state, r.n_rows) for r in run.ledger.orderBy("position").collect()]


def test_a_stage_over_the_budget_is_stopped(spark):
    before = threading.active_count()
    begun = time.monotonic()
    got = stages.run(spark, [("first", small(100)), ("slow", lambda s, done: slow(s, 60)), ("last", after)], budget_s=5)
    assert time.monotonic() - begun < 40
    assert got.timed_out and states(got) == [("first", "done", 100), ("slow", "stopped", None), ("last", "left", None)]
    assert list(got.outputs) == ["first"] and got.outputs["first"].count() == 100
    assert threading.active_count() <= before and not [t for t in threading.enumerate() if t.name.startswith("stage-")]
    assert not [t for t in spark.sparkContext.getJobTags() if t.startswith("stage-")]
    assert spark.range(10).count() == 10
    again = stages.run(spark, [("first", small(7)), ("slow", lambda s, done: s.range(3)), ("last", after)], folder=got.folder)
    assert not again.timed_out and states(again) == [("first", "reused", 100), ("slow", "done", 3), ("last", "done", 50)]


def test_jobs_begun_late_are_stopped_too(spark):
    def late(s, done):
        time.sleep(1.5)  # on the driver, where nothing can be interrupted
        return slow(s, 60)

    got = stages.run(spark, [("late", late)], budget_s=0.5)
    assert got.timed_out and states(got) == [("late", "stopped", None)]


def test_without_time_nothing_begins_and_without_budget_all_ends(spark):
    assert states(stages.run(spark, [("first", small(3))], budget_s=0)) == [("first", "left", None)]
    whole = stages.run(spark, [("first", small(3)), ("none", lambda s, done: done["first"].where("id < 0")), ("last", after)])
    assert not whole.timed_out and states(whole) == [("first", "done", 3), ("none", "done", 0), ("last", "done", 2)]
    assert stages.run(spark, []).ledger.count() == 0


def test_other_failures_raise(spark):
    def fails(s, done):
        return s.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x"))

    with pytest.raises(Exception, match="no"):
        stages.run(spark, [("first", small(3)), ("fails", fails)], budget_s=60)
    assert not [t for t in threading.enumerate() if t.name.startswith("stage-")]
    with pytest.raises(ValueError, match="names"):
        stages.run(spark, [("a", small(1)), ("a", small(2))])


def test_index_of_runs(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    long = "q" * 90
    for question, at, n in (("a", "2024-01-01", 1), ("a", "2024-02-01", 2), (long, "2024-01-01", 3), (long + "other end", "2024-03-01", 4), ("b", "2024-01-01", 5)):
        stages.record(stages.run(spark, [("first", small(n))]), path, question, "review", f"{at} 00:00:00")
    index = spark.read.parquet(path)
    assert index.count() == 5
    assert sorted(r.n_rows for r in stages.latest(index).collect()) == [2, 4, 5]
    odd = spark.createDataFrame([(None, None, 1), (None, None, 2), ("x", None, 3), ("x", "2024", 4)], "question string, at string, n int")
    assert sorted(r.n for r in stages.latest(odd).collect()) == [1, 2, 4] and stages.latest(odd.limit(0)).count() == 0
