"""Runs of named stages under a wall-clock budget. What finished stages wrote stays readable, and a later run takes it up.

The jobs of a stage carry a tag of their own; once the budget is spent a watcher interrupts that tag, again and again until the
stage has ended, so that jobs a stage starts late are stopped as well. Driver code between jobs is not interrupted.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_folder
from ..sources.layout import exists

Stage = tuple[str, Callable[[SparkSession, dict[str, DataFrame]], DataFrame]]
LEDGER = "position int, stage string, state string, n_rows long, seconds double, path string"
#: Seconds between two interrupts of a stage that is over the budget.
PAUSE = 0.1


@dataclass
class Run:
    """``outputs``: the stages that finished, in order, as written. ``ledger``: a row a stage, with the state ``done``,
    ``reused`` (found finished), ``stopped`` (interrupted) or ``left`` (never begun). ``timed_out``: the result is a partial one."""

    folder: str
    outputs: dict[str, DataFrame]
    ledger: DataFrame
    timed_out: bool


@contextmanager
def deadline(spark: SparkSession, at: float | None):
    """Interrupt what this thread runs on Spark from the monotonic time ``at`` on; yields an event that is set once that has begun.

    The watcher has ended, and the tag is gone, when the block is left, however that happens.
    """
    spent, over, tag = threading.Event(), threading.Event(), f"stage-{uuid.uuid4().hex}"
    if at is None:
        yield spent
        return

    def watch() -> None:
        wait = max(0.0, at - time.monotonic())
        while not over.wait(wait):
            spent.set()
            spark.sparkContext.cancelJobsWithTag(tag)
            wait = PAUSE

    watcher = threading.Thread(target=watch, name=tag, daemon=True)
    spark.sparkContext.addJobTag(tag)
    watcher.start()
    try:
        yield spent
    finally:
        over.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)


def run(spark: SparkSession, stages: list[Stage], budget_s: float | None = None, folder: str | None = None) -> Run:
    """Run stages in turn; each gets the outputs of those before it by name, and its frame is written as Parquet below ``folder``.

    ``folder`` must be one that all executors share; by default it is a new one below spark.checkpoint.dir. Given again, its
    finished stages are read, not run. A stage over the budget, which is one for the whole run, is interrupted, and neither it
    nor a later one has an output; without a budget nothing is. A stage that fails for another reason raises, and what was finished
    stays in the folder. A failure after the budget is spent counts as stopped. No stages give an empty ledger. Stages with equal
    names are refused, as one would take the other's output.
    """
    names = [name for name, _ in stages]
    if len(set(names)) < len(names):
        raise ValueError(f"stages need names of their own: {names}")
    folder = (folder or f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}").rstrip("/")
    at = None if budget_s is None else time.monotonic() + budget_s
    outputs: dict[str, DataFrame] = {}
    rows: list[tuple] = []
    timed_out = False
    for position, (name, stage) in enumerate(stages):
        path, begun = f"{folder}/{name}", time.monotonic()
        if not timed_out and exists(spark, f"{path}/_SUCCESS"):  # written to its end
            state = "reused"
        elif timed_out or (at is not None and begun >= at):
            timed_out, state = True, "left"
        else:
            state = "done"
            with deadline(spark, at) as spent:
                try:
                    stage(spark, dict(outputs)).write.mode("overwrite").parquet(path)
                except Exception:
                    if not spent.is_set():
                        raise
                    timed_out, state = True, "stopped"
        seconds = time.monotonic() - begun
        if state in ("done", "reused"):
            outputs[name] = spark.read.parquet(path)
        n_rows = outputs[name].count() if name in outputs else None  # from the files' footers
        rows.append((position, name, state, n_rows, seconds, path if name in outputs else None))
    return Run(folder, outputs, spark.createDataFrame(rows, LEDGER), timed_out)


def record(run_of: Run, index: str, question: str, kind: str, at: str) -> None:
    """Append a run's ledger, with its question, kind and time (UTC), to an index of runs in Parquet."""
    rows = run_of.ledger.select(F.lit(question).alias("question"), F.lit(kind).alias("kind"), F.lit(at).cast("timestamp").alias("at"), F.lit(run_of.folder).alias("folder"), F.lit(run_of.timed_out).alias("timed_out"), *run_of.ledger.columns)
    rows.coalesce(1).write.mode("append").parquet(index)


def latest(index: DataFrame, question: str = "question", at: str = "at", keys: int = 80) -> DataFrame:
    """Of runs whose question begins with the same ``keys`` characters the rows of the last, its ties all of them.

    A null question is one of its own; runs without a time come before all others. Other columns stay.
    """
    key = F.left(F.col(question), F.lit(keys))
    last = index.groupBy(key.alias("__key")).agg(F.max(at).alias("__last"))
    kept = index.withColumn("__of", key).join(last, F.col("__of").eqNullSafe(F.col("__key")) & F.col(at).eqNullSafe(F.col("__last")), "left_semi")
    return kept.drop("__of")
