"""What one task holds."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

from evidencelake.operators import integrity, vocabulary


def test_texts_are_scored_one_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(["a word " * 20_000] * 200)], names=["id", "text"])
    run = vocabulary._scorer(SimpleNamespace(value=[("word", "x", 1.0)]))
    tracemalloc.start()
    out = next(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 200 and out["score"][7].as_py() == 20_000 and peak < 4_000_000


def test_adjudications_copy_no_rows_for_distinct_counts(spark):
    made = spark.createDataFrame([("d1", "s", "full_text", "human", "a", "include"), ("d2", "s", "full_text", "human", "b", "include"), ("d3", "s", "full_text", "human", "b", "exclude")], "decision_id string, source_id string, stage string, origin string, actor_id string, decision string")
    t = spark.createDataFrame([("x", "s", "full_text", ["d1", "d2"], "consensus", "include", None), ("y", "s", "full_text", ["d2", "d3"], "consensus", "include", None)], "adjudication_id string, source_id string, stage string, decision_ids array<string>, status string, final_decision string, adjudicator_id string")
    out = integrity.adjudications(t, made)
    assert {(r.rule, r.key) for r in out.collect()} == {("two adjudications of one stage", "s|full_text"), ("one person", "y"), ("consensus does not fit", "y")}
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
