"""The stance model on sentences that it has not seen, its parts against plain versions, and the blend's weights."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.operators import stance_model
from evidencelake.plans import catalog


def test_held_out_accuracy(spark):
    rows = catalog.QUERIES["stance_model"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 80 and sum(r.model_stance == r.label for r in held) >= 0.9 * len(held)
    assert sum(r.blended == r.label for r in held) >= 0.8 * len(held)


def test_training_is_repeatable_and_odd_rows(spark):
    rows = [(f"good stone {k % 7}", "supporting") for k in range(30)] + [(f"no river {k % 5}", "contrasting") for k in range(12)] + [(None, "supporting"), ("x", None), ("", "contrasting")]
    frame = spark.createDataFrame(rows, "text string, label string")
    a, b = (stance_model.train(frame.repartition(n), "text", "label") for n in (1, 5))
    assert a.classes == ["supporting", "contrasting"] and np.array_equal(a.weights, b.weights) and np.array_equal(a.sigmoid, b.sigmoid)
    got = {r.text: r.model_scores for r in stance_model.predict(frame, "text", a).collect()}
    assert got["good stone 1"]["supporting"] > 0.6 > 0.4 > got["no river 2"]["supporting"]
    assert all(abs(sum(v.values()) - 1) < 1e-9 for v in got.values()) and None in got and "" in got
    with pytest.raises(ValueError, match="two labels"):
        stance_model.train(frame.where("label = 'supporting'"), "text", "label")
    small = stance_model.train(frame, "text", "label", learn_rows=10)
    assert small.learnt_from == 20 and np.array_equal(small.idf, a.idf)


def test_margin_classifier_is_optimal():
    """The gradient of the squared-hinge objective vanishes at the weights found."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0.4, 1.0, -1.0)
    rows = [(np.arange(6), r) for r in x]
    w = stance_model.margin_classifier(rows, y, 6, epochs=2_000)
    weight = np.array([60 / (2 * (y == s).sum()) for s in y])
    slack = np.maximum(0, 1 - y * (x @ w))
    assert np.abs(w - 2 * (weight * slack * y) @ x).max() < 1e-6


def test_sigmoid_is_calibrated():
    rng = np.random.default_rng(4)
    margin = rng.normal(size=20_000) * 2
    hit = rng.random(20_000) < 1 / (1 + np.exp(-(1.7 * margin - 0.6)))
    slope, offset = stance_model.fit_sigmoid(margin, hit)
    assert abs(slope - 1.7) < 0.1 and abs(offset + 0.6) < 0.1
    assert all(np.isfinite(stance_model.fit_sigmoid(np.array([-1.0, 1.0]), np.array([False, True]))))


def test_blend(spark):
    flat = {s: 0.2 for s in stance_model.STANCES}
    rows = [
        (1, flat | {"supporting": 0.9}, "contrasting", 0.9, False, {}), (2, flat | {"supporting": 0.9}, "contrasting", 0.9, True, {}), (3, flat, "contrasting", 0.9, False, {}), (4, flat, None, None, None, {"methodology": 1.0}), (5, {}, "nonsense", 0.9, False, {}),
    ]
    frame = spark.createDataFrame(rows, "k int, m map<string,double>, s string, c double, n boolean, d map<string,double>")
    got = {r.k: (r.b.stance, round(r.b.score, 6)) for r in frame.select("k", stance_model.blended(F.col("m"), F.col("s"), F.col("c"), F.col("n"), F.col("d")).alias("b")).collect()}
    assert got == {1: ("supporting", round(0.45 + 0.3 * 0.1 / 1.3, 6)), 2: ("contrasting", round(0.06 + 0.6 * 0.9 / 1.3, 6)), 3: ("contrasting", round(0.06 + 0.5 * 0.9 / 1.3, 6)), 4: ("methodology", round(0.5 * 0.2 + 0.3 * 0.2 + 0.2, 6)), 5: ("supporting", round(0.3 * 0.2, 6))}
    text = spark.createDataFrame([("However, we used it; thus.",), ("nothing",), (None,)], "t string").select(stance_model.discourse_scores(F.col("t")).alias("d")).collect()
    assert [sorted(r.d[s] for s in stance_model.STANCES)[-3:] for r in text] == [[pytest.approx(1 / 3)] * 3, [0.0] * 3, [0.0] * 3]
    turned = {r.t: r.negated for r in stance_model.lexicon_stance(spark.createDataFrame([("this does not support it",), ("this supports it",), (None,)], "t string"), "t").collect()}
    assert turned["this supports it"] is False and turned[None] is False
