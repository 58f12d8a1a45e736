"""The network learns from the training documents of every share."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import lm
from evidencelake.llm.scratch import Scratch


@pytest.mark.parametrize("share", range(lm.SHARES))
def test_each_share_is_trained_on(spark, share):
    texts = spark.range(400).select("id", F.concat_ws(" ", F.lit("one two three four five six"), F.col("id").cast("string")).alias("text"))
    docs = texts.where(F.pmod(F.xxhash64(F.xxhash64(F.col("id").cast("string"), "text")), F.lit(lm.SHARES)) == share)
    v, _ = lm.count_words(spark, docs, "text", Scratch(spark, "test"))
    start, p = lm.initial(v), lm.train(docs, "id", "text", v)
    assert any(not np.array_equal(start[k], p[k]) for k in p)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Rows dealt to 4 or 7 partitions, several shards a share: the same model and scores."""
    import random

    monkeypatch.setattr(lm, "SHARD_TOKENS", 1500)
    r = random.Random(1)
    rows = [(k, " ".join(f"w{int(r.expovariate(0.1))}" for _ in range(r.randint(0, 120)))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = ({x.doc_id: x.score for x in lm.score(spark, docs.repartition(n)).withColumnRenamed("id", "doc_id").collect()} for n in (4, 7))
    assert len(one) == 400 and all(math.isclose(one[k], other[k], rel_tol=1e-5) for k in one)


def test_every_token_is_trained_on(monkeypatch):
    """A stream whose length is no multiple of its lanes: the last lane is filled up, nothing is cut."""
    seen = []

    def recorded(p, v, before, after, fresh, h):
        seen.extend(after.ravel().tolist())
        return {k: np.zeros_like(x) for k, x in p.items()}, h, 0.0

    monkeypatch.setattr(lm, "gradients", recorded)
    counts = np.ones(2000, dtype=np.int64)
    v = lm.Vocabulary(np.arange(2000, dtype=np.uint64), counts, np.arange(2000), np.ones(lm.SURFACES), counts, 1, 2001, 2001)
    p = lm.initial(v)
    lm.train_on(p, v, lm.Adam(p, 0.01), np.arange(1999), np.array([0, 700, 1999]))
    assert set(seen) == set(range(1999))


def test_top_grows_with_the_vocabulary():
    assert lm.top_words(10) == lm.TOP and lm.top_words(9_000_000) == 3000
    for n in (10, 1024, 3000):
        counts = np.arange(n, 0, -1)
        v = lm.Vocabulary(np.arange(n, dtype=np.uint64), counts, np.arange(n), np.ones(lm.SURFACES), counts, 1, int(counts.sum()) + 1, n + 1)
        p = lm.initial(v)
        ids = np.arange(len(counts) + lm.SURFACES + 1)
        hidden = np.zeros((len(ids), lm.HIDDEN), dtype=np.float32)
        assert math.isclose(np.exp(lm.log_probabilities(p, v, hidden, ids)).sum(), 1, rel_tol=1e-3)
