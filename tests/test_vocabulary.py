"""Vocabulary counts against str.count, in one slice and in many."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidencelake.operators import vocabulary


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="ab é", min_size=1, max_size=4), min_size=1), st.text(alphabet="ab é", max_size=60))
def test_counts(terms, text):
    words = sorted(terms)
    got = vocabulary.term_counts(vocabulary.automaton(words), [len(w) for w in words], text)
    assert {words[k]: n for k, n in got.items()} == {w: text.count(w) for w in words if w in text}


def words() -> list[tuple]:
    r = random.Random(2)
    terms = sorted({"".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(400)})
    rows = [(r.choice(["geology", "physics", "law", None]), t.upper() if r.random() < 0.2 else t, r.choice([1.0, 0.5, 2.0]), k % 5) for k, t in enumerate(terms)]
    return rows + [("geology", terms[0], 1.0, 0), ("law", terms[0], 1.0, 3), ("law", "", 9.0, 1), ("law", None, 9.0, 1), ("minus", "a", -0.5, 9), ("physics", "b", None, 0)]


@pytest.mark.parametrize("limits", [{}, {"most_terms": 37}, {"most_chars": 100}])
def test_scores_and_best(spark, limits):
    r = random.Random(3)
    docs = [(k, "".join(r.choice("abcdéABx ") for _ in range(r.randint(0, 200)))) for k in range(60)] + [(60, None), (61, ""), (62, "ab" * 30_000), (None, "abcd"), (3, "another row of the same id abc")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, body string, label string, score int").repartition(3)
    v = words()
    want: dict = defaultdict(float)
    for i, t in docs:
        for label, w, weight, _ in v:
            if w:
                want[(i, label)] += (t or "").lower().count(w.lower()) * (weight or 0.0)
    table = spark.createDataFrame(v, "label string, word string, weight double, position int")
    got = {(x.id, x.label): x.score for x in vocabulary.label_scores(frame, "doc_id", F.col("body"), table, **limits).collect()}
    assert got == {k: s for k, s in want.items() if s}
    place: dict = {}
    for label, _, _, p in v:
        place[label] = min(p, place.get(label, p))
    best = Counter()
    for i in {i for i, _ in docs}:
        mine = sorted((-want[(i, label)], place[label], label is not None, label or "") for label in place if want[(i, label)] > 0)
        best[(i, *((mine[0][3] if mine[0][2] else None, -mine[0][0]) if mine else ("general", 0.0)))] += 1
    assert Counter(map(tuple, vocabulary.best_labels(frame, "doc_id", F.col("body"), table, **limits).collect())) == best


def test_empty_and_too_long(spark):
    frame = spark.createDataFrame([(1, "abc")], "doc_id long, body string")
    none = spark.createDataFrame([], "label string, word string, weight double, position int")
    assert [tuple(r) for r in vocabulary.best_labels(frame, "doc_id", F.col("body"), none).collect()] == [(1, "general", 0.0)]
    one = spark.createDataFrame([("a", "abc", 1.0, 1)], none.schema)
    assert vocabulary.best_labels(frame.limit(0), "doc_id", F.col("body"), one).count() == 0
    with pytest.raises(ValueError, match="longer"):
        vocabulary.label_scores(frame, "doc_id", F.col("body"), one, most_chars=2)
