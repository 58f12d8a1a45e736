"""Near copies at a Jaccard index of 0.8 or more, against all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as pipeline
from evidencelake.llm import simhash, simwide

COLUMNS = "doc_id long, text string"


def shingles(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(r: random.Random, text: str, edits: int) -> str:
    words = text.split()
    for at in r.sample(range(len(words)), edits):
        words[at] = f"edit{r.random():.9f}"
    return " ".join(words)


def partition(texts: list[str | None]) -> set[frozenset]:
    """Groups of row numbers joined by pairs alike in 0.8 of their shingles."""
    sets, of = [shingles(t) for t in texts], list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if of[a] != of[b] and jaccard(sets[a], sets[b]) >= 0.8:
            of = [of[a] if x == of[b] else x for x in of]
    return {frozenset(k for k, x in enumerate(of) if x == root) for root in of}


def corpus() -> list[str | None]:
    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    texts: list[str | None] = [None, "", " \n", "one two", "One  two", "one two three four five", "one two three four six"]
    for n, most in ((100, 2), (200, 4), (400, 8)):  # within 0.8 to 0.95, and beyond
        for edits in (1, 2, most, most + 1, 2 * most, 4 * most):
            for _ in range(4):
                base = prose(n)
                texts += [base, edited(r, base, edits)]
    chain = [prose(200)]
    for _ in range(25):
        chain.append(edited(r, chain[-1], 4))
    hub = prose(150)
    return texts + chain + [edited(r, hub, r.randint(1, 3)) for _ in range(60)]  # more than a small bucket holds


def groups(found) -> set[frozenset]:
    of: dict[int, set[int]] = {}
    for row in found:
        of.setdefault(row.root, set()).add(row.id)
    return set(map(frozenset, of.values()))


@pytest.mark.parametrize("block", [simwide.BLOCK, 16])
def test_near_copies_against_all_pairs(spark, block):
    """No link that all pairs do not give; nearly all that they give, and all between sets alike in 0.88 or more."""
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), COLUMNS).repartition(5)
    got, want = groups(simwide.near_copies(spark, docs, block=block).collect()), partition(texts)
    assert all(any(g <= w for w in want) for g in got)
    joined = lambda parts: sum(len(p) - 1 for p in parts)
    assert joined(got) >= 0.95 * joined(want)
    sets, of = [shingles(t) for t in texts], {k: g for g in got for k in g}
    assert all(b in of[a] for a, b in combinations(range(len(texts)), 2) if jaccard(sets[a], sets[b]) >= 0.88)


def test_recall_at_the_least_likeness(spark):
    """Pairs alike in 0.8 to 0.84, the hardest: 0.9 of them at least are found; pairs alike in 0.7 to 0.79 are not links."""
    r, rows, want = random.Random(12), [], {}
    while len(want) < 300:
        base = " ".join(f"w{r.randrange(3000)}" for _ in range(220))
        copy = edited(r, base, r.randint(4, 7))
        like = jaccard(shingles(base), shingles(copy))
        if 0.7 <= like <= 0.84:
            want[len(rows)] = like >= 0.8
            rows += [(len(rows), base), (len(rows) + 1, copy)]
    got = groups(simwide.near_copies(spark, spark.createDataFrame(rows, COLUMNS)).collect())
    found = {k: frozenset((k, k + 1)) in got for k in want}
    assert not any(found[k] for k in want if not want[k])
    assert sum(found.values()) >= 0.9 * sum(want.values()) > 50


def test_large_group_of_near_copies(spark):
    """A group far larger than a small bucket is one component, and its links grow with its size."""
    r = random.Random(2)
    base = " ".join(f"w{r.randrange(3000)}" for _ in range(200))
    docs = spark.createDataFrame([(k, edited(r, base, r.randint(0, 3))) for k in range(1500)] + [(2000 + k, " ".join(f"w{r.randrange(3000)}" for _ in range(200))) for k in range(500)], COLUMNS)
    assert sorted(map(len, groups(simwide.near_copies(spark, docs).collect()))) == [1] * 500 + [1500]


def test_thresholds_meet_all_within_the_budget():
    """Whatever the costs: two fingerprints that differ in fewer bits than the budget meet in a partition."""
    rng = np.random.default_rng(3)
    t = simhash.allocate(rng.random((6, 2, 50)) * 100, 6)
    assert ((t + 1).sum(axis=0) == 6).all()


def test_pipeline_drops_near_copies(spark):
    """Planted copies at 0.8 to 0.95 go, each to its original; less alike ones stay."""
    r = random.Random(4)
    rows, gone = [], set()
    for k, (n, edits) in enumerate([(100, 2), (200, 1), (200, 2), (200, 3), (200, 4), (400, 4), (400, 6), (400, 8)] * 4 + [(200, 12), (400, 30)] * 4):
        base = " ".join(f"w{r.randrange(3000)}" for _ in range(n))
        copy = edited(r, base, edits)
        like = jaccard(shingles(base), shingles(copy))
        rows += [(2 * k, base), (2 * k + 1, copy)]
        if like >= 0.8:
            gone.add(2 * k + 1)
    assert len(gone) >= 28
    kept = {x.doc_id for x in pipeline.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    assert {i for i, _ in rows} - kept <= gone and len(kept & gone) <= 0.1 * len(gone)


def test_empty(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert simwide.near_copies(spark, empty).count() == 0 and simwide.keep_one(spark, empty).count() == 0


def test_rows_without_own_id_stay(spark):
    """Unrelated texts that share an id, or have none, are each kept; copies of them are not."""
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(80)) for _ in range(9)]
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:8]] + [(8, texts[8]), (None, texts[8]), (None, texts[0]), (7, texts[4]), (9, texts[5])]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    want = sorted([(-1, t) for t in texts[:4]] + [(7, t) for t in texts[4:8]] + [(8, texts[8])])
    for keep_one in (simhash.keep_one, simwide.keep_one):
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.text) for x in keep_one(spark, docs).collect()) == want
