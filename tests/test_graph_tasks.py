"""More edges make more tasks, not larger ones, and the same rows."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from evidencelake.operators import graph
from evidencelake.sources import layout

_RNG = random.Random(5)
#: Papers by their references: one that all have, some of a few, none, null.
CITING = [(k, [0, *(_RNG.randint(1, 12) for _ in range(_RNG.randint(0, 6)))]) for k in range(40)] + [(40, []), (41, None)]


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(layout, "TASK_ROWS", 10)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_coupling_pairs_in_small_tasks(spark, small_tasks, chunk):
    want = Counter()
    for (a, x), (b, y) in combinations(CITING, 2):
        want[a, b] = len(set(x or []) & set(y or []))
    out = graph.coupling_pairs(spark.createDataFrame(CITING, "id int, refs array<int>"), "id", "refs", 2, chunk)
    assert {(r.a, r.b): r.shared for r in out.collect()} == {k: n for k, n in want.items() if n >= 2}
    assert out.rdd.getNumPartitions() > 4 and "hashpartitioning(a" in plan(out) and ", b#" not in plan(out).split("hashpartitioning(a")[1].split(")")[0]


def test_cocitation_in_small_tasks(spark, small_tasks):
    rows = [(k, [j % 42 for j in (x or [])] + [j % 42 for j in (x or [])][:1]) for k, x in CITING]
    want = Counter()
    for by, x in rows:
        inside = [j for j in x if j != by]
        for j in inside:
            want[j] += len(inside) - 1
    top = max(want.values())
    out = graph.cocitation_scores(spark.createDataFrame(rows, "id int, refs array<int>"), "id", "refs")
    assert {r.id: round(r.cocitation, 9) for r in out.collect()} == {k: round(want[k] / top, 9) for k, _ in rows}
    assert len(set(map(int, re.findall(r"hashpartitioning\(by#\d+, (\d+)\)", plan(out)))) - {4}) == 1


@pytest.mark.parametrize("kind", ["int", "string"])
def test_components_move_each_edge_a_few_times(spark, monkeypatch, kind):
    """A chain in order of its keys, a star around its greatest key, a ring, loops and nulls."""
    n = 600
    edges = [(k, k + 1) for k in range(n)] + [(9000, 1000 + k) for k in range(50)] + [(2000 + k, 2000 + (k + 1) % 7) for k in range(7)] + [(3000, 3000), (2000, None), (None, None)]
    want = {k: 0 for k in range(n + 1)} | {k: 1000 for k in [9000, *range(1000, 1050)]} | {k: 2000 for k in range(2000, 2007)} | {3000: 3000}
    name = (lambda k: k) if kind == "int" else (lambda k: k if k is None else f"{k:05d}")
    kept, keep = [], graph.Scratch.keep
    monkeypatch.setattr(graph.Scratch, "keep", lambda self, frame, label: (kept.append((label, out := keep(self, frame, label), out.count())), out)[1])
    rows = graph.components(spark, spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"src {kind}, dst {kind}")).collect()
    assert {r.node: r.component for r in rows} == {name(k): name(c) for k, c in want.items()} and len(rows) == len(want)
    moved = [n for label, _, n in kept if label.startswith("edges")]
    assert len(moved) > 1 and sum(moved) < 5 * len(edges) and len(moved) < 40


def test_pagerank_sorts_nodes_and_not_edges(spark, small_tasks, monkeypatch):
    """Edges are kept as short lists; ranks are those of the power method."""
    rows = [(k, [j % 43 for j in (x or [])] + [7, 7]) for k, x in CITING]
    ids = {k for k, _ in rows}
    near = {k: {j for j in x if j != k and j in ids} for k, x in rows}
    want = {k: 1 / len(ids) for k in ids}
    for _ in range(200):
        idle = sum(want[k] for k in ids if not near[k])
        want = {k: 0.15 / len(ids) + 0.85 * (idle / len(ids) + sum(want[j] / len(near[j]) for j in ids if k in near[j])) for k in ids}
    kept, keep = {}, graph.Scratch.keep
    monkeypatch.setattr(graph.Scratch, "keep", lambda self, frame, label: kept.setdefault(label, keep(self, frame, label)))
    papers = spark.createDataFrame(rows, "id int, refs array<int>")
    got = graph.pagerank(spark, papers.select("id"), graph.corpus_edges(papers, "id", "refs"), tolerance=1e-12, chunk=3)
    assert {r.id: r.rank for r in got.collect()} == pytest.approx(want, abs=1e-9)
    lists = [r.dsts for r in kept["shares"].collect()]
    assert sum(map(len, lists)) == sum(map(len, near.values())) and max(map(len, lists)) == 3
