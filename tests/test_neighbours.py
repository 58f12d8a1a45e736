"""Nearest neighbours against all pairs: every one is found."""

from __future__ import annotations

import numpy as np
import pytest

from evidencelake.operators import neighbours
from tests.test_density import vectors


def plain(rows: list[tuple], asked: list[tuple], k: int, least: float | None) -> dict:
    ok = lambda v: bool(v) and all(x is not None and x == x for x in v) and any(v)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    good = [(i, unit(v)) for i, v in rows if i is not None and ok(v)]
    out = {}
    for q, v in asked:
        if q is not None and ok(v):
            near = sorted((-round(float(unit(v) @ x), 9), i) for i, x in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in near if least is None or -s >= least]
    return out


@pytest.mark.parametrize(("k", "least", "block"), [(5, None, 16), (3, 0.8, 16), (400, None, 64), (4, None, 512)])
def test_nearest(spark, k, least, block):
    rows = vectors(11, 200)
    asked = [r for r in rows if r[0] is None or r[0] % 10 == 0] + [(9_999, [0.5] * 8), (9_998, None)]
    frame = lambda x: spark.createDataFrame([(*r, "x") for r in x], "id long, v array<double>, node string").repartition(3)
    got: dict = {}
    for r in neighbours.nearest(spark, frame(rows), frame(asked), "id", "v", k, least, block).collect():
        got.setdefault(r.query, []).append((r.rank, r.neighbour, round(r.cosine, 9)))
    for q, want in plain(rows, asked, k, least).items():
        mine = sorted(got.pop(q, []))
        assert [r for r, *_ in mine] == list(range(1, len(want) + 1)) and [s for *_, s in mine] == pytest.approx([s for _, s in want])
        assert {i for _, i, s in mine if s > mine[-1][2] + 1e-8} == {i for i, s in want if s > want[-1][1] + 1e-8}
    assert not got


def test_nothing_to_find(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert neighbours.nearest(spark, frame.limit(0), frame, "id", "v").count() == 0
    assert neighbours.nearest(spark, frame, frame.limit(0), "id", "v").count() == 0
    assert [(r.query, r.neighbour) for r in neighbours.nearest(spark, frame.where("id = 1"), frame, "id", "v").collect()] == [(2, 1)]


def test_expand_terms(spark):
    terms = [(1, "granite", [1.0, 0.1, 0.0]), (2, "granodiorite", [1.0, 0.2, 0.0]), (3, "law", [0.0, 0.0, 1.0]), (4, "tonalite", [0.9, 0.3, 0.1]), (5, "void", None)]
    table = spark.createDataFrame(terms, "term_id long, term string, vector array<double>")
    asked = spark.createDataFrame([("granite",), ("law",), ("void",), ("unknown",), (None,)], "term string")
    assert [(r.term, r.added, r["rank"]) for r in neighbours.expand_terms(spark, table, asked, 2, 0.9).orderBy("rank").collect()] == [("granite", "granodiorite", 1), ("granite", "tonalite", 2)]
