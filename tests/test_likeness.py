"""Likeness to a query and inverted abstracts against plain Python, on odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter

from evidencelake.operators import ranking
from evidencelake.plans import text_queries


def test_likeness_of_odd_rows_writes_no_terms(spark, monkeypatch):
    def no_table(*_):
        raise AssertionError("terms were written")

    monkeypatch.setattr(ranking, "Scratch", no_table, raising=False)
    rows = [(1, "red fox", "a fox and a hen"), (2, "hen house", None), (2, "red red barn", "barn"), (None, "red fox", "fox"), (3, None, ""), (4, "blue sky", "sky over barn")]
    got = {r.id: r.semantic for r in ranking.query_likeness(spark.createDataFrame(rows, "paper_id long, title string, abstract string"), "Red fox fox").collect()}

    def grams(t: str) -> list[str]:
        w = re.findall("[a-z0-9_]{2,}", t.lower())
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    docs: dict[object, Counter] = {}
    for k, title, abstract in [*rows, ("q", "Red fox fox", None)]:
        docs.setdefault(k, Counter()).update(grams(f"{title or ''} {abstract or ''}"))
    n, df = len(docs), Counter(t for c in docs.values() for t in c)
    raw = {k: {t: (1 + math.log(f)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, f in c.items() if df[t] <= 0.95 * n} for k, c in docs.items()}
    unit = {k: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()} for k, v in raw.items()}
    want = {str(k): sum(x * unit["q"].get(t, 0) for t, x in unit[k].items()) for k in (1, 2, 3, 4)} | {None: 0.0}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_inverted_abstracts_keep_every_row_and_shuffle_none(spark, monkeypatch):
    rows = [(1, "b a  b\nc a b"), (2, ""), (3, None), (4, " \n "), (5, "one")]
    monkeypatch.setattr(text_queries, "table", lambda *_: spark.createDataFrame(rows, "doc_id long, text string"))
    out = text_queries.inverted_abstracts(spark, "")
    assert {r.doc_id: r.abstract for r in out.collect()} == {1: "b a b c a b", 2: "", 3: None, 4: "", 5: "one"}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
