"""Queries without SQL against brute force over the whole small tables, and no query that reads part of its tables."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from pathlib import Path

import pandas as pd
import pytest

from evidencelake.functions import text as X
from evidencelake.operators import clustering, records
from evidencelake.plans import catalog

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")


def read(name):
    return pd.read_parquet(SMALL / f"{name}.parquet")


def said():
    out = defaultdict(dict)
    for r in read("conversations").itertuples():
        out[r.conv_id][f"{r.conv_id}/{r.turn:010d}"] = (set(re.findall("[a-z]+", (r.text or "").lower())), float(r.turn % 7))
    return out


def leaders_of(items, least=0.1):
    leader = {}
    for i in sorted(items):
        fits = []
        for j in leader:
            a, b = items[i][0], items[j][0]
            if leader[j] == j and a & b and len(a & b) / len(a | b) >= least:
                fits.append((-len(a & b) / len(a | b), j))
        leader[i] = min(fits)[1] if fits else i
    return leader


def test_leader_clusters(spark):
    want = {i: j for items in said().values() for i, j in leaders_of(items).items()}
    got = {r.id: r.leader for r in catalog.QUERIES["leader_clusters"](spark, str(SMALL)).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_agreement_groups(spark):
    want = {}
    for items in said().values():
        groups = defaultdict(list)
        for i, j in leaders_of(items).items():
            groups[j].append(items[i][1])
        for j, values in groups.items():
            mean = sum(values) / len(values)
            gap = (max(values) - min(values)) / abs(mean) if mean else 0.0
            want[j] = (len(values), round(gap, 9), gap > 0.2)
    got = {r.leader: (r.n, round(r.gap, 9), r.contrast) for r in catalog.QUERIES["agreement_groups"](spark, str(SMALL)).collect()}
    assert got == want


def test_best_sentences(spark):
    items = read("benchmark")
    claims = dict(zip(items["item_id"], items["text"]))

    def content(s):
        return {w for w in re.findall("[a-z]+", s.lower()) if len(w) > 2 and w not in X.STOP_WORDS}

    def best(text, claim):
        cut = [s.strip(" ") for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z])", text or "")]
        long = [s for s in cut if len(s) > 30]
        if not long:
            return (text or "")[:500]
        c = content(claim)
        scores = [len(c & content(s)) / len(c | content(s)) if c | content(s) else 0.0 for s in long]
        return long[scores.index(max(scores))][:500]

    want = {r.doc_id: (r.doc_id % len(claims), best(r.text, claims[r.doc_id % len(claims)])) for r in read("documents").itertuples() if r.doc_id % len(claims) in claims}
    got = {r.doc_id: (r.item_id, r.sentence) for r in catalog.QUERIES["best_sentences"](spark, str(SMALL)).collect()}
    assert got == want


def test_contained_equals_pairs(spark):
    texts = [(1, ["a", "b"]), (2, []), (3, ["c"]), (4, None), (5, ["a", "c", "d"])]
    claims = [(1, ["a", "c"]), (2, []), (3, None), (4, ["z"])]
    t, c = spark.createDataFrame(texts, "text_id int, tokens array<string>"), spark.createDataFrame(claims, "claim_id int, tokens array<string>")
    want = {(i, j, len(set(x) & set(y)) / len(y)) for i, x in texts for j, y in claims if x and y and set(x) & set(y)}
    assert {tuple(r) for r in clustering.contained(t, c, 0.1).collect()} == want
    assert {tuple(r) for r in clustering.contained(t, c, 0.6).collect()} == {x for x in want if x[2] >= 0.6}


def test_vector_pairs_equal_products(spark):
    rows = [(1, "x", 0.6), (1, "y", 0.8), (2, "y", 1.0), (3, "z", 1.0), (4, "x", 0.8), (4, "z", 0.6)]
    got = {(r.a, r.b): round(r.score, 9) for r in clustering.vector_pairs(spark.createDataFrame(rows, "id int, term string, weight double"), 0.5).collect()}
    assert got == {(1, 2): 0.8, (3, 4): 0.6}


def test_local_match_equals_pairs(spark):
    rng = random.Random(4)
    title = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 6)))
    p = [(k, rng.choice([None, None, "10.1/A", "10.1/b"]), rng.choice([None, title(), title(), title()])) for k in range(60)]
    f = [(k, rng.choice([None, "10.1/a"]) if k < 3 else None, rng.choice([None, title(), title(), title()])) for k in range(50)]

    def tokens(s):
        return set((s or "").split())

    for least in (0.5, 0.6, 1.0):
        want = {}
        for k, doi, s in p:
            same = [i for i, d, _ in f if d and doi and d.lower() == doi.lower()]
            near = [(-len(tokens(s) & tokens(x)) / len(tokens(s) | tokens(x)), i) for i, _, x in f if tokens(s) & tokens(x)]
            near = [x for x in near if -x[0] >= least]
            if same or near:
                want[k] = (min(same), 1.0) if same else (min(near)[1], -min(near)[0])
        schema = "{} int, doi string, title string"
        got = records.local_match(spark.createDataFrame(p, schema.format("paper_id")), spark.createDataFrame(f, schema.format("file_id")), least)
        assert {r.paper_id: (r.file_id, r.score) for r in got.collect()} == want


def test_graph_communities_cover_all_nations(spark):
    got = catalog.QUERIES["graph_communities"](spark, str(SMALL)).collect()
    assert sorted(r.id for r in got) == sorted(read("nation")["n_nationkey"]) and all(r.betweenness >= 0 for r in got)


def test_no_query_reads_an_id_subset():
    root = Path(catalog.__file__).parent
    for path in root.glob("*.py"):
        for line in path.read_text().splitlines():
            assert not re.search(r"""\"(lineitem|documents|benchmark|conversations)\"\)\.(where|limit|sample)\([^)]*(%|_id <)""", line), (path.name, line[:120])
