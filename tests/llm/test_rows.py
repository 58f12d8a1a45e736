"""Rows without an id, rows that share one, and repeated rows dealt over many batches: each is judged by itself."""

from __future__ import annotations

import random

import pytest
import xxhash

from evidencelake.llm import decontamination, lm, substrings
from tests.llm import brute

ITEM = "which of these benchmark words stand together in exactly this order of twelve"


@pytest.mark.parametrize("windows", [decontamination.BROADCAST_WINDOWS, 0])
def test_clean_documents_without_ids(spark, windows):
    rows = [(None, f"bad {ITEM} bad"), *((None, f"clean text number {k}") for k in range(5)), (None, None), (1, "clean with an id"), (2, f"{ITEM}"), (2, "same id, clean"), (2, "same id, clean"), (None, f"bad {ITEM} bad")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __row string").repartition(3)
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = decontamination.clean_documents(spark, docs, items, broadcast_windows=windows)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted((r for r in rows if ITEM not in (r[1] or "")), key=repr)


def test_texts_whose_hashes_agree_in_part(spark):
    """Two rows without an id whose text hashes agree in 32 bits: only the one with the shared window loses words."""
    r = random.Random(1)
    passage = " ".join(f"p{r.randrange(50)}" for _ in range(55))
    seen, pair = {}, None
    for k in range(400_000):
        text = f"{passage} tail{k}" if k % 2 else f"own{k} " + " ".join(f"q{j}" for j in range(55))
        low = xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFFFF
        other = seen.setdefault(low, text)
        if other.startswith("own") != text.startswith("own"):
            pair = sorted((other, text))
            break
    assert pair is not None
    rows = [(1, passage), (None, pair[0]), (None, pair[1])]
    want = brute.passages(rows)
    for x in substrings.drop_repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = next(t for i, t in rows if i == x.id and brute.passages(rows)[(i, t)][2] == x.kept)
        assert (x.n_words, x.n_removed, x.kept) == want[(x.id, text)]
    assert sorted(n for _, n, _ in want.values())[:2] == [0, 0]


def test_model_counts_of_repeated_rows(spark, monkeypatch):
    """Copies in one batch, in several, and in several partitions, with seldom words joined: every copy has the same counts."""
    r = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(40)]
    rows = [(k, texts[k % 40]) for k in range(60)] + [(5, texts[5])] * 25 + [(None, texts[7])] * 11 + [(7, None), (None, "7"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(lm, "TOP", 5)
    want = {}
    for x in lm.score(spark, docs, rounds=0).collect():
        want.setdefault((x.id, x.n_tokens), set()).add((x.n_known, round(x.base_score, 6)))
    assert all(len(v) == 1 for v in want.values())
    monkeypatch.setattr(lm, "COMMON", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = lm.score(spark, docs, rounds=0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for x in got:
        assert {(x.n_known, round(x.base_score, 6))} == want[(x.id, x.n_tokens)]
