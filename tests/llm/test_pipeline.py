"""The corpus pipeline: every stage on what its predecessor kept, with planted cases."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as pipeline
from evidencelake.llm import queries
from tests.llm import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, copies string, rid string"
ITEM = "which of these benchmark words stand together in exactly this order of twelve"


def corpus() -> list[tuple]:
    r = random.Random(3)
    words = ["w%d" % k for k in range(80)]
    prose = lambda k: "\n".join(" ".join(r.choice(words) for _ in range(12)) + f" {r.random():.9f}" for _ in range(k))
    rows = [[i, prose(r.randint(6, 20)), "en", r.choice("abc")] for i in range(120)]
    for i in range(120, 130):
        rows.append([i, rows[i - 120][1], "en", "a"])  # exact copies
    for i in range(130, 140):  # joined lines are no common lines, so the near-dedup has to see them
        rows.append([i, rows[i - 120][1].replace("\n", " "), "en", "b"])
    rows += [[140, prose(8) + " " + ITEM, "en", "c"], [141, "too short", "en", "a"], [142, None, None, None], [143, "", "en", "a"], [None, prose(9), "en", None], [144, " ".join(["rep eat"] * 200), "en", "a"]]
    rows += [rows[50], [145, prose(250), "en", "b"]]
    return [(i, t, g, s, len(t or ""), "x", "y") for i, t, g, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        kept = stage(spark, docs, folder)
        if name != "mix":
            assert kept.schema.names == docs.schema.names
        rows = kept.collect()
        ids = [r.doc_id for r in rows]
        assert set(ids) <= {r.doc_id for r in docs.collect()}
        seen[name] = rows
        docs = spark.createDataFrame(rows, kept.schema)
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    assert ids["quality_rules"].isdisjoint({141, 142, 143, 144}) and ids["quality_rules"] >= set(range(120))
    assert ids["line_dedup"].isdisjoint(range(120, 130)) and ids["line_dedup"] >= set(range(120))
    assert ids["near_dedup"].isdisjoint(range(130, 140)) and ids["near_dedup"] >= set(range(120))
    assert 140 in ids["near_dedup"] and 140 not in ids["decontaminate"] and ids["decontaminate"] >= set(range(120))
    near = [r.doc_id for r in seen["near_dedup"]]
    assert len(near) == len(set(near))
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    taken = {}
    for r in seen["mix"]:
        assert 1 <= int(r.copies) <= 3 and r.taken == int(r.copies) * len(brute.WORD.findall(r.text))
        taken[r.source] = taken.get(r.source, 0) + r.taken
    total = sum(len(brute.WORD.findall(r.text)) for r in seen["decontaminate"])
    assert abs(sum(taken.values()) - total) <= 0.05 * total


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "rid", "copies", "taken"}


def test_empty_corpus(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_return_the_contract(spark, folder):
    """Columns and digests of the thin queries, on the same documents."""
    rows = [r[:2] for r in corpus()]
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    lines, passages, hits = brute.line_dedup(rows), brute.passages(rows), brute.benchmark_hits(rows, [(1, ITEM)])
    for r in queries.op6_line_dedup(spark, folder).collect():
        n, dropped, kept = lines[(r.doc_id, text[r.doc_id])]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, dropped, brute.sha(kept))
    for r in queries.op7_substring_dedup(spark, folder).collect():
        n, gone, kept = passages[(r.doc_id, text[r.doc_id])]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, brute.sha(kept))
    for r in queries.op10_decontamination(spark, folder).collect():
        n, hit, items = hits[(r.doc_id, text[r.doc_id])]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), brute.sha(",".join(items)), hit > 0)
    for r in queries.op9_pii(spark, folder).collect():
        assert r.spans == "" and r.base_sha256 == brute.sha("")
    for r in queries.op4_quality(spark, folder).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.text_counts(text[r.doc_id])
    want = brute.component_ids(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, folder).collect()} == {(i, *want[(i, t)]) for i, t in rows}
