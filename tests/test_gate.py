"""Content gate over texts that the tables hold seldom."""

from __future__ import annotations

import duckdb

from evidencelake.operators import screening
from evidencelake.plans import catalog


def test_content_gate_equals_its_sql_on_blank_and_missing_texts(spark, tmp_path):
    texts = [None, "", "   ", ".", ". a sentence without a title" * 9, "  .b", "\n.", "a", "plain words. and more of them", "12"]
    rows = [(9 * k + m, text, "s", len(text or ""), "en") for k, text in enumerate(texts) for m in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["content_gate"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["content_gate"](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(want, key=str)


def test_a_beginning_alone_is_one(spark):
    items = [("Review for ", "a" * 200, "peer review"), (" review FOR x", "", "peer review"), ("Disclosure", "a" * 200, "peer review"), ("Review", "a" * 200, None), (None, None, "bare title")]
    frame = spark.createDataFrame([(t, a, "", w) for t, a, w in items], "title string, abstract string, type string, want string")
    assert all(r.reason == r.want for r in frame.withColumn("reason", screening.content_gate()).collect())
