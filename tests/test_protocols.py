"""Rules of protocols, on rows that break one each."""

from __future__ import annotations

from evidencelake.operators import integrity

GOOD = ("p", "which?", "2024-01-01T00:00:00Z", ["a"], [], ["s"], "draft", None)
FIELDS = "protocol_id research_question created_at_utc inclusion_criteria exclusion_criteria planned_sources status preregistration_uri".split()
SHAPE = "protocol_id string, research_question string, created_at_utc string, inclusion_criteria array<string>, exclusion_criteria array<string>, planned_sources array<string>, status string, preregistration_uri string"
BROKEN = [
    ("protocol_id", None, "no protocol id"), ("research_question", " ", "no question"), ("research_question", None, "no question"), ("created_at_utc", "2024-01-01", "time without offset"), ("created_at_utc", None, "time without offset"),
    ("inclusion_criteria", [], "no inclusion criterion"), ("inclusion_criteria", None, "no inclusion criterion"), ("inclusion_criteria", ["a", None], "no inclusion criterion"), ("inclusion_criteria", ["a", " a "], "no inclusion criterion"),
    ("exclusion_criteria", ["x", "x"], "bad exclusion criteria"), ("exclusion_criteria", [""], "bad exclusion criteria"), ("planned_sources", [], "no planned source"), ("planned_sources", [" "], "no planned source"),
    ("status", "lost", "unknown protocol status"), ("status", None, "unknown protocol status"), ("preregistration_uri", " ", "blank registration"),
]


def test_each_rule(spark):
    rows = [GOOD, ("q", *GOOD[1:4], None, *GOOD[5:7], "doi:1")]
    want = []
    for k, (field, value, rule) in enumerate(BROKEN):
        row = dict(zip(FIELDS, (f"r{k}", *GOOD[1:]), strict=True)) | {field: value}
        rows.append(tuple(row[f] for f in FIELDS))
        want.append((rule, row["protocol_id"]))
    frame = spark.createDataFrame(rows, SHAPE)
    found = integrity.protocols(frame).collect()
    assert sorted((r.rule, str(r.key)) for r in found) == sorted((a, str(b)) for a, b in want)
    twice = integrity.protocols(frame.limit(1).unionAll(frame.limit(1))).collect()
    assert [(r.rule, r.detail) for r in twice] == [("protocol id repeats", "n=2")] and integrity.protocols(frame.limit(0)).count() == 0
