"""Local matches in steps."""

from __future__ import annotations

from evidencelake.operators import records


def test_only_titles_that_nothing_is_so_alike_go_on(spark, monkeypatch):
    asked, rare = {}, records._rare
    monkeypatch.setattr(records, "_rare", lambda sets, name, seen, least: asked.update({least: sets.count()} if name == "a" else {}) or rare(sets, name, seen, least))
    titles = ["a b c d e", "f g h", "i j", "k l m n"]
    papers = spark.createDataFrame([(k, None, t) for k, t in enumerate(titles)], "paper_id int, doi string, title string")
    files = spark.createDataFrame([(10, None, "a b c d e pdf"), (11, None, "a b c d e x"), (12, None, "f g h pdf"), (13, None, "j i pdf x"), (14, None, "k z")], "file_id int, doi string, title string")
    got = {r.paper_id: (r.file_id, r.score) for r in records.local_match(papers, files).collect()}
    assert got == {0: (10, 5 / 6), 1: (12, 0.75), 2: (13, 0.5)}
    assert asked == {0.8: 4, 0.65: 3, 0.5: 2}
