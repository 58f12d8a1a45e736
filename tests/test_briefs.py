"""Tables behind a brief, on small cases."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from evidencelake.functions import text as X
from evidencelake.operators import briefs, extraction


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_sentences(spark):
    text = F.lit("First things are said at length here.  Then garnet zoning is described in detail! lower case goes on. 7 ends")
    row = one(spark, s=X.sentences(text), b=X.best_sentence(text, F.lit("zoning of garnet")), f=X.best_sentence(text, F.lit("unrelated words")), n=X.best_sentence(F.lit("short"), F.lit("x")), p=X.phrases(F.lit("the deep crust of the old craton"), ["the", "of"]))
    assert row.s == ["First things are said at length here.", "Then garnet zoning is described in detail! lower case goes on. 7 ends"]
    assert row.b.startswith("Then garnet") and row.f.startswith("First") and row.n == "short" and row.p == ["deep crust", "old craton"]


def test_structured_text(spark):
    note = F.lit("METHODS: We did it. RESULTS: Magnetic Resonance Imaging (MRI) helped 3 of them. We conclude that 5 matter. RESULTS: again")
    row = one(spark, s=extraction.sections(note), a=extraction.abbreviations(note), c=extraction.cue_sentence(note, "we conclude"))
    assert row.s == {"methods": "We did it.", "results": "Magnetic Resonance Imaging (MRI) helped 3 of them. We conclude that 5 matter."} and row.a == {"MRI": "Magnetic Resonance Imaging"} and row.c.startswith("We conclude")


def test_authors_and_gates(spark):
    names = lambda *x: F.array(*map(F.lit, x))
    row = one(spark, a=briefs.short_author(names("Ann LEE")), b=briefs.short_author(names("Ann Lee", "Bo Ek")), c=briefs.short_author(names("A B", "C D", "E F")), d=briefs.short_author(F.array().cast("array<string>")), e=briefs.short_author(F.lit(None).cast("array<string>")))
    assert tuple(row) == ("Lee", "Lee & Ek", "B et al.", "Anonymous", "Anonymous")
    row = one(spark, a=briefs.good_title(F.lit("Magma storage in arcs")), b=briefs.good_title(F.lit("farley2000abc")), c=briefs.good_title(F.lit("VOLUME 12, PAGES 1")), d=briefs.good_title(F.lit(None).cast("string")), e=briefs.good_finding(F.lit("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 a")), f=briefs.good_finding(F.lit("Garnet grows at depth in most of the samples studied.")), g=briefs.good_finding(F.lit(None).cast("string")))
    assert tuple(row) == (True, False, False, False, False, True, False)


def test_model_answers(spark):
    schema = "struct<a:int,b:array<string>>"
    texts = ['```json\n{"a": 1, "b": ["x",],}\n```', "none", None, 'well: {"a": 2} done']
    got = [r.j for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(briefs.json_of(F.col("t"), schema).alias("j")).collect()]
    assert got[0].a == 1 and got[0].b == ["x"] and (got[1] is None or got[1].a is None) and got[3].a == 2


def test_relations_and_limits(spark):
    rows = [(1, 1, "Garnet zoning records heating of the deep crust"), (1, 2, "Garnet zoning and heating of the deep crust however differ"), (1, 3, "Wine is red")]
    got = briefs.relation(spark.createDataFrame(rows, "g int, k int, finding string"), "g", ["k"]).orderBy("k").collect()
    assert [r.relation for r in got] == [None, "contrast", None]
    assert briefs.sections("alpha vs beta dykes", 3, 1, {"alpha": 2, "beta": 1}) == ["Evidence: alpha", "Evidence: beta", "Comparison: alpha vs beta", "Comparative synthesis", "Quantitative synthesis", "Findings", "Limitations", "Research gaps and future directions"]


def test_repairs(spark):
    tokens = spark.createDataFrame([("granitte",), ("garnett",), ("zzzzzzz",), ("granite",), ("abcd",)], "token string")
    words = spark.createDataFrame([("granite",), ("garnet",), ("granule",)], "word string")
    assert {r.token: r.word for r in briefs.repairs(tokens, words).collect()} == {"granitte": "granite", "garnett": "garnet"}
    assert {r.token: r.word for r in extraction.spelling(tokens, words).collect()} == {"granitte": "granite", "garnett": "garnet"}


def test_measurement_scales(spark):
    rows = [(1, 1000.0, "K", ""), (2, 1.0, "GPa", ""), (3, 3.0, "Ma", "age"), (4, 2.0, "Ga", ""), (5, 700.0, None, "temp"), (6, 1e9, "°C", ""), (7, 5.0, "furlong", "x")]
    got = {r.k: (r.kind, round(r.value, 2), r.unit) for r in briefs.normalised_measurements(spark.createDataFrame(rows, "k int, value double, unit string, measurement string")).collect()}
    assert got == {1: ("temperature", 726.85, "°C"), 2: ("pressure", 10.0, "kbar"), 4: ("age", 2000.0, "Ma"), 5: ("temperature", 700.0, "°C"), 7: ("pressure", 5.0, "kbar")}


@pytest.mark.parametrize(("value", "want"), [(0, "diagenetic/burial conditions"), (699.9, "upper amphibolite facies (sillimanite zone)"), (700, "granulite facies"), (1800, None), (-1, None)])
def test_bands(spark, value, want):
    assert one(spark, b=briefs.band(F.lit(float(value)), briefs.TEMPERATURE_BANDS)).b == want


def test_novelty_over_any_white_space(spark):
    texts = ["a novel\nmethod for dating", "the first  time that this was seen", "we\treview the field", "this is consistent\n with others", "an ordinary text", None, ""]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", extraction.novelty(F.col("t")).alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == ["methodological", "milestone", "review", "confirmation", "incremental", "incremental", "incremental"]


def test_titles_and_findings(spark):
    titles = {"1234567890 123": True, "all lower case title here": False, "ALL UPPER CASE TITLE HERE": True, "A 12345 67890": False, "farley2000keyonly": False, "VOL. 12 of Something": False, "A proper title of a paper": True, None: False, "Short": False}
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", briefs.good_title(F.col("t")).alias("g")).collect()
    assert {r.t: r.g for r in got} == titles
    plain = "The samples show a strong rise of pressure with depth in all wells"
    findings = {plain: True, plain + " <b>": False, "Keywords: " + plain: False, plain + " write to me@host.org": False, plain + " at 12 , 13 (2001) of": False, "short": False, plain + " corresponding author: x": False, plain + " in figure a.": False, None: False}
    got = spark.createDataFrame([(t,) for t in findings], "t string").select("t", briefs.good_finding(F.col("t")).alias("g")).collect()
    assert {r.t: r.g for r in got} == findings


def test_long_findings_and_their_marks(spark):
    """A long line is searched once for each mark, and one that could hold no mark is not searched."""
    plain = "The samples show a strong rise of pressure with depth in all wells"
    marks = ["\u212aey word\u017f", "kEYWORD: ", "a@bc.org", "] , which features", "],which show", "]   which shows", "12 , 3 (4)", "12Ma)", "3 Ma)", "ed\u0130tor's kind attention", "ed\u0131tor's kind attention", "editor's kind attention", "Contact: x", "ontact x", "self-gravitating", "Chapter also outlines key"]
    whole = ["]", "which features", "12 , (4)", "Ma)", "a@b", "editor", "chapter", "] x , which shows", "12 , 3 ()"]
    rows = [(k, f"{plain} {m}", F_) for k, (m, F_) in enumerate([(m, False) for m in marks] + [(m, True) for m in whole])]
    old = "(?iU)" + "|".join({"@\\w+\\.\\w{2,3}": ".*@\\w+\\.\\w{2,3}", "\\]\\s*(?:,\\s*)?which\\s+(?:features|show)": ".*\\]\\s*,?\\s*which\\s+(?:features|show)", "\\d\\s*Ma\\)": "\\d+\\s*Ma\\)", "\\d\\s*,\\s*\\d+\\s*\\(\\d+\\)": "\\d+\\s*,\\s*\\d+\\s*\\(\\d+\\)"}.get(p, p) for p in briefs.GARBLED)
    t = spark.createDataFrame(rows, "k int, t string, want boolean")
    assert t.where(briefs.is_garbled(F.col("t")) != F.col("t").rlike(old)).collect() == []
    got = {r.t: r.g for r in t.select("t", briefs.is_garbled(F.col("t")).alias("g")).collect()}
    assert [got[f"{plain} {m}"] for m in whole] == [False] * len(whole) and all(got[f"{plain} {m}"] for m in marks if m != "ontact x" and m.isascii())
    start = time.perf_counter()
    row = one(spark, g=briefs.good_finding(F.concat(F.repeat(F.lit("word ( ] "), 60_000), F.lit("end"))))
    assert row.g and time.perf_counter() - start < 20
