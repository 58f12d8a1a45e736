"""Duplicate resolution, screening, text, graph and contract checks on small cases."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from evidencelake.functions import text as X
from evidencelake.operators import clustering, evidence, extraction, graph, integrity, ranking, records, screening, summaries, verification
from evidencelake.sources import export, providers, stores


def corpus(spark, rows):
    """rows: dicts of title, authors, year, doi, arxiv_id."""
    data = []
    for k, r in enumerate(rows):
        base = dict.fromkeys(f.name for f in records.PAPER)
        base |= {"ingest_pos": k, "source": f"s{k}", "sources_seen": [f"s{k}"], "authors": [{"name": n, "orcid": None, "openalex_id": None, "affiliation": None, "countries": None} for n in r.pop("authors", [])]} | r
        data.append(tuple(base[f.name] for f in records.PAPER))
    return spark.createDataFrame(data, records.PAPER)


LONG = "Effects of monsoon rainfall on yields of kharif crops in Yavatmal district of Maharashtra"


@pytest.mark.parametrize(
    ("a", "b", "n"),
    [
        ({"title": "Introduction", "authors": ["Alice Chen"], "year": 2001}, {"title": "Introduction", "authors": ["Bob Diaz"], "year": 2005}, 2),
        ({"title": "Introduction", "authors": ["Alice Chen"], "year": 2001}, {"title": "Introduction", "authors": ["Bob Diaz"], "year": 2001}, 2),
        ({"title": "Magma storage under arcs in depth", "authors": ["Alice Chen"], "year": 2001, "arxiv_id": "1.2"}, {"title": "Magma storage under arcs in depth again", "authors": ["Alice Chen"], "year": 2001, "doi": "10.1/a"}, 1),
        ({"title": "One", "authors": ["A B"], "year": 2001, "doi": "10.1/X"}, {"title": "Two", "authors": ["C D"], "year": 2009, "doi": "10.1/x"}, 1),
        ({"title": "A title of its own", "year": 2001, "doi": "10.1/a"}, {"title": "A title of its own", "year": 2001}, 1),
        ({"title": "A title of its own", "year": 2001, "doi": "10.1/a"}, {"title": "A title of its own", "year": 2009}, 2),
        ({"title": "Paper with a supplement", "year": 2001, "doi": "10.1/a"}, {"title": "Paper with a supplement", "year": 2001, "doi": "10.1/a.s001"}, 1),
        ({"title": "One", "arxiv_id": "2.3", "year": 2000}, {"title": "Other", "arxiv_id": "2.3", "year": 2000}, 1),
        ({"title": "Same work posted twice over", "authors": ["Alice Chen"], "year": 2021}, {"title": "Same work posted twice over", "authors": ["Alice Chen"], "year": 2022}, 1),
        ({"title": "Crustal growth of cratons", "authors": ["Alice Chen"], "year": 2021}, {"title": "Ocean chemistry in deep time", "authors": ["Alice Chen"], "year": 2021}, 2),
        ({"title": LONG, "authors": ["A B"], "year": 2001, "doi": "10.1/q"}, {"title": LONG.lower() + ".", "authors": ["C D"], "year": 2011, "doi": "10.1/r"}, 1),
    ],
)
def test_duplicates(spark, a, b, n):
    out = records.deduplicate(spark, corpus(spark, [dict(a), dict(b)])).collect()
    assert len(out) == n
    if n == 1 and "s001" not in (b.get("doi") or ""):
        assert out[0].source == "merged" and out[0].sources_seen == ["s0", "s1"]


def test_merge_prefers_what_is_there(spark):
    rows = [{"title": "A title of its own", "year": 2001, "abstract": "", "concepts": ["x", "y"], "authors": ["J. Ita", "Ann Lee"]}, {"title": "A title of its own", "year": 2001, "abstract": "text", "doi": "10.1/a", "concepts": ["y", "z"], "authors": ["Joel Ita"]}]
    rows[1]["authors"] = ["Joel Ita"]
    merged = records.merge_clusters(corpus(spark, rows), spark.createDataFrame([(0, "c"), (1, "c")], "ingest_pos long, cluster string")).first()
    assert merged.abstract == "text" and merged.doi == "10.1/a" and merged.concepts == ["x", "y", "z"] and [a.name for a in merged.authors] == ["Joel Ita", "Ann Lee"]


def test_junk(spark):
    rows = [{"title": "dare2014"}, {"title": ""}, {"title": "Supplemental Material: x", "doi": "10.1/a"}, {"title": "Vol. 3"}, {"title": "dare2014", "year": 2014}, {"title": "A proper title here"}]
    assert [r.junk for r in corpus(spark, rows).orderBy("ingest_pos").select(records.is_junk().alias("junk")).collect()] == [True, True, True, True, False, False]


def test_text(spark):
    got = spark.createDataFrame([("Ünïcode – “Dash” Pranhita‐Godavari",)], "s string").select(X.fold("s").alias("f")).first().f
    assert got == "unicode - 'dash' pranhita-godavari"
    pairs = [("abcd", "abdc", True), ("abcd", "abxd", True), ("abcd", "abcde", True), ("abcd", "badc", False), ("abcd", "abcd", True), ("abcdef", "abdcfe", False), ("ab", "ba", True), ("abc", "cab", False)]
    got = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", X.within_one_edit(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    row = spark.range(1).select(X.number_range(F.lit("500-620 °C")).alias("r"), X.number_range(F.lit("about 7 kbar")).alias("v"), X.clean_doi(F.lit("10.1/ABC(2).,")).alias("d"), X.clean_doi(F.lit("10.1/abc(2")).alias("o"), X.clip_words(F.lit("one two three"), 9).alias("c"), X.slug(F.lit("A b, C!")).alias("s")).first()
    assert (row.r.value, row.r.low, row.r.high, row.v.value, row.v.low) == (560.0, 500.0, 620.0, 7.0, None) and row.d == "10.1/abc" and row.o == "10.1/abc" and row.c == "one two…" and row.s == "a-b-c"
    assert X.key_terms("Dongargarh granite research in India") == ["Dongargarh", "India", "granite"] and X.key_terms("Comparative Petrography of the Gadchiroli Dykes") == ["petrography", "gadchiroli", "dykes"]
    assert X.and_query("Nandgaon volcanics geochemistry") == "Nandgaon AND volcanics AND geochemistry"
    assert set(X.surface_forms("studies")) >= {"studies", "study"} and "weather" in X.surface_forms("weathering")


MEASURED = [
    ("cooling interval (>190–270 °C)", set()), ("piston-cylinder, 0.5–1.0 GPa", set()), ("range 700–900 °C; peak at 950 °C", {(950.0, "°C")}), ("temperatures up to 1050 °C recorded", set()), ("crystallization at 870 °C, 7.2 kbar, and 11 Ma", {(870.0, "°C"), (7.2, "kbar"), (11.0, "Ma")}),
    ("sample 47 was heated to 300 °C for 12 hours", {(300.0, "°C")}), ("in 2015 the eruption deposited ash", set()), ("the 2 km thick sequence spans 15 km laterally", {(2.0, "km"), (15.0, "km")}), ("annealed at 1073 K under 10 kbar", {(1073.0, "K"), (10.0, "kbar")}), ("standard state of 298 K", set()), ("accurate to ±25 °C", set()), ("", set()),
]


@pytest.mark.parametrize(("text", "want"), MEASURED)
def test_measurements(text, want):
    assert {(m.value, m.unit) for m in extraction.measurements_of(text)} == want


def test_measurement_errors_and_sides():
    (m,) = extraction.measurements_of("age of 45.2 ± 0.3 Ma (n = 12)")
    assert (m.value, m.uncertainty, m.n, m.measurement) == (45.2, 0.3, 12, "age")
    ((a, b),) = extraction.comparisons_of("650 ± 5 °C in rims versus 700 °C in cores")
    assert (a.value, b.value) == (650.0, 700.0)


def test_kappa_and_metrics(spark):
    rows = [(True, "include")] * 40 + [(True, "exclude")] * 10 + [(False, "include")] * 5 + [(False, "exclude")] * 45 + [(True, "maybe"), (False, None)]
    r = screening.confusion(spark.createDataFrame(rows, "included boolean, label string")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.maybe, r.unlabeled) == (40, 10, 5, 45, 1, 1) and r.kappa == pytest.approx(0.7) and r.precision == 0.8
    one = screening.confusion(spark.createDataFrame([(True, "include")], "included boolean, label string")).first()
    assert one.kappa is None and one.f1 == 1
    none = screening.confusion(spark.createDataFrame([], "included boolean, label string")).first()
    assert none.kappa is None and none.precision == 0


def test_work_saved(spark):
    ranked = spark.createDataFrame([(k, k <= 10 or k == 90) for k in range(1, 101)], "position long, relevant boolean")
    r = screening.work_saved(ranked).first()
    assert r.n_to == 90 and r.wss == pytest.approx(0.1) and r.recall_at_10 == pytest.approx(10 / 11)


def test_term_coverage(spark):
    p = spark.createDataFrame([(1, "Dykes of the Gadchiroli district", ""), (2, "Asymptomatic malaria transmission, Gadchiroli", ""), (3, "Pranhita–Godavari basin thermometry", ""), (4, "nothing", None)], "paper_id int, title string, abstract string")
    got = {r.paper_id: r for r in screening.term_coverage(p, ["gadchiroli", "dyke"]).collect()}
    assert got[1].kept and not got[2].kept and not got[4].kept
    fuzzy = {r.paper_id: r.matched for r in screening.term_coverage(p, ["prahnita", "godawari", "thermometer"]).collect()}
    assert set(fuzzy[3]) == {"prahnita", "godawari", "thermometer"} and fuzzy[1] == []
    typo = {r.paper_id: r.kept for r in screening.term_coverage(p, ["zzzzzzzz", "godawari", "thermometry"]).collect()}
    assert typo[3]  # a first term that nothing matches asks for nothing


def test_cooccurrence(spark):
    rows = [(k, "granite isotope study", "") for k in range(3)] + [(9, "granite only", ""), (10, "wine", "")]
    p = spark.createDataFrame(rows, "paper_id int, title string, abstract string")
    assert {r.paper_id for r in screening.cooccurrence(p, "granite isotope").collect()} == {0, 1, 2}
    assert screening.cooccurrence(p, "granite").count() == 5 and screening.cooccurrence(p, "qqq www").count() == 0


def test_pagerank(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1)]
    nodes = spark.createDataFrame([(k,) for k in range(1, 6)], "id long")
    got = {r.id: r.rank for r in graph.pagerank(spark, nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    rank = dict.fromkeys(range(1, 6), 0.2)
    for _ in range(100):
        idle = rank[5]
        rank = {k: 0.85 * (sum(rank[a] for a, b in edges if b == k) + idle / 5) + 0.03 for k in rank}
    assert all(got[k] == pytest.approx(rank[k], abs=1e-5) for k in rank) and sum(got.values()) == pytest.approx(1)


def test_small_graph(spark):
    near = [{} for _ in range(6)]
    for a, b in [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]:
        near[a][b] = near[b][a] = 1.0
    assert graph.communities(near).tolist() in ([0, 0, 0, 1, 1, 1], [1, 1, 1, 0, 0, 0])
    between = graph.betweenness(near, 50)
    assert between[2] == max(between) and between[0] == 0
    e = spark.createDataFrame([(1, 2)], "src long, dst long").withColumn("weight", F.lit(1.0))
    assert graph.small_graph_metrics(spark.createDataFrame([(1,), (2,)], "id long"), e) is None


def test_stance():
    lexicon = evidence.Lexicon(evidence.LEXICON)
    assert lexicon.judge("These results confirm and support the model")[0] == "supporting"
    assert lexicon.judge("This does not confirm the model")[0] == "contrasting" and lexicon.judge("")[1] == 0.0
    assert lexicon.judge("We used the method of others")[0] == "methodology" and lexicon.judge("Earlier work")[0] == "mentioning"


def test_contradictions(spark):
    rows = [("a", "t", "K", 1.0), ("b", "t", "K", 6.0), ("a", "u", "K", 1.0), ("a", "u", "K", 9.0), ("a", "v", "K", -1.0), ("b", "v", "K", 9.0), ("a", "w", "K", 2.0), ("b", "w", "K", 3.0)]
    got = evidence.contradictions(spark.createDataFrame(rows, "paper_key string, quantity string, unit string, value double")).collect()
    assert [(r.quantity, r.ratio, r.n_papers) for r in got] == [("t", 6.0, 2)]


def test_index_quartiles(spark):
    v = spark.createDataFrame([("a", float(x)) for x in (5, 1, 4, 2, 3)] + [("b", 7.0)], "g string, value double")
    got = {r.g: r for r in summaries.at_index(v, ["g"], "value", {"q1": (1, 4), "mid": (1, 2), "q3": (3, 4)}).collect()}
    assert (got["a"].q1, got["a"].mid, got["a"].q3, got["b"].q1) == (2.0, 3.0, 4.0, 7.0)


def test_diversity(spark):
    rows = [(k, True, 1 - k / 100, "x" if k < 6 else f"a{k}", f"v{k % 3}", 2000 + (24 if k > 17 else 0)) for k in range(20)]
    ranked = spark.createDataFrame(rows, "paper_id int, strong boolean, combined double, first_author string, venue_key string, year int")
    got = ranking.diversify(ranked, 10, 2025).orderBy("rank").collect()
    # the second recent paper finds a recent one at the end and is added without one going
    assert len(got) == 11 and sum(r.first_author == "x" for r in got) == 3 and sum(r.year >= 2020 for r in got) == 2
    venues = [r.venue_key for r in got]
    assert max(venues.count(v) for v in venues) <= 5


def test_leaders_and_packing(spark):
    items = spark.createDataFrame([(1, "g", 5, 10), (2, "g", 9, 6), (3, "g", 7, 5)], "id long, g string, p int, s int")
    pairs = spark.createDataFrame([("g", 1, 2, 0.5), ("g", 2, 3, 0.9)], "g string, a long, b long, score double")
    assert {r.id: r.leader for r in clustering.leaders(items, pairs, "id", "g").collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.id for r in clustering.pack(items, "g", "p", "s", 11, "id").collect()} == {2, 3}


def test_quotes(spark):
    pages = spark.createDataFrame([("s", 1, "aaa bbb"), ("s", 2, "bbb ccc")], "source_id string, page_number int, text string")
    quotes = spark.createDataFrame([(1, "s", "ccc", None), (2, "s", "bbb", None), (3, "s", "bbb", 1), (4, "s", "zzz", None), (5, "s", "aa", None)], "quote_id int, source_id string, quote string, page_number int")
    got = {r.quote_id: (r.page_number, r.start, r.end, r.status) for r in integrity.locate(pages, quotes).collect()}
    assert got == {1: (2, 4, 7, "found"), 2: (None, None, None, "ambiguous"), 3: (1, 4, 7, "found"), 4: (None, None, None, "not found"), 5: (None, None, None, "ambiguous")}


def test_quotes_in_long_texts_take_linear_time(spark):
    long = "ab" * 100_000
    pages = spark.createDataFrame([("s", 1, long + "é"), ("t", 1, ""), ("u", 1, "x"), ("v", 1, None)], "source_id string, page_number int, text string")
    quotes = spark.createDataFrame([(1, "s", "abé"), (2, "s", "abab"), (3, "t", ""), (4, "u", ""), (5, "v", "a"), (6, "u", None)], "quote_id int, source_id string, quote string").withColumn("page_number", F.lit(None).cast("int"))
    start = time.perf_counter()
    got = {r.quote_id: (r.start, r.status) for r in integrity.locate(pages, quotes).collect()}
    assert time.perf_counter() - start < 20
    assert got == {1: (199_998, "found"), 2: (None, "ambiguous"), 3: (0, "found"), 4: (None, "ambiguous"), 5: (None, "not found"), 6: (None, "not found")}


def test_islands_of_many_numbers_take_linear_time(spark):
    frame = spark.createDataFrame([(1, [3, 1, None, 2, 2, 7, 9, 8, 20, 30, 31]), (2, []), (3, None), (4, list(range(0, 60_000, 2)))], "k int, x array<bigint>")
    start = time.perf_counter()
    got = {r.k: r.t for r in frame.select("k", X.island_ranges(F.col("x")).alias("t")).collect()}
    assert time.perf_counter() - start < 20
    assert got == {1: "1–3, 7–9, 20, 30, 31", 2: "", 3: None, 4: ", ".join(map(str, range(0, 60_000, 2)))}


def test_retractions_and_labels(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Title,OriginalPaperDOI,RetractionDOI\nx,https://doi.org/10.1/A,10.1/b\ny,,\n")
    assert {r.doi for r in stores.read_retractions(spark, str(tmp_path / "r.csv")).collect()} == {"10.1/a", "10.1/b"}
    (tmp_path / "n.csv").write_text("Title\nx\n")
    assert stores.read_retractions(spark, str(tmp_path / "n.csv")).count() == 0
    (tmp_path / "l.jsonl").write_text('{"doi": "10.1/A", "label": "include"}\nbroken\n{"doi": "10.1/a ", "label": "EXCLUDE"}\n{"doi": "10.1/c", "label": "odd"}\n')
    assert {r.doi: r.label for r in stores.read_labels(spark, str(tmp_path / "l.jsonl")).collect()} == {"10.1/a": "exclude"}


def test_dumps_and_exports(spark, tmp_path):
    item = {"DOI": "10.1/x", "title": ["T {x}"], "author": [{"given": "Ann", "family": "Lee"}, {}], "issued": {"date-parts": [[2001, 2]]}, "container-title": ["J"], "type": "journal-article"}
    (tmp_path / "c.jsonl").write_text(json.dumps(item))
    r = providers.read_dump(spark, "crossref", str(tmp_path / "c.jsonl"))
    assert r.first().authors[0].name == "Ann Lee" and len(r.first().authors) == 1
    n = r.withColumn("number", F.lit(1))
    assert export.bibtex(n).first().entry == "@article{Lee200101,\n  title = {T x},\n  author = {Ann Lee},\n  year = {2001},\n  journal = {J},\n  doi = {10.1/x}\n}"
    assert export.ris(n).first().entry.splitlines()[:3] == ["TY  - JOUR", "T1  - T {x}", "AU  - Ann Lee"]
    assert export.apa(n).first().entry == "Ann Lee (2001). *T {x}*. J. https://doi.org/10.1/x" and json.loads(export.csl_json(n).first().entry)["author"] == [{"family": "Lee", "given": "Ann"}]
    export.write_text(export.ris(n), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="empty"):
        export.require(r.limit(0), ["doi"], "corpus")
    (tmp_path / "bad.jsonl").write_text('{"DOI": [')
    with pytest.raises(Exception):  # noqa: B017, PT011
        providers.read_dump(spark, "crossref", str(tmp_path / "bad.jsonl")).collect()


def test_paged_source(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"page-{k}.json").write_text(json.dumps({"results": [{"id": f"W{k}", "title": "t"}]}))
    providers.register(spark)
    got = spark.read.format("paged").option("path", str(tmp_path)).option("pages", 2).load()
    assert {r.id for r in got.collect()} == {"W0", "W1"}


def test_verification(spark):
    row = spark.range(1).select(verification.evidence_level(F.lit("Journal-Article")).alias("a"), verification.evidence_level(F.lit(""), F.lit("preprint")).alias("b"), verification.retraction(F.lit(False), F.lit("x"), F.lit(True)).alias("c"), verification.bias_tools(F.lit("a randomised cohort"), F.lit("")).alias("d")).first()
    assert (row.a, row.b, row.c) == ("IV", "V", "concern") and row.d == ["RoB 2", "ROBINS-I"]


def test_citations(spark):
    brief = spark.createDataFrame([(1, "see [1] and [3]\n## References\n[1] a\n[2] b\n")], "brief_id int, body string")
    assert {(r.number, r.cited, r.listed) for r in extraction.citation_check(brief).collect()} == {(1, True, True), (2, False, True), (3, True, False)}
