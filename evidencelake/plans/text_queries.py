"""Text functions and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import abbreviations as short_forms
from ..operators import clustering, extraction, fulltext, intent, readings, vocabulary
from .papers import PAPERS_SQL, papers
from .registry import query, table

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query("norm_titles", f"WITH {PAPERS_SQL} SELECT paper_id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS norm FROM papers")
def norm_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("paper_id", X.norm_title(F.col("title")).alias("norm"))


@query("content_stems", f"""SELECT doc_id, count(DISTINCT substr(w, 1, 6)) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) WHERE length(w) > 2 AND w NOT IN ({_STOP}) GROUP BY 1""")
def content_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.stems(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query("claim_containment", f"""WITH t AS (SELECT doc_id, list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2 AND x NOT IN ({_STOP})), lambda x: substr(x, 1, 6))) AS s FROM documents),
q AS (SELECT item_id, list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2 AND x NOT IN ({_STOP})), lambda x: substr(x, 1, 6))) AS c FROM benchmark)
SELECT doc_id, item_id, round(len(list_intersect(c, s))::DOUBLE / len(c), 6) AS score FROM t, q WHERE len(list_intersect(c, s))::DOUBLE / len(c) >= 0.1""")
def claim_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name, key, to: table(spark, sf_dir, name).select(F.col(key).alias(to), X.stems(F.col("text")).alias("tokens"))
    got = clustering.contained(read("documents", "doc_id", "text_id"), read("benchmark", "item_id", "claim_id"), 0.1)
    return got.select(F.col("text_id").alias("doc_id"), F.col("claim_id").alias("item_id"), F.round("score", 6).alias("score"))


@query("page_text", r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'),
  '(access provided by|get access|this is a preview of subscription content)[^.]*\.?', ' ', 'gi'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.sanitise(F.col("html"))).alias("text_md5"))


@query("study_types", "SELECT doc_id, CASE WHEN " + " WHEN ".join(f"regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in extraction.STUDY_TYPES) + " END AS study_type FROM documents")
def study_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", extraction.study_type(F.col("text")).alias("study_type"))


@query("novelty_classes", "SELECT doc_id, CASE WHEN " + " WHEN ".join(f"regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in extraction.NOVELTY) + " ELSE 'incremental' END AS novelty FROM documents")
def novelty_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", extraction.novelty(F.col("text")).alias("novelty"))


_VOCABULARY = (("english", "the", 1.0, 1), ("german", "der", 1.5, 2), ("french", "les", 1.5, 3), ("spanish", "que", 1.0, 4))


@query("weighted_classes", "WITH v(label, word, weight, position) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in _VOCABULARY) + """), s AS (SELECT doc_id, label, position, (length(text) - length(replace(lower(text), word, '')))::DOUBLE / length(word) * weight AS s FROM documents, v),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, position) AS r FROM s) SELECT doc_id AS id, CASE WHEN s > 0 THEN label ELSE 'general' END AS label, round(s, 6) AS score FROM b WHERE r = 1""")
def weighted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame(list(_VOCABULARY), "label string, word string, weight double, position int")
    out = extraction.weighted_class(table(spark, sf_dir, "documents").where("text = text"), "doc_id", F.col("text"), v)
    return out.withColumn("score", F.round("score", 6))


#: Hundreds of terms: the commonest words of each language, longer ones with more weight.
_FIELDS = """w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT lang AS label, word, 1 + (length(word) % 4) / 2.0 AS weight, length(lang) + ascii(lang) AS position FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM c) WHERE r <= 150)"""


@query("field_scores", f"WITH {_FIELDS} SELECT doc_id AS id, label, sum((length(text) - length(replace(lower(text), word, '')))::DOUBLE / length(word) * weight)::DOUBLE AS score FROM documents, v WHERE contains(lower(text), word) GROUP BY ALL")
def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.label_scores(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), _fields(spark, sf_dir))


@query("fields", f"""WITH {_FIELDS}, s AS (SELECT doc_id, label, position, sum((length(text) - length(replace(lower(text), word, '')))::DOUBLE / length(word) * weight)::DOUBLE AS s FROM documents, v WHERE contains(lower(text), word) GROUP BY ALL),
b AS (SELECT doc_id, label, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, position, label) AS r FROM s) SELECT DISTINCT d.doc_id AS id, coalesce(label, 'general') AS label, coalesce(s, 0.0) AS score FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND r = 1""")
def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.best_labels(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), _fields(spark, sf_dir))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    top = words.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where("r <= 150")
    return top.select(F.col("lang").alias("label"), "word", (1 + F.length("word") % 4 / 2).alias("weight"), (F.length("lang") + F.ascii("lang")).alias("position"))


@query("foreign_text", "SELECT doc_id, length(text) >= 20 AND coalesce(length(regexp_replace(text, '[\\x00-\\x7F]|\\P{L}', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '\\P{L}', '', 'g')), 0), 0) >= 0.3 AS is_foreign FROM documents")
def foreign_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.is_foreign(F.col("text")).alias("is_foreign"))


@query("keyword_phrases")
def keyword_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(X.phrases(F.col("text"), [*X.STOP_WORDS, *X.QUERY_STOP_WORDS])).alias("phrase"))
    return rows.groupBy("lang", "phrase").agg(F.count("*").alias("n")).where("n >= 20")


@query("best_sentences")
def best_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is the source that one claim cites, claims in turn."""
    claims = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim"))
    n = F.broadcast(claims.agg(F.count("*").alias("n")))
    cited = table(spark, sf_dir, "documents").crossJoin(n).select("doc_id", "text", F.try_mod(F.col("doc_id"), F.col("n")).alias("item_id"))
    return cited.join(claims, "item_id").select("doc_id", "item_id", X.best_sentence(F.col("text"), F.col("claim")).alias("sentence"))


@query("measurements")
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "events").select("event_id", F.format_string("run at %.1f °C under %.2f GPa, n = %d, after 700–900 °C", F.abs("value") * 10, F.abs("value") / 10, (F.col("event_id") % 7 + 2).cast("int")).alias("note"))
    return notes.select("event_id", F.explode(extraction.measurements("note")).alias("m")).select("event_id", "m.value", "m.unit", "m.measurement", "m.n")


#: Sentences with two numbers a and b: what is written, and the measurements that stand alone as (value, unit, label).
SENTENCES = (
    ("annealed at {a} K under {b} kbar", [("a", "K", "temperature"), ("b", "kbar", "pressure")]), ("a range of {b}–{c} GPa, with a peak at {a} MPa", [("a", "MPa", "pressure")]), ("temperatures up to {a} °C recorded. Held at {b} kbar", [("b", "kbar", "pressure")]),
    ("age of {a} ± {b} Ma", [("a", "Ma", "age")]), ("runs filtered to remove pressures >{b} kbar; the rest gave {a} ppm", [("a", "ppm", "concentration")]), ("δ¹⁸O = +{b}‰ and SiO₂ = {b} wt%", [("b", "‰", "δ18O"), ("b", "wt%", "SIO2")]),
    ("⁸⁷Sr/⁸⁶Sr = 0.7{a}, La/Yb = {b}", [("0.7a", "ratio", "87Sr/86Sr"), ("b", "ratio", "La/Yb")]), ("accuracy = {b}% on set {a}, RMSE = {b} °C", [("b", "%", "accuracy")]), ("calibrated to ±{b} °C, errors of {b}%, measured at {a} °C", [("a", "°C", "temperature")]),
    ("p < 0.01 with n = {a}; 95% CI: {b} to {c}", []), ("see section {a} and figure {b}", []), ("pressure was logged while {a} °C held, then {b} km of core", [("a", "°C", "temperature"), ("b", "km", "distance")]),
)


def _sentence(template: str) -> str:
    return "concat('" + template.replace("{a}", "', a, '").replace("{b}", "', b, '").replace("{c}", "', c, '") + "')"


#: a has three digits or more, b one decimal, c is above b; all as text.
_A, _B = "CAST(100 + user_id % 900 AS VARCHAR(9)) AS a", "concat(CAST(1 + event_id % 40 AS VARCHAR(9)), '.', CAST(1 + user_id % 9 AS VARCHAR(9))) AS b"
_NOTES = ("event_id", "CAST(event_id % 12 AS INT) AS kind", _A, _B, "concat(CAST(50 + event_id % 40 AS VARCHAR(9)), '.5') AS c")


@query("effect_readings", f"WITH notes AS (SELECT {', '.join(_NOTES)} FROM events) " + " UNION ALL ".join(f"SELECT event_id, CAST({'concat($0.7$, a)'.replace('$', chr(39)) if v == '0.7a' else v} AS DOUBLE) AS value, '{u}' AS unit, '{m}' AS measurement FROM notes WHERE kind = {k}" for k, (_, found) in enumerate(SENTENCES) for v, u, m in found))
def effect_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a note states: 298 K is a setting like any other here."""
    notes = table(spark, sf_dir, "events").selectExpr(*_NOTES)
    note = F.expr("CASE kind " + " ".join(f"WHEN {k} THEN {_sentence(t)}" for k, (t, _) in enumerate(SENTENCES)) + " END")
    return notes.select("event_id", F.explode(readings.stated_measurements(note)).alias("m")).select("event_id", "m.value", "m.unit", "m.measurement")


_CUES = ("vs", "versus", "compared to", "relative to", "in contrast to", "in the control group", "after placebo", "in the treatment group", "at baseline")
_ARMS = ("event_id", _A, _B, "CAST(5 + event_id % 60 AS VARCHAR(9)) AS n", "CASE event_id % 9 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CUES)) + " END AS cue")


@query("effect_pairs", f"WITH arms AS (SELECT {', '.join(_ARMS)} FROM events) SELECT event_id, CAST(a AS DOUBLE) AS m1, CAST(b AS DOUBLE) AS sd1, 7.0::DOUBLE AS m2, 0.5::DOUBLE AS sd2, CAST(n AS INT) AS n1, 0.03::DOUBLE AS p_value, cue AS comparison, 'mg' AS unit FROM arms".replace("cue AS comparison", "CASE event_id % 9 WHEN 5 THEN 'control group' WHEN 6 THEN 'placebo' WHEN 7 THEN 'treatment group' WHEN 8 THEN 'baseline' ELSE cue END AS comparison"))
def effect_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = table(spark, sf_dir, "events").selectExpr(*_ARMS)
    note = F.expr("concat('loss of ', a, ' ± ', b, ' mg here ', cue, ' 7.0 ± 0.5 mg (n = ', n, ', p = 0.03)')")
    return arms.select("event_id", F.explode(readings.effect_pairs(note)).alias("p")).select("event_id", "p.m1", "p.sd1", "p.m2", "p.sd2", "p.n1", "p.p_value", "p.comparison", "p.unit")


@query("simple_effects", """SELECT event_id, (event_id % 400) / 4.0 AS mean, (event_id % 40) / 4.0 AS sd, (event_id % 50) AS events, (event_id % 50 + 20) AS total FROM events""")
def simple_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = lambda n: (F.col("event_id") % n / 4).cast("decimal(18,2)").cast("string")
    note = F.concat(F.lit("mean "), quarter(400), F.lit(" ± "), quarter(40), F.lit(" and "), (F.col("event_id") % 50).cast("string"), F.lit("/"), (F.col("event_id") % 50 + 20).cast("string"), F.lit(" patients"))
    e = table(spark, sf_dir, "events").select("event_id", extraction.simple_effects(note).alias("e"))
    return e.select("event_id", F.col("e.means")[0]["mean"].alias("mean"), F.col("e.means")[0]["sd"].alias("sd"), F.col("e.events")[0]["events"].cast("long").alias("events"), F.col("e.events")[0]["total"].cast("long").alias("total"))


@query("method_words")
def method_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit("A randomized double-blind pilot study, n = "), F.col("event_id").cast("string"), F.lit(", over 12 weeks, ANOVA of "), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(extraction.method_words(note)).alias("category", "words")).where(F.size("words") > 0)


@query("citation_alignment", r"""WITH b AS (SELECT conv_id AS id, 'see [' || (conv_id % 9 + 1) || '] and [' || (conv_id % 4 + 1) || ']' AS body, conv_id % 4 + 1 AS a, conv_id % 5 + 1 AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
cited AS (SELECT DISTINCT id, unnest(regexp_extract_all(body, '\[(\d+)\]', 1))::INT AS number FROM b), listed AS (SELECT DISTINCT id, unnest([a, c])::INT AS number FROM b)
SELECT id, number, cited.number IS NOT NULL AS cited, listed.number IS NOT NULL AS listed FROM cited FULL JOIN listed USING (id, number)""")
def citation_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    number = lambda m: (c % m + 1).cast("string")
    body = F.concat(F.lit("see ["), number(9), F.lit("] and ["), number(4), F.lit("]\n## References\n["), number(4), F.lit("] x\n["), number(5), F.lit("] y\n"))
    briefs = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(c.alias("brief_id"), body.alias("body"))
    return extraction.citation_check(briefs)


@query("unsupported_numbers", """WITH b AS (SELECT p_partkey AS id, (p_partkey % 97 + 0.25)::DOUBLE AS value FROM part), e AS (SELECT DISTINCT p_size::DOUBLE AS v FROM part) SELECT id, value FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE abs(v - value) <= 0.5)""")
def unsupported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    briefs = p.select(F.col("p_partkey").alias("brief_id"), F.concat(F.lit("about "), (F.col("p_partkey") % 97).cast("string"), F.lit(".25 units")).alias("body"))
    return extraction.unsupported_numbers(briefs, p.select(F.col("p_size").cast("double").alias("value")).distinct())


@query("spelling_repairs")
def spelling_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(X.words(F.col("text"), "[a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return extraction.spelling(words.where("n = 1").select(F.col("word").alias("token")), words.where("n >= 20").select("word"))


@query("harvested_dois", """SELECT page_id, '10.1234/abc.' || page_id AS doi FROM pages""")
def harvested_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see (https://doi.org/10.1234/ABC."), F.col("page_id").cast("string"), F.lit(")."))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(X.harvest_dois(text)).alias("doi"))


@query("inverted_abstracts", "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS abstract FROM documents")
def inverted_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text to its index from word to places, and back; an index is made where its text lies."""
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    placed = table(spark, sf_dir, "documents").select("doc_id", F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))).alias("s"))
    rows = X.with_runs(placed, "s", "word")
    places = F.transform("runs", lambda r: F.struct(F.get("s", r["at"])["word"], F.transform(F.slice("s", r["at"] + 1, r["size"]), lambda x: x["at"])))
    index = rows.select("doc_id", F.when(F.col("s").isNotNull(), F.map_from_entries(places)).alias("index"))
    return index.select("doc_id", X.inverted_abstract(F.col("index")).alias("abstract"))


@query("island_ranges", """WITH n AS (SELECT DISTINCT l_suppkey, l_partkey AS x FROM lineitem), g AS (SELECT l_suppkey, x, x - row_number() OVER (PARTITION BY l_suppkey ORDER BY x) AS i FROM n),
r AS (SELECT l_suppkey, i, min(x) AS a, max(x) AS b FROM g GROUP BY ALL) SELECT l_suppkey, string_agg(CASE WHEN a = b THEN a::VARCHAR WHEN b = a + 1 THEN a || ', ' || b ELSE a || '–' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1""")
def island_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("x"))
    return rows.select("l_suppkey", X.island_ranges(F.col("x")).alias("ranges"))


@query("one_edit_names", "SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND damerau_levenshtein(a.n_name, b.n_name) <= 1")
def one_edit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(F.broadcast(b), (F.col("i") < F.col("j")) & X.within_one_edit(F.col("a"), F.col("b"))).select("a", "b")


@query("pico_and_sections")
def pico_and_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit("METHODS: Patients with "), F.col("event_type"), F.lit(" were treated with drug A compared to placebo. RESULTS: The Magnetic Resonance Imaging (MRI) score improved by 3 points. CONCLUSIONS: We conclude that dose matters for 12 patients."))
    e = table(spark, sf_dir, "events").select("event_id", extraction.pico(note).alias("p"), extraction.sections(note).alias("s"), extraction.abbreviations(note).alias("a"), extraction.cue_sentence(note, "we conclude").alias("finding"))
    return e.select("event_id", F.col("p.population").alias("population"), F.col("p.comparison").alias("comparison"), F.col("s")["results"].alias("results"), F.col("a")["MRI"].alias("mri"), "finding")


@query("arm_comparisons")
def arm_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.format_string("yield of %.1f ± 2.0 %% in the heated arm versus %.1f ± 1.5 %% in the control arm", F.abs("value"), F.abs("value") / 2)
    return table(spark, sf_dir, "events").select("event_id", F.explode(extraction.comparisons(note)).alias("c")).select("event_id", "c.*")


@query("table_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE round(l_extendedprice, 2) END AS number FROM lineitem")
def table_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("l_linenumber") % 4 == 0, "n.d.").otherwise(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "<").otherwise("~"), F.format_number("l_extendedprice", 2), F.lit(" ppm")))
    return extraction.table_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))).drop("raw")


#: Sentences that explain a short form of three words, in five ways, and one that does not.
_NAMES = ("p_partkey", "p_partkey % 6 AS kind", "lower(split_part(p_name, ' ', 1)) AS a", "lower(split_part(p_name, ' ', 2)) AS b")
_SHORT, _LONG = "upper(concat(substr(a, 1, 1), substr(b, 1, 1), 'x'))", "concat(a, ' ', b, ' xylem')"


@query("abbreviations", f"WITH t AS (SELECT {', '.join(_NAMES)} FROM part) SELECT p_partkey, {_SHORT} AS short, {_LONG} AS long FROM t WHERE kind < 5")
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").selectExpr(*_NAMES).withColumns({"short": F.expr(_SHORT), "long": F.expr(_LONG)})
    note = F.expr("""CASE kind WHEN 0 THEN concat('We looked at the ', long, ' (', short, ') twice.') WHEN 1 THEN concat('By ', short, ' (', long, ') it rose.') WHEN 2 THEN concat('Here ', short, ' stands for ', long, '.')
      WHEN 3 THEN concat('It is the ', long, ', hereafter ', short, '.') WHEN 4 THEN concat('the ', initcap(long), ' was seen, and ', short, ' again') ELSE 'No short form (see page 3) is explained here.' END""")
    return t.select("p_partkey", F.explode(short_forms.abbreviations(note)).alias("short", "long"))


_PARTS = {
    "introduction": "concat('1. Introduction', chr(10), text)", "methods": "concat('Materials and Methods', chr(10), lang, ' ', text)", "results": "concat('RESULTS', chr(10), n_chars, ' characters were counted in the text that is given above')", "area": "concat('2 Study area', chr(10), text)",
}
_FULL = f"concat('Said before any heading', chr(10), {', chr(10), '.join(_PARTS.values())}, chr(10), 'References', chr(10), text, chr(10), 'Conclusions: short')"


@query("text_sections", "WITH p AS (SELECT doc_id, " + ", ".join(f"trim({c}, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))) AS {n}" for n, c in _PARTS.items()) + f""" FROM documents WHERE text IS NOT NULL AND length({_FULL}) >= 200),
s AS (SELECT doc_id, 'introduction' AS section, CASE WHEN length(introduction) > 50 THEN introduction END AS body FROM p UNION ALL SELECT doc_id, 'results', CASE WHEN length(results) > 50 THEN results END FROM p
  UNION ALL SELECT doc_id, 'methods', concat_ws(concat(chr(10), chr(10)), CASE WHEN length(methods) > 50 THEN methods END, CASE WHEN length(area) > 50 THEN area END) FROM p)
SELECT doc_id, section, length(body)::INT AS chars, sha256(body) AS digest FROM s WHERE body <> ''""")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.when(F.col("text").isNotNull(), F.expr(_FULL))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(fulltext.sections(full)).alias("section", "body"))
    return d.select("doc_id", "section", F.char_length("body").alias("chars"), F.sha2("body", 256).alias("digest"))


#: Questions about parts: the whole name, its second word alone, both words apart, or neither. A name's words are names themselves.
_ASKED = """CASE p_partkey % 4 WHEN 0 THEN concat('An overview of the ', p_name, ' at depth') WHEN 1 THEN concat('How to classify any ', split_part(p_name, ' ', 2), '?') WHEN 2 THEN concat(split_part(p_name, ' ', 2), ' that is ', split_part(p_name, ' ', 1)) ELSE 'Springwidgets in general' END AS query"""


def _named_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, name, canonical, position): whole names and their second words as items, first words as looks."""
    p = table(spark, sf_dir, "part").select("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b"))
    rows = [p.select(F.lit("item").alias("slot"), F.col("p_name").alias("name"), F.col("p_name").alias("canonical"), F.lit(1).alias("position")), p.select(F.lit("item"), "b", "b", F.lit(2)), p.select(F.lit("item"), F.concat("b", F.lit("s")), "b", F.lit(3)), p.select(F.lit("look"), "a", "a", F.lit(4))]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3]).distinct()


@query("query_intents", f"""WITH q AS (SELECT p_partkey, p_partkey % 4 AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_name, {_ASKED} FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN p_name WHEN 1 THEN b WHEN 2 THEN b END AS item, CASE WHEN k IN (0, 2) THEN a END AS look, CASE k WHEN 0 THEN 'review' WHEN 1 THEN 'identification' END AS goal, k < 3 AS understood,
  CASE k WHEN 0 THEN query || ' ' || p_name || ' ' || a WHEN 1 THEN query || ' ' || b || ' ' || b || 's' WHEN 2 THEN query || ' ' || b || ' ' || b || 's ' || a ELSE query END AS expanded FROM q""")
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = table(spark, sf_dir, "part").selectExpr("p_partkey", _ASKED), _named_things(spark, sf_dir)
    found = intent.intents(q, v, "p_partkey", "query", ("item",))
    wide = intent.expanded(q, v, "p_partkey", "query").withColumnRenamed("id", "eid")
    return found.join(wide, F.col("id") == F.col("eid")).select(F.col("id").alias("p_partkey"), F.col("slots")["item"].alias("item"), F.col("slots")["look"].alias("look"), "goal", "understood", "expanded")
