"""The tables behind a brief."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import briefs, meta
from .papers import MEASURED_SQL, measured, papers
from .registry import query, table


@query("short_authors", """WITH n AS (SELECT DISTINCT o_custkey, CASE WHEN o_orderpriority LIKE '%-LOW' THEN 'Low' ELSE 'High' END AS n FROM orders WHERE o_orderpriority LIKE '%-LOW' OR o_orderpriority LIKE '%-HIGH')
SELECT o_custkey, string_agg(n, ' & ' ORDER BY n) AS author FROM n GROUP BY 1""")
def short_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '%-LOW' OR o_orderpriority LIKE '%-HIGH'")
    names = o.groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("J. "), F.element_at(F.split("o_orderpriority", "-"), -1)))).alias("names"))
    return names.select("o_custkey", briefs.short_author(F.col("names")).alias("author"))


@query("reference_list", "SELECT c_custkey AS number, '[' || c_custkey || '] Lee (' || CASE WHEN c_custkey % 2 = 0 THEN '2001' ELSE 'n.d.' END || '). ' || c_name || '.' || CASE WHEN c_custkey % 3 = 0 THEN ' DOI:[10.1/x](https://doi.org/10.1/x)' ELSE '' END AS line FROM customer")
def reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("number"), F.array(F.lit("Ann LEE")).alias("names"), F.when(k % 2 == 0, 2001).alias("year"), F.col("c_name").alias("title"), F.when(k % 3 == 0, "10.1/x").alias("doi"))
    return briefs.reference_list(c)


@query("provenance_routes", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'web rescue' WHEN c_custkey % 3 = 0 THEN 'source:openalex' ELSE 'source:?' END AS route FROM customer")
def provenance_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return briefs.provenance_route(table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, "web rescue").otherwise("").alias("discovery_provenance"), F.when(k % 3 == 0, "openalex").alias("source"))).select("c_custkey", "route")


@query("finding_gate")
def finding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = papers(spark, sf_dir).select("paper_id", briefs.good_title(F.col("title")).alias("good_title"), F.explode(X.sentences(F.col("abstract"))).alias("finding"))
    return told.groupBy("paper_id", "good_title").agg(F.count("*").alias("n"), F.count_if(briefs.good_finding(F.col("finding"))).alias("n_good"))


@query("limitations", "SELECT event_id AS id, 'The estimate may not hold for ' || event_type AS limitation FROM events WHERE event_id % 2 = 0")
def limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit("We measured things. "), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("The estimate may not hold for "), "event_type")).otherwise("All is well known here"), F.lit(". A caveat too."))
    return briefs.limitations(table(spark, sf_dir, "events").select("event_id", note.alias("note")), "note", "event_id")


@query("finding_relations")
def finding_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit("Heating of garnet samples gives values "), F.element_at(F.array(*map(F.lit, ("that confirm them", "however that differ", "and further", "as before"))), (F.col("turn") % 4 + 1).cast("int")))
    return briefs.relation(table(spark, sf_dir, "conversations").select("conv_id", "turn", note.alias("finding")), "conv_id", ["turn"]).select("conv_id", "turn", "relation")


@query("normalised_measurements", f"WITH {MEASURED_SQL}, k AS (SELECT seq, CASE unit WHEN 'K' THEN value - 273.15 + 300 WHEN '°C' THEN value WHEN 'kbar' THEN value WHEN 'GPa' THEN value * 10 END AS v, unit FROM measured) SELECT seq, round(v, 6) AS value, CASE WHEN unit IN ('K', '°C') THEN '°C' ELSE 'kbar' END AS unit FROM k WHERE unit IN ('K', '°C', 'kbar', 'GPa') AND CASE WHEN unit IN ('K', '°C') THEN v BETWEEN -50 AND 2500 ELSE v BETWEEN 0 AND 400 END")
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measured(spark, sf_dir).where("unit IN ('K', '°C', 'kbar', 'GPa')").withColumn("value", F.when(F.col("unit") == "K", F.col("value") + 300).otherwise(F.col("value")))
    return briefs.normalised_measurements(m).select("seq", F.round("value", 6).alias("value"), "unit")


def _case(column: str, bands: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {column} >= {a} AND {column} < {b} THEN '{n}'" for a, b, n in bands) + " END"


@query("interpretation_bands", f"""WITH v AS (SELECT l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'temperature' ELSE 'pressure' END AS m, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 20 ELSE l_quantity / 2 END AS x FROM lineitem), q AS (SELECT l_suppkey, m, list(x ORDER BY x) AS l FROM v GROUP BY ALL),
w AS (SELECT l_suppkey, max(CASE WHEN m = 'temperature' THEN l[len(l) // 2 + 1] END) AS temperature, max(CASE WHEN m = 'pressure' THEN l[len(l) // 2 + 1] END) AS pressure FROM q GROUP BY 1), g AS (SELECT *, temperature / pressure AS gradient FROM w)
SELECT l_suppkey, temperature, pressure, {_case('temperature', briefs.TEMPERATURE_BANDS)} AS temperature_band, {_case('pressure', briefs.PRESSURE_BANDS)} AS pressure_band, round(gradient, 6) AS gradient, {_case('gradient', briefs.GRADIENT_BANDS)} AS gradient_band FROM g""")
def interpretation_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("l_linenumber") % 2 == 0
    v = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(even, "temperature").otherwise("pressure").alias("measurement"), F.when(even, F.col("l_quantity") * 20).otherwise(F.col("l_quantity") / 2).alias("value"))
    return briefs.interpret(v, ["l_suppkey"]).withColumn("gradient", F.round("gradient", 6))


@query("known_offsets", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM events")
def known_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit("Ferry calibration"), F.when(F.col("event_id") % 3 == 0, " against Holdaway").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", F.size(briefs.known_offsets(note)).alias("n"))


@query("entity_kinds", "SELECT n_nationkey, ['locality', 'material', 'method', 'organism', 'concept'][n_nationkey % 5 + 1] AS kind FROM nation")
def entity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("a district in the north", "a rock of the crust", "a software package", "a genus of plants", "an idea"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", briefs.entity_kind(text).alias("kind"))


@query("related_values", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' OR l_linestatus = 'X' OR l_returnflag = 'A'")
def related_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("tag"))
    tags = spark.createDataFrame([("A", 0.4), ("R", 0.1)], "tag string, likeness double")
    return briefs.related_values(v, tags).select("l_orderkey", "l_linenumber")


@query("alias_extension", "SELECT lower(r_name) AS term, count(n_name) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def alias_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    aliases = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("term"), F.col("n_name").alias("alias"))
    return briefs.extend_aliases(r.select(F.col("r_name").alias("term")), aliases).select("term", F.size("aliases").cast("long").alias("n"))


@query("template_boosts", "SELECT doc_id, round((CASE WHEN contains(lower(text), 'thing') THEN 1.5::DOUBLE ELSE 1 END) * (CASE WHEN contains(lower(text), 'eren') THEN 1.2 ELSE 1 END), 6)::DOUBLE AS boost FROM documents WHERE NOT contains(lower(text), 'worthless')")
def template_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame([("thing", 1.5), ("Eren", 1.2), ("worthless", 0.0)], "word string, factor double")
    return briefs.boosted(table(spark, sf_dir, "documents").select("doc_id", "text"), templates, F.col("text")).select("doc_id", F.round("boost", 6).alias("boost"))


@query("token_fixes", "SELECT event_id, CASE event_type WHEN 'view' THEN 'see' ELSE event_type END AS fixed FROM events")
def token_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("VIEW", "see")], "from string, to string")
    return briefs.expand_tokens(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("token")), d).select("event_id", "fixed")


@query("ambiguous_terms", "SELECT lower(r_name) AS token, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1 HAVING count(*) > 1")
def ambiguous_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    senses = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("term"), F.col("n_name").alias("sense"))
    return briefs.ambiguous(r.select(F.col("r_name").alias("token")), senses).select("token", F.size("senses").cast("long").alias("n"))


@query("two_edit_repairs")
def two_edit_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(X.words(F.col("text"), "[a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return briefs.repairs(words.where("n = 1").select(F.col("word").alias("token")), words.where("n >= 5").select("word"))


@query("model_answers", "SELECT event_id, event_type AS kind, (event_id % 7)::INT AS n FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 4 = 0")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    answer = F.when(k % 4 == 0, "no answer").otherwise(F.concat(F.lit('Thinking...\n```json\n{"kind": "'), "event_type", F.lit('", "n": '), (k % 7).cast("string"), F.lit(",}\n```")))
    j = table(spark, sf_dir, "events").select("event_id", briefs.json_of(answer, "struct<kind:string,n:int>").alias("j"))
    return j.select("event_id", "j.kind", "j.n")


@query("model_preferred", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'model' ELSE event_type END AS kind, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS n FROM events")
def model_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("event_id"), F.array().cast("array<string>")
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.array(F.lit("a"), F.lit("b")).alias("list"), F.when(k % 2 == 0, "model").otherwise("").alias("model_kind"), F.when(k % 3 == 0, F.array(F.lit("m"))).otherwise(none).alias("model_list"))
    return briefs.prefer_model(e, ["kind", "list"]).select("event_id", "kind", F.size("list").alias("n"))


@query("alumina_saturation", "WITH s AS (SELECT l_suppkey, avg(l_quantity / (l_quantity / 3 + l_linenumber + 5)) AS ratio, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_linenumber > 1 GROUP BY 1) SELECT l_suppkey, n, round(ratio, 6) AS ratio, CASE WHEN ratio > 1 THEN 'peraluminous' WHEN ratio > 0.9 THEN 'metaluminous' ELSE 'subaluminous' END AS name FROM s")
def alumina_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("Al2O3"), (F.col("l_quantity") / 3).alias("CaO"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).otherwise(0).alias("Na2O"), F.lit(5.0).alias("K2O"))
    return briefs.alumina_saturation(s, ["l_suppkey"]).withColumn("ratio", F.round("ratio", 6))


@query("discourse_scores", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS score FROM events")
def discourse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.element_at(F.array(*map(F.lit, ("these confirm it", "however they say no", "confirm, however"))), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", briefs.discourse_score(note).alias("score"))


@query("compact_corpus", "SELECT doc_id AS paper_id FROM documents ORDER BY doc_id LIMIT 50")
def compact_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefs.compact(papers(spark, sf_dir)).select("paper_id")


@query("decade_spread")
def decade_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1e5).alias("effect"), F.lit(0.01).alias("variance"), F.year("o_orderdate").alias("year"))
    return briefs.decade_spread(meta.decade_pools(s, ["o_orderpriority"]), ["o_orderpriority"])
