"""Claims, contradictions, stance, timelines, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clustering, density, evidence, stance_model
from .papers import MEASURED_SQL, PAPERS_SQL, measured, papers
from .registry import query, table

_CLAIMS = f"{MEASURED_SQL}, c AS (SELECT event_type AS quantity, unit, paper_id AS paper_key, value, seq FROM measured)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select(F.col("event_type").alias("quantity"), "unit", F.col("paper_id").alias("paper_key"), "value", "seq")


@query("contradictions", f"""WITH {_CLAIMS}, g AS (SELECT quantity, unit, count(DISTINCT paper_key) AS n_papers, min(value) AS lo, max(value) AS hi FROM c GROUP BY ALL)
SELECT quantity, unit, n_papers, round(hi - lo, 4) AS spread, round(hi / lo, 2) AS ratio FROM g WHERE n_papers >= 2 AND lo > 0 AND hi / lo >= 5""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.contradictions(claims(spark, sf_dir)).drop("values").withColumn("spread", F.round("spread", 4))


@query("numeric_claims", f"""WITH {_CLAIMS} SELECT paper_key, quantity, unit, floor(value / 2)::BIGINT AS cell, min_by(CASE WHEN seq % 3 = 0 THEN 'fulltext' ELSE 'abstract' END, (CASE WHEN seq % 3 = 0 THEN 1000000000 ELSE 0 END) + seq) AS source FROM c GROUP BY ALL""")
def numeric_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims(spark, sf_dir).withColumns({"value": F.floor(F.col("value") / 2), "source": F.when(F.col("seq") % 3 == 0, "fulltext").otherwise("abstract"), "sentence": F.col("seq").cast("string")})
    return evidence.numeric_claims(rows).select("paper_key", "quantity", "unit", F.col("value").alias("cell"), "source")


@query("adjacent_gaps", """WITH v AS (SELECT l_suppkey AS claim, CASE l_linenumber % 3 WHEN 0 THEN 'temperature' WHEN 1 THEN 'pressure' ELSE 'other' END AS metric, l_extendedprice / 100 AS value, l_orderkey AS ref FROM lineitem),
n AS (SELECT *, lead(value) OVER w AS v2, lead(ref) OVER w AS ref2 FROM v WINDOW w AS (PARTITION BY claim, metric ORDER BY value, ref)), g AS (SELECT *, v2 - value AS delta, (v2 - value) / abs((v2 + value) / 2) AS rel, CASE metric WHEN 'temperature' THEN 0.15 WHEN 'pressure' THEN 0.20 ELSE 0.25 END AS lim, CASE metric WHEN 'temperature' THEN 50 WHEN 'pressure' THEN 1 ELSE 0 END AS least FROM n WHERE v2 IS NOT NULL)
SELECT claim, metric, ref, ref2, round(delta, 4) AS delta, round(rel, 6) AS relative, CASE WHEN rel > 2 * lim THEN 'severe' ELSE 'moderate' END AS severity FROM g WHERE delta >= least AND rel > lim""")
def adjacent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.when(F.col("l_linenumber") % 3 == 0, "temperature").when(F.col("l_linenumber") % 3 == 1, "pressure").otherwise("other")
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("claim"), metric.alias("metric"), (F.col("l_extendedprice") / 100).alias("value"), F.col("l_orderkey").alias("ref"))
    return evidence.adjacent_gaps(v, ["claim"]).select("claim", "metric", "ref", "ref2", F.round("delta", 4).alias("delta"), F.round("relative", 6).alias("relative"), "severity")


@query("evidence_grades", """WITH s AS (SELECT c_custkey, c_custkey % 13 AS n, CASE c_custkey % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' WHEN 2 THEN 'uncertain' ELSE 'contested' END AS a, c_custkey % 2 = 0 AS e, c_custkey % 3 = 0 AS m, c_custkey % 5 = 0 AS x FROM customer),
p AS (SELECT c_custkey, round(least(greatest(CASE WHEN n >= 10 THEN 0.35 WHEN n >= 5 THEN 0.25 WHEN n >= 3 THEN 0.15 WHEN n >= 1 THEN 0.05 ELSE 0 END + CASE a WHEN 'strong' THEN 0.30 WHEN 'moderate' THEN 0.20 WHEN 'uncertain' THEN 0.10 ELSE 0.05 END + CASE WHEN e THEN 0.20 WHEN m THEN 0.12 ELSE 0.03 END - CASE WHEN x THEN 0.15 ELSE 0 END, 0), 1), 2)::DOUBLE AS score FROM s)
SELECT c_custkey, score, CASE WHEN score >= 0.8 THEN 'A' WHEN score >= 0.6 THEN 'B' WHEN score >= 0.4 THEN 'C' ELSE 'D' END AS grade FROM p""")
def evidence_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    agreed = F.element_at(F.array(*map(F.lit, ("strong", "moderate", "uncertain", "contested"))), (k % 4 + 1).cast("int"))
    g = table(spark, sf_dir, "customer").select("c_custkey", evidence.evidence_grade(k % 13, agreed, k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("g"))
    return g.select("c_custkey", "g.score", "g.grade")


@query("claim_table")
def claim_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    items = c.select(F.concat_ws("/", "quantity", "unit").alias("cluster"), F.col("seq").alias("ref"), F.concat(F.lit("an experimental value of "), F.col("value").cast("string")).alias("finding"), F.lit("other").alias("metric"), "value")
    return evidence.claim_table(items).select("cluster", F.size("refs").alias("n_refs"), "consensus", "grade", "score")


@query("claim_matrix")
def claim_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.claim_matrix(papers(spark, sf_dir), ["thionea erenan", "the thing that eren"])


@query("timeline", f"""WITH {PAPERS_SQL}, c AS (SELECT list(citation_count ORDER BY citation_count) AS l FROM papers WHERE citation_count > 0), t AS (SELECT l[len(l) * 3 // 4 + 1] AS bar FROM c)
SELECT paper_id AS id, coalesce(year, 0) AS year, citation_count AS citations, citation_count >= bar AND citation_count > 0 AS milestone FROM papers, t""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.timeline(papers(spark, sf_dir))


@query("reference_numbers", f"WITH {PAPERS_SQL} SELECT paper_id AS id, row_number() OVER (ORDER BY coalesce(year, 9999), lower(coalesce(title, '')), paper_id) AS number FROM papers")
def reference_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.reference_numbers(papers(spark, sf_dir))


@query("paragraph_breaks")
def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir).where("year IS NOT NULL").withColumn("tokens", X.content_words(F.col("abstract")))
    return evidence.paragraph_breaks(p, "venue", ["year", "paper_id"]).select("paper_id", "breaks")


@query("stance")
def stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.element_at(F.array(*map(F.lit, ("These data confirm the model.", "This does not confirm the earlier report; however, it may differ.", "We used the method.", "They reported values.", ""))), (F.col("turn") % 5 + 1).cast("int"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", note.alias("context"))
    return evidence.stance(c, "context")


@query("context_summaries", """WITH s AS (SELECT conv_id, CASE WHEN turn % 4 = 0 THEN 's' WHEN turn % 4 = 2 AND conv_id % 5 = 0 THEN 'c' ELSE 'm' END AS k FROM conversations), c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (k = 's') AS supporting, count(*) FILTER (k = 'c') AS contrasting FROM s GROUP BY 1)
SELECT conv_id, n, supporting, contrasting, n - supporting - contrasting AS mentioning, CASE WHEN supporting > 3 AND contrasting = 0 THEN 'consensus' WHEN contrasting > 0 THEN 'contested' WHEN supporting + contrasting < 3 THEN 'emerging' ELSE 'consensus' END AS signal FROM c""")
def context_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("turn") % 4 == 0, "supporting").when((F.col("turn") % 4 == 2) & (F.col("conv_id") % 5 == 0), "contrasting").otherwise("mentioning")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("context"), label.alias("stance"), F.lit(0.9).alias("stance_confidence"))
    return evidence.context_summary(rows, "conv_id").drop("for", "against")


@query("stance_scores", "SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN 0.3 * s + 0.6 * d + 0.1 * m WHEN c < 0.5 THEN 0.3 * s + 0.5 * d + 0.2 * m ELSE 0.5 * s + 0.3 * d + 0.2 * m END, 6)::DOUBLE AS score FROM (SELECT event_id, (event_id % 10) / 10.0 AS c, CASE event_id % 3 WHEN 0 THEN (event_id % 10) / 10.0 WHEN 1 THEN -(event_id % 10) / 10.0 ELSE 0 END AS s, (event_id % 7) / 7.0 - 0.5 AS d, (event_id % 5) / 5.0 - 0.4 AS m FROM events)")
def stance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, ("supporting", "contrasting", "mentioning"))), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.round(evidence.combined_stance(name, k % 10 / 10, k % 7 / 7 - 0.5, k % 5 / 5 - 0.4, k % 4 == 0), 6).alias("score"))


@query("verdicts", "SELECT c_custkey, CASE WHEN c_custkey % 7 < 2 THEN 'Insufficient' WHEN s > 0 AND c = 0 THEN 'Supported' WHEN c > 0 AND s = 0 THEN 'Contradicted' WHEN s >= 2 * c THEN 'Mostly supported' WHEN c >= 2 * s THEN 'Mostly contradicted' ELSE 'Contested' END AS verdict FROM (SELECT c_custkey, c_custkey % 5 AS s, c_custkey % 3 AS c FROM customer)")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", evidence.verdict(k % 5, k % 3, k % 7).alias("verdict"))


@query("entity_comparison", f"WITH {PAPERS_SQL}, x AS (SELECT contains(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), 'thing') AS a, contains(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), 'eren') AS b FROM papers) SELECT count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (a AND b) AS both, count(*) FILTER (a OR b) AS either FROM x")
def entity_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.entity_comparison(papers(spark, sf_dir), "thing", "Eren")


@query("finding_pairs", """WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 3)) AS s FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS score FROM t a, t b WHERE a.item_id < b.item_id AND len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.05""")
def finding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.filter(X.words(F.col("text"), "[a-z]+"), lambda w: F.length(w) > 3)).alias("t"))
    return clustering.pair_scores(b, "item_id", "t", least=0.05).withColumn("score", F.round("score", 6))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as findings of a conversation: (conv_id, turn, id, t), their distinct words in t."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.concat_ws("/", "conv_id", F.lpad(F.col("turn").cast("string"), 10, "0")).alias("id"), F.array_distinct(X.words(F.col("text"), "[a-z]+")).alias("t"))


@query("leader_clusters")
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = turns(spark, sf_dir)
    return clustering.leaders(said, clustering.pair_scores(said, "id", "t", ["conv_id"], 0.1), "id", "conv_id")


@query("agreement_groups")
def agreement_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = turns(spark, sf_dir).withColumn("value", (F.col("turn") % 7).cast("double"))
    return clustering.agreement_groups(said, clustering.pair_scores(said, "id", "t", ["conv_id"], 0.1), "id", "conv_id")


@query("distinctive_terms", """WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS tf FROM t GROUP BY ALL), h AS (SELECT term, count(*) AS df FROM c GROUP BY 1), s AS (SELECT lang, sum(tf) AS a FROM c GROUP BY 1), n AS (SELECT count(DISTINCT lang) AS n FROM documents),
r AS (SELECT lang, term, tf::DOUBLE / a * (ln((1.0 + n) / (1 + df)) + 1) AS score FROM c JOIN h USING (term) JOIN s USING (lang), n) SELECT lang, term, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS k FROM r) WHERE k <= 3""")
def distinctive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", X.words(F.col("text"), "[a-z]{5,}").alias("t"))
    return clustering.distinctive_terms(d, "lang", "t").withColumn("score", F.round("score", 8))


#: How sentences of each stance begin; what follows is said in a conversation.
_SAID = {
    "supporting": ("These data agree with earlier work on", "In line with this, we find again", "Our findings corroborate the view of"), "contrasting": ("This is at odds with what was claimed on", "Contrary to that report we see no", "Earlier results on this fail to hold for"),
    "extending": ("We build on this model and add", "Going further than before, the scheme now covers", "This generalises the earlier case of"), "methodology": ("Samples were polished and analysed by", "A protocol of three steps was run for", "Spectra were calibrated against"), "mentioning": ("A review has listed", "Several authors have written about", "The term is common in texts on"),
}


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, label, context): turns of conversations behind a beginning of one stance."""
    k = F.col("conv_id") * 7 + F.col("turn") * 3
    begin = F.array(*(F.array(*map(F.lit, v)) for v in _SAID.values()))
    said = F.get(F.get(begin, (k % 5).cast("int")), (F.col("conv_id") % 3).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(F.array(*map(F.lit, _SAID)), (k % 5).cast("int")).alias("label"), F.concat_ws(" ", said, "text").alias("context"))


@query("stance_model")
def stance_learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four conversations of five and judges all turns, blended with lexicon and discourse."""
    rows = _sentences(spark, sf_dir)
    held_out = F.col("conv_id") % 5 == 3
    model = stance_model.train(rows.where(~held_out), "context", "label")
    judged = stance_model.lexicon_stance(stance_model.predict(rows, "context", model), "context")
    best = stance_model.blended(F.col("model_scores"), F.col("stance"), F.col("stance_confidence"), F.col("negated"), stance_model.discourse_scores(F.col("context")))
    top = F.array_max(F.transform(F.map_entries("model_scores"), lambda e: F.struct(e["value"], e["key"])))["key"]
    return judged.select("conv_id", "turn", "label", held_out.alias("held_out"), top.alias("model_stance"), best["stance"].alias("blended"), F.round(best["score"], 4).alias("score"))


_BLEND = """WITH e AS (SELECT event_id, (event_id % 10) / 10.0 AS c, event_id % 4 = 0 AS negated, event_id % 6 AS k, (event_id % 9) / 9.0 AS m, event_id % 3 AS d FROM events),
s AS (SELECT e.*, o, stance, CASE WHEN negated THEN 0.3 WHEN greatest(m, (1 - m) / 4) < 0.6 AND k < 5 THEN 0.3 ELSE 0.5 END AS wm, CASE WHEN negated THEN 0.6 WHEN greatest(m, (1 - m) / 4) < 0.6 AND k < 5 THEN 0.5 ELSE 0.3 END AS wl, CASE WHEN negated THEN 0.1 ELSE 0.2 END AS wd
  FROM e, (VALUES (0, 'supporting'), (1, 'contrasting'), (2, 'extending'), (3, 'methodology'), (4, 'mentioning')) AS v(o, stance)),
b AS (SELECT event_id, stance, o, wm * CASE WHEN o = event_id % 5 THEN m ELSE (1 - m) / 4 END + wl * CASE WHEN k = 5 THEN 0.2 WHEN o = k THEN greatest(c, 0.3) / (greatest(c, 0.3) + 0.4) ELSE 0.1 / (greatest(c, 0.3) + 0.4) END + wd * CASE WHEN o = d THEN 1.0 ELSE 0.0 END AS score FROM s)
SELECT event_id, round(max(score), 4)::DOUBLE AS score FROM b GROUP BY 1"""


@query("stance_blend", _BLEND)
def stance_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    names, k = F.array(*map(F.lit, stance_model.STANCES)), F.col("event_id")
    m = k % 9 / 9
    model = F.map_from_arrays(names, F.array(*(F.when(k % 5 == o, m).otherwise((1 - m) / 4) for o in range(5))))
    discourse = F.map_from_arrays(names, F.array(*(F.when(k % 3 == o, 1.0).otherwise(0.0) for o in range(5))))
    best = stance_model.blended(model, F.get(names, (k % 6).cast("int")), k % 10 / 10, k % 4 == 0, discourse)
    return e.select("event_id", F.round(best["score"], 4).alias("score"))


@query("density_clusters", """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS c FROM v x, v y WHERE list_cosine_similarity(x.e, y.e) >= 0.3),
core AS (SELECT a FROM s GROUP BY a HAVING count(*) >= 3), r(a, b) AS (SELECT a, a FROM core UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a WHERE s.b IN (FROM core)), comp AS (SELECT a, min(b) AS cluster FROM r GROUP BY a),
border AS (SELECT a, arg_max(b, c) AS b FROM s WHERE a NOT IN (FROM core) AND b IN (FROM core) GROUP BY a), m AS (SELECT a, cluster, 'core' AS kind FROM comp UNION ALL SELECT border.a, cluster, 'border' FROM border JOIN comp ON border.b = comp.a),
big AS (SELECT cluster FROM m GROUP BY cluster HAVING count(*) >= 3) SELECT vec_id, big.cluster, CASE WHEN big.cluster IS NULL THEN 'noise' ELSE m.kind END AS kind FROM v LEFT JOIN m ON vec_id = m.a LEFT JOIN big ON m.cluster = big.cluster""")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors are noise by nature: at a cosine of 0.3 a part of them forms chains."""
    found = density.density_clusters(spark, table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3, 3, 3)
    return found.withColumnRenamed("id", "vec_id")


@query("context_packing")
def context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.pack(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 20_000, "doc_id")


@query("themes")
def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([("things", "thing", 1.0, 1), ("there", "there", 1.0, 2)], "label string, word string, weight double, position int")
    return clustering.themes(papers(spark, sf_dir), v)
