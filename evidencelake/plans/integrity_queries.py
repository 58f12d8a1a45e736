"""Contract constraints: tables with planted violations, and what the checks report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity
from .registry import query, table


def counted(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query("execution_violations", """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'empty' WHEN 2 THEN 'failed' ELSE 'lost' END AS s, event_id % 3 AS c FROM events)
SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN s = 'succeeded' AND c = 0 THEN 'succeeded without results' END, CASE WHEN s = 'empty' AND c <> 0 THEN 'empty with results' END, CASE WHEN s = 'failed' AND c <> 0 THEN 'failed with results' END, CASE WHEN s = 'failed' AND event_id % 5 <> 0 THEN 'failed without error' END, CASE WHEN s <> 'failed' AND event_id % 5 = 0 THEN 'error without failure' END, CASE WHEN s = 'lost' THEN 'unknown status' END]) AS rule FROM e) WHERE rule IS NOT NULL GROUP BY 1""")
def execution_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("succeeded", "empty", "failed", "lost"))), (k % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(
        k.cast("string").alias("execution_id"), F.lit("p").alias("provider"), F.lit("q").alias("exact_query"), status.alias("status"), (k % 3).alias("result_count"), F.when(k % 5 == 0, "Timeout").alias("error_type"), F.lit("2024-01-01T00:00:00Z").alias("executed_at_utc"),
        F.lit("2024-01-01T00:00:00Z").alias("started_at_utc"), F.lit("2024-01-01T00:00:01Z").alias("finished_at_utc"),
    )
    return counted(integrity.executions(e))


@query("protocol_violations", """WITH p AS (SELECT o_orderkey AS k FROM orders)
SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN k % 6 = 0 OR k % 7 = 0 THEN 'no inclusion criterion' END, CASE WHEN k % 5 = 0 THEN 'no planned source' END, CASE WHEN k % 4 = 0 THEN 'bad exclusion criteria' END, CASE WHEN k % 9 = 0 THEN 'unknown protocol status' END, CASE WHEN k % 8 = 0 THEN 'blank registration' END, CASE WHEN k % 10 = 0 THEN 'time without offset' END, CASE WHEN k % 11 = 0 THEN 'no question' END]) AS rule FROM p) WHERE rule IS NOT NULL GROUP BY 1""")
def protocol_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as protocols: the words of the priority are the criteria, repeated in every seventh."""
    k, words = F.col("o_orderkey"), F.transform(F.split("o_orderpriority", "-"), lambda x: F.trim(x))
    none = F.array().cast("array<string>")
    p = table(spark, sf_dir, "orders").select(
        k.alias("protocol_id"), F.when(k % 11 == 0, " ").otherwise("which?").alias("research_question"), F.when(k % 10 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z").alias("created_at_utc"),
        F.when(k % 6 == 0, none).when(k % 7 == 0, F.concat(words, words)).otherwise(words).alias("inclusion_criteria"), F.when(k % 4 == 0, F.array(F.lit("x"), F.lit(" "))).when(k % 4 == 1, none).alias("exclusion_criteria"),
        F.when(k % 5 == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("planned_sources"), F.when(k % 9 == 0, "lost").otherwise("draft").alias("status"), F.when(k % 8 == 0, "").when(k % 8 == 1, "doi:1").alias("preregistration_uri"),
    )
    return counted(integrity.protocols(p))


@query("source_violations", "SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN c_custkey % 4 = 0 THEN 'no locator' END, CASE WHEN c_custkey % 10 = 0 THEN 'year out of range' END, CASE WHEN c_custkey % 7 = 0 THEN 'bad digest' END]) AS rule FROM customer) WHERE rule IS NOT NULL GROUP BY 1")
def source_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(integrity.sources(sources(spark, sf_dir)))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    digest = F.sha2(k.cast("string"), 256)
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("source_id"), F.col("c_name").alias("title"), none.alias("provider_record_id"), F.when(k % 4 != 0, "10.1/x").alias("doi"), none.alias("url"), F.when(k % 10 == 0, 1200).otherwise(2000).alias("publication_year"), F.when(k % 7 == 0, "abc").otherwise(digest).alias("content_sha256"))


@query("span_violations", """SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN o_custkey > 1400 THEN 'span without source' END, CASE WHEN o_custkey <= 1400 AND o_orderkey % 9 = 0 THEN 'other content version' END, CASE WHEN o_orderkey % 5 = 0 THEN 'offsets do not fit' END, CASE WHEN o_orderkey % 8 = 0 THEN 'no locator' END]) AS rule FROM orders) WHERE rule IS NOT NULL GROUP BY 1""")
def span_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    source = sources(spark, sf_dir).where("cast(source_id AS int) <= 1400").withColumn("content_sha256", F.sha2("source_id", 256))
    spans = o.select(
        k.alias("evidence_id"), F.col("o_custkey").cast("string").alias("source_id"), F.col("o_orderpriority").alias("quote"), F.when(k % 9 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(F.col("o_custkey").cast("string"), 256)).alias("source_sha256"), F.when(k % 8 != 0, "p1").alias("locator"), F.lit(None).cast("string").alias("section"),
        F.lit(None).cast("int").alias("page_number"), F.lit(0).alias("char_start"), (F.length("o_orderpriority") + F.when(k % 5 == 0, 1).otherwise(0)).alias("char_end"),
    )
    return counted(integrity.spans(spans, source))


@query("link_violations", """SELECT rule, count(*) AS n FROM (SELECT 'link without claim' AS rule FROM lineitem WHERE l_suppkey > 90 UNION ALL SELECT 'link without span' FROM lineitem WHERE l_partkey > 1900 UNION ALL SELECT 'reviewed by nobody' FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT 'reviewer of an unreviewed link' FROM lineitem WHERE l_linenumber = 3 UNION ALL SELECT 'link repeats' FROM (SELECT 1 FROM lineitem GROUP BY l_suppkey, l_partkey, l_returnflag HAVING count(*) > 1)) GROUP BY 1""")
def link_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("claim_id"), F.col("l_partkey").alias("evidence_id"), F.col("l_returnflag").alias("relation"), F.lit("r").alias("rationale"), F.when(n == 2, "human_reviewed").otherwise("unreviewed").alias("review_status"), F.when(n == 3, "me").alias("reviewer_id"))
    claims = table(spark, sf_dir, "supplier").where("s_suppkey <= 90").select(F.col("s_suppkey").alias("claim_id"))
    spans = table(spark, sf_dir, "part").where("p_partkey <= 1900").select(F.col("p_partkey").alias("evidence_id"))
    return counted(integrity.links(links, claims, spans))


@query("unlinked_claims", "SELECT c_custkey AS claim_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unlinked_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.unlinked(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("claim_id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("claim_id")))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("l_linenumber"), F.lit(None).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("decision_id"), F.col("l_orderkey").cast("string").alias("source_id"), F.lit("title_abstract").alias("stage"), F.when(F.col("l_returnflag") == "N", "include").otherwise("exclude").alias("decision"), F.concat(F.lit("p"), (k % 2).cast("string")).alias("actor_id"),
        F.lit("human").alias("origin"), F.lit("2024-01-01T00:00:00+00:00").alias("decided_at_utc"), F.when(F.col("l_returnflag") != "A", "r1").alias("reason_code"), none.alias("source_sha256"), none.alias("model_name"), none.alias("model_version"), none.alias("prompt_sha256"), F.when(k == 5, "rule").alias("rule_id"), "l_orderkey", "l_linenumber",
    )


@query("decision_violations", "SELECT rule, count(*) AS n FROM (SELECT 'exclusion without reason' AS rule FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'human with machine data' FROM lineitem WHERE l_linenumber = 5 UNION ALL SELECT 'decision id repeats' FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) GROUP BY 1")
def decision_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(integrity.decisions(decisions(spark, sf_dir)))


@query("adjudication_violations", """WITH d AS (SELECT l_orderkey AS s, count(*) AS n, count(DISTINCT l_linenumber % 2) AS p, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN 'include' ELSE 'exclude' END) AS o, bool_or(l_returnflag = 'N') AS inc FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN n < 2 THEN 'under two decisions' END, CASE WHEN p < 2 THEN 'one person' END, CASE WHEN o > 1 OR NOT inc THEN 'consensus does not fit' END]) AS rule FROM d) WHERE rule IS NOT NULL GROUP BY 1""")
def adjudication_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    a = d.where("l_linenumber <= 2").groupBy("source_id", "stage").agg(F.collect_list("decision_id").alias("decision_ids"))
    a = a.select(F.concat(F.lit("a"), "source_id").alias("adjudication_id"), "source_id", "stage", "decision_ids", F.lit("consensus").alias("status"), F.lit("include").alias("final_decision"), F.lit(None).cast("string").alias("adjudicator_id"))
    return counted(integrity.adjudications(a, d))


@query("dataset_violations", """WITH t AS (SELECT n_nationkey AS a, n_nationkey % 5 + 1 AS least FROM nation), e AS (SELECT s_suppkey, s_nationkey AS a, s_suppkey % 10 = 0 AS odd, s_suppkey % 12 AS study FROM supplier)
SELECT rule, count(*) AS n FROM (SELECT 'too few studies' AS rule FROM t LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) c USING (a) WHERE coalesce(n, 0) < least UNION ALL SELECT 'not comparable with the plan' FROM e WHERE odd UNION ALL SELECT 'study counts twice' FROM (SELECT 1 FROM e GROUP BY a, study HAVING count(*) > 1)) GROUP BY 1""")
def dataset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = {c: F.lit("x") for c in integrity.COMPARABLE} | {"unit": F.lit(None).cast("string")}
    plan = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("analysis_id"), (F.col("n_nationkey") % 5 + 1).alias("minimum_studies")).withColumns(same)
    est = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("effect_id"), F.col("s_nationkey").alias("analysis_id"), (F.col("s_suppkey") % 12).alias("study_id")).withColumns(same)
    est = est.withColumn("timepoint", F.when(F.col("effect_id") % 10 == 0, "y").otherwise("x"))
    return counted(integrity.dataset(plan, est))


@query("plan_violations", "SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN c_custkey % 3 = 0 THEN 'difference without unit' END, CASE WHEN c_custkey % 4 = 0 THEN 'random without estimator' END, CASE WHEN c_custkey % 5 = 0 THEN 'under two studies' END, CASE WHEN c_custkey % 6 = 1 THEN 'arms alike' END]) AS rule FROM customer) WHERE rule IS NOT NULL GROUP BY 1")
def plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    plans = table(spark, sf_dir, "customer").select(
        k.alias("analysis_id"), F.lit("mean_difference").alias("effect_measure"), F.lit("random_effects").alias("pooling_model"), F.when(k % 5 == 0, 1).otherwise(2).alias("minimum_studies"), F.when(k % 3 != 0, "mm").alias("unit"), F.lit("a").alias("intervention_id"), F.when(k % 6 == 1, "a").otherwise("b").alias("comparator_id"),
        F.when(k % 4 != 0, "reml").alias("tau_squared_estimator"), F.lit("normal").alias("confidence_interval_method"),
    )
    return counted(integrity.plans(plans))


@query("estimate_violations", "SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN s_acctbal <= 0 THEN 'no error' END, CASE WHEN s_suppkey % 3 = 0 THEN 'interval does not hold the estimate' END, CASE WHEN s_suppkey % 4 = 0 THEN 'half an interval' END]) AS rule FROM supplier) WHERE rule IS NOT NULL GROUP BY 1")
def estimate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(k.alias("effect_id"), F.lit(1.0).alias("estimate"), F.col("s_acctbal").alias("standard_error"), F.when((k % 3 == 0) & (k % 4 != 0), 2.0).when(k % 3 == 0, 2.0).otherwise(0.0).alias("ci_lower"), F.when(k % 4 != 0, 3.0).alias("ci_upper"), F.lit(None).cast("int").alias("n_intervention"), F.lit(None).cast("int").alias("n_comparator"))
    return counted(integrity.estimates(t))


@query("quote_positions", """WITH q AS (SELECT doc_id, substr(text, 1, 12) AS quote, text FROM documents WHERE length(text) >= 40), p AS (SELECT doc_id, strpos(substr(text, 2), quote) = 0 AS once FROM q) SELECT doc_id AS quote_id, CASE WHEN once THEN 0 END AS start, CASE WHEN once THEN 'found' ELSE 'ambiguous' END AS status FROM p""")
def quote_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("length(text) >= 40")
    pages = d.select(F.col("doc_id").alias("source_id"), F.lit(1).alias("page_number"), "text")
    quotes = d.select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("source_id"), F.substring("text", 1, 12).alias("quote"), F.lit(None).cast("int").alias("page_number"))
    return integrity.locate(pages, quotes).select("quote_id", "start", "status")
