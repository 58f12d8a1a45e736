"""Records: mapping, gates, resolution, merging, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import records, verification
from ..sources import providers
from .papers import PAPERS_SQL, papers
from .registry import query, table


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with all columns of the record schema; every ninth again as a preprint a year later."""
    p = papers(spark, sf_dir)
    author = F.concat(F.element_at(F.array(*map(F.lit, ("Alice Chen", "Bela Kovacs", "Carla Rossi", "Dan Smith", "Eva Berg"))), (F.col("paper_id") % 5 + 1).cast("int")))
    base = p.select(
        F.concat(F.lit("10.5555/"), F.col("paper_id").cast("string")).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), "title", "abstract", "year", "venue", "citation_count", "type", F.array(F.struct(author.alias("name"))).alias("people"),
        (F.col("paper_id") * 2).alias("ingest_pos"), F.lit("crossref").alias("source"), "paper_id",
    )
    again = base.where("paper_id % 9 = 0").withColumns({"doi": F.lit(None).cast("string"), "arxiv_id": F.concat(F.lit("2001."), F.col("paper_id").cast("string")), "abstract": F.lit(None).cast("string"), "year": F.col("year") + 1, "ingest_pos": F.col("ingest_pos") + 1, "source": F.lit("arxiv")})
    rows = base.unionByName(again)
    person = F.transform("people", lambda a: providers._author(a["name"]))
    have = {"authors": person, "sources_seen": F.array("source"), "referenced_works": F.array().cast("array<string>")} | {c: F.col(c) for c in ("doi", "arxiv_id", "title", "abstract", "year", "venue", "citation_count", "type", "source", "ingest_pos")}
    return rows.select(*((have[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in records.PAPER if f.name != "paper_id"), F.col("paper_id").cast("string").alias("paper_id"))


@query("deduplicate_papers")
def deduplicate_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.deduplicate(spark, full_records(spark, sf_dir)).select("cluster", "n_records", "paper_id", "doi", "arxiv_id", "title", "year", "source", "sources_seen")


@query("junk_records", f"""WITH {PAPERS_SQL} SELECT paper_id, title IS NULL OR trim(title) = '' OR starts_with(lower(trim(title)), 'supplemental material') AS junk FROM papers""")
def junk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = full_records(spark, sf_dir).where("source = 'crossref'")
    return rows.select(F.col("paper_id").cast("long").alias("paper_id"), records.is_junk().alias("junk"))


@query("supplement_dois", "SELECT s_suppkey, s_suppkey % 3 = 0 AS supplement FROM supplier")
def supplement_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    doi = F.concat(F.lit("10.1000/x"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ".s001").otherwise(".01"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", records.is_supplement(doi).alias("supplement"))


@query("primary_ids", f"""WITH {PAPERS_SQL} SELECT paper_id, CASE WHEN paper_id % 3 = 0 THEN 'doi:10.1/' || paper_id WHEN paper_id % 3 = 1 THEN 'arxiv:2001.' || paper_id ELSE 'title:' || substr(sha256(lower(title)), 1, 16) END AS pid FROM papers""")
def primary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, i = F.lit(None).cast("string"), F.col("paper_id")
    p = papers(spark, sf_dir).select("paper_id", "title", F.when(i % 3 == 0, F.concat(F.lit("10.1/"), i.cast("string"))).when(i % 3 == 1, "").alias("doi"), F.when(i % 3 == 1, F.concat(F.lit("2001."), i.cast("string"))).alias("arxiv_id"), none.alias("pmid"), none.alias("openalex_id"), none.alias("s2_paper_id"))
    return p.select("paper_id", records.primary_id().alias("pid"))


@query("new_papers", f"WITH {PAPERS_SQL} SELECT paper_id, title FROM papers WHERE paper_id NOT IN (SELECT doc_id FROM labels)")
def new_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.new_against(papers(spark, sf_dir).select("paper_id", "title"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id")))


@query("novel_reflections", f"""WITH {PAPERS_SQL}, c AS (SELECT * FROM papers WHERE paper_id % 2 = 0), f AS (SELECT * FROM papers)
SELECT paper_id FROM f WHERE paper_id % 5 <> 0 AND paper_id NOT IN (SELECT paper_id FROM c WHERE paper_id % 5 <> 0) AND lower(substr(title, 1, 80)) NOT IN (SELECT lower(substr(title, 1, 80)) FROM c)""")
def novel_reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir).select("paper_id", "title", F.when(F.col("paper_id") % 5 != 0, F.col("paper_id").cast("string")).alias("doi"))
    return records.novel_reflections(p, p.where("paper_id % 2 = 0")).select("paper_id")


@query("abstract_backfill", """SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN length(text) WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 80 THEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) END AS n, CASE WHEN doc_id % 4 = 0 AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 80 THEN 2 ELSE 1 END AS n_sources FROM documents""")
def abstract_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("doi"), "text")
    have = d.select("doc_id", "doi", F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("abstract"), F.array(F.lit("a")).alias("sources_seen"))
    found = d.select("doi", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("abstract"), F.lit("b").alias("source"))
    return records.backfill(have, found).select("doc_id", F.length("abstract").cast("long").alias("n"), F.size("sources_seen").alias("n_sources"))


@query("verified_extractions", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN l.n WHEN o_orderkey % 3 = 0 THEN l.n END AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'""")
def verified_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    verified = o.select(k.alias("k"), F.concat(F.lit("p"), k.cast("string")).alias("paper_id"), F.when(k % 3 == 0, F.concat(F.lit("10.1/"), k.cast("string"))).alias("doi"), F.when(F.col("o_orderstatus") == "P", "unresolved").otherwise("resolved").alias("verification_status"))
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    i = F.col("l_orderkey").cast("string")
    extracted = n.select(F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("p"), i)).otherwise(F.concat(F.lit("doi:10.1/"), i)).alias("paper_id"), "n")
    return records.by_identifier(verified, extracted, ["n"]).select("k", "n")


@query("local_matches")
def local_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir).select("paper_id", "title", F.when(F.col("paper_id") % 10 == 0, F.col("paper_id").cast("string")).alias("doi"))
    files = p.select(F.col("paper_id").alias("file_id"), "doi", F.concat("title", F.lit(" pdf")).alias("title"))
    return records.local_match(p, files)


@query("merged_authors", """SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1""")
def merged_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as papers of many records, priorities as authors, once abbreviated and once whole."""
    first = F.element_at(F.split("o_orderpriority", "-"), -1)
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("cluster"), F.col("o_orderkey").alias("ingest_pos"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("J. "), F.regexp_replace(first, " ", ""))).otherwise(F.concat(F.lit("Joel "), F.regexp_replace(first, " ", ""))).alias("name"))
    have = {"authors": F.array(providers._author(F.col("name"))), "ingest_pos": F.col("ingest_pos"), "source": F.lit("x"), "sources_seen": F.array(F.lit("x"))}
    rows = o.select("cluster", *((have[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in records.PAPER))
    merged = records.merge_clusters(rows.drop("cluster"), rows.select("ingest_pos", "cluster"))
    return merged.select(F.col("cluster").cast("long").alias("k"), F.size("authors").cast("long").alias("n"))


@query("retraction_status", "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'retracted' WHEN o_orderkey % 7 = 0 THEN 'concern' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'concern' ELSE 'clean' END AS status FROM orders")
def retraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("https://doi.org/10.1/C"), F.col("o_custkey").cast("string")).alias("doi"), verification.retraction(k % 100 == 0, F.when(k % 50 == 0, "Retraction notice"), k % 7 == 0).alias("retraction_status"))
    listed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("10.1/c"), F.col("c_custkey").cast("string")).alias("OriginalPaperDOI"), F.lit("").alias("RetractionDOI"))
    return verification.cross_check(r, verification.retraction_dois(listed)).select("o_orderkey", F.col("retraction_status").alias("status"))


@query("evidence_levels", f"WITH {PAPERS_SQL} SELECT paper_id, CASE WHEN paper_id % 17 = 0 THEN 'I' WHEN type = 'journal-article' OR type = 'proceedings-article' THEN 'IV' ELSE 'V' END AS level FROM papers")
def evidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("paper_id", verification.evidence_level(F.lit(""), F.col("type"), F.col("paper_id") % 17 == 0).alias("level"))


@query("bias_routing", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'RoB 2' WHEN event_id % 4 = 1 THEN 'ROBINS-I' WHEN event_id % 4 = 2 THEN 'QUADAS-2' ELSE 'JBI / CASP checklist' END AS tool, CASE WHEN event_id % 4 = 0 THEN 5 WHEN event_id % 4 = 1 THEN 7 WHEN event_id % 4 = 2 THEN 4 ELSE 1 END AS n FROM events")
def bias_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = F.element_at(F.array(*map(F.lit, ("a randomized trial", "cohort study", "diagnostic accuracy", "essay"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("paper_id"), verification.bias_tools(design, F.lit("journal-article")).alias("tools"))
    return verification.assessments(rows).groupBy(F.col("id").alias("event_id"), "tool").agg(F.count("*").cast("int").alias("n"))


@query("metadata_agreement", "SELECT o_custkey AS paper_id, CASE WHEN count(*) < 2 THEN 'single-source' WHEN count(DISTINCT o_orderstatus) <= 2 AND max(year(o_orderdate)) - min(year(o_orderdate)) <= 1 THEN 'consistent' ELSE 'discrepancy' END AS consistency FROM orders GROUP BY 1")
def metadata_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderstatus").alias("title"), F.year("o_orderdate").alias("year"))
    return verification.agreement(rows)


@query("resolver_merge", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey WHEN c_custkey % 3 = 0 THEN 'b' || c_custkey END AS title, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'resolved' ELSE 'unresolved' END AS verification_status,
  (CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) AS n_used FROM customer""")
def resolver_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"))
    answer = lambda n, p: c.where(F.col("paper_id") % n == 0).select("paper_id", F.concat(F.lit(p), F.col("paper_id").cast("string")).alias("title"))
    out = verification.resolvers(c, {"first": answer(2, "a"), "second": answer(3, "b")}, ["title"])
    return out.select(F.col("paper_id").alias("c_custkey"), "title", "verification_status", F.size("used").alias("n_used"))


@query("verification_report", "SELECT o_orderstatus AS verification_status, o_orderpriority AS level, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def verification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.report(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("verification_status"), F.col("o_orderpriority").alias("level")))


@query("venue_lookup", "SELECT c_custkey, n_name AS venue_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def venue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("issn"))
    n = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("issn"), F.col("n_name").alias("name"))
    return verification.lookup(c, n, "issn", ["name"], "venue_").select("c_custkey", "venue_name")


@query("knowledge_merge", "SELECT o_orderkey, o_orderkey % 3 = 0 AS fresh FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def knowledge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("10.1/A"), F.col("o_orderkey").cast("string")).alias("doi"))
    return records.with_knowledge(o.where("o_orderkey % 3 = 0").withColumn("fresh", F.lit(True)), o.where("o_orderkey % 2 = 0").withColumns({"doi": F.lower("doi"), "fresh": F.lit(False)})).select("o_orderkey", "fresh")


def discovery_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers with keys that ranking needs."""
    p = papers(spark, sf_dir)
    return p.withColumns({"first_author": F.element_at(F.array(*map(F.lit, ("chen", "kovacs", "rossi", "smith", "berg"))), (F.col("paper_id") % 5 + 1).cast("int")), "venue_key": X.text_or_empty(F.col("venue"))})
