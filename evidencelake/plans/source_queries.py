"""Provider mappings, stores, exports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import records
from ..scratch import Scratch, shared_folder
from ..sources import export, pages, providers, stores
from ..streaming import monitor
from .papers import papers
from .record_queries import full_records
from .registry import query, table


def _json(frame: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON text read with a provider's schema, as a dump would be."""
    return frame.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


@query("map_crossref", "SELECT 'C-' || c_custkey AS doi, c_name AS title, 'Ann ' || c_mktsegment AS author, (2000 + c_custkey % 20)::INT AS year, c_custkey % 9 = 0 AS is_retracted FROM customer")
def map_crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    item = F.struct(
        F.concat(F.lit("C-"), k.cast("string")).alias("DOI"), F.array("c_name").alias("title"), F.array(F.struct(F.lit("Ann").alias("given"), F.col("c_mktsegment").alias("family"))).alias("author"), F.struct(F.array(F.array((k % 20 + 2000).cast("int"))).alias("date-parts")).alias("issued"),
        F.when(k % 9 == 0, "retraction").otherwise("journal-article").alias("type"),
    )
    r = providers.from_crossref(_json(table(spark, sf_dir, "customer").select(F.to_json(item).alias("json")), providers.CROSSREF))
    return r.select("doi", "title", F.col("authors")[0]["name"].alias("author"), "year", "is_retracted")


@query("map_openalex", "SELECT s_suppkey::VARCHAR AS doi, 'a b ' || s_name AS abstract, n_name AS venue, s_suppkey % 2 = 0 AS is_open_access, 2 AS n_concepts FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def map_openalex(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    item = F.struct(
        F.concat(F.lit("https://doi.org/"), F.col("s_suppkey").cast("string")).alias("doi"), F.map_from_arrays(F.array(F.lit("b"), F.col("s_name"), F.lit("a")), F.array(F.array(F.lit(1)), F.array(F.lit(2)), F.array(F.lit(0)))).alias("abstract_inverted_index"),
        F.struct(F.struct(F.col("n_name").alias("display_name")).alias("source")).alias("primary_location"), F.struct((F.col("s_suppkey") % 2 == 0).alias("is_oa")).alias("open_access"), F.array(F.struct(F.lit("x").alias("display_name"))).alias("concepts"), F.array(F.struct(F.lit("y").alias("display_name"))).alias("topics"),
    )
    r = providers.from_openalex(_json(s.select(F.to_json(item).alias("json")), providers.OPENALEX))
    return r.select("doi", "abstract", "venue", "is_open_access", F.size("concepts").alias("n_concepts"))


@query("map_semantic_scholar", "SELECT p_partkey::VARCHAR AS doi, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'short ' || p_name END AS abstract, 'A, B' AS type FROM part")
def map_semantic_scholar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    item = F.struct(F.struct(k.cast("string").alias("DOI")).alias("externalIds"), F.when(k % 2 == 0, F.col("p_name")).otherwise("").alias("abstract"), F.struct(F.concat(F.lit("short "), "p_name").alias("text")).alias("tldr"), F.array(F.lit("A"), F.lit("B")).alias("publicationTypes"))
    r = providers.from_semantic_scholar(_json(table(spark, sf_dir, "part").select(F.to_json(item).alias("json")), providers.SEMANTIC))
    return r.select("doi", "abstract", "type")


@query("map_epmc", "SELECT c_custkey::VARCHAR AS pmid, c_name AS title, (1990 + c_custkey % 30)::INT AS year FROM customer WHERE c_custkey % 3 <> 0")
def map_epmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    item = F.struct(F.when(k % 3 != 0, k.cast("string")).alias("pmid"), F.concat(F.lit("<i>"), "c_name", F.lit("</i>")).alias("title"), (k % 30 + 1990).cast("string").alias("pubYear"))
    return providers.from_epmc(_json(table(spark, sf_dir, "customer").select(F.to_json(item).alias("json")), providers.EPMC)).select("pmid", "title", "year")


@query("union_sources", "SELECT 'a' AS source, count(*) AS n FROM documents UNION ALL SELECT 'b', count(*) FROM documents WHERE doc_id % 2 = 0")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    both = providers.union_sources(p.select("paper_id", "title").withColumn("source", F.lit("a")), p.where("paper_id % 2 = 0").select("paper_id", "year").withColumn("source", F.lit("b")))
    return both.groupBy("source").agg(F.count("*").alias("n"))


@query("arrival_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) AS ingest_pos FROM orders")
def arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.with_order(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus", "o_orderkey"]).select("o_orderkey", "ingest_pos")


@query("bibtex", """SELECT row_number() OVER (ORDER BY doc_id) AS number, '@article{' || ['Chen', 'Kovacs', 'Rossi', 'Smith', 'Berg'][(doc_id % 5 + 1)::INT] || CASE WHEN doc_id % 11 <> 0 THEN (1990 + doc_id % 35)::VARCHAR ELSE 'ND' END || '07,' AS head FROM documents""")
def bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = full_records(spark, sf_dir).where("source = 'crossref'")
    numbered = providers.with_order(r.withColumn("k", F.col("paper_id").cast("long")), ["source", "k"]).withColumn("seven", F.lit(7))
    got = export.bibtex(numbered.withColumn("n", F.col("ingest_pos")), "n")
    key = numbered.select(F.col("ingest_pos").alias("n"), export.bibtex_key(F.col("seven")).alias("key"))
    return got.join(key, "n").select(F.col("n").alias("number"), F.concat(F.split_part("entry", F.lit("{"), F.lit(1)), F.lit("{"), "key", F.lit(",")).alias("head"))


@query("reference_formats")
def reference_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = full_records(spark, sf_dir).where("source = 'crossref'").withColumn("number", F.col("ingest_pos"))
    parts = [f(r).withColumn("format", F.lit(name)) for name, f in export.FORMATS.items()]
    return providers.union_sources(*parts).groupBy("format").agg(F.count("*").alias("n"), F.sum(F.length("entry")).alias("chars"))


@query("knowledge_base", "SELECT o_custkey::VARCHAR AS key, max(o_orderkey)::VARCHAR AS payload FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two months ago are past their time; of the two puts since, the later counts."""
    base = stores.KnowledgeBase(spark, f"{shared_folder(spark)}/kb-{uuid.uuid4().hex}")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), "o_orderkey")
    now = 1_700_000_000.0
    base.put(o.select("key", F.col("o_orderkey").cast("string").alias("payload")), "search", now - 60 * 86400)
    even = o.where("o_orderkey % 2 = 0").groupBy("key").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    base.put(even.select("key", F.col("lo").cast("string").alias("payload")), "search", now - 100)
    base.put(even.select("key", F.col("hi").cast("string").alias("payload")), "search", now - 50)
    return base.get("search", now)


@query("synthetic_gold", "SELECT 'include' AS label, 32 AS n UNION ALL SELECT 'exclude', 268")
def synthetic_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.synthetic_gold(spark).groupBy("label").agg(F.count("*").cast("int").alias("n"))


@query("artifact_round_trip", "SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents")
def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    export.write_artifact(full_records(spark, sf_dir).where("source = 'crossref'"), path, {"query": "q"})
    back = export.require(providers.read_corpus(spark, f"{path}/rows"), ["paper_id", "title"], "corpus")
    return back.agg(F.count("*").alias("n"), F.sum(F.col("paper_id").cast("long")).alias("ids"))


@query("provenance_hashes")
def provenance_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.provenance(spark, "corpus", f"{sf_dir}/nation.parquet", {"limit": "none"}).select("stage", "sha256", "bytes", "params")


def _stream(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """A table as a stream of files."""
    kept = Scratch(spark, "stream")
    kept.keep(frame, name)
    return spark.readStream.schema(frame.schema).parquet(kept.path(name))


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a streaming query has written when its input is at its end."""
    out = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("append").parquet(f"{out}/rows")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType())])).parquet(f"{out}/rows")


@query("stream_new_records", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def stream_new_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("seen_at"))
    base = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    got = monitor.new_records(_stream(spark, e, "events"), base, "user_id", "seen_at", "3650 days")
    return _drained(spark, got, "append").select("user_id").distinct()


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    last = _drained(spark, monitor.windowed_counts(_stream(spark, e, "events"), "ts", ["event_type"], late="3650 days"), "update")
    return last.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "__batch").alias("n"))


@query("stream_contradictions", "SELECT event_type AS quantity, round(max(abs(value) + 1) / min(abs(value) + 1), 4) AS ratio FROM events GROUP BY 1 HAVING max(abs(value) + 1) / min(abs(value) + 1) >= 5")
def stream_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("quantity"), F.lit("u").alias("unit"), F.col("user_id").alias("paper_key"), (F.abs("value") + 1).alias("value"))
    last = _drained(spark, monitor.running_contradictions(_stream(spark, e, "claims")), "update")
    return last.groupBy("quantity").agg(F.round(F.max_by("ratio", "__batch"), 4).alias("ratio"))


@query("stream_sessions")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return _drained(spark, monitor.sessions(_stream(spark, e, "events"), "ts", "user_id"), "append").select("user_id", "start", "end", "n")


@query("stream_first_seen", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    last = _drained(spark, monitor.first_seen(_stream(spark, e, "events"), "user_id", "ts", "3650 days"), "update")
    return last.groupBy("user_id").agg(F.max("n").alias("n"))


@query("merge_sources")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = full_records(spark, sf_dir)
    return records.merge_clusters(r, r.select("ingest_pos", F.concat(F.lit("c"), "paper_id").alias("cluster"))).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_records").alias("records"))


#: Documents as the pages of a provider: 50 a page by id, years that go with the pages.
_PAGED = """paged AS (SELECT doc_id::VARCHAR AS id, '10.' || (1000 + doc_id // 50 % 7)::VARCHAR || '/' || doc_id::VARCHAR AS doi, substr(text, 1, 40) AS title, (1990 + doc_id // 50 % 35)::INT AS year,
  CASE WHEN doc_id % 5 = 0 THEN 'posted-content' WHEN doc_id % 5 < 4 THEN 'journal-article' END AS type, CASE WHEN doc_id % 3 < 2 THEN doc_id % 3 = 0 END AS is_open_access FROM documents)"""


def _pages(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the documents' pages, written by Spark."""
    page = F.floor(F.col("doc_id") / 50).cast("int")
    kind = F.when(F.col("doc_id") % 5 == 0, "posted-content").when(F.col("doc_id") % 5 < 4, "journal-article")
    records = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("10."), (page % 7 + 1000).cast("string"), F.lit("/"), F.col("doc_id").cast("string")).alias("doi"), F.substring("text", 1, 40).alias("title"), (page % 35 + 1990).alias("year"), kind.alias("type"), F.when(F.col("doc_id") % 3 < 2, F.col("doc_id") % 3 == 0).alias("is_open_access"), page.alias("page"),
    )
    path = Scratch(spark, "pages").path("provider")
    pages.write_pages(records, path)
    return path


@query("provider_scan", f"WITH {_PAGED} SELECT id, doi, title, year FROM paged WHERE year BETWEEN 1995 AND 2004 AND is_open_access AND type = 'journal-article'")
def provider_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.read_pages(spark, _pages(spark, sf_dir))
    return found.where("year BETWEEN 1995 AND 2004 AND is_open_access AND type = 'journal-article'").select("id", "doi", "title", "year")


@query("provider_prefix", f"WITH {_PAGED} SELECT id, doi, type FROM paged WHERE doi LIKE '10.1003/%'")
def provider_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.of_prefix(spark, _pages(spark, sf_dir), "10.1003").select("id", "doi", "type")


@query("provider_stream", f"WITH {_PAGED} SELECT type, count(*) AS n, min(year) AS first_year FROM paged GROUP BY type")
def provider_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as a stream that ends where the chain of cursors does."""
    scratch = Scratch(spark, "page-stream")
    out = scratch.path("records")
    pages.stream_pages(spark, _pages(spark, sf_dir)).writeStream.format("parquet").option("checkpointLocation", scratch.path("state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("type").agg(F.count("*").alias("n"), F.min("year").alias("first_year"))
