"""The synthetic tables seen as evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.layout import dealt, spread
from .registry import table

#: documents as papers: the title is the text up to the first full stop.
PAPERS_SQL = """papers AS (SELECT doc_id AS paper_id, split_part(text, '.', 1) AS title, text AS abstract, CASE WHEN doc_id % 11 <> 0 THEN (1990 + doc_id % 35)::INT END AS year,
  source AS venue, (n_chars % 500)::INT AS citation_count, lang AS language, CASE WHEN doc_id % 7 = 0 THEN 'proceedings-article' WHEN doc_id % 13 = 0 THEN 'posted-content' ELSE 'journal-article' END AS type FROM documents)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars", "lang"))
    return d.select(
        F.col("doc_id").alias("paper_id"), F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("abstract"), F.when(F.col("doc_id") % 11 != 0, (1990 + F.col("doc_id") % 35).cast("int")).alias("year"),
        F.col("source").alias("venue"), (F.col("n_chars") % 500).cast("int").alias("citation_count"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 7 == 0, "proceedings-article").when(F.col("doc_id") % 13 == 0, "posted-content").otherwise("journal-article").alias("type"),
    )


#: events as measurements: units in turn, values from 1 on.
MEASURED_SQL = """measured AS (SELECT event_id AS seq, user_id::VARCHAR AS paper_id, round(abs(value) + 1, 4) AS value, CASE event_id % 6 WHEN 0 THEN 'kbar' WHEN 1 THEN 'GPa' WHEN 2 THEN 'K' WHEN 3 THEN '°C' WHEN 4 THEN 'ppm' ELSE 'furlong' END AS unit,
  '' AS measurement, CASE WHEN event_id % 3 = 0 THEN round(abs(value) / 10 + 0.1, 4) END AS uncertainty, CASE WHEN event_id % 2 = 0 THEN (event_id % 9 + 2)::INT END AS n, event_type FROM events)"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    unit = F.element_at(F.array(*map(F.lit, ("kbar", "GPa", "K", "°C", "ppm", "furlong"))), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("paper_id"), F.round(F.abs("value") + 1, 4).alias("value"), unit.alias("unit"), F.lit("").alias("measurement"),
        F.when(F.col("event_id") % 3 == 0, F.round(F.abs("value") / 10 + 0.1, 4)).alias("uncertainty"), F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 9 + 2).cast("int")).alias("n"), "event_type",
    )


#: line items as studies: pools by return flag and line status, variances from tax.
STUDIES_SQL = "studies AS (SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_discount AS effect, l_tax + 0.01 AS variance, l_shipdate, CAST(extract(year FROM l_shipdate) AS INT) AS year FROM lineitem)"


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", F.col("l_discount").alias("effect"), (F.col("l_tax") + 0.01).alias("variance"), "l_shipdate", F.year("l_shipdate").alias("year"))


#: suppliers cite parts.
CITES_SQL = "cites AS (SELECT DISTINCT l_suppkey AS paper_id, l_partkey AS ref FROM lineitem)"


def citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, referenced_works): suppliers with the parts that they deliver."""
    lines = table(spark, sf_dir, "lineitem")
    rows = dealt(lines.select(F.col("l_suppkey").alias("paper_id"), F.col("l_partkey").alias("ref")), lines.count(), "paper_id").distinct()
    return rows.groupBy("paper_id").agg(F.array_sort(F.collect_list("ref")).alias("referenced_works"))


def inner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): suppliers that cite suppliers, by the rest of the part number."""
    lines = table(spark, sf_dir, "lineitem")
    n = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("n"))
    ends = lines.crossJoin(F.broadcast(n)).select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % F.col("n") + 1).alias("dst")).where("src <> dst")
    return dealt(ends, lines.count(), "src").distinct()
