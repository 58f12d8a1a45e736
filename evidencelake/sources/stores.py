"""Labels, retraction lists, gold sets and the knowledge base with its time to live."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import screening, verification

#: Days that cached searches and verifications stay valid. Fixed values.
SEARCH_DAYS, VERIFY_DAYS = 30, 90


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(doi, label): JSON lines, broken ones passed over; the last of a key counts, by file order."""
    raw = spark.read.schema("doi string, label string, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    rows = raw.where("_corrupt_record IS NULL").select("doi", "label", F.monotonically_increasing_id().alias("at"))
    return screening.last_labels(rows)


def read_retractions(spark: SparkSession, path: str) -> DataFrame:
    """(doi): those of a CSV's columns with ``doi`` in their name."""
    return verification.retraction_dois(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, title, abstract, label) of a labelled CSV (title, abstract, include)."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    low = raw.toDF(*(c.strip().lower() for c in raw.columns))
    return low.where("include IN ('0', '1')").select(F.sha2(F.concat_ws("|", "title", "abstract"), 256).alias("paper_id"), F.substring("title", 1, 300).alias("title"), F.regexp_replace("abstract", "\\s+", " ").alias("abstract"), F.when(F.col("include") == "1", "include").otherwise("exclude").alias("label"))


def synthetic_gold(spark: SparkSession, n: int = 300, relevant: int = 32, seed: int = 7) -> DataFrame:
    """A labelled corpus made from a seed: a few papers on one subject among others."""
    noise = F.element_at(F.array(*map(F.lit, ("clinical trial of drug outcomes", "wireless network protocol evaluation", "renaissance poetry analysis", "image classification benchmarks"))), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4)) + 1).cast("int"))
    hit = F.col("id") < relevant
    rows = spark.range(n).withColumn("title", F.when(hit, F.concat(F.lit("Amphibole thermobarometry study "), "id")).otherwise(F.concat(noise, F.lit(" experiment "), "id")))
    return rows.select(F.col("id").alias("paper_id"), "title", F.when(hit, "amphibole thermobarometry constrains magma storage temperatures and pressures in arc magmas").otherwise(F.concat(noise, F.lit(" with quantitative evaluation"))).alias("abstract"), F.when(hit, "include").otherwise("exclude").alias("label"))


class KnowledgeBase:
    """Cached searches and verifications as Parquet, partitioned by kind and day; entries past their time are not read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame, kind: str, now: float | None = None) -> None:
        """Append (key, payload) rows."""
        at = F.lit(time.time() if now is None else now)
        rows.select("key", "payload", at.alias("ts"), F.lit(kind).alias("kind"), F.to_date(F.timestamp_seconds(at)).alias("day")).write.mode("append").partitionBy("kind", "day").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema("key string, payload string, ts double, kind string, day date").parquet(self.path)

    def get(self, kind: str, now: float | None = None) -> DataFrame:
        """(key, payload): the latest live entry of each key. Old days are pruned by their folders."""
        days = SEARCH_DAYS if kind == "search" else VERIFY_DAYS
        now = time.time() if now is None else now
        live = self.rows().where((F.col("kind") == kind) & (F.col("day") >= F.to_date(F.timestamp_seconds(F.lit(now - days * 86400)))) & (F.col("ts") > now - days * 86400))
        return live.groupBy("key").agg(F.max_by("payload", "ts").alias("payload"))

    def stats(self) -> DataFrame:
        return self.rows().groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
