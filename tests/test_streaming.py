"""Streams to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.sources import stores
from evidencelake.streaming import monitor


def test_replayed_batches_add_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "paper_id string, n int")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    write = monitor.merge_batch(f"{tmp_path}/base")
    for k in range(2):  # another checkpoint reads everything again
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state{k}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r.paper_id for r in spark.read.parquet(f"{tmp_path}/base").collect()} == {"a", "b"}
    assert spark.read.parquet(f"{tmp_path}/base").count() == 2
    broken = monitor.merge_batch(f"{tmp_path}/broken")
    (tmp_path / "broken" / "_temporary").mkdir(parents=True)  # what a first batch leaves that was broken off
    for k in range(2):
        broken(rows.unionAll(spark.createDataFrame([(None, 4), (None, 5)], rows.schema)), k)
    assert sorted(str(r.paper_id) for r in spark.read.parquet(f"{tmp_path}/broken").collect()) == ["None", "a", "b"]


def test_new_records(spark, tmp_path):
    rows = spark.range(6).select((F.col("id") % 4).cast("string").alias("paper_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("seen_at"))
    rows.write.parquet(f"{tmp_path}/in")
    base = spark.createDataFrame([("1",)], "paper_id string")
    new = monitor.new_records(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), base)
    q = new.writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.paper_id for r in spark.table("fresh").collect()) == ["0", "2", "3"]


def test_knowledge_base_prunes_old_days(spark, tmp_path):
    base = stores.KnowledgeBase(spark, str(tmp_path / "kb"))
    now = 1_700_000_000.0
    rows = spark.createDataFrame([("k", "old")], "key string, payload string")
    base.put(rows, "search", now - 40 * 86400)
    base.put(rows, "verify", now - 40 * 86400)
    assert base.get("search", now).count() == 0 and base.get("verify", now).first().payload == "old"
    plan = base.get("verify", now)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "day" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]
    assert {r.kind: r.n for r in base.stats().collect()} == {"search": 1, "verify": 1}
