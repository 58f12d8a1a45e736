"""Citation graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from .papers import CITES_SQL, citing, inner_edges
from .registry import query, table

_EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS dst FROM lineitem WHERE l_suppkey <> l_partkey % (SELECT max(s_suppkey) FROM supplier) + 1)"


@query("coupling_pairs", f"WITH {CITES_SQL} SELECT x.paper_id AS a, y.paper_id AS b, count(*) AS shared FROM cites x JOIN cites y ON x.ref = y.ref AND x.paper_id < y.paper_id GROUP BY 1, 2 HAVING count(*) >= 2")
def coupling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coupling_pairs(citing(spark, sf_dir), "paper_id", "referenced_works")


@query("coupling_scores", f"WITH {CITES_SQL}, o AS (SELECT ref, count(*) - 1 AS o FROM cites GROUP BY 1), r AS (SELECT paper_id, sum(o) + 0.5 * ln(1 + count(*)) AS r FROM cites JOIN o USING (ref) GROUP BY 1) SELECT paper_id AS id, round(r / max(r) OVER (), 6) AS coupling FROM r")
def coupling_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coupling_scores(citing(spark, sf_dir), "paper_id", "referenced_works").withColumn("coupling", F.round("coupling", 6))


def inner_citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inner_edges(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("refs"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).join(rows, "id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<bigint>")))


@query("cocitation_scores", f"WITH {_EDGES}, c AS (SELECT src, dst FROM e WHERE dst IN (SELECT s_suppkey FROM supplier)), t AS (SELECT src, count(*) - 1 AS o FROM c GROUP BY 1), r AS (SELECT s_suppkey AS id, coalesce(sum(o), 0) AS r FROM supplier LEFT JOIN c ON dst = s_suppkey LEFT JOIN t ON t.src = c.src GROUP BY 1) SELECT id, round(r / max(r) OVER (), 6) AS cocitation FROM r")
def cocitation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cocitation_scores(inner_citing(spark, sf_dir), "id", "refs").withColumn("cocitation", F.round("cocitation", 6))


@query("network_centrality")
def network_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.centrality(spark, inner_citing(spark, sf_dir), "id", "refs")


@query("connected_components", "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders linked to the customer's next by price: chains whose least key may stand anywhere."""
    by_price = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(by_price).alias("dst"))
    return graph.components(spark, e)


@query("coauthor_edges", "WITH n AS (SELECT o_custkey AS p, list_slice(list_sort(list_distinct(list(o_orderpriority))), 1, 8) AS l FROM orders GROUP BY 1), x AS (SELECT p, unnest(l) AS n FROM n) SELECT a.n AS a, b.n AS b, count(*) AS weight FROM x a JOIN x b ON a.p = b.p AND a.n < b.n GROUP BY ALL")
def coauthor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("names"))
    return graph.coauthor_edges(p, "o_custkey", "names")


@query("snowball_backward", f"""WITH {_EDGES}, d1 AS (SELECT DISTINCT dst AS id FROM e WHERE src <= 2), d2 AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM d1 WHERE id > 2))
SELECT id, min(depth) AS depth FROM (SELECT s_suppkey AS id, 0 AS depth FROM supplier WHERE s_suppkey <= 2 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2) GROUP BY 1""")
def snowball_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey <= 2").select(F.col("s_suppkey").alias("id"))
    return graph.snowball(spark, seeds, inner_edges(spark, sf_dir), depth=2)[0]


@query("snowball_saturation")
def snowball_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey <= 2").select(F.col("s_suppkey").alias("id"))
    log = graph.snowball(spark, seeds, inner_edges(spark, sf_dir), depth=6, direction="forward", least_new=5, least_ratio=0.15)[1]
    return spark.createDataFrame(log, "depth int, new long, total long, ratio double")


@query("graph_density", f"WITH {_EDGES} SELECT (SELECT count(*) FROM supplier) AS n_nodes, count(*) AS n_edges, round(count(*)::DOUBLE / ((SELECT count(*) FROM supplier) * ((SELECT count(*) FROM supplier) - 1)), 6) AS density FROM e")
def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return graph.density(n, inner_edges(spark, sf_dir)).withColumn("density", F.round("density", 6))


@query("graph_communities")
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that trade, weighted by lines: a graph whose size the nations bound, whatever the orders."""
    read = lambda name, *columns: table(spark, sf_dir, name).select(*columns)
    lines = read("lineitem", "l_orderkey", "l_suppkey").join(read("orders", "o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("n"))
    ends = lines.join(read("supplier", "s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey")).join(read("customer", "c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
    e = ends.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.sum("n").cast("double").alias("weight"))
    n = read("nation", F.col("n_nationkey").cast("long").alias("id"))
    out = graph.small_graph_metrics(n, e)
    return spark.createDataFrame(out if out is not None else [], "id long, betweenness double, community long")


@query("max_scaled_balances", "SELECT s_suppkey AS id, round(CASE WHEN max(s_acctbal) OVER () > 0 THEN s_acctbal / max(s_acctbal) OVER () ELSE 0 END, 6) AS scaled FROM supplier")
def max_scaled_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.max_scaled(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("raw")), "raw", "scaled").withColumn("scaled", F.round("scaled", 6))
