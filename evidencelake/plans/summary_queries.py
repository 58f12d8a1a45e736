"""Summaries of measurements, years, concepts, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import domains, summaries
from .papers import MEASURED_SQL, PAPERS_SQL, measured, papers
from .registry import query, table


def rounded(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: F.round(n, 6) for n in names})


@query("measurement_summary", f"WITH {MEASURED_SQL} SELECT unit, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM measured GROUP BY 1")
def measurement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.basic(measured(spark, sf_dir), ["unit"]), "mean", "median", "sd")


@query("robust_summary", f"""WITH {MEASURED_SQL}, b AS (SELECT paper_id, count(*) AS n, avg(value) AS mean, median(value) AS med, coalesce(stddev_samp(value), 0) AS sd, min(value) AS lo, max(value) AS hi, list(value ORDER BY value) AS l FROM measured GROUP BY 1 HAVING count(*) >= 2),
a AS (SELECT paper_id, median(abs(value - med)) AS mad, count(*) FILTER (sd > 0 AND abs(value - mean) > 2 * sd) AS n_outliers FROM measured JOIN b USING (paper_id) GROUP BY 1)
SELECT paper_id, n, round(CASE WHEN n < 4 THEN lo ELSE l[n // 4 + 1] END, 6) AS q1, round(CASE WHEN n < 4 THEN hi ELSE l[3 * n // 4 + 1] END, 6) AS q3, round(mad, 6) AS mad, n_outliers, n >= 4 AND sd / abs(mean) > 0.5 AS two_modes FROM b JOIN a USING (paper_id)""")
def robust_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.robust(measured(spark, sf_dir), ["paper_id"]).select("paper_id", "n", "q1", "q3", "mad", "n_outliers", "two_modes"), "q1", "q3", "mad")


@query("median_intervals")
def median_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.median_interval(measured(spark, sf_dir), ["unit"], draws=200)


@query("convergence", f"""WITH {MEASURED_SQL}, q AS (SELECT paper_id, list(value ORDER BY value) AS l, count(*) AS n FROM measured GROUP BY 1), f AS (SELECT paper_id, n, l[n // 4 + 1] AS q1, l[n // 2 + 1] AS mid, l[3 * n // 4 + 1] AS q3 FROM q WHERE n >= 3),
v AS (SELECT f.*, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS i FROM measured JOIN f USING (paper_id)) SELECT paper_id, any_value(n) AS n, count(*) FILTER (i) AS n_inliers, count(*) FILTER (NOT i) AS n_outliers, min(value) FILTER (i) AS lo, max(value) FILTER (i) AS hi, any_value(mid) AS mid, (max(value) FILTER (i) - min(value) FILTER (i)) / any_value(mid) <= 0.5 AS consistent FROM v GROUP BY 1""")
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.convergence(measured(spark, sf_dir), ["paper_id"])


@query("publication_trends", f"WITH {PAPERS_SQL}, y AS (SELECT year AS y, count(*) AS c FROM papers WHERE year IS NOT NULL GROUP BY 1) SELECT sum(c)::BIGINT AS n, min(y) AS first, max(y) AS last, arg_max(y, c * 10000 - y) AS peak, round((sum(c) FILTER (y >= (SELECT max(y) FROM y) - 5))::DOUBLE / sum(c), 6) AS recent_share FROM y")
def publication_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.trends(papers(spark, sf_dir)), "recent_share")


@query("decade_histogram", "WITH c AS (SELECT (year(o_orderdate) // 10 * 10)::INT AS bin, count(*) AS n FROM orders GROUP BY 1) SELECT bin, n, floor(n::DOUBLE / max(n) OVER () * 40)::INT AS bar FROM c")
def decade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.histogram(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")), step=10)


@query("top_concepts", "WITH t AS (SELECT p_partkey AS o, unnest(list_slice(string_split(p_type, ' '), 1, 2)) AS v, generate_subscripts(list_slice(string_split(p_type, ' '), 1, 2), 1) AS i FROM part) SELECT v AS value, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, min(o * 10 + i) LIMIT 6")
def top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.top_values(table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("concepts")), "concepts", 6, first=2, order="p_partkey")


@query("research_gaps", f"""WITH {PAPERS_SQL}, m AS (SELECT max(year) AS last FROM papers), t AS (SELECT max(c) AS big, count(*) AS k FROM (SELECT count(*) AS c FROM papers GROUP BY type))
SELECT count(*) AS n, count(year) >= 5 AND count(*) FILTER (year >= last - 5) < 0.3 * count(year) AS few_recent, count(*) FILTER (citation_count % 3 > 0) < 0.5 * count(*) AS few_measured, any_value(k) >= 2 AND any_value(big) >= 0.6 * count(*) AS one_theme, false AS no_coupling FROM papers, m, t GROUP BY last""")
def research_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.gaps(papers(spark, sf_dir).withColumns({"n_values": F.col("citation_count") % 3, "theme": F.col("type")}))


@query("dataset_summary", "SELECT variable, count(*) AS n, min(v) AS lo, max(v) AS hi, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS variable, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem) GROUP BY 1")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.dataset_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query("method_landscape", """WITH v AS (SELECT o_orderpriority AS theme, CASE WHEN l_linenumber % 2 = 0 THEN 'temperature' ELSE 'pressure' END AS m, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey), k AS (SELECT theme, min(q) FILTER (m = 'temperature') AS temperature_lo, max(q) FILTER (m = 'temperature') AS temperature_hi, min(q) FILTER (m = 'pressure') AS pressure_lo, max(q) FILTER (m = 'pressure') AS pressure_hi FROM v GROUP BY 1)
SELECT o_orderpriority AS theme, count(*) AS n, any_value(temperature_lo) AS temperature_lo, any_value(temperature_hi) AS temperature_hi, any_value(pressure_lo) AS pressure_lo, any_value(pressure_hi) AS pressure_hi FROM orders LEFT JOIN k ON theme = o_orderpriority GROUP BY 1""")
def method_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("theme"))
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.when(F.col("l_linenumber") % 2 == 0, "temperature").otherwise("pressure").alias("measurement"), F.col("l_quantity").alias("value"))
    return summaries.method_landscape(p, v)


@query("cross_theme_medians", f"WITH {MEASURED_SQL} SELECT unit AS measurement, count(*) AS n, round(median(value), 6) AS median, count(DISTINCT event_type) AS themes FROM measured GROUP BY 1 HAVING count(*) >= 5")
def cross_theme_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.cross_theme_medians(measured(spark, sf_dir).select(F.col("unit").alias("measurement"), "value", F.col("event_type").alias("theme"))), "median")


@query("measurement_kinds", f"WITH {MEASURED_SQL} SELECT seq, CASE WHEN unit IN ('K', '°C') THEN 'temperature' WHEN unit IN ('kbar', 'GPa') THEN 'pressure' WHEN value * 20 BETWEEN 200 AND 1600 THEN 'temperature' WHEN value * 20 BETWEEN 0.1 AND 100 THEN 'pressure' ELSE 'other' END AS kind FROM measured")
def measurement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("seq", summaries.classify_measurement(F.col("measurement"), F.col("unit"), F.col("value") * 20).alias("kind"))


_SAMPLES_SQL = """s AS (SELECT l_partkey, l_returnflag, CASE WHEN l_linenumber > 1 THEN l_extendedprice * l_linenumber / 100 + 1.371e-7 END AS age, CASE WHEN l_linenumber < 5 THEN (l_orderkey % 360)::DOUBLE END AS strike, CASE WHEN l_linenumber > 2 THEN l_quantity END AS dip,
  l_tax * 12 + 0.0007 AS cu, (l_quantity + 0.037) / 6 AS au, 30.0000001371 + l_extendedprice / 2000 AS silica, l_discount * 80 + 0.0137 AS soda, l_tax * 60 AS potash FROM lineitem)"""


@query("domain_statistics", f"""WITH {_SAMPLES_SQL}, g AS (SELECT l_partkey, l_returnflag, count(*) FILTER (age > 0) AS age_n, min(age) FILTER (age > 0) AS age_lo, max(age) FILTER (age > 0) AS age_hi, avg(age) FILTER (age > 0) AS age_mean, stddev_samp(age) FILTER (age > 0) AS age_sd,
  count(*) FILTER (strike IS NOT NULL AND dip IS NOT NULL) AS turns, avg(strike) FILTER (dip IS NOT NULL) AS strike, avg(dip) FILTER (strike IS NOT NULL) AS dip, avg(silica) AS silica, avg(soda) + avg(potash) AS alkali, count(*) FILTER (cu > 0) AS cu_n, avg(cu) FILTER (cu > 0) AS cu, count(*) FILTER (au > 0) AS au_n, avg(au) FILTER (au > 0) AS au FROM s GROUP BY ALL)
SELECT l_partkey, l_returnflag, age_n, round(age_lo, 6) AS age_lo, round(age_hi, 6) AS age_hi, round(age_mean, 6) AS age_mean, round(CASE WHEN age_n > 0 THEN coalesce(age_sd, 0) END, 6) AS age_sd, CASE WHEN age_mean > 541 THEN 'Precambrian' END AS era, CASE WHEN age_mean > 2500 THEN 'Archean' WHEN age_mean > 541 THEN 'Proterozoic' END AS eon,
  turns, round(strike, 6) AS mean_strike, round(dip, 6) AS mean_dip, round(silica, 6) AS silica, round(alkali, 6) AS alkali,
  CASE WHEN silica < 45 THEN CASE WHEN alkali < 3 THEN 'basanite' ELSE 'foidite / tephrite' END WHEN silica < 52 THEN 'basalt' WHEN silica < 57 THEN 'basaltic andesite' WHEN silica < 63 THEN 'andesite'
    WHEN silica >= 77 THEN 'high-silica rhyolite' WHEN alkali > 8 THEN 'phonolite' WHEN silica < 65 AND alkali > 5 THEN 'trachyandesite' WHEN silica < 69 THEN 'dacite' WHEN alkali > 5 THEN 'trachyte' ELSE 'rhyolite' END AS rock,
  concat_ws('; ', CASE WHEN cu_n > 0 THEN 'Cu_pct ' || cu_n || CASE WHEN cu < 0.3 THEN ' low grade' WHEN cu < 1 THEN ' moderate grade' ELSE ' high grade' END END, CASE WHEN au_n > 0 THEN 'Au_ppm ' || au_n || CASE WHEN au < 1 THEN ' low grade' WHEN au < 5 THEN ' moderate grade' ELSE ' high grade' END END) AS grades FROM g""")
def domain_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as samples of their part, by return flag; odd offsets keep means off the ties of rounding and the edges of classes."""
    line = F.col("l_linenumber")
    s = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_returnflag", F.when(line > 1, F.col("l_extendedprice") * line / 100 + 1.371e-7).alias("Age_Ma"), F.when(line < 5, F.col("l_orderkey") % 360).alias("Strike"), F.when(line > 2, F.col("l_quantity")).alias("Dip"),
        (F.col("l_tax") * 12 + 0.0007).alias("Cu_pct"), ((F.col("l_quantity") + 0.037) / 6).alias("Au_ppm"), (30.0000001371 + F.col("l_extendedprice") / 2000).alias("SiO2"), (F.col("l_discount") * 80 + 0.0137).alias("Na2O"), (F.col("l_tax") * 60).alias("K2O"),
    )
    flat = domains.statistics(s, ["l_partkey", "l_returnflag"]).select(
        "l_partkey", "l_returnflag", F.col("age.n").alias("age_n"), F.col("age.lo").alias("age_lo"), F.col("age.hi").alias("age_hi"), F.col("age.mean").alias("age_mean"), F.col("age.sd").alias("age_sd"), "age.era", "age.eon",
        F.col("orientation.n").alias("turns"), "orientation.mean_strike", "orientation.mean_dip", "rock.silica", "rock.alkali", F.col("rock.name").alias("rock"),
        F.array_join(F.transform("grades", lambda g: F.concat_ws(" ", g["metal"], g["n"].cast("string"), g["category"])), "; ").alias("grades"),
    )
    return rounded(flat, "age_lo", "age_hi", "age_mean", "age_sd", "mean_strike", "mean_dip", "silica", "alkali")
