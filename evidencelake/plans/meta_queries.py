"""Effect sizes, pooling, heterogeneity, bias, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import effects as E
from ..operators import effects as arms
from ..operators import meta, units
from .papers import MEASURED_SQL, STUDIES_SQL, measured, studies
from .registry import query, table

BY = ["l_returnflag", "l_linestatus"]


def rounded(frame: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({n: F.round(n, digits) for n in names})


_HET = f"""WITH {STUDIES_SQL}, m AS (SELECT l_returnflag, l_linestatus, count(*) AS k, sum(1 / variance) AS sw, sum(effect / variance) / sum(1 / variance) AS mu, sum(1 / (variance * variance)) AS sww FROM studies GROUP BY ALL),
h AS (SELECT l_returnflag, l_linestatus, any_value(k) AS k, any_value(sw) AS sw, any_value(mu) AS mu, any_value(sww) AS sww, sum((effect - mu) * (effect - mu) / variance) AS q FROM studies JOIN m USING (l_returnflag, l_linestatus) GROUP BY ALL),
t AS (SELECT *, k - 1 AS df, greatest((q - (k - 1)) / (sw - sww / sw), 0) AS tau FROM h)"""


@query("heterogeneity", _HET + " SELECT l_returnflag, l_linestatus, k, round(q, 4) AS q, df, round(CASE WHEN q > 0 THEN greatest((q - df) / q * 100, 0) ELSE 0 END, 6) AS i_squared, round(tau, 8) AS tau_squared, round(q / df, 6) AS h_squared FROM t")
def heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = meta.heterogeneity(studies(spark, sf_dir), BY)
    return rounded(rounded(rounded(h, "i_squared", "h_squared"), "tau_squared", digits=8), "q", digits=4)


@query("pool_fixed", f"WITH {STUDIES_SQL}, p AS (SELECT l_returnflag, l_linestatus, count(*) AS k, sum(effect / variance) / sum(1 / variance) AS e, sqrt(1 / sum(1 / variance)) AS s FROM studies GROUP BY ALL) SELECT l_returnflag, l_linestatus, k, round(e, 6) AS effect, round(s, 8) AS se, round(e - 1.959964 * s, 6) AS ci_lower, round(e + 1.959964 * s, 6) AS ci_upper, round(e / s, 4) AS z_score, 'fixed' AS model FROM p")
def pool_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = meta.pool_fixed(studies(spark, sf_dir), BY)
    return rounded(rounded(rounded(p, "effect", "ci_lower", "ci_upper"), "se", digits=8), "z_score", digits=4)


@query("pool_random_dl", _HET + """, g AS (SELECT l_returnflag, l_linestatus, tau FROM t),
p AS (SELECT l_returnflag, l_linestatus, any_value(tau) AS tau, count(*) AS k, sum(effect / (variance + tau)) / sum(1 / (variance + tau)) AS e, sqrt(1 / sum(1 / (variance + tau))) AS s FROM studies JOIN g USING (l_returnflag, l_linestatus) GROUP BY l_returnflag, l_linestatus)
SELECT l_returnflag, l_linestatus, k, round(e, 6) AS effect, round(s, 8) AS se, round(tau, 8) AS tau_squared FROM p""")
def pool_random_dl(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = meta.pool_random(studies(spark, sf_dir), BY).select(*BY, "k", "effect", "se", "tau_squared")
    return rounded(rounded(p, "effect"), "se", "tau_squared", digits=8)


@query("pool_reml_hksj")
def pool_reml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.pool_advanced(studies(spark, sf_dir), BY)


@query("pool_paule_mandel")
def pool_pm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.pool_advanced(studies(spark, sf_dir), BY, method="pm", hksj=False)


@query("leave_one_out")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_acctbal") / 1000).alias("effect"), (F.lit(0.1) + F.col("s_suppkey") % 7 / 10).alias("variance"))
    return meta.leave_one_out(s, ["s_nationkey"])


@query("bias_diagnostics")
def bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_acctbal") / 1000).alias("effect"), (F.lit(0.1) + F.col("c_custkey") % 17 / 10).alias("variance"))
    return meta.bias_diagnostics(s, ["c_nationkey"])


@query("egger_regression", f"""WITH {STUDIES_SQL}, x AS (SELECT l_returnflag, l_linestatus, effect / sqrt(variance) AS y, 1 / sqrt(variance) AS p FROM studies),
r AS (SELECT l_returnflag, l_linestatus, count(*) AS n, regr_intercept(y, p) AS intercept, regr_sxx(y, p) AS sxx, regr_syy(y, p) AS syy, regr_sxy(y, p) AS sxy, avg(p) AS mx FROM x GROUP BY ALL)
SELECT l_returnflag, l_linestatus, n, round(intercept, 6) AS intercept, round(sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + mx * mx / sxx)), 6) AS se_intercept, n - 2 AS df FROM r WHERE n >= 3""")
def egger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(meta.egger(studies(spark, sf_dir), BY).drop("t"), "intercept", "se_intercept")


@query("subgroup_effects")
def subgroup_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.subgroups(studies(spark, sf_dir), ["l_returnflag"], "l_linestatus")[0]


@query("subgroup_heterogeneity", f"""WITH {STUDIES_SQL}, g AS (SELECT l_returnflag, l_linestatus, sum(effect / variance) / sum(1 / variance) AS mu FROM studies GROUP BY ALL), t AS (SELECT l_returnflag, sum(effect / variance) / sum(1 / variance) AS mu FROM studies GROUP BY ALL),
w AS (SELECT l_returnflag, l_linestatus, sum((effect - mu) * (effect - mu) / variance) AS q, count(*) AS n FROM studies JOIN g USING (l_returnflag, l_linestatus) GROUP BY ALL), a AS (SELECT l_returnflag, sum((effect - mu) * (effect - mu) / variance) AS q FROM studies JOIN t USING (l_returnflag) GROUP BY ALL)
SELECT l_returnflag, round(sum(CASE WHEN n >= 2 THEN w.q ELSE 0 END), 3) AS q_within, round(greatest(any_value(a.q) - sum(CASE WHEN n >= 2 THEN w.q ELSE 0 END), 0), 3) AS q_between, greatest(count(*) - 1, 1) AS df_between FROM w JOIN a USING (l_returnflag) GROUP BY ALL""")
def subgroup_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(meta.subgroups(studies(spark, sf_dir), ["l_returnflag"], "l_linestatus")[1], "q_within", "q_between", digits=3)


@query("decade_pools")
def decade_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1e5).alias("effect"), F.lit(0.01).alias("variance"), F.year("o_orderdate").alias("year"))
    return meta.decade_pools(s, ["o_orderpriority"])


@query("pool_certainty")
def pool_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = studies(spark, sf_dir)
    return meta.certainty(meta.pool_random(s, BY).join(meta.heterogeneity(s, BY).select(*BY, "i_squared"), BY))


_ARMS = """a AS (SELECT o_custkey AS paper_id, avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS mean1, stddev_samp(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS sd1, count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS n1,
  avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) AS mean2, stddev_samp(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) AS sd2, count(CASE WHEN o_orderkey % 2 = 1 THEN 1 END) AS n2 FROM orders GROUP BY 1)"""


def order_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    side = lambda r: F.when(F.col("o_orderkey") % 2 == r, F.col("o_totalprice"))
    return o.groupBy(F.col("o_custkey").alias("paper_id")).agg(*(x for k, r in ((1, 0), (2, 1)) for x in (F.avg(side(r)).alias(f"mean{k}"), F.stddev_samp(side(r)).alias(f"sd{k}"), F.count(side(r)).alias(f"n{k}"))))


@query("effects_continuous", f"""WITH {_ARMS}, d AS (SELECT *, sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / greatest(n1 + n2 - 2, 1)) AS p FROM a WHERE sd1 IS NOT NULL AND sd2 IS NOT NULL), e AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE (mean1 - mean2) / p END AS d FROM d)
SELECT paper_id, round(CASE WHEN n1 + n2 <= 3 THEN d ELSE d * (1 - 3 / (4.0 * (n1 + n2) - 9)) END, 6) AS effect, round((n1 + n2)::DOUBLE / (n1 * n2) + d * d / (2.0 * (n1 + n2 - 2)), 6) AS variance, 'smd' AS scale FROM e""")
def effects_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    pairs = order_arms(spark, sf_dir).where("sd1 IS NOT NULL AND sd2 IS NOT NULL").withColumns({"ci_lower": none, "ci_upper": none})
    return rounded(arms.continuous(pairs), "effect", "variance")


_TWO = "t AS (SELECT l_suppkey AS paper_id, count(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 1 END) AS events1, count(CASE WHEN l_linestatus = 'O' THEN 1 END) + 1 AS total1, count(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 END) AS events2, count(CASE WHEN l_linestatus = 'F' THEN 1 END) + 1 AS total2 FROM lineitem GROUP BY 1)"


def two_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = F.col("l_linestatus"), F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("paper_id")).agg(F.count_if((s == "O") & (r == "N")).alias("events1"), (F.count_if(s == "O") + 1).alias("total1"), F.count_if((s == "F") & (r == "R")).alias("events2"), (F.count_if(s == "F") + 1).alias("total2"))


@query("effects_odds_ratio", f"WITH {_TWO}, c AS (SELECT paper_id, events1 + 0.5 AS a, total1 - events1 + 0.5 AS b, events2 + 0.5 AS c, total2 - events2 + 0.5 AS d FROM t) SELECT paper_id, round(ln(a * d / (b * c)), 6) AS effect, round(1 / a + 1 / b + 1 / c + 1 / d, 6) AS variance, 'log_or' AS scale FROM c")
def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arms.dichotomous(two_by_two(spark, sf_dir)), "effect", "variance")


@query("effects_risk_ratio", f"WITH {_TWO} SELECT paper_id, round(ln(greatest((events1::DOUBLE / total1) / (events2::DOUBLE / total2), 1e-10)), 6) AS effect, round(1 / (events1 + 0.5) - 1 / (total1 + 1.0) + 1 / (events2 + 0.5) - 1 / (total2 + 1.0), 6) AS variance, 'log_rr' AS scale FROM t WHERE events2 > 0")
def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arms.dichotomous(two_by_two(spark, sf_dir), "rr"), "effect", "variance")


@query("effect_conversions", "SELECT s_suppkey, round(ln(greatest(s_acctbal / 1000 + 2, 1e-10)) / 1.8142, 6) AS d, round(exp(s_acctbal / 10000 * 1.8142), 6) AS ratio, CASE WHEN s_acctbal = 0 THEN NULL ELSE round(1 / abs(s_acctbal / 10000), 4) END AS nnt, round(s_acctbal / 1000 - 1.959964 * sqrt(greatest(s_acctbal / 100, 0)), 5) AS low FROM supplier")
def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("s_acctbal")
    low, _ = E.interval(x / 1000, E.standard_error(x / 100))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(E.or_to_d(x / 1000 + 2), 6).alias("d"), F.round(E.d_to_or(x / 10000), 6).alias("ratio"), F.when(x != 0, F.round(E.number_needed_to_treat(x / 10000), 4)).alias("nnt"), F.round(low, 5).alias("low"))


_UNITS = "u(unit, base, factor, shift, kind) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c!r}::DOUBLE, {d!r}::DOUBLE, '{e}')" for a, b, c, d, e in units.FAMILIES) + ")"


@query("unit_canonical", f"WITH {MEASURED_SQL}, {_UNITS} SELECT seq, round(CASE WHEN base IS NULL THEN value ELSE value * factor + shift END, 6) AS value, coalesce(base, unit) AS unit, CASE WHEN base IS NULL THEN measurement ELSE kind END AS measurement, round(CASE WHEN base IS NULL THEN uncertainty ELSE uncertainty * abs(factor) END, 6) AS uncertainty FROM measured LEFT JOIN u USING (unit)")
def unit_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(units.canonical(measured(spark, sf_dir)).select("seq", "value", "unit", "measurement", "uncertainty"), "value", "uncertainty")


@query("unit_pools", f"""WITH {MEASURED_SQL}, {_UNITS}, c AS (SELECT CASE WHEN base IS NULL THEN 'value (' || unit || ')' ELSE kind || ' (' || base || ')' END AS pool, CASE WHEN base IS NULL THEN value ELSE value * factor + shift END AS e,
  CASE WHEN coalesce(uncertainty * coalesce(abs(factor), 1) * uncertainty * coalesce(abs(factor), 1) / n, 1) > 0 THEN coalesce(uncertainty * coalesce(abs(factor), 1) * uncertainty * coalesce(abs(factor), 1) / n, 1) ELSE 1 END AS v FROM measured LEFT JOIN u USING (unit))
SELECT pool, count(*) AS k, round(sum(e / v) / sum(1 / v), 6) AS effect FROM c GROUP BY 1 HAVING count(*) >= 2""")
def unit_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(meta.pool_fixed(units.pools(measured(spark, sf_dir)), ["pool"]).select("pool", "k", "effect"), "effect")


@query("range_effects", "SELECT l_orderkey::VARCHAR AS paper_id, round((min(l_quantity) + max(l_quantity)) / 2, 6) AS effect, round(CASE WHEN max(l_quantity) > min(l_quantity) THEN power(greatest((max(l_quantity) - min(l_quantity)) / 4, 5), 2) ELSE 625 END, 6) AS variance FROM lineitem GROUP BY l_orderkey")
def range_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("paper_id")).agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return rounded(arms.from_ranges(r), "effect", "variance")


@query("physical_bands", f"WITH {MEASURED_SQL} SELECT seq, value, CASE WHEN value < 2 THEN 'low' WHEN value < 10 THEN 'middle' WHEN value < 40 THEN 'high' END AS band FROM measured WHERE unit = 'kbar'")
def physical_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([("low", 0.0, 2.0), ("middle", 2.0, 10.0), ("high", 10.0, 40.0)], "band string, low double, high double")
    return units.in_band(measured(spark, sf_dir).where("unit = 'kbar'").select("seq", "value"), bands, "value")


@query("plausible_values", f"WITH {MEASURED_SQL} SELECT seq, value, unit FROM measured WHERE unit NOT IN ('kbar', '°C') OR (unit = 'kbar' AND value BETWEEN 0.3 AND 15) OR (unit = '°C' AND value BETWEEN 5 AND 60)")
def plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([("kbar", 0.3, 15.0), ("°C", 5.0, 60.0)], "measurement string, low double, high double")
    rows = measured(spark, sf_dir).select("seq", "value", F.col("unit").alias("measurement"))
    return units.plausible(rows, ranges).select("seq", "value", F.col("measurement").alias("unit"))
