"""Summaries of measurements, years, concepts and gaps.

Quartiles are those of an index into the sorted values (``sorted[n // 4]``), read off running counts of equal values.
"""

from __future__ import annotations

import random
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def at_index(values: DataFrame, by: list[str], value: str, parts: dict[str, tuple[int, int]]) -> DataFrame:
    """(by, a column for each part): the value at place ``n * a // b`` of each group's sorted values, counted from 0.

    Equal values are counted first, so a group of any size is ordered by its distinct values alone.
    """
    counts = values.groupBy(*by, value).agg(F.count("*").alias("__c"))
    key = by or [F.lit(0)]
    run = counts.withColumns({"__upto": F.sum("__c").over(W.partitionBy(*key).orderBy(value)), "__n": F.sum("__c").over(W.partitionBy(*key))})
    return run.groupBy(*by).agg(*(F.min(F.when(F.col("__upto") > F.floor(F.col("__n") * a / b), F.col(value))).alias(name) for name, (a, b) in parts.items()))


def basic(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, least, greatest, mean, median and sample deviation (0 for one) of each group."""
    v = F.col(value)
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"))


def robust(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Adds to the basic summary quartiles (from 4 values on, else the ends), the median distance from the median, how many lie
    over two deviations from the mean, and a flag of two modes. Groups of two or more."""
    base = basic(values, by, value).where("n >= 2")
    q = at_index(values, by, value, {"q1": (1, 4), "q3": (3, 4)})
    joined = values.join(base, by)
    away = joined.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"), F.count_if((F.col("sd") > 0) & (F.abs(F.col(value) - F.col("mean")) > 2 * F.col("sd"))).alias("n_outliers"))
    out = base.join(q, by).join(away, by)
    few = F.col("n") < 4
    spread = F.coalesce(F.try_divide(F.col("sd"), F.abs("mean")), F.lit(0.0))
    return out.withColumns({"q1": F.when(few, F.col("lo")).otherwise(F.col("q1")), "q3": F.when(few, F.col("hi")).otherwise(F.col("q3")), "two_modes": (spread > 0.5) & ~few})


def median_interval(values: DataFrame, by: list[str], value: str = "value", draws: int = 1000, seed: int = 42) -> DataFrame:
    """(by, low, high): percentile interval of the median of groups of ten values or more, by draws with replacement."""
    kinds = ", ".join(f"`{b}` {values.schema[b].dataType.simpleString()}" for b in by)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = sorted(rows["v"])
        if len(v) < 10:
            return pd.DataFrame(columns=[*by, "low", "high"])
        r = random.Random(seed)
        m = sorted(median(r.choices(v, k=len(v))) for _ in range(draws))
        return pd.DataFrame([{**{b: rows[b].iloc[0] for b in by}, "low": m[int(0.025 * draws)], "high": m[int(0.975 * draws)]}])

    return values.select(*by, F.col(value).cast("double").alias("v")).groupBy(*by).applyInPandas(run, f"{kinds}, low double, high double")


def convergence(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, n, n_inliers, n_outliers, lo, hi, mid, consistent) of groups of three or more: inliers lie within 1.5 times the
    quartile distance; they agree when their span is at most half the upper median."""
    q = at_index(values, by, value, {"q1": (1, 4), "mid": (1, 2), "q3": (3, 4)})
    joined = values.join(q, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    out = joined.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inliers"), F.count_if(~inside).alias("n_outliers"), F.min(F.when(inside, F.col(value))).alias("lo"), F.max(F.when(inside, F.col(value))).alias("hi"), F.first("mid").alias("mid"))
    return out.where("n >= 3").withColumn("consistent", F.coalesce(F.try_divide(F.col("hi") - F.col("lo"), F.col("mid")), F.lit(0.0)) <= 0.5)


def trends(papers: DataFrame, year: str = "year") -> DataFrame:
    """One row: dated papers, first, last and peak year, and the share of the last five years."""
    years = papers.where(F.col(year).isNotNull()).groupBy(F.col(year).alias("y")).agg(F.count("*").alias("c"))
    top = years.agg(F.max("y").alias("last"))
    return years.crossJoin(F.broadcast(top)).agg(F.sum("c").alias("n"), F.min("y").alias("first"), F.max("y").alias("last"), F.max_by("y", F.struct("c", -F.col("y"))).alias("peak"), (F.sum(F.when(F.col("y") >= F.col("last") - 5, F.col("c")).otherwise(0)) / F.sum("c")).alias("recent_share"))


def histogram(papers: DataFrame, year: str = "year", step: int = 1, width: int = 40) -> DataFrame:
    """(bin, n, bar): counts by year or decade and the length of their bars."""
    c = papers.where(F.col(year).isNotNull()).groupBy((F.floor(F.col(year) / step) * step).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.max("n").alias("__top")))).withColumn("bar", F.floor(F.col("n") / F.col("__top") * width).cast("int")).drop("__top")


def top_values(papers: DataFrame, column: str, most: int, first: int | None = None, order: str | None = None) -> DataFrame:
    """(value, n): the most frequent entries of a list column (of its first entries), those seen first before equals."""
    listed = F.slice(column, 1, first) if first else F.col(column)
    rows = papers.select(F.posexplode(listed).alias("at", "value"), *( [F.col(order).alias("o")] if order else [F.lit(0).alias("o")]))
    return rows.where("value IS NOT NULL AND value <> ''").groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("o", "at")).alias("f")).orderBy(F.desc("n"), "f", "value").limit(most).select("value", "n")


def gaps(papers: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row of flags: few recent papers, few with numbers, one theme for most, no coupling. Columns: year, n_values, theme."""
    last = papers.agg(F.max("year").alias("__last"))
    themes = papers.groupBy("theme").agg(F.count("*").alias("c")).agg(F.max("c").alias("__big"), F.count("*").alias("__themes"))
    row = papers.crossJoin(F.broadcast(last)).agg(F.count("*").alias("n"), F.count("year").alias("dated"), F.count_if(F.col("year") >= F.col("__last") - 5).alias("recent"), F.count_if(F.col("n_values") > 0).alias("measured")).crossJoin(themes)
    linked = F.lit(False) if edges is None else F.lit(edges.isEmpty())
    return row.select(
        "n", ((F.col("dated") >= 5) & (F.col("recent") < 0.3 * F.col("dated"))).alias("few_recent"), (F.col("measured") < 0.5 * F.col("n")).alias("few_measured"),
        ((F.col("__themes") >= 2) & (F.col("__big") >= 0.6 * F.col("n"))).alias("one_theme"), linked.alias("no_coupling"),
    )


def dataset_summary(table: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, n, lo, hi, mean, sd) of numeric columns, in one pass."""
    stacked = table.select(F.inline(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns)))).where("value IS NOT NULL")
    return stacked.groupBy("variable").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))


def method_landscape(papers: DataFrame, values: DataFrame) -> DataFrame:
    """(theme, n, ranges of temperature and pressure): papers of a theme and what they measured."""
    kinds = values.join(papers.select("paper_id", "theme"), "paper_id").groupBy("theme").agg(*(f(F.when(F.col("measurement") == m, F.col("value"))).alias(f"{m}_{n}") for m in ("temperature", "pressure") for n, f in (("lo", F.min), ("hi", F.max))))
    return papers.groupBy("theme").agg(F.count("*").alias("n")).join(kinds, "theme", "left")


def cross_theme_medians(values: DataFrame, least: int = 5) -> DataFrame:
    return values.groupBy("measurement").agg(F.count("*").alias("n"), F.median("value").alias("median"), F.count_distinct("theme").alias("themes")).where(F.col("n") >= least)


def classify_measurement(label: Column, unit: Column, value: Column) -> Column:
    """What a value measures: by its unit, else its label, else its size."""
    low = F.lower(F.coalesce(label, F.lit("")))
    by_unit = F.when(unit.isin("°C", "C", "K"), "temperature").when(unit.isin("kbar", "GPa", "MPa", "kPa", "bar"), "pressure").when(unit.isin("Ma", "Ga", "ka"), "age")
    by_label = F.when(low.contains("temp"), "temperature").when(low.contains("press"), "pressure").when(low.rlike("\\bage\\b|geochron"), "age")
    return F.coalesce(by_unit, by_label, F.when(value.between(200, 1600), "temperature").when(value.between(0.1, 100), "pressure").otherwise("other"))


def bundle(papers: DataFrame) -> DataFrame:
    """Type and text length by theme for a compact overview."""
    return papers.groupBy("theme").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
