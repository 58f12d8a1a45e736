"""Study effects of a corpus, from pairs of arms, event counts, stated effects and single values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import effects as E


def continuous(pairs: DataFrame) -> DataFrame:
    """(paper_id, effect, variance, scale) of two arms (mean1, sd1, n1, mean2, sd2, n2): standardised with the small-sample
    correction where deviations and sizes are known; a raw difference else, with its interval's variance or that of the sizes.

    The corrected difference keeps the variance of the uncorrected one.
    """
    full = F.col("sd1").isNotNull() & F.col("sd2").isNotNull() & F.col("n1").isNotNull() & F.col("n2").isNotNull()
    c = F.col
    d = E.cohens_d(c("mean1"), c("sd1"), c("n1"), c("mean2"), c("sd2"), c("n2"))
    by_size = F.when(c("n1").isNotNull() & c("n2").isNotNull(), 1.0 / c("n1") + 1.0 / c("n2"))
    raw = F.coalesce(E.variance_from_interval(c("ci_lower"), c("ci_upper")), by_size)
    out = pairs.select("paper_id", F.when(full, E.hedges_g(d, c("n1"), c("n2"))).otherwise(E.mean_difference(c("mean1"), c("mean2"))).alias("effect"), F.when(full, E.variance_d(c("n1"), c("n2"), d)).otherwise(raw).alias("variance"), F.when(full, "smd").otherwise("difference").alias("scale"))
    return out.where("effect IS NOT NULL AND variance > 0")


def dichotomous(tables: DataFrame, measure: str = "or") -> DataFrame:
    """Log odds or risk ratios of events of totals in two arms (events1, total1, events2, total2)."""
    a, b, c, d = F.col("events1"), F.col("total1") - F.col("events1"), F.col("events2"), F.col("total2") - F.col("events2")
    if measure == "or":  # the cells by arm: event and exposure in a, no event and exposure in b
        effect, variance = E.log_ratio(E.odds_ratio(a, c, b, d)), E.variance_log_or(a, b, c, d)
    else:
        effect, variance = E.log_ratio(E.risk_ratio(a, b, c, d)), E.variance_log_rr(a, b, c, d)
    return tables.select("paper_id", effect.alias("effect"), variance.alias("variance"), F.lit(f"log_{measure}").alias("scale")).where("effect IS NOT NULL")


def stated(values: DataFrame, n: int = 30) -> DataFrame:
    """Effects as papers state them: standardised differences at ``n`` an arm, ratios with an interval on the log scale."""
    ratio = F.col("kind").isin("or", "rr", "hr")
    se = (E.log_ratio(F.col("ci_upper")) - E.log_ratio(F.col("ci_lower"))) / (2 * 1.96)
    out = values.select("paper_id", F.when(ratio, E.log_ratio(F.col("value"))).otherwise(F.col("value")).alias("effect"), F.when(ratio, se * se).otherwise(E.variance_d(F.lit(n), F.lit(n), F.col("value"))).alias("variance"), F.col("kind").alias("scale"))
    return out.where("variance > 0")


def from_ranges(ranges: DataFrame) -> DataFrame:
    """Middles of ranges; their error is a quarter of the width, five at least, and 25 for a single value."""
    se = F.when(F.col("high") > F.col("low"), F.greatest((F.col("high") - F.col("low")) / 4, F.lit(5.0))).otherwise(25.0)
    return ranges.select("paper_id", ((F.col("low") + F.col("high")) / 2).alias("effect"), (se * se).alias("variance"))
