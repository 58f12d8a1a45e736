"""Statistics of samples by field of study: ages, ore grades, orientations, and the rock class of oxide analyses.

Samples are wide rows, a column a quantity; a table need not have all of them. All statistics come from one aggregation, whose
partial sums meet by group, so a group of any size costs each task a row of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INF = float("inf")
#: Mean silica below, mean alkali above and below, name; the first that fits. Fixed values.
ROCKS = (
    (45.0, -_INF, 3.0, "basanite"), (45.0, -_INF, _INF, "foidite / tephrite"),
    (52.0, -_INF, _INF, "basalt"), (57.0, -_INF, _INF, "basaltic andesite"), (63.0, -_INF, _INF, "andesite"),
    (69.0, 8.0, _INF, "phonolite"), (65.0, 5.0, _INF, "trachyandesite"), (69.0, -_INF, _INF, "dacite"),
    (77.0, 8.0, _INF, "phonolite"), (77.0, 5.0, _INF, "trachyte"), (77.0, -_INF, _INF, "rhyolite"),
    (_INF, -_INF, _INF, "high-silica rhyolite"),
)
#: Metal, mean grade from which it is moderate, from which it is high. Fixed values.
GRADES = (("Cu_pct", 0.3, 1.0), ("Au_ppm", 1.0, 5.0), ("Zn_pct", 2.5, 10.0), ("Pb_pct", 1.0, 5.0), ("Ni_pct", 0.5, 1.5))
#: Mean age in Ma above which, name; the first that fits. Fixed values.
EONS = ((2500.0, "Archean"), (541.0, "Proterozoic"))


def rock_class(silica: Column, alkali: Column) -> Column:
    """Name by mean silica and the sum of the mean alkalis; null where either is."""
    out = F.when(silica.isNull() | alkali.isNull(), F.lit(None).cast("string"))
    for below, above, under, name in ROCKS:
        fits = (silica < below) & (alkali > above) & (alkali < under) if below < _INF else F.lit(True)
        out = out.when(fits, name)
    return out


def grade_category(metal: str, mean: Column) -> Column:
    moderate, high = next((m, h) for name, m, h in GRADES if name == metal)
    return F.when(mean < moderate, "low grade").when(mean < high, "moderate grade").when(mean.isNotNull(), "high grade")


def eon(mean: Column) -> Column:
    out = F.when(mean.isNull(), F.lit(None).cast("string"))
    for above, name in EONS:
        out = out.when(mean > above, name)
    return out


def _number(samples: DataFrame, name: str) -> Column:
    """The quantity as a double; null where there is none, where it is no number, and where the table has no such column."""
    if name not in samples.columns:
        return F.lit(None).cast("double")
    value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value), value)


def statistics(samples: DataFrame, by: list[str]) -> DataFrame:
    """A row a group: structs ``age`` (n, lo, hi, mean, sd, era, eon), ``orientation`` (n, mean_strike, mean_dip), ``rock`` (n,
    silica, alkali, name) and the array ``grades`` (metal, n, lo, hi, mean, category) of the metals that it has.

    Ages and grades count where they are above zero, orientations where a sample has both angles; means are plain ones, of
    angles too. A single age has a spread of zero. A group without such values has a count of zero and nulls, or no grades. A
    rock needs a value of each of SiO2, Na2O and K2O, in whichever samples. Nulls and NaN are no values. Groups may be null; other
    columns are not read; an empty table gives an empty one.
    """
    metals = [name for name, _, _ in GRADES]
    read = samples.select(*by, *(_number(samples, c).alias(f"__{c}") for c in ("Age_Ma", "Strike", "Dip", "SiO2", "Na2O", "K2O", *metals)))
    above = lambda c: F.when(F.col(f"__{c}") > 0, F.col(f"__{c}"))
    both = F.col("__Strike").isNotNull() & F.col("__Dip").isNotNull()
    sums = [F.count(above("Age_Ma")).alias("__age_n"), F.min(above("Age_Ma")).alias("__age_lo"), F.max(above("Age_Ma")).alias("__age_hi"), F.avg(above("Age_Ma")).alias("__age_mean"), F.stddev_samp(above("Age_Ma")).alias("__age_sd")]
    sums += [F.count_if(both).alias("__turn_n"), *(F.avg(F.when(both, F.col(f"__{c}"))).alias(f"__turn_{c}") for c in ("Strike", "Dip"))]
    sums += [F.count("__SiO2").alias("__rock_n"), *(F.avg(f"__{c}").alias(f"__rock_{c}") for c in ("SiO2", "Na2O", "K2O"))]
    for m in metals:
        sums += [F.count(above(m)).alias(f"__{m}_n"), F.min(above(m)).alias(f"__{m}_lo"), F.max(above(m)).alias(f"__{m}_hi"), F.avg(above(m)).alias(f"__{m}_mean")]
    found = read.groupBy(*by).agg(*sums)
    mean, alkali = F.col("__age_mean"), F.col("__rock_Na2O") + F.col("__rock_K2O")
    spread = F.when(mean.isNotNull(), F.coalesce("__age_sd", F.lit(0.0)))
    grades = [F.when(F.col(f"__{m}_n") > 0, F.struct(F.lit(m).alias("metal"), *(F.col(f"__{m}_{c}").alias(c) for c in ("n", "lo", "hi", "mean")), grade_category(m, F.col(f"__{m}_mean")).alias("category"))) for m in metals]
    return found.select(
        *by,
        F.struct(F.col("__age_n").alias("n"), F.col("__age_lo").alias("lo"), F.col("__age_hi").alias("hi"), mean.alias("mean"), spread.alias("sd"), F.when(mean > EONS[-1][0], "Precambrian").alias("era"), eon(mean).alias("eon")).alias("age"),
        F.struct(F.col("__turn_n").alias("n"), F.col("__turn_Strike").alias("mean_strike"), F.col("__turn_Dip").alias("mean_dip")).alias("orientation"),
        F.struct(F.col("__rock_n").alias("n"), F.col("__rock_SiO2").alias("silica"), alkali.alias("alkali"), rock_class(F.col("__rock_SiO2"), alkali).alias("name")).alias("rock"),
        F.array_compact(F.array(*grades)).alias("grades"),
    )
