"""Unit families and pools of measurements that may be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: unit, base unit of its family, factor, offset, what the base measures. Fixed values.
FAMILIES = (
    ("kbar", "kbar", 1.0, 0.0, "pressure"), ("GPa", "kbar", 10.0, 0.0, "pressure"), ("MPa", "kbar", 0.01, 0.0, "pressure"), ("bar", "kbar", 1e-3, 0.0, "pressure"), ("kPa", "kbar", 1e-5, 0.0, "pressure"),
    ("Ma", "Ma", 1.0, 0.0, "age"), ("Ga", "Ma", 1000.0, 0.0, "age"), ("ka", "Ma", 0.001, 0.0, "age"),
    ("km", "km", 1.0, 0.0, "distance"), ("m", "km", 1e-3, 0.0, "distance"), ("cm", "km", 1e-5, 0.0, "distance"), ("mm", "km", 1e-6, 0.0, "distance"), ("µm", "km", 1e-9, 0.0, "distance"), ("nm", "km", 1e-12, 0.0, "distance"),
    ("%", "%", 1.0, 0.0, "percentage/composition"), ("wt%", "%", 1.0, 0.0, "percentage/composition"), ("‰", "%", 0.1, 0.0, "percentage/composition"),
    ("ppm", "ppm", 1.0, 0.0, "concentration"), ("ppb", "ppm", 0.001, 0.0, "concentration"),
    ("°C", "°C", 1.0, 0.0, "temperature"), ("K", "°C", 1.0, -273.15, "temperature"),
)
#: Labels that say nothing of what was measured. Fixed values.
GENERIC = ("", "measurement", "value", "unknown")


def unit_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAMILIES), "unit string, base string, factor double, offset double, kind string")


def canonical(measurements: DataFrame) -> DataFrame:
    """Values and errors in the base unit of their family; other units stay. A shift leaves an error as it is."""
    units = F.broadcast(unit_table(measurements.sparkSession))
    known = F.col("base").isNotNull()
    out = measurements.join(units, "unit", "left")
    return out.withColumns({
        "value": F.when(known, F.col("value") * F.col("factor") + F.col("offset")).otherwise(F.col("value")), "uncertainty": F.when(known, F.col("uncertainty") * F.abs("factor")).otherwise(F.col("uncertainty")), "unit": F.coalesce("base", "unit"),
        "measurement": F.when(known & F.lower(F.coalesce("measurement", F.lit(""))).isin(*GENERIC), F.col("kind")).otherwise(F.col("measurement")),
    }).drop("base", "factor", "offset", "kind")


def labelled(measurements: DataFrame) -> DataFrame:
    """Study rows (pool, paper_id, effect, variance): values by label and base unit; the variance of a mean with an error and a
    size, else 1. Rows without label and unit are left out."""
    c = canonical(measurements)
    label = F.lower(F.trim(F.coalesce("measurement", F.lit(""))))
    named = c.withColumn("pool", F.concat_ws(" ", F.when(label == "", F.lit("value")).otherwise(label), F.concat(F.lit("("), F.coalesce("unit", F.lit("")), F.lit(")")))).where((label != "") | (F.coalesce("unit", F.lit("")) != ""))
    variance = F.coalesce(F.try_divide(F.col("uncertainty") * F.col("uncertainty"), F.col("n").cast("double")), F.lit(1.0))
    return named.select("pool", "paper_id", F.col("value").alias("effect"), F.when(variance > 0, variance).otherwise(1.0).alias("variance"))


def pools(measurements: DataFrame) -> DataFrame:
    """The study rows of ``labelled`` of which a pool has two or more."""
    rows = labelled(measurements)
    many = rows.groupBy("pool").agg(F.count("*").alias("k")).where("k >= 2").select("pool")
    return rows.join(many, "pool", "left_semi")


def in_band(values: DataFrame, bands: DataFrame, value: str, band: str = "band") -> DataFrame:
    """The band [low, high) that a value is in, null for none; bands are a few dozen rows."""
    joined = values.join(F.broadcast(bands), (F.col(value) >= F.col("low")) & (F.col(value) < F.col("high")), "left")
    return joined.drop("low", "high")


def plausible(measurements: DataFrame, ranges: DataFrame) -> DataFrame:
    """Measurements within the range of their label; labels without a range stay."""
    return measurements.join(ranges, "measurement", "left").where("low IS NULL OR value BETWEEN low AND high").drop("low", "high")
