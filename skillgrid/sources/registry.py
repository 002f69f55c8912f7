"""Dimension tables of models and statistics. Both are fixed by the code and a few rows long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Models with their leads (days), lead windows, cycle hour and default flag.
MODELS = [
    ("gfs", "GFS", 1, 14, [(1, 7), (7, 14), (1, 10)], 12, True),
    ("nbm", "NBM", 1, 11, [(1, 7), (7, 11), (1, 10)], 12, False),
]
# Statistics with label, unit, colour map, kind and default flag.
STATISTICS = [
    ("bias", "Bias", "mm", "diverging_reversed", "verification", False),
    ("sacc", "SACC", "%", "diverging_reversed", "verification", False),
    ("nrmse", "NRMSE", "%", "diverging", "verification", False),
    ("nmad", "NMAD", "%", "diverging", "verification", True),
    ("forecast", "Forecast", "mm", "sequential", "display", False),
]
# Seasons and their months; month and season names.
SEASONS = {"djf": (12, 1, 2), "mam": (3, 4, 5), "jja": (6, 7, 8), "son": (9, 10, 11)}
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
SEASON_NAMES = {"djf": "Winter", "mam": "Spring", "jja": "Summer", "son": "Autumn"}

DEFAULT_MODEL = next((m[0] for m in MODELS if m[6]), MODELS[0][0])
DEFAULT_STATISTIC = next((s[0] for s in STATISTICS if s[5]), STATISTICS[0][0])


def model_dim(spark: SparkSession) -> DataFrame:
    """``model, label, lead_min, lead_max, lead_windows, cycle_hour, is_default, forecast_hours``."""
    schema = "model string, label string, lead_min int, lead_max int, lead_windows array<struct<start:int,end:int>>, cycle_hour int, is_default boolean"
    hours = F.transform(F.sequence("lead_min", "lead_max"), lambda d: d * 24)
    return spark.createDataFrame(MODELS, schema).withColumn("forecast_hours", hours)


def lead_options(models: DataFrame) -> DataFrame:
    """``model, position, lead_key``: every lead day of a model, then its windows that lie within them."""
    days = F.transform(F.sequence("lead_min", "lead_max"), lambda d: d.cast("string"))
    fitting = F.filter("lead_windows", lambda w: (w["start"] >= F.col("lead_min")) & (w["end"] <= F.col("lead_max")))
    windows = F.transform(fitting, lambda w: F.concat_ws("_", w["start"].cast("string"), w["end"].cast("string")))
    return models.select("model", F.posexplode(F.concat(days, windows)).alias("position", "lead_key"))


def statistic_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATISTICS, "statistic string, label string, units string, colormap string, kind string, is_default boolean")


def lead_windows(spark: SparkSession) -> DataFrame:
    """One row for each model and lead window: ``model, start, end, lead_key``."""
    w = model_dim(spark).select("model", F.explode("lead_windows").alias("w"))
    return w.select("model", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.concat_ws("_", "w.start", "w.end").alias("lead_key"))
