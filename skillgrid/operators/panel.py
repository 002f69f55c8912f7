"""Panel tables: one row a lead, with statistics, best model and forecasts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import interpolate


def panel(means: DataFrame, statistics: list[str], winners: DataFrame | None = None, forecast: DataFrame | None = None, model_keys: tuple[str, ...] = ()) -> DataFrame:
    """``region_id, model, lead`` and a column for each statistic, the best model and each model's forecast."""
    out = means.groupBy("region_id", "model", "lead").pivot("statistic", statistics).agg(F.first("value"))
    if winners is not None:
        out = out.join(winners.select("region_id", "lead", F.col("model").alias("best_model")), ["region_id", "lead"], "left")
    if forecast is not None:
        wide = forecast.groupBy("region_id", "lead").pivot("model", list(model_keys)).agg(F.first("value"))
        out = out.join(wide.select("region_id", "lead", *(F.col(m).alias(f"forecast_{m}") for m in model_keys)), ["region_id", "lead"], "left")
    return out


def curve_summary(means: DataFrame) -> DataFrame:
    """Least and most, first and last value of a lead curve, and its slope a day."""
    v = F.col("value")
    known = means.where(v.isNotNull()).groupBy("region_id", "model", "statistic").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("value", "lead").alias("first_value"), F.max_by("value", "lead").alias("last_value"), F.min("lead").alias("first_lead"), F.max("lead").alias("last_lead"))
    return known.withColumn("slope", F.try_divide(F.col("last_value") - F.col("first_value"), (F.col("last_lead") - F.col("first_lead")).cast("double")))


def at_lead(means: DataFrame, at: Column) -> DataFrame:
    """Curves at the lead ``at`` (a number or a column of ``means``), between the leads on both sides; clamped to the first and last lead.

    A missing side takes the value of the other. Regions, models and statistics are one row each for each ``at``.
    """
    keys = ["region_id", "model", "statistic"]
    own = Window.partitionBy(*keys)
    rows = means.withColumn("at", F.greatest(F.least(at.cast("double"), F.max("lead").over(own).cast("double")), F.min("lead").over(own).cast("double")))
    below, above = F.col("lead") == F.floor("at"), F.col("lead") == F.ceil("at")
    ends = rows.where(below | above).groupBy(*keys, "at").agg(F.max(F.when(below, F.col("value"))).alias("low"), F.max(F.when(above, F.col("value"))).alias("high"))
    return ends.select(*keys, "at", interpolate(F.col("low"), F.col("high"), F.col("at") - F.floor("at")).alias("value"))


def at_fraction(means: DataFrame, step: float) -> DataFrame:
    """Curves at lead + ``step`` (0 to 1), on an axis that has every lead; clamped at its end."""
    w = Window.partitionBy("region_id", "model", "statistic").orderBy("lead")
    after, last = F.lead("value").over(w), F.lead("lead").over(w).isNull()
    value = F.when(last, F.col("value")).otherwise(interpolate(F.col("value"), after, F.lit(step)))
    return means.select("region_id", "model", "statistic", (F.col("lead") + step).alias("at"), value.alias("value"))
