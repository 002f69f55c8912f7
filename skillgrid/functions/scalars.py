"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.registry import DEFAULT_MODEL, MONTH_NAMES, SEASON_NAMES, SEASONS


def finite(x: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def init_date(name: Column) -> Column:
    """Init date of a run's name ``YYYYMMDD_12z``."""
    return F.to_date(F.split(name, "_")[0], "yyyyMMdd")


def lead_of_hour(fhour: Column) -> Column:
    return F.floor(fhour / 24).cast("int")


def window_key(start: Column, end: Column) -> Column:
    return F.concat_ws("_", start.cast("string"), end.cast("string"))


def month_key(month: Column) -> Column:
    return F.lpad(month.cast("string"), 2, "0")


def season_of(month: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, months in SEASONS.items():
        out = out.when(month.isin(*months), name)
    return out


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*(F.lit(m) for m in MONTH_NAMES)), month)


def season_name(season: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, name in SEASON_NAMES.items():
        out = out.when(season == key, name)
    return out


def lead_label(lead_key: Column) -> Column:
    """``Day 3`` or ``1–7 Day Average``."""
    parts = F.split(lead_key, "_")
    return F.when(F.size(parts) == 2, F.concat(parts[0], F.lit("–"), F.element_at(parts, -1), F.lit(" Day Average"))).otherwise(F.concat(F.lit("Day "), lead_key))


def period_label(period: Column, period_key: Column) -> Column:
    season = F.coalesce(F.concat(season_name(period_key), F.lit(" ("), F.upper(period_key), F.lit(")")), F.upper(period_key))
    return F.when(period == "monthly", F.coalesce(F.try_element_at(F.array(*(F.lit(m) for m in MONTH_NAMES)), period_key.try_cast("int")), period_key)).when(period == "seasonal", season).otherwise("Yearly")


def t_label(valid: Column, today: Column) -> Column:
    """``T+3d``, ``T-1d``, ``T+0d``: days from today."""
    return F.format_string("T%+dd", F.datediff(valid, today))


def date_labels(d: Column) -> dict[str, Column]:
    return {"short": F.date_format(d, "M/d"), "medium": F.date_format(d, "MMMM d, yyyy"), "full": F.date_format(d, "EEEE, MMMM d, yyyy")}


def range_label(init: Column, start: Column, end: Column) -> Column:
    """Short dates of a span of leads, one where both ends are a day; without an init date the leads themselves."""
    low, high = (F.date_format(F.date_add(init, k.cast("int")), "M/d") for k in (start, end))
    dates = F.when(start == end, low).otherwise(F.concat(low, F.lit("–"), high))
    return F.coalesce(dates, F.concat(start.cast("string"), F.lit("–"), end.cast("string"), F.lit("d")))


def winner_metric(statistic: Column) -> Column:
    # Names of the loss of each statistic.
    return F.when(statistic == "bias", "region_mean_abs_value_lower_better").when(statistic == "sacc", "region_mean_value_higher_better").otherwise("region_mean_value_lower_better")


def loss(statistic: Column, value: Column) -> Column:
    """What a region's best model has least of."""
    return F.when(statistic == "bias", F.abs(value)).when(statistic == "sacc", -value).otherwise(value)


# Limits of good and of ok; True: higher is better.
TIERS = {"sacc": (42, 20, True), "nmad": (100, 125, False), "nrmse": (350, 510, False), "bias": (2, 4, False)}


def quality_tier(statistic: Column, value: Column) -> Column:
    """good, ok or bad by the statistic's limits; bias by its size; null without a value."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, (good, ok, higher) in TIERS.items():
        v = F.abs(value) if name == "bias" else value
        inside = (lambda limit, v=v: v > limit) if higher else (lambda limit, v=v: v < limit)
        out = out.when((statistic == name) & inside(good), "good").when((statistic == name) & inside(ok), "ok").when(statistic == name, "bad")
    return out


def resolve_model(*asked: Column) -> Column:
    """The first model that is asked for, trimmed and in lower case, or the default."""
    return F.coalesce(*(F.nullif(F.lower(F.trim(a)), F.lit("")) for a in asked), F.lit(DEFAULT_MODEL))


def status_key(status: Column) -> Column:
    """Transfer status without what follows ``downloaded`` or ``failed``."""
    return F.when(status.startswith("downloaded"), "downloaded").when(status.startswith("failed"), "failed").otherwise(status)


def sub_hours(day_hour: Column) -> Column:
    """The six-hour buckets that end within the day that ends at this hour."""
    return F.array(day_hour - 18, day_hour - 12, day_hour - 6, day_hour)


def normalize_zip(code: Column) -> Column:
    return F.substring(F.regexp_replace(code, r"\D", ""), 1, 5)


def geometry_key(kind: Column, numbers: Column) -> Column:
    """Region key of coordinates to five places."""
    return F.concat_ws(":", kind, F.array_join(F.transform(numbers, lambda v: F.format_string("%.5f", v)), ","))


# Colours of the maps.
BLUE, WHITE, RED, PURPLE = (44, 123, 182), (255, 255, 255), (215, 25, 28), (120, 40, 200)


def position(value: Column, low: Column, high: Column) -> Column:
    """Place of a value in its range, 0 to 1; an empty range counts as 1 wide."""
    return F.least(F.greatest((value - low) / F.when(high != low, high - low).otherwise(1.0), F.lit(0.0)), F.lit(1.0))


def rgba(colormap: Column, t: Column) -> Column:
    """``struct<r,g,b,a>`` of 0 to 255, truncated; an unknown map is diverging; alpha is 0 without a value."""

    def two(low: tuple, high: tuple, k: int) -> Column:
        below = F.lit(float(low[k])) + (WHITE[k] - low[k]) * (t / 0.5)
        above = F.lit(float(WHITE[k])) + (high[k] - WHITE[k]) * ((t - 0.5) / 0.5)
        return F.when(t <= 0.5, below).otherwise(above)

    def channel(k: int) -> Column:
        ramp = F.lit(float(WHITE[k])) + (PURPLE[k] - WHITE[k]) * t
        return F.coalesce(F.when(colormap == "sequential", ramp).when(colormap == "diverging_reversed", two(RED, BLUE, k)).otherwise(two(BLUE, RED, k)).cast("int"), F.lit(0))

    alpha = F.when(t.isNull(), 0).when(colormap == "sequential", F.least(t * 1020.0, F.lit(255.0)).cast("int")).otherwise(255)
    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), alpha.alias("a"))


def interpolate(low: Column, high: Column, fraction: Column) -> Column:
    """Between two leads; where one side is missing, the other."""
    return F.when(low.isNull(), high).when(high.isNull(), low).otherwise(low + (high - low) * fraction)


def blend_weight(t: Column) -> Column:
    """Weight of the later lead, in steps of 1/64, 0 to 1."""
    return F.least(F.greatest(F.round(t * 64) / 64, F.lit(0.0)), F.lit(1.0))
