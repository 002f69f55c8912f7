"""Region questions over the published layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import loss, month_key, resolve_model, season_of, winner_metric
from .areas import rectangle_means


def _sets(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions with a key of their cells, and the cells of each key once: regions with the same cells are aggregated once."""
    keyed = cells.select("region_id", "model", F.xxhash64("cells").alias("set_a"), F.xxhash64(F.lit(1), "cells").alias("set_b"), "cells")
    return keyed.drop("cells"), keyed.drop("region_id").distinct().select("model", "set_a", "set_b", F.explode("cells").alias("cell_id"))


def region_shapes(cells: DataFrame) -> DataFrame:
    """``region_id, shape, grids``: a region's cells on all grids in one row, and 128 bits that regions with the same cells have in common."""
    grids = cells.groupBy("region_id").agg(F.array_sort(F.collect_set(F.struct("model", "how", "cells"))).alias("grids"))
    return grids.select("region_id", F.struct(F.xxhash64("grids").alias("a"), F.xxhash64(F.lit(1), "grids").alias("b")).alias("shape"), "grids")


def shape_cells(shapes: DataFrame) -> DataFrame:
    """The cells of each shape once, as those of a region that has the shape for its id."""
    return shapes.groupBy("shape").agg(F.first("grids").alias("grids")).select(F.col("shape").alias("region_id"), F.inline("grids"))


def _split(cells: DataFrame, grid: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """Rectangles, whose cells are a block, and the other regions; without a ``grid`` all go the way of the others."""
    if grid is None or "how" not in cells.columns:
        return None, cells
    return cells.where("how = 'overlap'"), cells.where("how <> 'overlap'")


def region_means(stats: DataFrame, cells: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Unweighted mean of the values of a region's cells, one row for each layer; null without any value.

    ``cells``: ``region_id, model, how, cells``. With a ``grid`` (``model, cell_id, row, col``), rectangles
    are answered from summed-area tables. For other regions cells are joined before anything
    else, so a layer's other cells are never dealt out.
    """
    layer = ["statistic", "period", "period_key", "lead_key"]
    out = ["region_id", "model", *layer, "value", "n_cells"]
    blocks, others = _split(cells, grid)
    regions, sets = _sets(others)
    means = stats.join(sets, ["model", "cell_id"]).groupBy("model", "set_a", "set_b", *layer).agg(F.avg("value").alias("value"), F.count("value").alias("n_cells"))
    found = regions.join(means, ["model", "set_a", "set_b"]).select(*out)
    if blocks is None:
        return found
    return found.unionByName(rectangle_means(stats, blocks, grid, ["model", *layer], {"value": F.col("value")}).withColumnRenamed("value_n", "n_cells").select(*out))


def region_summary(wide: DataFrame, cells: DataFrame, statistics: list[str], grid: DataFrame | None = None) -> DataFrame:
    """One row for each region, model, lead and other key of ``wide`` (a column for each statistic): means and losses of all statistics.

    ``{s}``, ``{s}_loss`` and ``{s}_n`` are the mean, the mean loss and the number of values of statistic ``s``.
    With a ``grid``, rectangles are answered from summed-area tables.
    """
    keys = [c for c in wide.columns if c not in (*statistics, "sample_count", "cell_id", "model")]
    out = ["region_id", "model", *keys, *(f"{s}{end}" for s in statistics for end in ("", "_loss", "_n"))]
    blocks, others = _split(cells, grid)
    regions, sets = _sets(others)
    each = [e for s in statistics for e in (F.avg(s).alias(s), F.avg(loss(F.lit(s), F.col(s))).alias(f"{s}_loss"), F.count(s).alias(f"{s}_n"))]
    means = wide.join(sets, ["model", "cell_id"]).groupBy("model", "set_a", "set_b", *keys).agg(*each)
    found = regions.join(means, ["model", "set_a", "set_b"]).select(*out)
    if blocks is None:
        return found
    values = {n: v for s in statistics for n, v in ((s, F.col(s)), (f"{s}_loss", loss(F.lit(s), F.col(s))))}
    return found.unionByName(rectangle_means(wide, blocks, grid, ["model", *keys], values).select(*out))


def _wanted(cells: DataFrame, models: DataFrame) -> DataFrame:
    return cells.select("region_id", "model").join(F.broadcast(models.select("model", F.explode(F.sequence("lead_min", "lead_max")).alias("lead"))), "model")  # a fixed dimension


def curves(summary: DataFrame, cells: DataFrame, models: DataFrame, statistics: list[str]) -> DataFrame:
    """Every lead of a model's range for each region and statistic, from one period's summary; leads without a layer have no data."""
    means = F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in statistics))
    out = _wanted(cells, models).join(summary, ["region_id", "model", "lead"], "left").select("region_id", "model", "lead", F.explode(means).alias("m"))
    return out.select("region_id", "model", "m.statistic", "lead", "m.value", F.col("m.value").isNull().alias("no_data"))


def region_losses(summary: DataFrame, statistics: list[str]) -> DataFrame:
    """A row for each statistic of a summary, with the keys of the summary."""
    keys = [c for c in summary.columns if not any(c in (s, f"{s}_loss", f"{s}_n") for s in statistics)]
    losses = F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(f"{s}_loss").alias("loss")) for s in statistics))
    return summary.select(*keys, F.explode(losses).alias("l")).select(*keys, "l.statistic", "l.loss")


def lead_winners(losses: DataFrame, places: int | None = None) -> DataFrame:
    """The model with the least loss for each region, statistic, lead and period; the first by name on ties.

    Leads without any loss are left out. ``places`` rounds losses before they are compared.
    """
    value = F.col("loss") if places is None else F.round("loss", places)
    keys = [c for c in losses.columns if c not in ("model", "loss")]
    best = losses.where("loss is not null").groupBy(*keys).agg(F.min(F.struct(value.alias("loss"), F.col("model"))).alias("b"), F.count("*").alias("n_models"))
    return best.select(*keys, F.col("b.model").alias("model"), F.col("b.loss").alias("loss"), "n_models", winner_metric(F.col("statistic")).alias("metric"))


def forecasts(latest: DataFrame, cells: DataFrame, models: DataFrame) -> DataFrame:
    """Mean forecast of every model and integer lead of its range for each region."""
    regions, sets = _sets(cells)
    means = latest.join(sets, ["model", "cell_id"]).groupBy("model", "set_a", "set_b", "lead").agg(F.avg("value").alias("value"))
    found = regions.join(means, ["model", "set_a", "set_b"]).select("region_id", "model", "lead", "value")
    return _wanted(cells, models).join(found, ["region_id", "model", "lead"], "left").select("region_id", "model", "lead", "value", F.col("value").isNull().alias("no_data"))


PERIODS, REGION_TYPES = ("yearly", "monthly", "seasonal"), ("point", "rectangle", "polygon")


def _region_error(requests: DataFrame) -> Column:
    """The rule on a request's region; its type is held against the known ones where the table has it."""
    known = F.coalesce(F.col("region_type").isin(*REGION_TYPES), F.lit(False)) if "region_type" in requests.columns else F.lit(True)
    return F.when(~known, "unknown region type").when(F.col("region_id").isNull(), "no region")


def _period_key(month: int) -> Column:
    """The asked month or season, or that of the current ``month``."""
    now = F.lit(month)
    return F.when(F.col("period") == "monthly", F.coalesce("month", month_key(now))).when(F.col("period") == "seasonal", F.coalesce("season", season_of(now))).otherwise("")


def _period_error() -> Column:
    return F.when(~F.coalesce(F.col("period"), F.lit("yearly")).isin(*PERIODS), "unknown period")


def validated(requests: DataFrame, models: list[str], statistics: list[str]) -> DataFrame:
    """Adds the resolved model and ``error``: the first rule that a request breaks, or null."""
    model = resolve_model(F.col("model"))
    known = F.size(F.array_except(F.coalesce("statistics", F.array().cast("array<string>")), F.array(*(F.lit(s) for s in statistics)))) == 0
    one, span = F.col("lead").isNotNull(), F.col("min_lead").isNotNull() | F.col("max_lead").isNotNull()
    error = (
        F.when(_period_error().isNotNull(), _period_error())
        .when(_region_error(requests).isNotNull(), _region_error(requests))
        .when(~model.isin(models), "unknown model")
        .when(~known, "unknown statistic")
        .when(one == span, "either a lead or a range of leads")
        .when(span & (F.col("min_lead").isNull() | F.col("max_lead").isNull()), "a range needs both ends")
        .when(span & (F.col("min_lead") > F.col("max_lead")), "range of leads ends before it begins")
    )
    return requests.withColumns({"model": model, "error": error})


def labelled(answers: DataFrame, spec: DataFrame) -> DataFrame:
    """Adds ``label`` and ``units`` of the statistic. ``spec`` is the statistic dimension."""
    return answers.join(F.broadcast(spec.select("statistic", "label", "units")), "statistic", "left")


def run_requests(requests: DataFrame, stats: DataFrame, cells: DataFrame, models: list[str], statistics: list[str], month: int, grid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers and rejects of a request table. ``month`` is the current month, for requests that name none.

    Only layers and regions that some request asks for are read; requests that ask the same of one region are answered once.
    """
    checked = validated(requests, models, statistics)
    ok = checked.where("error is null").withColumns(
        {
            "period": F.coalesce("period", F.lit("yearly")),
            "period_key": _period_key(month),
            "statistic": F.explode(F.when(F.size("statistics") > 0, F.col("statistics")).otherwise(F.array(*(F.lit(s) for s in statistics)))),
        }
    )
    leads = F.when(F.col("lead").isNotNull(), F.array("lead")).otherwise(F.transform(F.sequence("min_lead", "max_lead"), lambda v: v.cast("string")))
    asked = ok.select("request_id", "region_id", "model", "period", "period_key", "statistic", F.explode(leads).alias("lead_key"))
    layer = ["model", "period", "period_key", "statistic", "lead_key"]
    asked_layers = stats.join(asked.select(*layer).distinct(), layer, "left_semi")
    asked_cells = cells.join(asked.select("region_id", "model").distinct(), ["region_id", "model"], "left_semi")
    means = region_means(asked_layers, asked_cells, grid)
    out = asked.join(means, ["region_id", "model", "period", "period_key", "statistic", "lead_key"], "left")
    return out.select("request_id", "region_id", "model", "period", "period_key", "statistic", "lead_key", "value", F.col("value").isNull().alias("no_data")), checked.where("error is not null").select("request_id", "error")


def _winner_checked(requests: DataFrame, statistics: list[str], month: int) -> DataFrame:
    """Adds ``error``, the first rule that a request for winners breaks, and the period and key it asks for."""
    error = (
        F.when(_period_error().isNotNull(), _period_error())
        .when(_region_error(requests).isNotNull(), _region_error(requests))
        .when(F.col("statistic") == "forecast", "forecast has no winners")
        .when(~F.coalesce(F.col("statistic").isin(statistics), F.lit(False)), "unknown statistic")
        .when(F.col("min_lead").isNull() | F.col("max_lead").isNull() | (F.least("min_lead", "max_lead") < 0), "a range needs both ends")
        .when(F.col("min_lead") > F.col("max_lead"), "range of leads ends before it begins")
    )
    return requests.withColumn("error", error).withColumns({"period": F.coalesce("period", F.lit("yearly")), "period_key": _period_key(month)})


def winner_rejects(requests: DataFrame, statistics: list[str], month: int) -> DataFrame:
    """Requests for winners that break a rule, with the rule."""
    return _winner_checked(requests, statistics, month).where("error is not null").select("request_id", "error")


def run_winner_requests(requests: DataFrame, wide: DataFrame, shapes: DataFrame, statistics: list[str], month: int, grid: DataFrame | None = None, places: int | None = None) -> DataFrame:
    """Best model for each lead of a request's range. ``wide`` covers all periods; ``shapes`` are of ``region_shapes``.

    Only layers and regions that some request asks for are read. Winners are found for each shape once, however many
    regions have it, and a request meets them in one row, whose leads are cut to its range after the joins.
    """
    ok = _winner_checked(requests, statistics, month).where("error is null").select("request_id", "region_id", "statistic", "period", "period_key", "min_lead", "max_lead")
    layers = wide.join(ok.select("period", "period_key").distinct(), ["period", "period_key"], "left_semi")
    asked = shapes.join(ok.select("region_id").distinct(), "region_id", "left_semi")
    best = lead_winners(region_losses(region_summary(layers, shape_cells(asked), statistics, grid), statistics), places).withColumnRenamed("region_id", "shape")
    by_lead = best.groupBy("shape", "statistic", "period", "period_key").agg(F.collect_list(F.struct("lead", "model", "loss", "n_models", "metric")).alias("leads"))
    found = ok.join(shapes.select("region_id", "shape"), "region_id").join(by_lead, ["shape", "statistic", "period", "period_key"])
    within = F.filter("leads", lambda v: v["lead"].between(F.col("min_lead"), F.col("max_lead")))
    return found.select("request_id", "region_id", "statistic", "period", "period_key", F.inline(within))


def run_forecast_requests(requests: DataFrame, latest: DataFrame, cells: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest forecasts of every model and lead for each request, and rejects."""
    checked = requests.withColumn("error", _region_error(requests))
    asked = checked.where("error is null").select("request_id", "region_id")
    return asked.join(forecasts(latest, cells, models), "region_id"), checked.where("error is not null").select("request_id", "error")
