"""Legend ranges, coloured pixels, blends and JSON of the published layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blend_weight, position, rgba


def percentiles(layers: DataFrame, keys: tuple[str, ...], shares: tuple[float, ...] = (0.02, 0.98), accuracy: int = 10_000) -> DataFrame:
    """The key columns and ``p``: exact interpolated percentiles of ``value`` for each share, null without a value.

    A mergeable sketch brackets each percentile; what lies below and above is only counted, and
    the few values inside are ranked. So no task ever holds the values of a slice. A bracket that
    misses its percentile raises.
    """
    margin = 2.0 / accuracy
    edges = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-margin, margin)]
    sketch = layers.groupBy(*keys).agg(F.percentile_approx("value", F.array(*map(F.lit, edges)), accuracy).alias("edge"), F.count("value").alias("n"))
    v, edge = F.col("value"), F.col("edge")
    side = lambda k: F.when(v < edge[2 * k], -1).when(v > edge[2 * k + 1], 1).otherwise(0)
    places = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("share"), side(k).alias("side")) for k, s in enumerate(shares))))
    placed = layers.where("value is not null").join(F.broadcast(sketch), list(keys)).select(*keys, "n", "value", places.alias("at")).select(*keys, "n", "value", "at.*")  # one row a slice
    own = F.when(F.col("side") == 0, F.col("value"))
    counted = placed.groupBy(*keys, "n", "k", "share", "side", own.alias("own")).agg(F.count("*").alias("c"), F.min("value").alias("least"), F.max("value").alias("most"))
    order = Window.partitionBy(*keys, "k").orderBy("side", "own")
    upto = F.sum("c").over(order)
    ranked = counted.withColumns({"upto": upto, "before": upto - F.col("c"), "pos": F.col("share") * (F.col("n") - 1)})

    def at(rank: Column) -> Column:
        here = (F.col("before") <= rank) & (rank < F.col("upto"))
        value = F.when(F.col("least") == F.col("most"), F.col("least")).when((F.col("side") == -1) & (rank == F.col("upto") - 1), F.col("most")).when((F.col("side") == 1) & (rank == F.col("before")), F.col("least"))
        return F.max(F.when(here, F.coalesce(value, F.raise_error(F.lit("a percentile is outside its bracket")).cast("double"))))

    ends = ranked.groupBy(*keys, "k", "pos").agg(at(F.floor("pos")).alias("low"), at(F.ceil("pos")).alias("high"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("pos") - F.floor("pos"))
    found = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", value.alias("p"))))["p"].alias("p"))
    return sketch.select(*keys).join(found, list(keys), "left")


def legend_ranges(layers: DataFrame, spec: DataFrame, mode: str = "export", keys: tuple[str, ...] = ("model", "statistic", "period", "period_key"), fixed: dict[str, tuple[float, float]] | None = None, approximate: bool = False) -> DataFrame:
    """``low, high, colormap`` of each slice. Diverging: 2nd and 98th percentile; sequential: from 0.

    Mode ``export``: a sequential range ends at 1 at least; ``tile``: it ends at 1 only when the
    percentile isn't over 0. A range that doesn't rise is 1 wide. Without a value it is (-1, 1),
    or (0, 1) if sequential. ``approximate`` reads ``layers`` once, for a sketch, instead of twice.
    """
    ends = layers.groupBy(*keys).agg(F.percentile_approx("value", F.array(F.lit(0.02), F.lit(0.98)), 10_000).alias("p")) if approximate else percentiles(layers, keys)
    return fit_ranges(ends, spec, mode, keys, fixed)


def fit_ranges(ends: DataFrame, spec: DataFrame, mode: str, keys: tuple[str, ...], fixed: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Legend ranges from the two percentiles ``p`` of each slice, null where it has no value."""
    found = ends.join(F.broadcast(spec.select("statistic", "colormap")), "statistic")
    sequential, low, high = F.col("colormap") == "sequential", F.col("p")[0], F.col("p")[1]
    top = F.greatest(high, F.lit(1.0)) if mode == "export" else F.when(high <= 0, 1.0).otherwise(high)
    out_low = F.when(F.col("p").isNull(), F.when(sequential, 0.0).otherwise(-1.0)).when(sequential, 0.0).otherwise(low)
    out_high = F.when(F.col("p").isNull(), 1.0).when(sequential, top).when(high <= low, low + 1).otherwise(high)
    for name, (a, b) in (fixed or {}).items():
        out_low, out_high = F.when(F.col("statistic") == name, a).otherwise(out_low), F.when(F.col("statistic") == name, b).otherwise(out_high)
    return found.select(*keys, "colormap", out_low.alias("low"), out_high.alias("high"))


LAYER = ["model", "statistic", "period", "period_key", "lead_key"]


def not_rendered(layers: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Keys of layers that the ledger of rendered ones lacks; all with ``force``."""
    keys = layers.select(*LAYER).distinct()
    return keys if force else keys.join(ledger, LAYER, "left_anti")


def tile_layers(layers: DataFrame, spec: DataFrame) -> DataFrame:
    """Layers that get tiles: of display-only statistics the yearly period alone. ``spec`` is the statistic dimension."""
    shown = F.broadcast(spec.select("statistic", "kind"))
    return layers.join(shown, "statistic").where((F.col("kind") != "display") | (F.col("period") == "yearly")).drop("kind")


def land_mask(observation: DataFrame) -> DataFrame:
    """Cells that an observation ever covered."""
    return observation.where("value is not null").select(*[c for c in ("model", "cell_id") if c in observation.columns]).distinct()


def coloured(layers: DataFrame, ranges: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Layers with ``r, g, b, a``; cells outside the mask are left out."""
    shown = layers if mask is None else layers.join(mask, [c for c in mask.columns if c in layers.columns], "left_semi")
    keys = [c for c in ranges.columns if c in layers.columns and c not in ("low", "high", "colormap")]
    joined = shown.join(F.broadcast(ranges), keys)  # one row a slice
    return joined.withColumn("c", rgba(F.col("colormap"), position(F.col("value"), F.col("low"), F.col("high")))).select(*layers.columns, "c.r", "c.g", "c.b", "c.a")


def pixels(colours: DataFrame, image: DataFrame) -> DataFrame:
    """Colours of each image pixel; ``image`` has ``px, py, model, cell_id``."""
    return colours.join(image, ["model", "cell_id"])


def blended(pixel_rows: DataFrame, lead: Column, keys: list[str]) -> DataFrame:
    """Two leads' pixels blended at a fractional lead on premultiplied channels; the weight has 64 steps.

    ``lead`` is a column of the rows. Rows of the lead below and above it are summed with their
    weights, so no self-join is needed; the lead is clamped to the least and greatest lead that a pixel has.
    """
    own = Window.partitionBy(*keys)
    pixel_rows = pixel_rows.withColumns({"first_lead": F.min("lead").over(own), "last_lead": F.max("lead").over(own)})
    lead = F.greatest(F.least(lead, F.col("last_lead").cast("double")), F.col("first_lead").cast("double"))
    weight = blend_weight(lead - F.floor(lead))
    share = F.when(F.col("lead") == F.floor(lead), 1 - weight).when(F.col("lead") == F.floor(lead) + 1, weight)
    near = pixel_rows.withColumn("w", share).where("w is not null")
    alpha = F.sum(F.col("a") * F.col("w"))
    channels = [F.when(alpha > 0, F.sum(F.col(c) * F.col("a") * F.col("w")) / alpha).otherwise(0.0).alias(c) for c in "rgb"]
    return near.groupBy(*keys).agg(*channels, alpha.alias("a"))


def config_json(models: DataFrame, statistics: DataFrame, inits: DataFrame) -> DataFrame:
    """One JSON document: models, statistics, defaults and init dates."""
    m = models.join(F.broadcast(inits), "model", "left").agg(F.array_sort(F.collect_list(F.struct("model", "label", "lead_min", "lead_max", F.col("init_date").cast("string").alias("init_date"), "is_default"))).alias("models"))
    s = statistics.agg(F.array_sort(F.collect_list(F.struct("statistic", "label", "units", "colormap", "kind", "is_default"))).alias("statistics"))
    both = m.crossJoin(s)  # one row each
    default = lambda c, k: F.element_at(F.filter(F.col(c), lambda x: x["is_default"]), 1)[k]
    return both.select(F.to_json(F.struct("models", "statistics", default("models", "model").alias("default_model"), default("statistics", "statistic").alias("default_statistic"))).alias("config"))


def forecast_calendar(models: DataFrame, inits: DataFrame) -> DataFrame:
    """Models that have an init date, with it and their leads; ``per_model`` as JSON by model."""
    return models.join(inits, "model").select("model", "init_date", "lead_min", "lead_max", F.to_json(F.struct(F.col("init_date").cast("string").alias("initDate"), F.col("lead_min").alias("leadMin"), F.col("lead_max").alias("leadMax"))).alias("entry"))
