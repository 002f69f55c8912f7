"""The general tables as forecasts and observations.

Cells are ``l_suppkey % 24`` on a grid of 4 rows and 6 columns; observations are quantities by
ship date, forecasts quantities by order date, plus the lead. Customers own saved shapes.
Values are whole numbers, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid
from ..operators.pairing import accumulate, by_period, finalize_wide, layers, pairs, with_valid_date
from ..operators.regions import region_cells
from ..sources import registry

LATS = [25.0, 30.0, 35.0, 40.0]
LONS = [-120.0, -112.0, -104.0, -96.0, -88.0, -80.0]
N_CELLS = len(LATS) * len(LONS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_shipdate").cast("date").alias("valid_date"), (F.col("l_suppkey") % N_CELLS).cast("int").alias("cell_id")).agg(F.sum("l_quantity").cast("double").alias("value"))


def forecast_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    model = F.when(F.col("l_returnflag") == "A", "gfs").otherwise("nbm")
    joined = line.select("l_orderkey", "l_suppkey", "l_quantity", model.alias("model")).join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("model", F.col("o_orderdate").cast("date").alias("init_date"), (F.col("l_suppkey") % N_CELLS).cast("int").alias("cell_id")).agg(F.sum("l_quantity").cast("double").alias("fv"))


def forecast(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """``base`` is ``forecast_base`` where a query has written it already."""
    leads = F.broadcast(registry.model_dim(spark).select("model", F.explode(F.sequence("lead_min", "lead_max")).alias("lead")))
    rows = (forecast_base(spark, sf_dir) if base is None else base).join(leads, "model").select("model", "init_date", "lead", "cell_id", (F.col("fv") + F.col("lead")).alias("value"))
    return with_valid_date(rows, registry.model_dim(spark))


def accumulators(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    return accumulate(pairs(forecast(spark, sf_dir, base), observation(spark, sf_dir)))


def wide(spark: SparkSession, sf_dir: str, periods=("yearly",), base: DataFrame | None = None) -> DataFrame:
    """Finished statistics by lead day, a column each."""
    return finalize_wide(by_period(accumulators(spark, sf_dir, base), periods))


def stats(spark: SparkSession, sf_dir: str, periods=("monthly", "seasonal", "yearly"), names=None) -> DataFrame:
    return layers(accumulators(spark, sf_dir), registry.lead_windows(spark), periods, names)


def axes(spark: SparkSession) -> DataFrame:
    rows = [(m[0], a, i, v) for m in registry.MODELS for a, values in (("lat", LATS), ("lon", LONS)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "model string, axis string, idx int, center double")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's saved shape: a point, rectangle, triangle, thin polygon or a polygon of two vertices."""
    k = F.col("c_custkey")
    x, y = (F.lit(-124.0) + (k * 7) % 50), (F.lit(22.0) + (k * 3) % 20)
    wide, high = ((k % 11) + F.lit(0.25)), ((k % 7) + F.lit(0.25))
    kind = F.when(k % 5 == 0, "point").when(k % 5 == 1, "rectangle").otherwise("polygon")
    p = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    ring = F.when(k % 5 == 0, F.array(p(x, y))).when(k % 5 == 2, F.array(p(x, y), p(x + wide * 2, y), p(x + wide, y + high * 2))).when(k % 5 == 3, F.array(p(x, y), p(x + wide, y + F.lit(0.125)), p(x + wide, y + F.lit(0.25)), p(x, y + F.lit(0.125)))).when(k % 5 == 4, F.array(p(x, y), p(x + wide, y + high)))
    bounds = F.when(k % 5 == 1, F.array(*(v.cast("double") for v in (x, y, x + wide, y + high))))
    return read(spark, sf_dir, "customer").select(k.alias("region_id"), kind.alias("type"), ring.alias("coordinates"), bounds.alias("bounds"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are few bytes and much work each, so they are dealt out over all cores first."""
    dealt = regions(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism, "region_id")
    return region_cells(dealt, grid.axis_arrays(axes(spark)))
