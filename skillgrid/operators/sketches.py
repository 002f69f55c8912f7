"""Legend ranges from sketches that are stored beside the layers.

A layer has one KLL sketch of its values. A slice's range comes from the merged sketches of its
layers, so a layer that is new or computed anew costs a pass over its own values, and the others'
values are not read again. ``publish.legend_ranges`` stays the exact way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.scratch import Scratch
from .publish import LAYER, fit_ranges

K = 4096
FOLDERS = ["model", "statistic", "period"]
STORED = "n long, sketch binary, " + ", ".join(f"{c} string" for c in LAYER)


def layer_sketches(layers: DataFrame, k: int = K) -> DataFrame:
    """The layer's keys, ``n`` values and their ``sketch``; a layer without a value has an empty one.

    A sketch keeps all of up to about ``k`` values, so ranks are exact there; beyond, it grows to some
    ``20 * k`` bytes, and ranks are off by less than ``2.3 / k ** 0.9`` of the values (0.13 %) in 99 of 100 cases.
    Tasks make partial sketches before anything is shuffled.
    """
    return layers.groupBy(*LAYER).agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Put ``sketches`` in place of those that are stored of the same layers.

    Folders are those of model, statistic and period; where ``sketches`` has no layer of one, its files stay
    as they are. In the others the stored sketches, not values, are read and written again.
    """
    spark = sketches.sparkSession
    with Scratch(spark) as scratch:
        new = scratch.keep(sketches.select(*LAYER, "n", "sketch"))
        if sinks.exists(spark, path):
            old = stored_sketches(spark, path).join(new.select(*FOLDERS).distinct(), FOLDERS, "left_semi").join(new.select(*LAYER), LAYER, "left_anti")
            new = scratch.keep(old.unionByName(new))  # written first, since the files it is read from are replaced
        new.repartition(*FOLDERS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(path)


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    """What ``store_sketches`` wrote; filters on model, statistic and period are answered from folder names."""
    return spark.read.schema(STORED).parquet(path).select(*LAYER, "n", "sketch")


def sketch_percentiles(sketches: DataFrame, keys: tuple[str, ...], shares: tuple[float, ...] = (0.02, 0.98), k: int = K) -> DataFrame:
    """The key columns, ``n`` and ``p``: for each share the least value that so many of all are at or below; null without a value."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    filled = F.when(F.col("n") > 0, F.col("sketch"))
    return merged.select(*keys, "n", F.kll_sketch_get_quantile_double(filled, F.array(*map(F.lit, shares))).alias("p"))


def sketched_ranges(sketches: DataFrame, spec: DataFrame, mode: str = "export", keys: tuple[str, ...] = ("model", "statistic", "period", "period_key"), fixed: dict[str, tuple[float, float]] | None = None, k: int = K) -> DataFrame:
    """``low, high, colormap`` of each slice as ``legend_ranges`` has them, from stored sketches and without interpolation between values."""
    return fit_ranges(sketch_percentiles(sketches, keys, k=k), spec, mode, keys, fixed)
