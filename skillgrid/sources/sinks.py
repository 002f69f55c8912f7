"""Writers. Slices are partition columns, so that readers prune to the layers they need."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import affine


def write_stats(stats: DataFrame, path: str) -> None:
    """Replace the slices that ``stats`` has rows of; other models, statistics and periods stay as they are."""
    stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "statistic", "period", "period_key").parquet(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def claim(spark: SparkSession, folder: str, number: int, content: str) -> None:
    """Make ``content`` the current state of ``folder``, as its ``number``-th.

    The file of that number is created only if it isn't there, so that of two writers that start from one
    state the later fails, with ``FileExistsError``, and nothing of the first is lost.
    """
    at, store = _hadoop(spark, f"{folder}/{number:09d}")
    try:
        out = store.create(at, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            raise FileExistsError(f"state {number} of {folder} was written by another") from e
        raise
    out.write(bytearray(content.encode()))
    out.close()


def current(spark: SparkSession, folder: str) -> tuple[int, str]:
    """Number and content of the latest state; 0 and nothing if there is none. One that is still being written doesn't count."""
    at, store = _hadoop(spark, folder)
    if not store.exists(at):
        return 0, ""
    found = sorted((f.getPath() for f in store.listStatus(at) if f.getPath().getName().isdigit() and f.getLen()), key=lambda p: p.getName())
    if not found:
        return 0, ""
    stream = store.open(found[-1])
    content = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return int(found[-1].getName()), content


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _hadoop(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, store = _hadoop(spark, path)
    store.delete(at, True)


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Store ``df`` dealt out by ``keys``, one file a bucket, and read it back as a table of the session.

    Tables of equal keys and buckets join and aggregate on those keys without a shuffle. ``buckets`` should leave
    files that a task can hold; a bucket is not split further, so keys should be many, as dates with cells are.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def append_ledger(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("append").parquet(path)


def layer_export(stats: DataFrame) -> DataFrame:
    """One array of float32 a layer, in the order of cells; null where a cell has no value. Display-only layers stay out."""
    cells = F.array_sort(F.collect_list(F.struct("cell_id", F.col("value").cast("float").alias("value"))))
    layers = stats.where(F.col("statistic") != "forecast").groupBy("model", "statistic", "period", "period_key", "lead_key").agg(cells.alias("c"))
    return layers.select("model", "statistic", "period", "period_key", "lead_key", F.col("c.value").alias("layer_values"))


def forecast_export(latest: DataFrame) -> DataFrame:
    """One array of float32 for each model and lead of the latest forecasts, in the order of cells; null where a cell has no value."""
    cells = F.array_sort(F.collect_list(F.struct("cell_id", F.col("value").cast("float").alias("value"))))
    return latest.groupBy("model", "init_date", "lead").agg(cells.alias("c")).select("model", "init_date", "lead", F.col("c.value").alias("layer_values"))


def grid_metadata(axes: DataFrame, crs: str = "EPSG:4326") -> DataFrame:
    """``model, lats, lons, transform, crs`` of each model's grid: what a reader of its layers needs to place them."""
    arrays = grid_export(axes)
    return arrays.select("model", "lats", "lons", affine("lats", "lons").alias("transform"), F.lit(crs).alias("crs"))


def write_grid_metadata(axes: DataFrame, path: str, crs: str = "EPSG:4326") -> None:
    grid_metadata(axes, crs).write.mode("overwrite").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON document a row: grids, calendars or the configuration."""
    rows.write.mode("overwrite").json(path)


def grid_export(axes: DataFrame) -> DataFrame:
    """``model, n_lat, n_lon, lats, lons`` in the order of the axes."""

    def axis(name: str):
        return F.array_sort(F.collect_list(F.when(F.col("axis") == name, F.struct("idx", "center"))))["center"]

    return axes.groupBy("model").agg(axis("lat").alias("lats"), axis("lon").alias("lons")).select("model", F.size("lats").alias("n_lat"), F.size("lons").alias("n_lon"), "lats", "lons")


def write_panel_csv(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").option("nullValue", "").csv(path)


def write_zip_directory(zips: DataFrame, path: str) -> None:
    zips.withColumn("prefix", F.substring("zip", 1, 3)).write.mode("overwrite").partitionBy("prefix").json(path)


def write_pixels(pixels: DataFrame, path: str) -> None:
    pixels.write.mode("overwrite").partitionBy("model", "statistic", "period").parquet(path)
