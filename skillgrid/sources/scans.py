"""Readers of raw layouts: array files, flat layers, inventories and CSV. All take a path that Spark can read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .fields import register

PARTIAL = ".part"


def forecast_fields(spark: SparkSession, root: str, model: str, n_lat: int, n_lon: int, cycle: str = "12z", hours: list[int] | None = None) -> DataFrame:
    """``model, init_date, fhour, lead, cell_id, value`` from ``{root}/{year}/{YYYYMMDD}_{cycle}/fHHH_*.npy``.

    Files of other cycles, of other hours than ``hours``, and those that filters on init date, hour or lead
    rule out, are not opened, nor are partial files. A field of another shape than the grid's raises.
    Non-finite values become null.
    """
    register(spark)
    found = spark.read.format("forecast_fields").options(model=model, cycle=cycle, n_lat=n_lat, n_lon=n_lon).load(root)
    return found if hours is None else found.where(F.col("fhour").isin(hours))


def write_fields(fields: DataFrame, root: str, n_lat: int, n_lon: int, cycle: str = "12z") -> None:
    """Rows ``init_date, fhour, values`` as array files in the layout that ``forecast_fields`` reads."""
    register(fields.sparkSession)
    fields.select("init_date", "fhour", "values").write.format("forecast_fields").options(cycle=cycle, n_lat=n_lat, n_lon=n_lon).mode("append").save(root)


def layer_tree(spark: SparkSession, root: str, n_cells: int) -> DataFrame:
    """``model, lead_key, cell_id, value`` of a forecast tree ``{root}/{model}/lead_{key}.bin``; a layer that isn't there has no row."""
    name = F.regexp_extract("path", r"/([^/]+)/lead_[^/]+\.bin$", 1)
    layers = flat_layers(spark, root, n_cells).where(name != "")
    return layers.select(name.alias("model"), F.regexp_extract("path", r"/lead_([^/]+)\.bin$", 1).alias("lead_key"), "cell_id", "value")


CALENDAR = "map<string,struct<initDate:string,leadMin:int,leadMax:int>>"


def read_calendar(documents: DataFrame, column: str = "value") -> DataFrame:
    """``model, init_date, lead_min, lead_max`` of calendar documents, JSON by model; one that can't be parsed gives no row."""
    parsed = documents.select(F.explode(F.from_json(column, CALENDAR)).alias("model", "c"))
    return parsed.where("c is not null").select("model", F.try_to_date("c.initDate").alias("init_date"), F.col("c.leadMin").alias("lead_min"), F.col("c.leadMax").alias("lead_max"))


def array_fields(df: DataFrame, n_lat: int, n_lon: int) -> DataFrame:
    """Rows of cells from a table with one ``values`` array a field; a wrong length raises."""
    checked = F.when(F.size("values") == n_lat * n_lon, F.col("values")).otherwise(F.raise_error(F.lit("field has another size than the grid")).cast("array<double>"))
    return df.withColumn("values", checked).select(*[c for c in df.columns if c != "values"], F.posexplode("values").alias("cell_id", "value"))


def flat_layers(spark: SparkSession, root: str, n_cells: int) -> DataFrame:
    """``path, cell_id, value`` of little-endian float32 layers ``*.bin``; layers of another size raise."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(root).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                values = np.frombuffer(row.content, "<f4").astype(np.float64)
                if len(values) != n_cells:
                    raise ValueError(f"{row.path} has {len(values)} cells, the grid has {n_cells}")
                yield pd.DataFrame({"path": row.path, "cell_id": np.arange(n_cells, dtype=np.int32), "value": values})

    return files.mapInPandas(decode, "path string, cell_id int, value double").withColumn("value", finite(F.col("value")))


def observed(raw: DataFrame, nodata: float) -> DataFrame:
    """Observations with the nodata code and non-finite values as null."""
    return raw.withColumn("value", F.when(F.col("value") != nodata, finite(F.col("value"))))


def observation_day(valid_date: Column) -> Column:
    """The day as it stands in observation file names."""
    return F.date_format(valid_date, "yyyyMMdd")


def inventory_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of inventory files, which are small; lines are numbered by their place, from 1."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")), "\r?\n").alias("lines"))
    return files.select("file", F.posexplode("lines").alias("at", "line")).select("file", (F.col("at") + 1).alias("line_no"), "line")


def zip_directory(raw: DataFrame) -> DataFrame:
    """Trimmed codes of at least five characters, cut to five; coordinates to six places."""
    code = F.trim("zip")
    places = {c: F.round(F.col(c).cast("double"), 6) for c in ("lat", "lon", "min_lon", "min_lat", "max_lon", "max_lat")}
    return raw.where(F.length(code) >= 5).select(F.substring(code, 1, 5).alias("zip"), *(v.alias(k) for k, v in places.items()))


def zip_csv(spark: SparkSession, path: str) -> DataFrame:
    return zip_directory(spark.read.csv(path, header=True))


def stored_accumulators(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """A stored accumulator table, or None if one of ``keys`` is missing: then all is computed anew."""
    stored = spark.read.parquet(path)
    return stored if set(keys) <= set(stored.columns) else None


def complete_files(files: DataFrame, name: str = "path") -> DataFrame:
    return files.where(~F.col(name).endswith(PARTIAL))


def count_partial(files: DataFrame, name: str = "path") -> DataFrame:
    return files.agg(F.count_if(F.col(name).endswith(PARTIAL)).alias("n_partial"))


def has_grib_magic(content: Column) -> Column:
    return F.substring(content, 1, 4).cast("string") == "GRIB"


def length_matches(content: Column, announced: Column) -> Column:
    return F.octet_length(content) == announced
