"""Streaming pairing: forecasts and observations as streams, accumulators kept up batch by batch.

``stream_pairs`` gives the pairs themselves, for days and cells that have few values; ``keep_paired_sums`` keeps the
sums over all pairs and never makes one, so that a day and cell may have any number of values on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairing import KEYS, accumulate, add_up, counted_sums
from ..sources.sinks import claim, current, remove


def stream_pairs(forecast: DataFrame, observation: DataFrame, delay: str = "20 days") -> DataFrame:
    """Inner join of two streams by valid day and cell.

    ``forecast``: ``model, init_date, lead, cell_id, m, f_day`` with ``f_day`` a timestamp of the
    valid day; ``observation``: ``o_cell, o, o_day``. Watermarks bound the state; the delay must
    exceed the longest lead, since a forecast comes that much before its observation.
    """
    left, right = forecast.withWatermark("f_day", delay), observation.withWatermark("o_day", delay)
    joined = left.join(right, (F.col("f_day") == F.col("o_day")) & (F.col("cell_id") == F.col("o_cell")))
    return joined.select("model", "init_date", "lead", F.to_date("f_day").alias("valid_date"), "cell_id", "m", "o")


def keep_accumulators(paired: DataFrame, path: str, checkpoint: str):
    """Start a stream whose batches are each merged into the sums under ``path``.

    A batch adds its sums to the current version and writes the next one, whose number is that of the batch;
    the file that makes it current is the ledger of batches. A batch that is run again after that changes
    nothing, one that broke off before is merged anew. The last two versions are kept, for readers that began before.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        merge_batch(batch, path, epoch)

    return paired.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batch(batch: DataFrame, path: str, epoch: int) -> None:
    """Merge one batch, unless it is in the current version already."""
    spark = batch.sparkSession
    number, name = current(spark, f"{path}/current")
    if epoch < number:
        return
    new = accumulate(batch)
    if number:
        new = add_up(spark.read.parquet(f"{path}/{name}").unionByName(new), KEYS)
    target = f"sums-{epoch:09d}-{uuid.uuid4().hex}"
    new.write.parquet(f"{path}/{target}")
    _publish(spark, path, epoch, name, target)


def _publish(spark: SparkSession, path: str, epoch: int, name: str, target: str) -> None:
    """Make ``target`` current, and remove all that belongs neither to it nor to ``name``, the version before."""
    claim(spark, f"{path}/current", epoch + 1, target)
    versions = [v.removeprefix("sums-") for v in (name, target)]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    for old in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
        kind, _, version = old.getPath().getName().partition("-")
        if kind == "new" or (kind in ("sums", "open") and version not in versions):
            remove(spark, str(old.getPath()))


VALUE = ["is_forecast", "model", "lead", "day", "cell_id", "value"]


def keep_paired_sums(forecast: DataFrame, observation: DataFrame, path: str, checkpoint: str, delay: str = "20 days"):
    """Start a stream that adds all pairs of two streams, by valid day and cell, to the sums under ``path``.

    The streams, and what ``delay`` must exceed, are those of ``stream_pairs``; batches are merged as ``keep_accumulators``
    says. Beside the sums a version has the counts of equal values that later ones may still pair with: those of
    days no more than ``delay`` before the last day of the stream that is behind. Older values that come late are left out.
    """
    spark = forecast.sparkSession
    kinds = {c: forecast.schema[c].dataType for c in ("model", "lead")}
    left = forecast.select(F.lit(True).alias("is_forecast"), *kinds, F.col("f_day").cast("timestamp").alias("day"), "cell_id", F.col("m").cast("double").alias("value"))
    right = observation.select(F.lit(False).alias("is_forecast"), *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()), F.col("o_day").cast("timestamp").alias("day"), F.col("o_cell").alias("cell_id"), F.col("o").cast("double").alias("value"))

    def write(batch: DataFrame, epoch: int) -> None:
        merge_values(spark, batch, path, epoch, delay)

    return left.unionByName(right).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_values(spark: SparkSession, batch: DataFrame, path: str, epoch: int, delay: str = "20 days") -> None:
    """Merge one batch of values (``VALUE``, both sides in one table), unless it is in the current version already.

    New forecasts meet all observations, old forecasts the new observations.
    """
    number, name = current(spark, f"{path}/current")
    if epoch < number:
        return
    version = f"{epoch:09d}-{uuid.uuid4().hex}"
    old = spark.read.parquet(f"{path}/{name.replace('sums-', 'open-', 1)}") if number else None
    rows = batch.where("day is not null and cell_id is not null")
    if old is not None:
        rows = _since(rows, _oldest(old, delay))
    rows.groupBy(*VALUE).agg(F.count("*").alias("n")).write.parquet(f"{path}/new-{version}")
    new = spark.read.parquet(f"{path}/new-{version}")
    sides = lambda df: (df.where("is_forecast").drop("is_forecast"), df.where("not is_forecast").drop("is_forecast", "model", "lead"))
    (forecast, observation), still = sides(new), new
    sums = counted_sums(forecast, observation)
    if old is not None:
        old_forecast, old_observation = sides(old)
        more = counted_sums(old_forecast, observation).unionByName(counted_sums(forecast, old_observation))
        sums = add_up(spark.read.parquet(f"{path}/{name}").unionByName(sums).unionByName(more), KEYS)
        still = old.unionByName(new).groupBy(*VALUE).agg(F.sum("n").alias("n"))
    sums.write.parquet(f"{path}/sums-{version}")
    _since(still, _oldest(still, delay)).write.parquet(f"{path}/open-{version}")
    _publish(spark, path, epoch, name, f"sums-{version}")


def _oldest(values: DataFrame, delay: str) -> int | None:
    """The watermark in microseconds: ``delay`` before the last day of the stream that is behind; None while one has no values."""
    last = values.groupBy("is_forecast").agg(F.max("day").alias("last"))
    return last.agg(F.when(F.count("*") == 2, F.unix_micros(F.min("last") - F.expr(f"interval {delay}")))).first()[0]


def _since(values: DataFrame, oldest: int | None) -> DataFrame:
    return values if oldest is None else values.where(F.unix_micros("day") >= oldest)


def accumulated(spark, path: str) -> DataFrame:
    """Sums over all batches so far: one version, however many batches there were."""
    return spark.read.parquet(f"{path}/{current(spark, f'{path}/current')[1]}")
