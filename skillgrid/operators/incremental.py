"""Incremental upkeep of accumulators, with late observations.

The ledger has the runs of cells that were paired, for each model, init date and lead (one row
where a whole grid came at once), so an observation that comes after its forecast was processed,
or a part of a day that comes after another part, is picked up by the next run. Forecasts that
the ledger covers leave before they meet observations. The result is that of computing all anew.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.statistics import Statistic
from ..sources.scratch import Scratch
from ..sources.sinks import claim, current
from .pairing import KEYS, accumulate, add_up, pairs

LEDGER = ["model", "init_date", "lead"]


def runs_of_cells(paired: DataFrame) -> DataFrame:
    """``model, init_date, lead, first_cell, last_cell``: the cells of each init and lead, put together where they follow each other."""
    cells = paired.select(*LEDGER, "cell_id").distinct()
    island = F.col("cell_id") - F.row_number().over(Window.partitionBy(*LEDGER).orderBy("cell_id"))
    return cells.withColumn("island", island).groupBy(*LEDGER, "island").agg(F.min("cell_id").alias("first_cell"), F.max("cell_id").alias("last_cell")).drop("island")


def update(stored: DataFrame | None, ledger: DataFrame | None, forecast: DataFrame, observation: DataFrame, registered: list[Statistic] | None = None) -> tuple[DataFrame, DataFrame]:
    """New accumulators and ledger after adding the pairs whose init, lead and cell the ledger lacks."""
    if ledger is not None:
        f, done = forecast.alias("f"), ledger.alias("done")
        same = [F.col(f"f.{c}") == F.col(f"done.{c}") for c in LEDGER]
        forecast = f.join(done, [*same, F.col("f.cell_id").between(F.col("done.first_cell"), F.col("done.last_cell"))], "left_anti")
    new = Scratch(forecast.sparkSession).keep(pairs(forecast, observation))
    acc, done = accumulate(new, registered), runs_of_cells(new)
    if stored is None:
        return acc, done
    return add_up(stored.unionByName(acc), KEYS, registered), ledger.unionByName(done)


@dataclass(frozen=True)
class Version:
    """A published state: its number, accumulators, ledger, and the lead ranges and tag they were made with."""

    number: int
    acc: DataFrame
    ledger: DataFrame
    seen: DataFrame


def write_version(acc: DataFrame, ledger: DataFrame, root: str, models: DataFrame, tag: str, after: int = 0) -> int:
    """Publish both tables as the state that follows number ``after``, and return its number.

    All is written beside what is current, and becomes current by one file. If another has followed
    ``after`` meanwhile, ``FileExistsError`` is raised, and nothing changes.
    """
    spark, name = acc.sparkSession, f"{after + 1:09d}-{uuid.uuid4().hex}"
    acc.write.parquet(f"{root}/versions/{name}/acc")
    ledger.write.parquet(f"{root}/versions/{name}/ledger")
    models.select("model", "lead_min", "lead_max", F.lit(tag).alias("tag")).write.parquet(f"{root}/versions/{name}/seen")
    claim(spark, f"{root}/current", after + 1, name)
    return after + 1


def current_version(spark: SparkSession, root: str) -> Version | None:
    """The state that was published last, or None."""
    number, name = current(spark, f"{root}/current")
    read = lambda table: spark.read.parquet(f"{root}/versions/{name}/{table}")
    return Version(number, read("acc"), read("ledger"), read("seen")) if number else None


def refresh(forecast: DataFrame, observation: DataFrame, root: str, models: DataFrame, tag: str) -> Version:
    """Publish the next state: what is stored and what is new where ``can_update`` allows it, else all anew."""
    spark = forecast.sparkSession
    old = current_version(spark, root)
    usable = old is not None and can_update(old.ledger, old.acc, models, old.seen, tag)
    acc, ledger = update(old.acc, old.ledger, forecast, observation) if usable else update(None, None, forecast, observation)
    write_version(acc, ledger, root, models, tag, old.number if old else 0)
    return current_version(spark, root)


def can_update(ledger: DataFrame | None, stored: DataFrame | None, models: DataFrame, seen: DataFrame | None, tag: str) -> bool:
    """Whether stored sums may be added to; otherwise all is computed anew.

    ``seen`` has ``model, lead_min, lead_max, tag`` as they were when the sums were stored; ``models`` is the model dimension.
    """
    if ledger is None or stored is None or seen is None:
        return False
    now = models.select("model", "lead_min", "lead_max", F.lit(tag).alias("tag"))
    if not now.exceptAll(seen.select(*now.columns)).isEmpty():
        return False
    return completeness(stored, models).where("n_missing > 0").isEmpty()


def completeness(acc: DataFrame, models: DataFrame) -> DataFrame:
    """``model, month, missing, n_missing``: leads of a model's range that a month's sums lack.

    A model without any sums lacks all of its leads, in a row with a null month.
    """
    found = acc.groupBy("model", "month").agg(F.collect_set("lead").alias("found"))
    wanted = F.broadcast(models.select("model", F.sequence("lead_min", "lead_max").alias("wanted")))  # a fixed dimension
    both = found.join(wanted, "model", "right")
    missing = F.array_sort(F.array_except("wanted", F.coalesce("found", F.array().cast("array<int>"))))
    return both.select("model", "month", missing.alias("missing"), F.size(missing).alias("n_missing"))


def shape_snapshot(log: DataFrame) -> DataFrame:
    """Current saved shapes from a log of ``create``, ``update`` and ``delete``.

    The last create or delete decides whether a shape exists; updates after it carry over the
    fields they set, and updates with no create before them are ignored.
    """
    order = Window.partitionBy("user_id", "shape_id").orderBy("ts", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = F.sum((F.col("op") != "update").cast("int")).over(upto)
    lives = log.withColumn("life", made).where("life > 0")
    own = Window.partitionBy("user_id", "shape_id", "life").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.row_number().over(Window.partitionBy("user_id", "shape_id").orderBy(F.desc("ts"), F.desc("seq")))
    filled = lives.select("user_id", "shape_id", F.first("op").over(own).alias("first_op"), F.first("ts").over(own).alias("created_at"), F.col("ts").alias("updated_at"), F.last("name", True).over(own).alias("name"), F.last("region", True).over(own).alias("region"), last.alias("back"))
    return filled.where("back = 1 and first_op = 'create'").drop("back", "first_op")
