"""Planning and audit of ingest: byte ranges, gaps, catch-up and transfer counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sub_hours

from ..functions.scalars import status_key


def inventory(lines: DataFrame) -> DataFrame:
    """``file, line_no, begin, variable, level, accumulation, extra, end``: ``end`` is the byte before the next line's, null on the last.

    Fields are trimmed; lines of less than six are left out after they ended the line before.
    """
    p = F.split("line", ":")
    part = lambda k: F.trim(F.get(p, F.lit(k)))
    begin = part(1).try_cast("long")
    after = F.lead(begin).over(Window.partitionBy("file").orderBy("line_no"))
    named = {"variable": part(3), "level": part(4), "accumulation": part(5), "extra": part(6)}
    return lines.select("file", "line_no", F.size(p).alias("parts"), begin.alias("begin"), *(v.alias(k) for k, v in named.items()), (after - 1).alias("end")).where("parts >= 6").drop("parts")


def byte_ranges(lines: DataFrame, variable: str, level: str, accumulation: Column | None = None) -> DataFrame:
    """Byte range of the first line of each file that matches; probabilistic lines don't."""
    found = inventory(lines).where((F.col("variable") == variable) & (F.col("level") == level) & ~F.coalesce("extra", F.lit("")).startswith("prob"))
    if accumulation is not None:
        found = found.where(F.col("accumulation") == accumulation)
    first = F.min_by(F.struct("line_no", "begin", "end"), "line_no")
    return found.groupBy("file").agg(first.alias("f")).select("file", "f.line_no", "f.begin", "f.end", F.concat(F.lit("bytes="), F.col("f.begin").cast("string"), F.lit("-"), F.coalesce(F.col("f.end").cast("string"), F.lit(""))).alias("range"))


def expected_files(models: DataFrame, first: Column, last: Column, spans: DataFrame) -> DataFrame:
    """Every init date and forecast hour of each model over ``spans`` (one row)."""
    days = spans.select(F.explode(F.sequence(first, last)).alias("init_date"))
    return days.crossJoin(F.broadcast(models.select("model", F.explode("forecast_hours").alias("fhour"))))  # a fixed dimension


def needed_hours(days: DataFrame, hour: str = "day_hour") -> DataFrame:
    """Every six-hour field that any of the days is made of, once: the columns of ``days`` but ``hour``, and ``fhour``."""
    rest = [c for c in days.columns if c != hour]
    return days.select(*rest, F.explode(sub_hours(F.col(hour))).alias("fhour")).distinct()


def missing_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.join(present, ["model", "init_date", "fhour"], "left_anti")


def catch_up(latest: DataFrame, yesterday: Column) -> DataFrame:
    """``model, init_date`` from the day after the latest to yesterday; nothing when up to date."""
    start = F.date_add("latest", 1)
    return latest.select("model", F.explode(F.when(start <= yesterday, F.sequence(start, yesterday)).otherwise(F.array().cast("array<date>"))).alias("init_date"))


def freshest(inventory_days: DataFrame, now: Column) -> DataFrame:
    """The newer of today (14 hours back) and the day before that has data, by model."""
    today = F.to_date(now - F.expr("interval 14 hours"))
    return inventory_days.where(F.col("init_date").isin(today, F.date_sub(today, 1))).groupBy("model").agg(F.max("init_date").alias("init_date"))


def transfer_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(status_key(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


def failure_examples(log: DataFrame, most: int = 5) -> DataFrame:
    """The first failures of a run; the number is what the report asks for."""
    return log.where(status_key(F.col("status")) == "failed").orderBy("task").limit(most)
