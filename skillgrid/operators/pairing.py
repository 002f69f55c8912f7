"""Forecast and observation pairs, their accumulators, and rollups of those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, month_key, season_of
from ..functions.statistics import Statistic, all_sums, statistics, sum_names

KEYS = ["model", "month", "lead", "cell_id"]


def with_valid_date(forecast: DataFrame, models: DataFrame) -> DataFrame:
    """Forecasts within their model's lead range, with ``valid_date``. The model table is a fixed dimension."""
    bounds = F.broadcast(models.select("model", "lead_min", "lead_max"))
    kept = forecast.join(bounds, "model").where(F.col("lead").between(F.col("lead_min"), F.col("lead_max")))
    return kept.withColumn("valid_date", F.date_add("init_date", F.col("lead"))).drop("lead_min", "lead_max")


def pairs(forecast: DataFrame, observation: DataFrame) -> DataFrame:
    """``model, init_date, lead, valid_date, cell_id, m, o`` where both values are finite.

    ``forecast`` has ``valid_date``; ``observation`` may have ``model`` when grids differ.
    Filters run before the join, so only pairs that count are dealt out.
    """
    on = [c for c in ("model", "valid_date", "cell_id") if c in observation.columns]
    left = forecast.select("model", "init_date", "lead", "valid_date", "cell_id", finite(F.col("value")).alias("m")).where("m is not null")
    right = observation.select(*on, finite(F.col("value")).alias("o")).where("o is not null")
    return left.join(right, on)


def accumulate(paired: DataFrame, registered: list[Statistic] | None = None) -> DataFrame:
    """Sums of all statistics by model, month of the valid date, lead and cell, in one aggregation."""
    sums = [F.sum(expr).alias(name) for name, expr in all_sums(registered).items()]
    return paired.groupBy("model", F.month("valid_date").alias("month"), "lead", "cell_id").agg(*sums)


def counted_sums(forecast: DataFrame, observation: DataFrame) -> DataFrame:
    """What ``accumulate`` gives for every pair of a forecast and an observation of one day and cell, without the pairs.

    ``forecast``: ``model, lead, day, cell_id, value, n``; ``observation``: ``day, cell_id, value, n``; ``n`` is how often
    a value came. The values of a day and cell are sorted together, and each meets all smaller ones of the other side at once, so
    the work grows with the values and not with their pairs. Distances are added up step by step from one value to
    the next, as terms that are never negative. Null and non-finite values are few different ones, and are joined.
    """
    known = finite(F.col("value")).isNotNull()
    return add_up(_sorted_sums(forecast.where(known), observation.where(known)).unionByName(_joined_sums(forecast, observation)), KEYS)


_SLICE = ["model", "lead", "day", "cell_id"]


def _sorted_sums(forecast: DataFrame, observation: DataFrame) -> DataFrame:
    """``counted_sums`` of finite values."""
    none = F.lit(0).cast("long")
    seen = observation.join(forecast.select(*_SLICE).distinct(), ["day", "cell_id"])
    rows = forecast.select(*_SLICE, "value", F.col("n").alias("m"), none.alias("o")).unionByName(seen.select(*_SLICE, "value", none.alias("m"), F.col("n").alias("o")))
    order = Window.partitionBy(*_SLICE).orderBy("value")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"gap": F.col("value") - F.lag("value").over(order)} | {f"{s}_n": F.sum(s).over(before) for s in "mo"})

    def moved(s: str, term: Column) -> Column:
        """What the smaller values of a side add when they are seen from this value and no longer from the last."""
        return F.sum(F.when((F.col(f"{s}_n") > 0) & (F.col("gap") > 0), F.col("gap") * term).otherwise(0.0)).over(upto)

    rows = rows.withColumns({f"{s}_far": moved(s, F.col(f"{s}_n")) for s in "mo"})
    rows = rows.withColumns({f"{s}_last": F.lag(f"{s}_far").over(order) for s in "mo"})
    rows = rows.withColumns({f"{s}_square": moved(s, 2 * F.col(f"{s}_last") + F.col("gap") * F.col(f"{s}_n")) for s in "mo"})
    m, o, v = F.col("m"), F.col("o"), F.col("value")
    above, below = F.sum(F.when(m > 0, m * F.col("o_far"))), F.sum(F.when(o > 0, o * F.col("m_far")))
    each = {"ms": m * v, "os": o * v, "mq": m * v * v, "oq": o * v * v}
    found = rows.groupBy(*_SLICE).agg(
        F.sum(m).alias("mn"), F.sum(o).alias("on"), *(F.sum(e).alias(k) for k, e in each.items()),
        (above - below).alias("sum_error"), (above + below).alias("sum_abs_error"), F.sum(F.when(m > 0, m * F.col("o_square")).otherwise(o * F.col("m_square"))).alias("sum_squared_error"),
    ).where("mn > 0 and on > 0")
    times = lambda a, b: F.col(a) * F.col(b)
    sums = {"n": times("mn", "on"), "sum_model": times("ms", "on"), "sum_obs": times("os", "mn"), "sum_model_sq": times("mq", "on"), "sum_obs_sq": times("oq", "mn"), "sum_cross": times("ms", "os")}
    return found.select("model", F.month("day").alias("month"), "lead", "cell_id", *(sums.get(c, F.col(c)).alias(c) for c in sum_names()))


def _joined_sums(forecast: DataFrame, observation: DataFrame) -> DataFrame:
    """``counted_sums`` of the pairs of which one value at least is null or not finite."""
    known = lambda c: finite(F.col(c)).isNotNull()
    left, right = forecast.withColumnsRenamed({"value": "m", "n": "m_n"}), observation.withColumnsRenamed({"value": "o", "n": "o_n"})
    both = left.where(~known("m")).join(right, ["day", "cell_id"]).unionByName(left.where(known("m")).join(right.where(~known("o")), ["day", "cell_id"]))
    sums = [F.sum(expr * F.col("m_n") * F.col("o_n")).alias(name) for name, expr in all_sums().items()]
    return both.groupBy("model", F.month("day").alias("month"), "lead", "cell_id").agg(*sums)


def add_up(acc: DataFrame, keys: list[str], registered: list[Statistic] | None = None) -> DataFrame:
    """Sums of sums by fewer keys; ``registered`` names those of statistics that are not built in."""
    return acc.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sum_names(registered) if c in acc.columns))


def by_period(acc: DataFrame, periods: tuple[str, ...] = ("monthly", "seasonal", "yearly"), registered: list[Statistic] | None = None) -> DataFrame:
    """Sums by ``period, period_key`` from month sums in one aggregation: months, seasons over all years, and the year."""
    each = {
        "monthly": F.struct(F.lit("monthly").alias("period"), month_key(F.col("month")).alias("period_key")),
        "seasonal": F.struct(F.lit("seasonal").alias("period"), season_of(F.col("month")).alias("period_key")),
        "yearly": F.struct(F.lit("yearly").alias("period"), F.lit("").alias("period_key")),
    }
    rows = acc.withColumn("p", F.explode(F.array(*(each[p] for p in periods)))).select("*", "p.period", "p.period_key")
    return add_up(rows, ["model", "period", "period_key", "lead", "cell_id"], registered)


def by_window(sums: DataFrame, windows: DataFrame, registered: list[Statistic] | None = None) -> DataFrame:
    """Sums over lead windows, of slices that have every lead of the window. ``windows`` is a fixed dimension."""
    keys = ["model", "period", "period_key"]
    within = sums.join(F.broadcast(windows), "model").where(F.col("lead").between(F.col("start"), F.col("end")))
    whole = within.groupBy(*keys, "lead_key").agg(F.count_distinct("lead").alias("found"), F.first(F.col("end") - F.col("start") + 1).alias("wanted")).where("found = wanted")
    return add_up(within, [*keys, "lead_key", "cell_id"], registered).join(whole.select(*keys, "lead_key"), [*keys, "lead_key"], "left_semi")


def finalize(sums: DataFrame, registered: list[Statistic] | None = None, names: list[str] | None = None) -> DataFrame:
    """One row for each statistic: the key columns, ``statistic, value, sample_count``."""
    chosen = [s for s in (registered if registered is not None else statistics()) if names is None or s.name in names]
    cols = {c: F.col(c) for c in sums.columns}
    rows = F.array(*(F.struct(F.lit(s.name).alias("statistic"), s.finalize(cols).alias("value")) for s in chosen))
    keys = [c for c in sums.columns if c not in sum_names(registered)]
    return sums.select(*keys, F.col("n").alias("sample_count"), F.explode(rows).alias("s")).select(*keys, "s.statistic", "s.value", "sample_count")


def finalize_wide(sums: DataFrame, registered: list[Statistic] | None = None) -> DataFrame:
    """The key columns, a column for each statistic, and ``sample_count``: one row where ``finalize`` has several."""
    cols = {c: F.col(c) for c in sums.columns}
    keys = [c for c in sums.columns if c not in sum_names(registered)]
    return sums.select(*keys, *(s.finalize(cols).alias(s.name) for s in (registered if registered is not None else statistics())), F.col("n").alias("sample_count"))


def layers(acc: DataFrame, windows: DataFrame, periods: tuple[str, ...] = ("monthly", "seasonal", "yearly"), names: list[str] | None = None, registered: list[Statistic] | None = None) -> DataFrame:
    """The published table: every period by lead day and by lead window."""
    sums = by_period(acc, periods, registered)
    days = sums.withColumn("lead_key", F.col("lead").cast("string")).drop("lead")
    return finalize(days.unionByName(by_window(sums, windows, registered)), registered, names)


def daily_from_buckets(buckets: DataFrame, keys: list[str], hour: str = "fhour") -> DataFrame:
    """Daily sums of four six-hour buckets, told apart by ``hour``; a cell with a missing bucket, or one twice, has no value."""
    which = F.when(F.col("value").isNotNull(), F.expr(f"shiftleft(1, cast(pmod(`{hour}` div 6, 4) as int))"))
    return buckets.groupBy(*keys).agg(F.when((F.count("value") == 4) & (F.bit_or(which) == 15), F.sum("value")).alias("value"))


def window_means(forecast: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean forecast over lead windows; a cell that misses a lead, or has one twice, has no value, a window that misses a lead no row."""
    within = forecast.join(F.broadcast(windows), "model").where(F.col("lead").between(F.col("start"), F.col("end")))
    length = F.col("end") - F.col("start") + 1
    found = within.groupBy("model", "init_date", "lead_key", "start", "end").agg(F.count_distinct("lead").alias("found")).where(F.col("found") == length)
    leads = F.bit_or(F.when(F.col("value").isNotNull(), F.expr("shiftleft(1L, cast(lead - start as int))")))
    whole = (F.count("value") == F.first(length)) & (leads == F.expr("shiftleft(1L, cast(first(end - start + 1) as int)) - 1"))
    means = within.groupBy("model", "init_date", "lead_key", "cell_id", "start", "end").agg(F.when(whole, F.avg("value")).alias("value"))
    return means.join(found.select("model", "init_date", "lead_key"), ["model", "init_date", "lead_key"], "left_semi").drop("start", "end")


def lead_extract(forecast: DataFrame, spans: DataFrame, last: int) -> DataFrame:
    """``model, init_date, cell_id, lead_key, found, value``: every lead day and lead window in one aggregation.

    Each cell's sums and counts are added up over its leads 1 to ``last``, so that a span is a difference of two of
    them. ``found`` are the leads of the span with one value; ``value`` is their mean where that is all of them,
    else null. A span without any has no row, so an empty table gives none. ``spans`` (``model, lead_key, start, end``,
    a day being a span of one) is a fixed dimension.
    """
    days = range(1, last + 1)
    at = lambda k, c: F.when(F.col("lead") == k, c)
    sums = [F.sum(at(k, F.col("value"))).alias(f"s{k}") for k in days]
    counts = [F.count(at(k, F.col("value"))).alias(f"c{k}") for k in days]
    cells = forecast.groupBy("model", "init_date", "cell_id").agg(*sums, *counts)
    once = [F.when(F.col(f"c{k}") == 1, F.col(f"s{k}")) for k in days]
    total, seen = [F.lit(0.0)], [F.lit(0).cast("long")]
    for v in once:
        total.append(total[-1] + F.coalesce(v, F.lit(0.0)))
        seen.append(seen[-1] + v.isNotNull().cast("long"))
    cells = cells.select("model", "init_date", "cell_id", F.array(*once).alias("day"), F.array(*total).alias("total"), F.array(*seen).alias("seen"))
    rows = cells.join(F.broadcast(spans.select("model", "lead_key", "start", "end")), "model")
    between = lambda c: F.get(c, F.col("end")) - F.get(c, F.col("start") - 1)
    length = F.col("end") - F.col("start") + 1
    mean = F.when(length == 1, F.get("day", F.col("start") - 1)).otherwise(between("total") / length)
    rows = rows.withColumn("found", between("seen")).where("found > 0")
    return rows.select("model", "init_date", "cell_id", "lead_key", "found", F.when(F.col("found") == length, mean).alias("value"))


def latest_init(forecast: DataFrame) -> DataFrame:
    """Rows of each model's latest init date."""
    last = forecast.groupBy("model").agg(F.max("init_date").alias("init_date"))
    return forecast.join(F.broadcast(last), ["model", "init_date"], "left_semi")  # one row for each model
