"""The registered queries, each beside the SQL it is held against."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.statistics import sum_names
from ..operators import grid, incremental, ingest, pairing, panel, publish, query, sketches
from ..sources import registry as dims
from ..sources import scans, sinks
from ..sources.scratch import Scratch, shared_folder
from ..streaming import pairing as streaming
from . import fixtures as fx
from . import sql as S

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
STATISTICS = ["bias", "sacc", "nrmse", "nmad"]


def register(name: str, oracle: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.finalize(fx.accumulators(spark, sf_dir))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- pairing and accumulators

for _s in STATISTICS:
    register(f"stat_{_s}", f"WITH {S.ACC} {S.finished('acc', 'model, month, lead, cell_id', (_s,))}")(lambda spark, d, s=_s: pairing.finalize(fx.accumulators(spark, d), names=[s]))


@register("accumulators", f"WITH {S.ACC} SELECT * FROM acc")
def accumulators(spark, d):
    return fx.accumulators(spark, d)


@register("forecast_scan", f"WITH {S.FC} SELECT model, init_date, lead, cell_id, m AS value, valid_date, CAST(lead * 24 AS INT) AS fhour, strftime(valid_date, '%Y%m%d') AS observation_day, strftime(init_date, '%Y%m%d') || '_12z' AS run_name FROM fc")
def forecast_scan(spark, d):
    out = fx.forecast(spark, d)
    run = F.concat(F.date_format("init_date", "yyyyMMdd"), F.lit("_12z"))
    hour = F.col("lead") * 24
    return out.select("model", fn.init_date(run).alias("init_date"), fn.lead_of_hour(hour).alias("lead"), "cell_id", "value", "valid_date", hour.cast("int").alias("fhour"), scans.observation_day(F.col("valid_date")).alias("observation_day"), run.alias("run_name"))


@register("observation_nodata", "SELECT CAST(l_shipdate AS DATE) AS valid_date, CAST(l_suppkey % 24 AS INT) AS cell_id, sum(CASE WHEN l_quantity <> 1 THEN CAST(l_quantity AS DOUBLE) END) AS value, count(CASE WHEN l_quantity <> 1 THEN 1 END) AS n FROM lineitem GROUP BY 1, 2")
def observation_nodata(spark, d):
    raw = fx.read(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("valid_date"), (F.col("l_suppkey") % 24).cast("int").alias("cell_id"), F.col("l_quantity").cast("double").alias("value"))
    return scans.observed(raw, 1.0).groupBy("valid_date", "cell_id").agg(F.sum("value").alias("value"), F.count("value").alias("n"))


for _p in ("monthly", "seasonal", "yearly"):
    register(f"period_{_p}", f"WITH {S.PERIOD} {S.finished(f'(SELECT * FROM per WHERE period = {chr(39)}{_p}{chr(39)})', 'model, period, period_key, lead, cell_id')}")(lambda spark, d, p=_p: pairing.finalize(pairing.by_period(fx.accumulators(spark, d), (p,))))


@register("period_all", f"WITH {S.PERIOD} SELECT * FROM per")
def period_all(spark, d):
    return pairing.by_period(fx.accumulators(spark, d))


@register("lead_windows", f"WITH {S.WINDOW} {S.finished('bywin', 'model, period, period_key, lead_key, cell_id')}")
def lead_windows(spark, d):
    return pairing.finalize(pairing.by_window(pairing.by_period(fx.accumulators(spark, d)), dims.lead_windows(spark)))


@register("stats_layers", f"WITH {S.STATS} SELECT * FROM stats")
def stats_layers(spark, d):
    return fx.stats(spark, d)


@register("layer_keys", f"WITH {S.STATS} SELECT DISTINCT model, statistic, period, period_key, lead_key FROM stats")
def layer_keys(spark, d):
    return fx.stats(spark, d).select("model", "statistic", "period", "period_key", "lead_key").distinct()


@register("rendered_anti_join", f"WITH {S.STATS} SELECT DISTINCT model, statistic, period, period_key, lead_key FROM stats WHERE NOT (period = 'yearly' AND NOT contains(lead_key, '_'))")
def rendered_anti_join(spark, d):
    # rendered before: the yearly layers of single leads, from a run over the years alone
    done = fx.wide(spark, d).select("model", "period", "period_key", F.col("lead").cast("string").alias("lead_key")).distinct()
    ledger = done.withColumn("statistic", F.explode(F.array(*(F.lit(s) for s in STATISTICS))))
    return publish.not_rendered(fx.stats(spark, d), ledger)


@register("forecast_windows", f"WITH {S.FC}, w AS (SELECT fc.model, init_date, lead_key, cell_id, e - s + 1 AS wanted, lead, m FROM fc JOIN win ON fc.model = win.model AND lead BETWEEN s AND e) SELECT model, init_date, lead_key, cell_id, avg(m) AS value FROM w GROUP BY model, init_date, lead_key, cell_id")
def forecast_windows(spark, d):
    return pairing.window_means(fx.forecast(spark, d), dims.lead_windows(spark))


EXTRACT = f"{S.FC}, span AS (SELECT model, lead AS s, lead AS e, CAST(lead AS VARCHAR) AS lead_key FROM leads UNION ALL SELECT model, s, e, lead_key FROM win)"


@register("forecast_extract", f"WITH {EXTRACT} SELECT fc.model, init_date, cell_id, lead_key, count(nullif(m, 20)) AS found, CASE WHEN count(nullif(m, 20)) = any_value(e - s + 1) THEN avg(m) END AS value FROM fc JOIN span ON fc.model = span.model AND lead BETWEEN s AND e GROUP BY fc.model, init_date, cell_id, lead_key HAVING count(nullif(m, 20)) > 0")
def forecast_extract(spark, d):
    """Days and windows of every forecast from one scan; a value of 20 stands for no data."""
    models = dims.model_dim(spark)
    days = models.select("model", F.explode(F.sequence("lead_min", "lead_max")).alias("start")).select("model", F.col("start").cast("string").alias("lead_key"), "start", F.col("start").alias("end"))
    spans = days.unionByName(dims.lead_windows(spark).select("model", "lead_key", "start", "end"))
    values = fx.forecast(spark, d).withColumn("value", F.nullif(F.col("value"), F.lit(20.0)))
    return pairing.lead_extract(values, spans, last=max(m[3] for m in dims.MODELS))


@register("stored_pairing", f"WITH {S.ACC} SELECT * FROM acc")
def stored_pairing(spark, d):
    """Forecasts and observations stored by valid date and cell once, and paired without a shuffle from then on."""
    base, keys = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}", ["valid_date", "cell_id"]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = [sinks.write_bucketed(df, f"{base}/{name}", keys, buckets) for name, df in (("forecast", fx.forecast(spark, d)), ("observation", fx.observation(spark, d)))]
    return pairing.accumulate(pairing.pairs(*stored))


BUCKETS = "b AS (SELECT CAST(o_orderdate AS DATE) AS init_date, CAST(l_suppkey % 24 AS INT) AS cell_id, CAST(l_linenumber AS INT) * 6 AS fhour, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"


@register("daily_from_6h", f"WITH {BUCKETS}, days AS (SELECT init_date, cell_id, h AS day_hour, unnest([h - 18, h - 12, h - 6, h]) AS fhour FROM (SELECT DISTINCT init_date, cell_id FROM b), (VALUES (24), (42)) t(h)) SELECT days.init_date, days.cell_id, day_hour, CASE WHEN count(value) = 4 THEN sum(value) END AS value FROM days LEFT JOIN b ON b.init_date = days.init_date AND b.cell_id = days.cell_id AND b.fhour = days.fhour GROUP BY 1, 2, 3")
def daily_from_6h(spark, d):
    line, orders = fx.read(spark, d, "lineitem"), fx.read(spark, d, "orders")
    b = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderdate").cast("date").alias("init_date"), (F.col("l_suppkey") % 24).cast("int").alias("cell_id"), (F.col("l_linenumber").cast("int") * 6).alias("fhour")).agg(F.sum("l_quantity").cast("double").alias("value"))
    days = b.select("init_date", "cell_id").distinct().withColumn("day_hour", F.explode(F.array(F.lit(24), F.lit(42))))
    wanted = days.withColumn("fhour", F.explode(fn.sub_hours(F.col("day_hour"))))
    return pairing.daily_from_buckets(wanted.join(b, ["init_date", "cell_id", "fhour"], "left"), ["init_date", "cell_id", "day_hour"])


# --- grid and regridding


@register("cell_edges", f"WITH {S.OBS}, {S.AXES} SELECT cell_id, lat, lon, s AS lat_low, n AS lat_high, w AS lon_low, e AS lon_high, count(*) AS n_obs FROM obs JOIN cell USING (cell_id) GROUP BY ALL")
def cell_edges(spark, d):
    ax = fx.axes(spark).where("model = 'gfs'")
    c, e = grid.cells(ax), grid.edges(ax)
    side = lambda a, k: e.where(F.col("axis") == a).select(F.col("idx").alias(k), F.col("low").alias(f"{a}_low"), F.col("high").alias(f"{a}_high"))
    cells = c.join(side("lat", "row"), "row").join(side("lon", "col"), "col").select("cell_id", "lat", "lon", "lat_low", "lat_high", "lon_low", "lon_high")
    n = fx.observation(spark, d).groupBy("cell_id").agg(F.count("*").alias("n_obs"))
    return n.join(F.broadcast(cells), "cell_id")  # the grid is a fixed dimension


SOURCE = "src AS (SELECT CAST(l_shipdate AS DATE) AS valid_date, CAST(l_suppkey % 20 AS INT) AS src_row, CAST(l_partkey % 40 AS INT) AS src_col, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2, 3)"


def _source(spark, d):
    return fx.read(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("valid_date"), (F.col("l_suppkey") % 20).cast("int").alias("src_row"), (F.col("l_partkey") % 40).cast("int").alias("src_col")).agg(F.sum("l_quantity").cast("double").alias("value"))


@register("regrid_nearest", f"WITH {SOURCE}, {S.AXES} SELECT cell_id, d.valid_date, value FROM cell CROSS JOIN (SELECT DISTINCT valid_date FROM src) d LEFT JOIN src ON src.valid_date = d.valid_date AND src_row = CAST(floor((lat - 45.0e0) / -1.25e0) AS INT) AND src_col = CAST(floor((lon - -125.0e0) / 1.25e0) AS INT)")
def regrid_nearest(spark, d):
    cells = grid.cells(fx.axes(spark).where("model = 'gfs'"))
    return grid.regrid(cells, _source(spark, d), (1.25, 0.0, -125.0, 0.0, -1.25, 45.0)).select("cell_id", "valid_date", "value")


LCC = """lcc AS (SELECT cell_id, 6371200.0e0 * f / pow(tan(pi() / 4 + radians(lat) / 2), nn) AS rho, nn * radians(lon + 97.5e0) AS turn, 6371200.0e0 * f / pow(tan(pi() / 4 + radians(38.5e0) / 2), nn) AS rho0
  FROM cell, (SELECT sin(radians(38.5e0)) AS nn, cos(radians(38.5e0)) * pow(tan(pi() / 4 + radians(38.5e0) / 2), sin(radians(38.5e0))) / sin(radians(38.5e0)) AS f)),
place AS (SELECT cell_id, CAST(floor((rho0 - rho * cos(turn) + 1500000.0e0) / 100000.0e0) AS INT) AS r, CAST(floor((rho * sin(turn) + 2000000.0e0) / 100000.0e0) AS INT) AS c FROM lcc)"""


@register("regrid_lcc", f"WITH {SOURCE}, {S.AXES}, {LCC} SELECT cell_id, r AS src_row, c AS src_col, d.valid_date, value FROM place CROSS JOIN (SELECT DISTINCT valid_date FROM src) d LEFT JOIN src ON src.valid_date = d.valid_date AND src_row = r AND src_col = c")
def regrid_lcc(spark, d):
    cells = grid.cells(fx.axes(spark).where("model = 'gfs'"))
    x, y = grid.lambert(F.col("lat"), F.col("lon"), 38.5, -97.5, 38.5, 38.5)
    return grid.regrid(cells, _source(spark, d), (100000.0, 0.0, -2000000.0, 0.0, 100000.0, -1500000.0), x, y).select("cell_id", "src_row", "src_col", "valid_date", "value")


@register("lon_wrap_crop", """WITH a AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'east' ELSE 'wide' END AS model, CAST(s_suppkey * 7 % CASE WHEN s_suppkey % 2 = 0 THEN 180 ELSE 360 END AS DOUBLE) AS center FROM supplier),
w AS (SELECT model, CASE WHEN max(center) OVER (PARTITION BY model) > 180 THEN center + 180 - 360 * floor((center + 180) / 360) - 180 ELSE center END AS center FROM a)
SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY center) - 1 AS INT) AS idx, center, center BETWEEN -130 AND -60 AS in_crop FROM w""")
def lon_wrap_crop(spark, d):
    k = F.col("s_suppkey")
    axis = fx.read(spark, d, "supplier").select(F.when(k % 2 == 0, "east").otherwise("wide").alias("model"), F.when(k % 2 == 0, k * 7 % 180).otherwise(k * 7 % 360).cast("double").alias("center")).distinct()
    return grid.wrap_longitudes(axis).select("model", "idx", "center", F.col("center").between(-130, -60).alias("in_crop"))


@register("grid_audit", "SELECT CASE WHEN l_returnflag = 'A' THEN 'gfs' ELSE 'nbm' END AS model, count(DISTINCT l_linestatus) AS n_grids, count(DISTINCT l_linestatus) = 1 AS consistent FROM lineitem GROUP BY 1")
def grid_audit(spark, d):
    rows = fx.read(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", "gfs").otherwise("nbm").alias("model"), F.col("l_linestatus").alias("transform"), F.lit("EPSG:4326").alias("crs"), F.lit(4).alias("n_lat"), F.lit(6).alias("n_lon"))
    return grid.check_single_grid(rows)


@register("grid_guard", f"WITH {S.BASE}, {S.AXES}, g AS (SELECT model, year(init_date) AS y, array_to_string(list_sort(list(DISTINCT lat)), ',') || ';' || array_to_string(list_sort(list(DISTINCT lon)), ',') AS grid FROM base JOIN cell USING (cell_id) GROUP BY 1, 2) SELECT model, count(DISTINCT grid) AS n_grids, count(DISTINCT grid) = 1 AS consistent FROM g GROUP BY 1")
def grid_guard(spark, d):
    """The grid that each year's forecasts cover, from their cells: a model whose years differ stops the query."""
    cells = grid.cells(fx.axes(spark)).select("model", "cell_id", "lat", "lon")  # a fixed dimension
    seen = fx.forecast_base(spark, d).select("model", F.year("init_date").alias("y"), "cell_id").distinct().join(F.broadcast(cells), ["model", "cell_id"])
    grids = seen.groupBy("model", "y").agg(*(F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("lat", "lon")))
    return grid.require_single_grid(grids.select("model", grid.affine("lats", "lons").cast("string").alias("transform"), F.lit("EPSG:4326").alias("crs"), F.size("lats").alias("n_lat"), F.size("lons").alias("n_lon")))


@register("grid_crop", f"WITH {S.OBS}, {S.AXES} SELECT cell_id, lat, lon, count(*) AS n_obs FROM obs JOIN cell USING (cell_id) WHERE lat BETWEEN 25 AND 35 AND lon BETWEEN -112 AND -88 GROUP BY ALL")
def grid_crop(spark, d):
    box = grid.crop(grid.cells(fx.axes(spark).where("model = 'gfs'")), -112.0, 25.0, -88.0, 35.0)
    n = fx.observation(spark, d).groupBy("cell_id").agg(F.count("*").alias("n_obs"))
    return n.join(F.broadcast(box.select("cell_id", "lat", "lon")), "cell_id")  # the grid is a fixed dimension


# --- regions

for _name, _how in (("region_rectangle", "overlap"), ("region_polygon", "centers"), ("region_polygon_corners", "corners"), ("region_nearest", "nearest")):
    register(_name, f"WITH {S.REGION} SELECT region_id, model, cell_id FROM rc WHERE how = '{_how}'")(
        lambda spark, d, how=_how: fx.cells(spark, d).where(F.col("how") == how).select("region_id", "model", F.explode("cells").alias("cell_id"))
    )


@register("region_fallback", f"WITH {S.REGION} SELECT region_id, model, any_value(how) AS how, count(*) AS n_cells, min(cell_id) AS first_cell, max(cell_id) AS last_cell FROM rc GROUP BY region_id, model")
def region_fallback(spark, d):
    c = fx.cells(spark, d)
    return c.select("region_id", "model", "how", F.size("cells").cast("long").alias("n_cells"), F.array_min("cells").alias("first_cell"), F.array_max("cells").alias("last_cell"))


MEANS = f"{S.YEARLY}, means AS (SELECT region_id, model, statistic, period, period_key, lead_key, avg(value) AS value, count(value) AS n_cells FROM yearly JOIN rc USING (model, cell_id) GROUP BY ALL)"
ALL = f"{MEANS}, asked AS (SELECT DISTINCT region_id, rc.model, statistic, lead FROM rc JOIN leads ON rc.model = leads.model, (VALUES ('bias'), ('sacc'), ('nrmse'), ('nmad')) t(statistic)), allleads AS (SELECT asked.region_id, asked.model, asked.statistic, asked.lead, value FROM asked LEFT JOIN means m ON m.region_id = asked.region_id AND m.model = asked.model AND m.statistic = asked.statistic AND m.lead_key = CAST(asked.lead AS VARCHAR))"


def _yearly(spark, d, names=None):
    return fx.stats(spark, d, ("yearly",), names)


def _cells(spark, d):
    """The cells of all regions, written once for the several steps that read them."""
    return Scratch(spark).keep(fx.cells(spark, d))


def _grid(spark):
    return grid.cells(fx.axes(spark))


def _summary(spark, d, cells=None, periods=("yearly",), base=None):
    """Means and losses of every region, model and lead day: what curves and winners both read. The layers are written once."""
    return query.region_summary(Scratch(spark).keep(fx.wide(spark, d, periods, base)), _cells(spark, d) if cells is None else cells, STATISTICS, _grid(spark))


def _curves(spark, d, cells=None, summary=None):
    cells = _cells(spark, d) if cells is None else cells
    return query.curves(_summary(spark, d, cells) if summary is None else summary, cells, dims.model_dim(spark), STATISTICS)


@register("region_mean", f"WITH {MEANS} SELECT region_id, model, statistic, lead_key, round(value, 6) AS value, n_cells FROM means WHERE contains(lead_key, '_')")
def region_mean(spark, d):
    windows = Scratch(spark).keep(_yearly(spark, d).where(F.col("lead_key").contains("_")))
    return query.region_means(windows, _cells(spark, d), _grid(spark)).select("region_id", "model", "statistic", "lead_key", F.round("value", 6).alias("value"), "n_cells")


@register("region_all_leads", f"WITH {ALL} SELECT region_id, model, statistic, lead, round(value, 6) AS value, value IS NULL AS no_data FROM allleads")
def region_all_leads(spark, d):
    return _curves(spark, d).withColumn("value", F.round("value", 6))


LOSS = f"{S.YEARLY}, losses AS (SELECT region_id, model, statistic, lead_key, round(avg(CASE statistic WHEN 'bias' THEN abs(value) WHEN 'sacc' THEN -value ELSE value END), 6) AS loss FROM yearly JOIN rc USING (model, cell_id) WHERE NOT contains(lead_key, '_') GROUP BY ALL)"
WINNERS = f"{LOSS}, winners AS (SELECT region_id, statistic, CAST(lead_key AS INT) AS lead, arg_min(model, (loss, model)) AS model, min(loss) AS loss, count(*) AS n_models FROM losses WHERE loss IS NOT NULL GROUP BY ALL)"


def _winners(spark, d, summary=None):
    losses = query.region_losses(_summary(spark, d) if summary is None else summary, STATISTICS)
    return query.lead_winners(losses.drop("period", "period_key"), places=6)


@register("lead_winners", f"WITH {WINNERS} SELECT *, CASE statistic WHEN 'bias' THEN 'region_mean_abs_value_lower_better' WHEN 'sacc' THEN 'region_mean_value_higher_better' ELSE 'region_mean_value_lower_better' END AS metric FROM winners")
def lead_winners(spark, d):
    return _winners(spark, d)


FORECASTS = f"{S.FC}, {S.LATEST}, {S.REGION}, fmeans AS (SELECT region_id, rc.model, lead, avg(m) AS value FROM rc JOIN latest ON rc.model = latest.model AND rc.cell_id = latest.cell_id GROUP BY ALL), forecasts AS (SELECT region_id, model, lead, round(value, 6) AS value, value IS NULL AS no_data FROM (SELECT DISTINCT region_id, model FROM rc) JOIN leads USING (model) LEFT JOIN fmeans USING (region_id, model, lead))"


def _forecasts(spark, d, cells=None, base=None):
    return query.forecasts(pairing.latest_init(fx.forecast(spark, d, base)), _cells(spark, d) if cells is None else cells, dims.model_dim(spark))


@register("forecast_all_models", f"WITH {FORECASTS} SELECT * FROM forecasts")
def forecast_all_models(spark, d):
    return _forecasts(spark, d).withColumn("value", F.round("value", 6))


def _requests(spark, d):
    """Every order is a request."""
    k = F.col("o_orderkey")
    names = F.when(k % 4 == 0, F.array(F.lit("bias"))).when(k % 4 == 1, F.array(F.lit("nmad"), F.lit("sacc"))).when(k % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("nrmse")))
    names = F.when(k % 11 == 0, F.array(F.lit("skill"))).otherwise(names)
    return fx.read(spark, d, "orders").select(
        k.alias("request_id"), F.when(k % 3 == 0, " GFS ").when(k % 3 == 1, "nbm").alias("model"), F.when(k % 2 == 0, F.lit("3")).alias("lead"),
        F.when(k % 2 == 1, F.lit(5)).alias("min_lead"), F.when(k % 2 == 1, F.when(k % 7 == 0, 4).otherwise(6)).alias("max_lead"), F.col("o_custkey").alias("region_id"),
        F.when(k % 13 == 0, "circle").when(k % 13 == 1, "point").otherwise("polygon").alias("region_type"),
        F.when(k % 5 == 0, "monthly").when(k % 5 == 1, "seasonal").when(k % 5 == 2, "daily").otherwise("yearly").alias("period"),
        F.when(k % 17 == 0, "11").alias("month"), F.when(k % 17 == 1, "djf").alias("season"), names.alias("statistics"))


REQUESTS = """req AS (SELECT o_orderkey AS request_id, CASE o_orderkey % 3 WHEN 1 THEN 'nbm' ELSE 'gfs' END AS model, o_custkey AS region_id, o_orderkey % 2 = 0 AS one, CASE o_orderkey % 5 WHEN 0 THEN 'monthly' WHEN 1 THEN 'seasonal' WHEN 2 THEN 'daily' ELSE 'yearly' END AS period,
  CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 17 = 0 THEN '11' ELSE '04' END WHEN 1 THEN CASE WHEN o_orderkey % 17 = 1 THEN 'djf' ELSE 'mam' END ELSE '' END AS period_key,
  CASE o_orderkey % 4 WHEN 0 THEN ['bias'] WHEN 1 THEN ['nmad', 'sacc'] WHEN 2 THEN ['bias', 'sacc', 'nrmse', 'nmad'] ELSE ['nrmse'] END AS names,
  CASE WHEN o_orderkey % 5 = 2 THEN 'unknown period' WHEN o_orderkey % 13 = 0 THEN 'unknown region type' WHEN o_orderkey % 11 = 0 THEN 'unknown statistic' WHEN o_orderkey % 2 = 1 AND o_orderkey % 7 = 0 THEN 'range of leads ends before it begins' END AS error FROM orders)"""
SPEC = "spec AS (SELECT * FROM (VALUES ('bias', 'Bias', 'mm'), ('sacc', 'SACC', '%'), ('nrmse', 'NRMSE', '%'), ('nmad', 'NMAD', '%')) t(statistic, label, units))"


@register("batch_requests", f"WITH {S.STATS}, {S.REGION}, {REQUESTS}, {SPEC}, named AS (SELECT *, unnest(names) AS statistic FROM req WHERE error IS NULL), asked AS (SELECT *, unnest(CASE WHEN one THEN ['3'] ELSE ['5', '6'] END) AS lead_key FROM named), means AS (SELECT region_id, model, statistic, period, period_key, lead_key, round(avg(value), 6) AS value FROM stats JOIN rc USING (model, cell_id) GROUP BY ALL) SELECT request_id, region_id, model, period, period_key, statistic, label, units, lead_key, value, value IS NULL AS no_data FROM asked LEFT JOIN means USING (region_id, model, period, period_key, statistic, lead_key) LEFT JOIN spec USING (statistic)")
def batch_requests(spark, d):
    answers, _ = query.run_requests(_requests(spark, d), Scratch(spark).keep(fx.stats(spark, d)), _cells(spark, d), ["gfs", "nbm"], STATISTICS, month=4, grid=_grid(spark))
    return query.labelled(answers, dims.statistic_dim(spark)).withColumn("value", F.round("value", 6))


@register("batch_rejects", f"WITH {REQUESTS} SELECT request_id, error FROM req WHERE error IS NOT NULL")
def batch_rejects(spark, d):
    return query.validated(_requests(spark, d), ["gfs", "nbm"], STATISTICS).where("error is not null").select("request_id", "error")


def _winner_requests(spark, d):
    k = F.col("o_orderkey")
    names = F.array(*(F.lit(s) for s in [*STATISTICS, "forecast"]))
    return fx.read(spark, d, "orders").select(k.alias("request_id"), F.col("o_custkey").alias("region_id"), F.when(k % 13 == 0, "circle").otherwise("rectangle").alias("region_type"), F.get(names, (k % 5).cast("int")).alias("statistic"),
        F.when(k % 3 == 0, "monthly").when(k % 3 == 1, "seasonal").alias("period"), F.lit(None).cast("string").alias("month"), F.when(k % 2 == 0, "son").alias("season"), (k % 9).cast("int").alias("min_lead"), (k * 7 % 12).cast("int").alias("max_lead"))


WINNER_REQUESTS = """wreq AS (SELECT o_orderkey AS request_id, o_custkey AS region_id, (['bias', 'sacc', 'nrmse', 'nmad', 'forecast'])[o_orderkey % 5 + 1] AS statistic, CASE o_orderkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'seasonal' ELSE 'yearly' END AS period,
  CASE o_orderkey % 3 WHEN 0 THEN '04' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'son' ELSE 'mam' END ELSE '' END AS period_key, o_orderkey % 9 AS min_lead, o_orderkey * 7 % 12 AS max_lead,
  CASE WHEN o_orderkey % 13 = 0 THEN 'unknown region type' WHEN o_orderkey % 5 = 4 THEN 'forecast has no winners' WHEN o_orderkey % 9 > o_orderkey * 7 % 12 THEN 'range of leads ends before it begins' END AS error FROM orders)"""
ALL_LOSS = f"{S.STATS}, {S.REGION}, alllosses AS (SELECT region_id, statistic, period, period_key, lead_key, model, round(avg(CASE statistic WHEN 'bias' THEN abs(value) WHEN 'sacc' THEN -value ELSE value END), 6) AS loss FROM stats JOIN rc USING (model, cell_id) WHERE NOT contains(lead_key, '_') GROUP BY ALL)"


@register("winner_requests", f"WITH {ALL_LOSS}, {WINNER_REQUESTS}, best AS (SELECT region_id, statistic, period, period_key, CAST(lead_key AS INT) AS lead, arg_min(model, (loss, model)) AS model, min(loss) AS loss, count(*) AS n_models FROM alllosses WHERE loss IS NOT NULL GROUP BY ALL) SELECT request_id, region_id, statistic, period, period_key, lead, model, loss, n_models FROM wreq JOIN best USING (region_id, statistic, period, period_key) WHERE error IS NULL AND lead BETWEEN min_lead AND max_lead")
def winner_requests(spark, d):
    scratch = Scratch(spark)
    shapes, wide = scratch.keep(query.region_shapes(fx.cells(spark, d))), scratch.keep(fx.wide(spark, d, ("monthly", "seasonal", "yearly")))
    return query.run_winner_requests(_winner_requests(spark, d), wide, shapes, STATISTICS, month=4, grid=_grid(spark), places=6).drop("metric")


@register("winner_rejects", f"WITH {WINNER_REQUESTS} SELECT request_id, error FROM wreq WHERE error IS NOT NULL")
def winner_rejects(spark, d):
    return query.winner_rejects(_winner_requests(spark, d), STATISTICS, month=4)


@register("forecast_requests", f"WITH {FORECASTS} SELECT o_orderkey AS request_id, o_custkey AS region_id, model, lead, value, no_data FROM orders JOIN forecasts ON region_id = o_custkey WHERE o_orderkey % 13 <> 0")
def forecast_requests(spark, d):
    asked = _winner_requests(spark, d).select("request_id", "region_id", "region_type")
    answers, _ = query.run_forecast_requests(asked, pairing.latest_init(fx.forecast(spark, d)), _cells(spark, d), dims.model_dim(spark))
    return answers.withColumn("value", F.round("value", 6))


LOG = """log AS (SELECT o_custkey AS user_id, o_orderkey % 5 AS shape_id, CASE o_orderkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'update' END AS op, CASE WHEN o_orderkey % 3 <> 0 THEN 'shape ' || o_orderkey END AS name,
  CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS region, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS seq FROM orders)"""


def _shape_log(spark, d):
    k = F.col("o_orderkey")
    return fx.read(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), (k % 5).alias("shape_id"), F.when(k % 4 == 0, "create").when(k % 4 == 1, "delete").otherwise("update").alias("op"), F.when(k % 3 != 0, F.concat(F.lit("shape "), k.cast("string"))).alias("name"), F.when(k % 2 == 0, F.col("o_custkey")).alias("region"), F.col("o_orderdate").cast("timestamp").alias("ts"), k.alias("seq"))


SNAPSHOT = f"""{LOG}, lives AS (SELECT *, sum(CASE WHEN op <> 'update' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, shape_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS life FROM log),
filled AS (SELECT *, first(op) OVER w AS first_op, first(ts) OVER w AS created_at, last(name IGNORE NULLS) OVER w AS the_name, last(region IGNORE NULLS) OVER w AS the_region, row_number() OVER (PARTITION BY user_id, shape_id ORDER BY ts DESC, seq DESC) AS back FROM lives WHERE life > 0 WINDOW w AS (PARTITION BY user_id, shape_id, life ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
snap AS (SELECT user_id, shape_id, created_at, ts AS updated_at, the_name AS name, the_region AS region FROM filled WHERE back = 1 AND first_op = 'create')"""


@register("saved_shapes_snapshot", f"WITH {SNAPSHOT} SELECT * FROM snap")
def saved_shapes_snapshot(spark, d):
    return incremental.shape_snapshot(_shape_log(spark, d))


@register("saved_shapes_stats", f"WITH {SNAPSHOT}, {MEANS} SELECT user_id, shape_id, model, statistic, round(value, 6) AS value FROM snap JOIN means ON region = region_id WHERE lead_key = '3'")
def saved_shapes_stats(spark, d):
    shapes = incremental.shape_snapshot(_shape_log(spark, d)).where("region is not null").select("user_id", "shape_id", F.col("region").alias("region_id"))
    means = query.region_means(_yearly(spark, d).where("lead_key = '3'"), _cells(spark, d))
    return shapes.join(means, "region_id").select("user_id", "shape_id", "model", "statistic", F.round("value", 6).alias("value"))


@register("region_geometry_key", f"WITH {S.REGION} SELECT type || ':' || array_to_string(list_transform(CASE type WHEN 'rectangle' THEN [bw, bs, be, bn] ELSE flatten(ring) END, lambda v: printf('%.5f', v)), ',') AS geo_key, count(*) AS n, min(region_id) AS region_id FROM region GROUP BY 1")
def region_geometry_key(spark, d):
    numbers = F.when(F.col("type") == "rectangle", F.col("bounds")).otherwise(F.flatten("coordinates"))
    return fx.regions(spark, d).groupBy(fn.geometry_key(F.col("type"), numbers).alias("geo_key")).agg(F.count("*").alias("n"), F.min("region_id").alias("region_id"))


@register("zip_lookup", """WITH z AS (SELECT DISTINCT substr(trim(CAST(10000 + s_suppkey AS VARCHAR)), 1, 5) AS zip, round(CAST(s_acctbal AS DOUBLE) / 100, 6) AS lat FROM supplier), z1 AS (SELECT zip, min(lat) AS lat FROM z GROUP BY 1)
SELECT c_custkey, zip IS NOT NULL AS found, lat FROM customer LEFT JOIN z1 ON zip = substr(regexp_replace('US-' || CAST(10000 + c_custkey AS VARCHAR), '\\D', '', 'g'), 1, 5)""")
def zip_lookup(spark, d):
    k = (F.col("s_suppkey") + 10000).cast("string")
    raw = fx.read(spark, d, "supplier").select(F.concat(F.lit(" "), k, F.lit(" ")).alias("zip"), *((F.col("s_acctbal").cast("double") / 100).alias(c) for c in ("lat", "lon", "min_lon", "min_lat", "max_lon", "max_lat")))
    zips = scans.zip_directory(raw).groupBy("zip").agg(F.min("lat").alias("lat"))
    asked = fx.read(spark, d, "customer").select("c_custkey", fn.normalize_zip(F.concat(F.lit("US-"), (F.col("c_custkey") + 10000).cast("string"))).alias("zip"))
    return asked.join(zips, "zip", "left").select("c_custkey", F.col("lat").isNotNull().alias("found"), "lat")


# --- publishing

RANGES = "SELECT model, statistic, period, period_key, CASE WHEN statistic IN ('bias', 'sacc') THEN 'diverging_reversed' ELSE 'diverging' END AS colormap, quantile_cont(value, 0.02) AS p, quantile_cont(value, 0.98) AS q FROM stats GROUP BY ALL"
FIT = "SELECT model, statistic, period, period_key, colormap, round(coalesce(p, -1.0e0), 6) AS low, round(CASE WHEN p IS NULL THEN 1.0e0 WHEN q <= p THEN p + 1 ELSE q END, 6) AS high FROM r"


def _ranges(spark, d, mode, periods=("monthly", "seasonal", "yearly")):
    layers = Scratch(spark).keep(fx.stats(spark, d, periods))
    return layers, publish.legend_ranges(layers, dims.statistic_dim(spark), mode)


@register("legend_range_export", f"WITH {S.STATS}, r AS ({RANGES}) {FIT}")
def legend_range_export(spark, d):
    return _ranges(spark, d, "export")[1].withColumns({c: F.round(c, 6) for c in ("low", "high")})


for _mode, _top in (("export", "greatest(q, 1.0e0)"), ("tile", "CASE WHEN q <= 0 THEN 1.0e0 ELSE q END")):
    register(f"forecast_range_{_mode}", f"WITH {S.FC} SELECT model, statistic, colormap, low, round({_top}, 6) AS high FROM (SELECT model, 'forecast' AS statistic, 'sequential' AS colormap, 0.0e0 AS low, quantile_cont((m - 20) / 100, 0.98) AS q FROM fc GROUP BY 1)")(
        lambda spark, d, mode=_mode: publish.legend_ranges(Scratch(spark).keep(fx.forecast(spark, d).select("model", F.lit("forecast").alias("statistic"), ((F.col("value") - 20) / 100).alias("value"))), dims.statistic_dim(spark), mode, ("model", "statistic")).withColumn("high", F.round("high", 6))
    )


@register("legend_range_tile", f"WITH {S.STATS}, r AS ({RANGES}) {FIT}")
def legend_range_tile(spark, d):
    return _ranges(spark, d, "tile")[1].withColumns({c: F.round(c, 6) for c in ("low", "high")})


SKETCHED = RANGES.replace("quantile_cont", "quantile_disc")


@register("legend_range_sketched", f"WITH {S.STATS}, r AS ({SKETCHED}) {FIT}")
def legend_range_sketched(spark, d):
    """Lead days are stored first; the windows come later, and ranges then cover both without the days' values."""
    layers, path = Scratch(spark).keep(fx.stats(spark, d)), f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    window = F.col("lead_key").contains("_")
    for part in (layers.where(~window), layers.where(window)):
        sketches.store_sketches(sketches.layer_sketches(part), path)
    ranges = sketches.sketched_ranges(sketches.stored_sketches(spark, path), dims.statistic_dim(spark))
    return ranges.withColumns({c: F.round(c, 6) for c in ("low", "high")})


def _mix(low, high, t, k):
    return f"CASE WHEN {t} <= 0.5 THEN {low[k]}.0e0 + ({fn.WHITE[k]} - {low[k]}) * ({t} / 0.5e0) ELSE {fn.WHITE[k]}.0e0 + ({high[k]} - {fn.WHITE[k]}) * (({t} - 0.5e0) / 0.5e0) END"


def _colour_sql(name: str) -> str:
    t = "t"
    if name == "sequential":
        rgb = [f"{fn.WHITE[k]}.0e0 + ({fn.PURPLE[k]} - {fn.WHITE[k]}) * t" for k in range(3)]
        a = "CAST(trunc(least(t * 1020.0e0, 255.0e0)) AS INT)"
    else:
        low, high = (fn.BLUE, fn.RED) if name == "diverging" else (fn.RED, fn.BLUE)
        rgb, a = [_mix(low, high, t, k) for k in range(3)], "255"
    r, g, b = (f"CAST(trunc({x}) AS INT)" for x in rgb)
    return f"WITH {S.FC} SELECT model, init_date, lead, cell_id, {r} AS r, {g} AS g, {b} AS b, {a} AS a FROM (SELECT *, least(greatest((m - 20.0e0) / 180.0e0, 0.0e0), 1.0e0) AS t FROM fc)"


for _c in ("diverging", "diverging_reversed", "sequential"):
    register(f"colormap_{_c}", _colour_sql(_c))(
        lambda spark, d, c=_c: fx.forecast(spark, d).withColumn("c", fn.rgba(F.lit(c), fn.position(F.col("value"), F.lit(20.0), F.lit(200.0)))).select("model", "init_date", "lead", "cell_id", "c.r", "c.g", "c.b", "c.a")
    )


@register("land_mask", "SELECT CAST(l_suppkey % 24 AS INT) AS cell_id FROM lineitem WHERE l_quantity <> 1 GROUP BY 1")
def land_mask(spark, d):
    raw = fx.read(spark, d, "lineitem").select((F.col("l_suppkey") % 24).cast("int").alias("cell_id"), F.col("l_quantity").cast("double").alias("value"))
    return publish.land_mask(scans.observed(raw, 1.0))


IMAGE = (-124.0, 22.5, -76.0, 42.5, 24, 16)  # west, south, east, north, width, height


def _image(spark):
    px = grid.mercator_pixels(spark, *IMAGE)
    index = grid.source_index(F.col("lon"), F.col("lat"), (8.0, 0.0, -124.0, 0.0, 5.0, 22.5))
    inside = index["src_row"].between(0, 3) & index["src_col"].between(0, 5)
    return px.where(inside).select("px", "py", (index["src_row"] * 6 + index["src_col"]).cast("int").alias("cell_id"))


IMAGE_SQL = """image AS (SELECT CAST(id % 24 AS INT) AS px, CAST(id // 24 AS INT) AS py FROM (SELECT unnest(generate_series(0, 383)) AS id)),
ends AS (SELECT 6378137.0e0 * ln(tan(pi() / 4 + radians(42.5e0) / 2)) AS top, 6378137.0e0 * ln(tan(pi() / 4 + radians(22.5e0) / 2)) AS bottom),
geo AS (SELECT px, py, degrees(atan(sinh((top - (py + 0.5e0) * ((top - bottom) / 16)) / 6378137.0e0))) AS lat, -124.0e0 + (px + 0.5e0) * 2 AS lon FROM image, ends),
pix AS (SELECT px, py, CAST(floor((lat - 22.5e0) / 5) * 6 + floor((lon + 124.0e0) / 8) AS INT) AS cell_id FROM geo)"""


@register("mercator_pixels", f"WITH {S.FC}, {S.LATEST}, {IMAGE_SQL} SELECT model, lead, px, py, m AS value FROM latest JOIN pix USING (cell_id)")
def mercator_pixels(spark, d):
    latest = pairing.latest_init(fx.forecast(spark, d))
    return latest.join(F.broadcast(_image(spark)), "cell_id").select("model", "lead", "px", "py", "value")  # the image has a fixed size


@register("layer_tiles", f"WITH {S.STATS}, r AS ({RANGES}), {IMAGE_SQL}, fit AS (SELECT model, statistic, period, period_key, colormap, coalesce(p, -1.0e0) AS low, CASE WHEN p IS NULL THEN 1.0e0 WHEN q <= p THEN p + 1 ELSE q END AS high FROM r) SELECT statistic, model, lead_key, count(*) AS n_pixels, count(value) AS n_shown FROM stats JOIN fit USING (model, statistic, period, period_key) JOIN pix USING (cell_id) WHERE period = 'yearly' GROUP BY ALL")
def layer_tiles(spark, d):
    layers, ranges = _ranges(spark, d, "tile", ("yearly",))
    shown = publish.coloured(layers, ranges, publish.land_mask(fx.observation(spark, d)))
    tiles = shown.join(F.broadcast(_image(spark)), "cell_id")
    return tiles.groupBy("statistic", "model", "lead_key").agg(F.count("*").alias("n_pixels"), F.count_if(F.col("a") > 0).alias("n_shown"))


def _tint(name: str, k: int) -> str:
    low, high = (fn.BLUE, fn.RED) if name == "diverging" else (fn.RED, fn.BLUE)
    return f"CAST(trunc({_mix(low, high, 't', k)}) AS INT)"


_CHANNELS = ", ".join(f"CASE WHEN t IS NULL THEN 0 WHEN colormap = 'diverging' THEN {_tint('diverging', k)} ELSE {_tint('diverging_reversed', k)} END AS {c}" for k, c in enumerate("rgb"))


@register("tile_pixels", f"WITH {S.STATS}, r AS ({RANGES}), {IMAGE_SQL}, fit AS ({FIT}), v AS (SELECT stats.*, colormap, least(greatest((value - low) / (high - low), 0.0e0), 1.0e0) AS t FROM stats JOIN fit USING (model, statistic, period, period_key) WHERE period = 'yearly') SELECT model, statistic, lead_key, px, py, {_CHANNELS}, CASE WHEN t IS NULL THEN 0 ELSE 255 END AS a FROM v JOIN pix USING (cell_id)")
def tile_pixels(spark, d):
    layers, ranges = _ranges(spark, d, "tile", ("yearly",))
    colours = publish.coloured(layers, ranges.withColumns({c: F.round(c, 6) for c in ("low", "high")}))
    image = _image(spark).withColumn("model", F.explode(F.array(*(F.lit(m[0]) for m in dims.MODELS))))  # of a fixed size
    path = f"{shared_folder(spark)}/pixels-{uuid.uuid4().hex}"
    sinks.write_pixels(publish.pixels(colours, F.broadcast(image)), path)
    return spark.read.parquet(path).select("model", "statistic", "lead_key", "px", "py", "r", "g", "b", "a")


@register("stored_layers", f"WITH {S.STATS} SELECT cell_id, lead_key, value, sample_count FROM stats WHERE model = 'gfs' AND statistic = 'nmad' AND period = 'seasonal' AND period_key = 'djf'")
def stored_layers(spark, d):
    path = f"{shared_folder(spark)}/stats-{uuid.uuid4().hex}"
    sinks.write_stats(fx.stats(spark, d), path)
    stored = spark.read.parquet(path)  # slices are folders, so only one is read
    return stored.where("model = 'gfs' and statistic = 'nmad' and period = 'seasonal' and period_key = 'djf'").select("cell_id", "lead_key", "value", "sample_count")


@register("array_fields", f"WITH {S.FC}, {S.LATEST}, {S.OBS}, {S.AXES} SELECT model, init_date, lead, cell_id, CAST(CAST(m AS FLOAT) AS DOUBLE) AS value FROM (SELECT DISTINCT model, init_date, lead FROM latest) CROSS JOIN cell LEFT JOIN latest USING (model, init_date, lead, cell_id)")
def array_fields(spark, d):
    latest = pairing.latest_init(fx.forecast(spark, d))
    grid_cells = F.explode(F.sequence(F.lit(0), F.lit(fx.N_CELLS - 1))).alias("cell_id")
    whole = latest.select("model", "init_date", "lead").distinct().select("*", grid_cells).join(latest, ["model", "init_date", "lead", "cell_id"], "left")
    fields = sinks.forecast_export(whole).withColumnRenamed("layer_values", "values")
    return scans.array_fields(fields, len(fx.LATS), len(fx.LONS)).withColumn("value", F.col("value").cast("double"))


@register("raw_fields", f"WITH {S.BASE} SELECT model, init_date, 24 AS fhour, 1 AS lead, cell_id, CAST(CAST(fv AS FLOAT) AS DOUBLE) AS value FROM base")
def raw_fields(spark, d):
    base = Scratch(spark).keep(fx.forecast_base(spark, d).repartition(2 * spark.sparkContext.defaultParallelism, "model", "init_date"))
    by_cell = F.map_from_entries(F.collect_list(F.struct("cell_id", "fv")))
    values = F.transform(F.sequence(F.lit(0), F.lit(fx.N_CELLS - 1)), lambda k: F.try_element_at("cells", k))
    fields = base.groupBy("model", "init_date").agg(by_cell.alias("cells")).select("model", "init_date", F.lit(24).alias("fhour"), values.alias("values"))
    root, out = f"{shared_folder(spark)}/fields-{uuid.uuid4().hex}", None
    for model in (m[0] for m in dims.MODELS):
        scans.write_fields(fields.where(F.col("model") == model), f"{root}/{model}", len(fx.LATS), len(fx.LONS))
        found = scans.forecast_fields(spark, f"{root}/{model}", model, len(fx.LATS), len(fx.LONS), hours=[24])
        out = found if out is None else out.unionByName(found)
    return out.where("value is not null")


RAW_LATS, RAW_LONS, RAW_BOX = [40.0, 35.0, 30.0, 25.0], [140.0, 180.0, 220.0, 260.0, 300.0, 340.0], (-150.0, 26.0, -50.0, 42.0)  # north to south, 0..360


@register("oriented_fields", f"WITH {S.FC}, {S.LATEST}, raw AS (SELECT model, init_date, lead, m, 40.0e0 - 5 * (cell_id // 6) AS lat, ([140.0e0, -180.0e0, -140.0e0, -100.0e0, -60.0e0, -20.0e0])[cell_id % 6 + 1] AS lon FROM latest) SELECT model, init_date, lead, lat, lon, CAST(CAST(m AS FLOAT) AS DOUBLE) AS value FROM raw WHERE lat BETWEEN 26 AND 42 AND lon BETWEEN -150 AND -50")
def oriented_fields(spark, d):
    latest = pairing.latest_init(fx.forecast(spark, d))
    grid_cells = F.explode(F.sequence(F.lit(0), F.lit(fx.N_CELLS - 1))).alias("cell_id")
    whole = latest.select("model", "init_date", "lead").distinct().select("*", grid_cells).join(latest, ["model", "init_date", "lead", "cell_id"], "left")
    fields = sinks.forecast_export(whole).withColumnRenamed("layer_values", "values")
    rows = [(m[0], a, i, v) for m in dims.MODELS for a, axis in (("lat", RAW_LATS), ("lon", RAW_LONS)) for i, v in enumerate(axis)]
    turned = grid.orientation(spark.createDataFrame(rows, "model string, axis string, idx int, center double"), RAW_BOX)
    placed = grid.oriented(fields, turned).join(F.broadcast(turned.select("model", "lats", "lons")), "model").select("model", "init_date", "lead", "lats", "lons", F.posexplode("values").alias("k", "value"))
    row, col = F.expr("cast(k div size(lons) as int)"), F.expr("k % size(lons)")
    return placed.where("value is not null").select("model", "init_date", "lead", F.get("lats", row).alias("lat"), F.get("lons", col).alias("lon"), F.col("value").cast("double").alias("value"))


@register("calendar_reader", f"WITH {S.BASE}, {S.MODEL} SELECT base.model, init_date, lead_min, lead_max FROM (SELECT DISTINCT model, init_date FROM base) base JOIN model ON base.model = model.model WHERE day(init_date) % 7 <> 0")
def calendar_reader(spark, d):
    """A calendar document of every init date; those of some days are cut short, as a broken download leaves them."""
    inits = fx.forecast_base(spark, d).select("model", "init_date").distinct().join(dims.model_dim(spark), "model")
    entry = F.to_json(F.map_from_arrays(F.array("model"), F.array(F.struct(F.col("init_date").cast("string").alias("initDate"), F.col("lead_min").alias("leadMin"), F.col("lead_max").alias("leadMax")))))
    documents = inits.select(F.when(F.dayofmonth("init_date") % 7 == 0, F.substring(entry, 1, 20)).otherwise(entry).alias("value"))
    return scans.read_calendar(documents)


@register("lead_blend", f"WITH {S.FC}, {S.LATEST}, c AS (SELECT model, lead, cell_id, CAST(trunc(255.0e0 + (120 - 255) * t) AS INT) AS r, CAST(trunc(least(t * 1020.0e0, 255.0e0)) AS INT) AS a FROM (SELECT *, least(greatest((m - 20.0e0) / 180.0e0, 0.0e0), 1.0e0) AS t FROM latest)), b AS (SELECT model, cell_id, sum(r * a * w) AS ra, sum(a * w) AS a FROM (SELECT *, CASE lead WHEN 3 THEN 1 - 0.296875e0 WHEN 4 THEN 0.296875e0 END AS w FROM c) WHERE w IS NOT NULL GROUP BY 1, 2) SELECT model, cell_id, round(CASE WHEN a > 0 THEN ra / a ELSE 0.0e0 END, 6) AS r, round(a, 6) AS a FROM b")
def lead_blend(spark, d):
    latest = pairing.latest_init(fx.forecast(spark, d))
    rows = latest.withColumn("c", fn.rgba(F.lit("sequential"), fn.position(F.col("value"), F.lit(20.0), F.lit(200.0)))).select("model", "lead", "cell_id", "c.r", "c.g", "c.b", "c.a")
    return publish.blended(rows, F.lit(3.3), ["model", "cell_id"]).select("model", "cell_id", F.round("r", 6).alias("r"), F.round("a", 6).alias("a"))


@register("layer_export", f"WITH {S.STATS} SELECT model, statistic, period, period_key, lead_key, count(*) AS n_cells, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 3) AS total FROM stats GROUP BY ALL")
def layer_export(spark, d):
    out = sinks.layer_export(fx.stats(spark, d))
    total = F.aggregate("layer_values", F.lit(None).cast("double"), lambda s, v: F.when(v.isNull(), s).otherwise(F.coalesce(s, F.lit(0.0)) + v.cast("double")))
    return out.select("model", "statistic", "period", "period_key", "lead_key", F.size("layer_values").cast("long").alias("n_cells"), F.round(total, 3).alias("total"))


PANEL = f"{ALL}, {LOSS.split(S.YEARLY + ', ')[1]}, {WINNERS.split(LOSS + ', ')[1]}, {S.LATEST}, {FORECASTS.split(S.REGION + ', ')[1]}"


@register("panel_csv", f"""WITH {PANEL} SELECT a.region_id, a.model, a.lead, round(max(CASE WHEN a.statistic = 'bias' THEN a.value END), 6) AS bias, round(max(CASE WHEN a.statistic = 'sacc' THEN a.value END), 6) AS sacc, round(max(CASE WHEN a.statistic = 'nrmse' THEN a.value END), 6) AS nrmse, round(max(CASE WHEN a.statistic = 'nmad' THEN a.value END), 6) AS nmad,
any_value(w.model) AS best_model, any_value(g.value) AS forecast_gfs, any_value(b.value) AS forecast_nbm FROM allleads a LEFT JOIN winners w ON w.region_id = a.region_id AND w.lead = a.lead AND w.statistic = 'nmad'
LEFT JOIN forecasts g ON g.region_id = a.region_id AND g.lead = a.lead AND g.model = 'gfs' LEFT JOIN forecasts b ON b.region_id = a.region_id AND b.lead = a.lead AND b.model = 'nbm' GROUP BY a.region_id, a.model, a.lead""")
def panel_csv(spark, d):
    scratch = Scratch(spark)
    base, cells = scratch.keep(fx.forecast_base(spark, d)), _cells(spark, d)
    summary = scratch.keep(_summary(spark, d, cells, base=base))
    winners = _winners(spark, d, summary).where("statistic = 'nmad'")
    out = panel.panel(_curves(spark, d, cells, summary), STATISTICS, winners, _forecasts(spark, d, cells, base), ("gfs", "nbm"))
    return out.select("region_id", "model", "lead", *(F.round(c, 6).alias(c) for c in STATISTICS), "best_model", *(F.round(c, 6).alias(c) for c in ("forecast_gfs", "forecast_nbm")))


@register("quality_tiers", f"WITH {S.STATS} SELECT statistic, CASE statistic WHEN 'sacc' THEN CASE WHEN value > 42 THEN 'good' WHEN value > 20 THEN 'ok' ELSE 'bad' END WHEN 'nmad' THEN CASE WHEN value < 100 THEN 'good' WHEN value < 125 THEN 'ok' ELSE 'bad' END WHEN 'nrmse' THEN CASE WHEN value < 350 THEN 'good' WHEN value < 510 THEN 'ok' ELSE 'bad' END ELSE CASE WHEN abs(value) < 2 THEN 'good' WHEN abs(value) < 4 THEN 'ok' ELSE 'bad' END END AS tier, count(*) AS n FROM stats WHERE value IS NOT NULL GROUP BY 1, 2")
def quality_tiers(spark, d):
    return fx.stats(spark, d).where("value is not null").groupBy("statistic", fn.quality_tier(F.col("statistic"), F.col("value")).alias("tier")).agg(F.count("*").alias("n"))


@register("lead_interp", f"WITH {ALL}, n AS (SELECT *, lead(value) OVER w AS nxt, lead(lead) OVER w IS NULL AS ended FROM allleads WINDOW w AS (PARTITION BY region_id, model, statistic ORDER BY lead)) SELECT region_id, model, statistic, lead + 0.25e0 AS pos, round(CASE WHEN ended THEN value WHEN value IS NULL THEN nxt WHEN nxt IS NULL THEN value ELSE value + (nxt - value) * 0.25e0 END, 5) AS value FROM n")
def lead_interp(spark, d):
    return panel.at_fraction(_curves(spark, d), 0.25).select("region_id", "model", "statistic", F.col("at").cast("double").alias("pos"), F.round("value", 5).alias("value"))


@register("lead_at", f"WITH {ALL}, a AS (SELECT *, least(greatest(CAST(region_id % 18 AS DOUBLE) + 0.5e0, 1.0e0), CASE model WHEN 'gfs' THEN 14.0e0 ELSE 11.0e0 END) AS pos FROM allleads), e AS (SELECT region_id, model, statistic, pos, max(CASE WHEN lead = floor(pos) THEN value END) AS lo, max(CASE WHEN lead = ceil(pos) THEN value END) AS hi FROM a GROUP BY ALL) SELECT region_id, model, statistic, pos, round(coalesce(lo + (hi - lo) * (pos - floor(pos)), lo, hi), 5) AS value FROM e")
def lead_at(spark, d):
    return panel.at_lead(_curves(spark, d), F.col("region_id") % 18 + F.lit(0.5)).select("region_id", "model", "statistic", F.col("at").alias("pos"), F.round("value", 5).alias("value"))


@register("lead_slope", f"WITH {ALL} SELECT region_id, model, statistic, round(min(value), 6) AS low, round(max(value), 6) AS high, min(lead) AS first_lead, max(lead) AS last_lead, round((arg_max(value, lead) - arg_min(value, lead)) / CASE WHEN max(lead) = min(lead) THEN NULL ELSE max(lead) - min(lead) END, 5) AS slope FROM allleads WHERE value IS NOT NULL GROUP BY 1, 2, 3")
def lead_slope(spark, d):
    return panel.curve_summary(_curves(spark, d)).select("region_id", "model", "statistic", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "first_lead", "last_lead", F.round("slope", 5).alias("slope"))


def _inits(spark, d):
    return fx.forecast_base(spark, d).groupBy("model").agg(F.max("init_date").alias("init_date"))


@register("latest_init", f"WITH {S.BASE} SELECT model, max(init_date) AS init_date FROM base GROUP BY 1")
def latest_init(spark, d):
    return _inits(spark, d)


def _json_row(fields: dict) -> str:
    return "{" + ",".join(f'"{k}":{json.dumps(v) if not isinstance(v, tuple) else v[0]}' for k, v in fields.items()) + "}"


_MODEL_ROWS = ",".join(_json_row({"model": m[0], "label": m[1], "lead_min": m[2], "lead_max": m[3], "init_date": (f"\"' || (SELECT max(init_date) FROM base WHERE model = '{m[0]}') || '\"",), "is_default": m[6]}) for m in sorted(dims.MODELS))
_STATISTIC_ROWS = ",".join(_json_row(dict(zip(("statistic", "label", "units", "colormap", "kind", "is_default"), row, strict=True))) for row in sorted(dims.STATISTICS))


@register("config_json", f"""WITH {S.BASE} SELECT '{{"models":[{_MODEL_ROWS}],"statistics":[{_STATISTIC_ROWS}],"default_model":"{dims.DEFAULT_MODEL}","default_statistic":"{dims.DEFAULT_STATISTIC}"}}' AS config""")
def config_json(spark, d):
    return publish.config_json(dims.model_dim(spark), dims.statistic_dim(spark), _inits(spark, d))


@register("forecast_calendar", f"""WITH {S.MODEL}, {S.BASE} SELECT model, init_date, lead_min, lead_max, '{{"initDate":"' || strftime(init_date, '%Y-%m-%d') || '","leadMin":' || lead_min || ',"leadMax":' || lead_max || '}}' AS entry FROM model JOIN (SELECT model, max(init_date) AS init_date FROM base GROUP BY 1) USING (model)""")
def forecast_calendar(spark, d):
    return publish.forecast_calendar(dims.model_dim(spark), _inits(spark, d))


@register("labels", f"""WITH {S.STATS}, k AS (SELECT DISTINCT period, period_key, lead_key FROM stats), mn AS (SELECT ['January','February','March','April','May','June','July','August','September','October','November','December'] AS names)
SELECT period, period_key, lead_key, CASE WHEN contains(lead_key, '_') THEN replace(lead_key, '_', '–') || ' Day Average' ELSE 'Day ' || lead_key END AS lead_label, CASE period WHEN 'monthly' THEN names[CAST(period_key AS INT)] WHEN 'seasonal' THEN CASE period_key WHEN 'djf' THEN 'Winter' WHEN 'mam' THEN 'Spring' WHEN 'jja' THEN 'Summer' ELSE 'Autumn' END || ' (' || upper(period_key) || ')' ELSE 'Yearly' END AS period_label FROM k, mn""".replace("CAST(period_key AS INT)", "TRY_CAST(period_key AS INT)"))
def labels(spark, d):
    keys = fx.stats(spark, d, names=["bias"]).select("period", "period_key", "lead_key").distinct()
    return keys.select("*", fn.lead_label(F.col("lead_key")).alias("lead_label"), fn.period_label(F.col("period"), F.col("period_key")).alias("period_label"))


@register("date_labels", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%-m/%-d') AS short, strftime(o_orderdate, '%B %-d, %Y') AS medium, strftime(o_orderdate, '%A, %B %-d, %Y') AS full_label, 'T' || CASE WHEN date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) >= 0 THEN '+' ELSE '' END || date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) || 'd' AS t_label FROM orders")
def date_labels(spark, d):
    day = fx.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    named = fn.date_labels(F.col("day"))
    return day.select("day", named["short"].alias("short"), named["medium"].alias("medium"), named["full"].alias("full_label"), fn.t_label(F.col("day"), F.lit("1998-01-01").cast("date")).alias("t_label"))


@register("range_labels", f"WITH {S.MODEL}, {S.BASE}, n AS (SELECT DISTINCT model, CASE WHEN day(init_date) <> 1 THEN init_date END AS init_date FROM base) SELECT n.model, init_date, s AS start_lead, e AS end_lead, coalesce(strftime(init_date + s, '%-m/%-d') || '–' || strftime(init_date + e, '%-m/%-d'), s || '–' || e || 'd') AS label FROM n JOIN win ON n.model = win.model")
def range_labels(spark, d):
    """Chips of lead windows for every init date; the first of a month stands for a calendar that isn't there."""
    inits = fx.forecast_base(spark, d).select("model", F.when(F.dayofmonth("init_date") != 1, F.col("init_date")).alias("init_date")).distinct()
    both = inits.join(F.broadcast(dims.lead_windows(spark)), "model")
    return both.select("model", "init_date", F.col("start").alias("start_lead"), F.col("end").alias("end_lead"), fn.range_label(F.col("init_date"), F.col("start"), F.col("end")).alias("label"))


@register("tile_layers", f"WITH {S.PAIRS}, k AS (SELECT DISTINCT model, month(valid_date) AS month, lead FROM pairs), p AS (SELECT model, 'monthly' AS period, lpad(CAST(month AS VARCHAR), 2, '0') AS period_key, lead FROM k UNION SELECT model, 'yearly', '', lead FROM k) SELECT statistic, model, period, period_key, CAST(lead AS VARCHAR) AS lead_key FROM p, (VALUES ('nmad'), ('forecast')) t(statistic) WHERE statistic = 'nmad' OR period = 'yearly'")
def tile_layers(spark, d):
    layers = pairing.by_period(fx.accumulators(spark, d), ("monthly", "yearly")).select("model", "period", "period_key", F.col("lead").cast("string").alias("lead_key")).distinct()
    both = layers.withColumn("statistic", F.explode(F.array(F.lit("nmad"), F.lit("forecast"))))
    return publish.tile_layers(both, dims.statistic_dim(spark)).select("statistic", "model", "period", "period_key", "lead_key")


@register("zip_export", "SELECT substr(CAST(10000 + s_suppkey AS VARCHAR), 1, 5) AS zip, substr(CAST(10000 + s_suppkey AS VARCHAR), 1, 3) AS prefix, min(round(CAST(s_acctbal AS DOUBLE) / 100, 6)) AS lat FROM supplier GROUP BY 1, 2")
def zip_export(spark, d):
    """The directory as JSON by the beginning of its codes, and read back."""
    raw = fx.read(spark, d, "supplier").select((F.col("s_suppkey") + 10000).cast("string").alias("zip"), *((F.col("s_acctbal").cast("double") / 100).alias(c) for c in ("lat", "lon", "min_lon", "min_lat", "max_lon", "max_lat")))
    path = f"{shared_folder(spark)}/zips-{uuid.uuid4().hex}"
    sinks.write_zip_directory(scans.zip_directory(raw).groupBy("zip").agg(F.min("lat").alias("lat")), path)
    return spark.read.schema("zip string, lat double, prefix string").json(path)


@register("stored_sums", f"WITH {S.ACC} SELECT * FROM acc")
def stored_sums(spark, d):
    """Sums that were stored before, read back if they have all keys; a table that lacks one is not used."""
    root = f"{shared_folder(spark)}/sums-{uuid.uuid4().hex}"
    fx.accumulators(spark, d).write.parquet(f"{root}/whole")
    wanted = [*pairing.KEYS, *sum_names()]
    whole = scans.stored_accumulators(spark, f"{root}/whole", wanted)
    whole.drop("sum_cross").write.parquet(f"{root}/old")
    old = scans.stored_accumulators(spark, f"{root}/old", wanted)
    return (old if old is not None else whole).select(*wanted)


# --- ingest

LINES = """ordered AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line_no, CAST(l_quantity AS BIGINT) * 100 AS size, l_returnflag, l_linestatus FROM lineitem),
lines AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM ordered), ranged AS (SELECT *, lead(b) OVER (PARTITION BY file ORDER BY line_no) - 1 AS e FROM lines)"""


@register("needed_hours", f"WITH {S.BASE} SELECT DISTINCT model, init_date, unnest([h - 18, h - 12, h - 6, h]) AS fhour FROM base, (VALUES (24), (36), (48)) t(h)")
def needed_hours(spark, d):
    """Days may share buckets, as those of hours 24 and 36 do."""
    days = fx.forecast_base(spark, d).select("model", "init_date").distinct().withColumn("day_hour", F.explode(F.array(F.lit(24), F.lit(36), F.lit(48))))
    return ingest.needed_hours(days)


@register("inventory_byte_ranges", f"WITH {LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS k FROM ranged WHERE l_returnflag = 'A' AND l_linestatus <> 'O') SELECT file, CAST(line_no AS INT) AS line_no, b AS begin_byte, e AS end_byte, 'bytes=' || b || '-' || coalesce(CAST(e AS VARCHAR), '') AS range FROM f WHERE k = 1")
def inventory_byte_ranges(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = fx.read(spark, d, "lineitem").withColumn("file", F.col("l_orderkey"))
    numbered = line.withColumns({"line_no": F.row_number().over(w), "b": F.coalesce(F.sum(F.col("l_quantity").cast("long") * 100).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")})
    text = F.concat_ws(":", F.col("line_no").cast("string"), F.col("b").cast("string"), F.lit("d=2026032012"), F.when(F.col("l_returnflag") == "A", "APCP").otherwise("TMP"), F.lit("surface"), F.lit("0-6 hour acc fcst"), F.when(F.col("l_linestatus") == "O", "prob >0.254").otherwise(""))
    out = ingest.byte_ranges(numbered.select("file", "line_no", text.alias("line")), "APCP", "surface", F.lit("0-6 hour acc fcst"))
    return out.select("file", "line_no", F.col("begin").alias("begin_byte"), F.col("end").alias("end_byte"), "range")


@register("forecast_export", f"WITH {S.FC}, {S.LATEST} SELECT model, init_date, lead, count(*) AS n_cells, round(sum(CAST(CAST(m AS FLOAT) AS DOUBLE)), 3) AS total, min(cell_id) AS first_cell FROM latest GROUP BY ALL")
def forecast_export(spark, d):
    latest = pairing.latest_init(fx.forecast(spark, d))
    first = latest.groupBy("model", "lead").agg(F.min("cell_id").alias("first_cell"))
    total = F.aggregate("layer_values", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return sinks.forecast_export(latest).join(first, ["model", "lead"]).select("model", "init_date", "lead", F.size("layer_values").cast("long").alias("n_cells"), F.round(total, 3).alias("total"), "first_cell")


@register("grid_metadata", f"WITH {S.OBS}, {S.AXES}, grid AS (SELECT (SELECT list(c ORDER BY i) FROM lat) AS lats, (SELECT list(c ORDER BY i) FROM lon) AS lons) SELECT model, array_to_string(lats, ',') AS lats, array_to_string(lons, ',') AS lons, array_to_string([lons[2] - lons[1], 0.0e0, lons[1] - (lons[2] - lons[1]) / 2, 0.0e0, lats[2] - lats[1], lats[1] - (lats[2] - lats[1]) / 2], ',') AS transform, 'EPSG:4326' AS crs, n_obs FROM grid, (VALUES ('gfs'), ('nbm')) t(model), (SELECT count(*) AS n_obs FROM obs)")
def grid_metadata(spark, d):
    n = fx.observation(spark, d).agg(F.count("*").alias("n_obs"))
    text = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("lats", "lons", "transform")]
    return sinks.grid_metadata(fx.axes(spark)).select("model", *text, "crs").crossJoin(n)  # one row each


@register("lead_options", f"WITH {S.MODEL}, {S.BASE}, o AS (SELECT model, 0 AS kind, lead AS a, 0 AS b, CAST(lead AS VARCHAR) AS lead_key FROM leads UNION ALL SELECT win.model, 1, row_number() OVER (PARTITION BY win.model ORDER BY CASE lead_key WHEN '1_7' THEN 1 WHEN '1_10' THEN 3 ELSE 2 END), 0, lead_key FROM win JOIN model ON win.model = model.model AND s >= lead_min AND e <= lead_max) SELECT o.model, CAST(row_number() OVER (PARTITION BY o.model ORDER BY kind, a) - 1 AS INT) AS position, lead_key, n_inits FROM o JOIN (SELECT model, count(DISTINCT init_date) AS n_inits FROM base GROUP BY 1) USING (model)")
def lead_options(spark, d):
    n = fx.forecast_base(spark, d).groupBy("model").agg(F.count_distinct("init_date").alias("n_inits"))
    return dims.lead_options(dims.model_dim(spark)).join(n, "model")


@register("download_gap", f"WITH {S.MODEL}, {S.BASE}, span AS (SELECT min(init_date) AS a, max(init_date) AS b FROM base), expected AS (SELECT model, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS init_date, lead * 24 AS fhour FROM span, leads), present AS (SELECT DISTINCT model, init_date, fhour FROM base JOIN (SELECT model, lead * 24 AS fhour FROM leads) USING (model)) SELECT init_date, model, fhour FROM expected ANTI JOIN present USING (model, init_date, fhour)")
def download_gap(spark, d):
    base = fx.forecast_base(spark, d)
    models = dims.model_dim(spark)
    expected = ingest.expected_files(models, F.col("a"), F.col("b"), base.agg(F.min("init_date").alias("a"), F.max("init_date").alias("b")))
    present = base.select("model", "init_date").distinct().join(F.broadcast(models.select("model", F.explode("forecast_hours").alias("fhour"))), "model")
    return ingest.missing_files(expected, present)


@register("catchup_dates", f"WITH {S.BASE} SELECT model, CAST(unnest(generate_series(max(init_date) + 1, DATE '2002-01-01', INTERVAL 1 DAY)) AS DATE) AS init_date FROM base GROUP BY model")
def catchup_dates(spark, d):
    return ingest.catch_up(_inits(spark, d).withColumnRenamed("init_date", "latest"), F.lit("2002-01-01").cast("date"))


@register("freshest_forecast", f"WITH {S.BASE} SELECT model, max(init_date) AS init_date FROM base WHERE init_date IN (DATE '1997-05-04', DATE '1997-05-03') GROUP BY model")
def freshest_forecast(spark, d):
    return ingest.freshest(fx.forecast_base(spark, d).select("model", "init_date").distinct(), F.lit("1997-05-04 20:00:00").cast("timestamp"))


@register("transfer_status_counts", "SELECT CASE WHEN event_type = 'purchase' THEN 'downloaded' WHEN event_type = 'error' THEN 'failed' ELSE event_type END AS status, count(*) AS n FROM events GROUP BY 1")
def transfer_status_counts(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "downloaded (12 KB)").when(kind == "error", F.concat(F.lit("failed: "), F.col("user_id").cast("string"))).otherwise(kind)
    return ingest.transfer_counts(fx.read(spark, d, "events").select(F.col("event_id").alias("task"), status.alias("status")))


@register("failure_examples", "SELECT event_id AS task, 'failed: ' || user_id AS status FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 5")
def failure_examples(spark, d):
    log = fx.read(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("task"), F.concat(F.lit("failed: "), F.col("user_id").cast("string")).alias("status"))
    return ingest.failure_examples(log)


@register("file_audit", """WITH f AS (SELECT p_partkey % 7 = 0 AS part, p_partkey % 5 <> 0 AS magic, p_partkey % 3 <> 0 AS whole FROM part)
SELECT whole AS length_ok, magic AS magic_ok, count(CASE WHEN NOT part THEN 1 END) AS n_complete, count(CASE WHEN part THEN 1 END) AS n_partial FROM f GROUP BY ALL""")
def file_audit(spark, d):
    k = F.col("p_partkey")
    content = F.concat(F.when(k % 5 != 0, F.lit("GRIB")).otherwise(F.lit("HTML")), F.col("p_name")).cast("binary")
    files = fx.read(spark, d, "part").select(F.concat(F.lit("f"), k.cast("string"), F.when(k % 7 == 0, F.lit(scans.PARTIAL)).otherwise(F.lit(".grib2"))).alias("path"), content.alias("content"), (F.octet_length(content) + F.when(k % 3 == 0, 1).otherwise(0)).alias("announced"))
    marked = files.select("path", scans.length_matches(F.col("content"), F.col("announced")).alias("length_ok"), scans.has_grib_magic(F.col("content")).alias("magic_ok"))
    both = scans.complete_files(marked).withColumn("partial", F.lit(0)).unionByName(marked.where(F.col("path").endswith(scans.PARTIAL)).withColumn("partial", F.lit(1)))
    return both.groupBy("length_ok", "magic_ok").agg(F.sum(1 - F.col("partial")).alias("n_complete"), F.sum("partial").alias("n_partial"))


# --- incremental


@register("completeness_audit", f"WITH {S.ACC}, f AS (SELECT model, month, list(DISTINCT lead) AS found FROM acc GROUP BY 1, 2) SELECT model, month, CAST(lead_max - lead_min + 1 - coalesce(len(list_filter(found, lambda x: x BETWEEN lead_min AND lead_max)), 0) AS INT) AS n_missing FROM model LEFT JOIN f USING (model)")
def completeness_audit(spark, d):
    return incremental.completeness(fx.accumulators(spark, d), dims.model_dim(spark)).select("model", "month", "n_missing")


def _updated(spark, d):
    """A first run sees forecasts and observations up to a day, and one half of that day's cells; the second sees all."""
    cut = F.lit("1996-06-30").cast("date")
    fc, obs = fx.forecast(spark, d), fx.observation(spark, d)
    early = obs.where((F.col("valid_date") < cut) | ((F.col("valid_date") == cut) & (F.col("cell_id") < 12)))
    stored, ledger = incremental.update(None, None, fc.where(F.col("init_date") <= cut), early)
    return incremental.update(stored, ledger, fc, obs)


@register("incremental_update", f"WITH {S.ACC} SELECT * FROM acc WHERE n > 0")
def incremental_update(spark, d):
    return _updated(spark, d)[0].select(*pairing.KEYS, *sum_names())


def _published(spark, d):
    """Two states, one after the other: forecasts of days up to one, then all."""
    root = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    forecast, observation, models = fx.forecast(spark, d), fx.observation(spark, d), dims.model_dim(spark)
    early = F.col("valid_date") < F.lit("1996-06-30").cast("date")
    incremental.refresh(forecast, observation.where(early), root, models, "sums-1")
    return incremental.refresh(forecast, observation, root, models, "sums-1")


@register("incremental_version", f"WITH {S.ACC} SELECT * FROM acc WHERE n > 0")
def incremental_version(spark, d):
    return _published(spark, d).acc.select(*pairing.KEYS, *sum_names())


@register("version_manifest", f"WITH {S.PAIRS} SELECT 2 AS number, model, lead_min, lead_max, 'sums-1' AS tag, count(DISTINCT pairs.init_date) AS n_inits, count(DISTINCT (pairs.init_date, pairs.lead)) AS n_paired FROM model JOIN pairs USING (model) GROUP BY ALL")
def version_manifest(spark, d):
    state = _published(spark, d)
    done = state.ledger.groupBy("model").agg(F.count_distinct("init_date").alias("n_inits"), F.count_distinct("init_date", "lead").alias("n_paired"))
    return state.seen.join(done, "model").select(F.lit(state.number).alias("number"), "model", "lead_min", "lead_max", "tag", "n_inits", "n_paired")


@register("incremental_ledger", f"WITH {S.PAIRS} SELECT model, init_date, lead, count(DISTINCT cell_id) AS n_cells FROM pairs GROUP BY ALL")
def incremental_ledger(spark, d):
    ledger = _updated(spark, d)[1]
    return ledger.groupBy("model", "init_date", "lead").agg(F.sum(F.col("last_cell") - F.col("first_cell") + 1).cast("long").alias("n_cells"))


STREAM_SQL = """f AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id % 24 AS INT) AS cell_id, count(*)::DOUBLE AS m FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2), o AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id % 24 AS INT) AS cell_id, count(*)::DOUBLE AS o FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1, 2)"""


@register("streaming_pairing", """WITH e AS (SELECT date_trunc('day', ts) AS day, CAST(user_id % 24 AS INT) AS cell_id, event_type IN ('view', 'click') AS forecast, value FROM events), p AS (SELECT month(a.day) AS month, a.cell_id, a.value AS m, b.value AS o FROM e a JOIN e b ON a.forecast AND NOT b.forecast AND a.day = b.day AND a.cell_id = b.cell_id)
SELECT 'gfs' AS model, CAST(month AS INT) AS month, 1 AS lead, cell_id, count(*) AS n, round(sum(m - o), 4) AS sum_error FROM p GROUP BY month, cell_id""")
def streaming_pairing(spark, d):
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = fx.read(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    day, cell = F.date_trunc("day", "ts"), (F.col("user_id") % 24).cast("int")
    is_forecast = F.col("event_type").isin("view", "click")
    left = source.where(is_forecast).select(F.lit("gfs").alias("model"), F.date_sub(F.to_date("ts"), 1).alias("init_date"), F.lit(1).alias("lead"), cell.alias("cell_id"), F.col("value").alias("m"), day.alias("f_day"))
    right = source.where(~is_forecast).select(cell.alias("o_cell"), F.col("value").alias("o"), day.alias("o_day"))
    streaming.keep_paired_sums(left, right, f"{root}/acc", f"{root}/state").awaitTermination()
    return streaming.accumulated(spark, f"{root}/acc").select("model", "month", "lead", "cell_id", "n", F.round("sum_error", 4).alias("sum_error"))
