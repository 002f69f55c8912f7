"""Hand-worked cases, properties, and sources and sinks on files."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.functions import scalars as fn
from skillgrid.functions.statistics import Statistic, all_sums, statistics
from skillgrid.operators import grid, incremental, ingest, pairing, panel, publish, query, regions
from skillgrid.plans import fixtures as fx
from skillgrid.sources import registry, scans, sinks

SCHEMA = "model string, init_date date, lead int, valid_date date, cell_id int, value double"


def scores(spark, m, o):
    day = dt.date(2020, 1, 5)
    fc = spark.createDataFrame([("gfs", day - dt.timedelta(days=k + 1), 1, day - dt.timedelta(days=k), 0, float(v)) for k, v in enumerate(m)], SCHEMA)
    obs = spark.createDataFrame([(day - dt.timedelta(days=k), 0, float(v)) for k, v in enumerate(o)], "valid_date date, cell_id int, value double")
    out = pairing.finalize(pairing.accumulate(pairing.pairs(fc, obs)))
    return {r.statistic: (r.value, r.sample_count) for r in out.collect()}


@pytest.mark.parametrize(
    "m, o, bias, nmad, nrmse, sacc",
    [([2, 4, 6], [1, 5, 6], 0, 16.6667, 20.4124, 94.4911), ([3], [2], 1, 50, 50, None), ([1, 1], [0, 0], 1, 1e12, 1e12, None), ([0, 0], [0, 0], 0, 0, 0, None)],
)
def test_statistics(spark, m, o, bias, nmad, nrmse, sacc):
    got = scores(spark, m, o)
    for name, wanted in {"bias": bias, "nmad": nmad, "nrmse": nrmse, "sacc": sacc}.items():
        assert got[name][0] == (None if wanted is None else pytest.approx(wanted, rel=1e-4, abs=1e-9))


def test_missing_values(spark):
    assert scores(spark, [float("nan"), 2, 2], [1, float("inf"), 2])["bias"] == (0.0, 1)


def test_edges_and_nearest(spark):
    axes = spark.createDataFrame([("gfs", "lat", 0, 0.0), ("gfs", "lat", 1, 1.0), ("gfs", "lat", 2, 3.0), ("gfs", "lon", 0, 5.0)], "model string, axis string, idx int, center double")
    got = {(r.axis, r.idx): (r.low, r.high) for r in grid.edges(axes).collect()}
    assert got == {("lat", 0): (-0.5, 0.5), ("lat", 1): (0.5, 2.0), ("lat", 2): (2.0, 4.0), ("lon", 0): (4.5, 5.5)}
    points = spark.createDataFrame([(1, "point", [[99.0, 0.5]], None), (2, "circle", None, None)], "region_id int, type string, coordinates array<array<double>>, bounds array<double>")
    cells = {r.region_id: r.cells for r in regions.region_cells(points, grid.axis_arrays(axes)).collect()}
    assert cells == {1: [0], 2: []}


def test_window_needs_every_lead(spark):
    rows = [("gfs", 1, lead, 0, 1, *([1.0] * 8)) for lead in range(1, 7)]
    acc = spark.createDataFrame(rows, "model string, month int, lead int, cell_id int, n long, sum_error double, sum_abs_error double, sum_squared_error double, sum_model double, sum_obs double, sum_model_sq double, sum_obs_sq double, sum_cross double")
    assert pairing.by_window(pairing.by_period(acc), registry.lead_windows(spark)).count() == 0


def test_winners(spark):
    rows = [(1, "nbm", "nmad", 3, 2.0), (1, "gfs", "nmad", 3, 2.0), (1, "gfs", "nmad", 12, None)]
    got = query.lead_winners(spark.createDataFrame(rows, "region_id int, model string, statistic string, lead int, loss double")).collect()
    assert [(r.lead, r.model) for r in got] == [(3, "gfs")]


def test_daily_sum_and_ranges(spark):
    b = spark.createDataFrame([(0, h, v) for h, v in zip((6, 12, 18, 24), (1.0, 2.0, None, 4.0))], "cell_id int, fhour int, value double")
    assert pairing.daily_from_buckets(b, ["cell_id"]).first().value is None
    low = spark.createDataFrame([("forecast", 0.4), ("forecast", 0.4)], "statistic string, value double")
    spec = registry.statistic_dim(spark)
    assert publish.legend_ranges(low, spec, "export", ("statistic",)).first().high == 1.0
    assert publish.legend_ranges(low, spec, "tile", ("statistic",)).first().high == pytest.approx(0.4)


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_percentiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(3)
    slices = {"ties": np.repeat([1.0, 2.0, 3.0], [50, 4000, 7]), "few": np.array([4.0, -1.0, 9.0]), "one": np.array([5.0]), "many": rng.normal(size=5000), "constant": np.full(300, 2.5)}
    rows = [(k, float(x)) for k, v in slices.items() for x in v] + [("none", None), ("few", None)]
    layers = spark.createDataFrame(rows, "s string, value double").repartition(7)
    shares = (0.0, 0.02, 0.5, 0.98, 1.0)
    got = {r.s: r.p for r in publish.percentiles(layers, ("s",), shares, accuracy).collect()}
    assert got.pop("none") is None and set(got) == set(slices)
    for k, v in slices.items():
        assert np.allclose(got[k], np.quantile(v, shares), rtol=0, atol=1e-12)


def test_byte_ranges(spark):
    lines = [f"{k}:{b}:d=2026032012:{v}:surface:0-6 hour acc fcst:" for k, b, v in ((1, 0, "TMP"), (2, 100, "APCP"), (3, 250, "TMP"))]
    rows = [("a", k + 1, x) for k, x in enumerate(lines)] + [("b", 3, lines[2].replace("TMP", "APCP"))]
    got = {r.file: r.range for r in ingest.byte_ranges(spark.createDataFrame(rows, "file string, line_no int, line string"), "APCP", "surface").collect()}
    assert got == {"a": "bytes=100-249", "b": "bytes=250-"}


def test_months_add_up_to_years(spark):
    acc = fx.accumulators(spark, "/root/testdata/sf0.001").cache()
    year = pairing.by_period(acc, ("yearly",)).agg(F.sum("n"), F.sum("sum_error")).first()
    assert tuple(year) == tuple(acc.agg(F.sum("n"), F.sum("sum_error")).first())
    wide = pairing.finalize(pairing.by_period(acc, ("yearly",))).groupBy("model", "lead", "cell_id").pivot("statistic").agg(F.first("value"))
    assert not wide.where("abs(sacc) > 100 or nrmse < nmad - 1e-9").count()


def test_late_observation_is_counted(spark, tmp_path):
    day = dt.date(2020, 1, 1)
    cells = (0, 1, 2, 3)
    fc = spark.createDataFrame([("gfs", day, k, day + dt.timedelta(days=k), c, 1.0 * k + c) for k in (1, 2, 3) for c in cells], SCHEMA)
    obs = spark.createDataFrame([(day + dt.timedelta(days=k), c, 1.0) for k in (1, 2, 3) for c in cells], "valid_date date, cell_id int, value double")
    # a day that is missing, and one of which only cells 1 and 3 came
    early = obs.where((F.col("valid_date") < day + dt.timedelta(days=2)) | ((F.col("valid_date") == day + dt.timedelta(days=2)) & F.col("cell_id").isin(1, 3)))
    stored, ledger = incremental.update(None, None, fc, early)
    assert ledger.count() == 3
    models, root = spark.createDataFrame([("gfs", 1, 3)], "model string, lead_min int, lead_max int"), str(tmp_path)
    assert incremental.current_version(spark, root) is None
    assert incremental.write_version(stored, ledger, root, models, "a") == 1
    old = incremental.current_version(spark, root)
    stored, ledger = incremental.update(old.acc, old.ledger, fc, obs)
    assert incremental.write_version(stored, ledger, root, models, "a", old.number) == 2
    with pytest.raises(FileExistsError):  # a second writer that began from the same state
        incremental.write_version(old.acc, old.ledger, root, models, "a", old.number)
    state = incremental.current_version(spark, root)
    stored, ledger = state.acc, state.ledger
    assert state.number == 2 and tuple(state.seen.first()) == ("gfs", 1, 3, "a")
    whole = pairing.accumulate(pairing.pairs(fc, obs))
    assert not stored.select(*whole.columns).exceptAll(whole).count() and stored.agg(F.sum("n")).first()[0] == 12
    again, _ = incremental.update(stored, ledger, fc, obs)
    assert not again.select(*whole.columns).exceptAll(whole).count()

    dim = "model string, lead_min int, lead_max int"
    model, seen = spark.createDataFrame([("gfs", 1, 3)], dim), spark.createDataFrame([("gfs", 1, 3, "a")], dim + ", tag string")
    assert incremental.can_update(ledger, stored, model, seen, "a")
    assert not incremental.can_update(ledger, stored, model, seen, "b") and not incremental.can_update(ledger, stored, model, None, "a")
    assert not incremental.can_update(ledger, stored, spark.createDataFrame([("gfs", 1, 4)], dim), seen, "a")
    assert not incremental.can_update(ledger, stored.where("false"), model, seen, "a")
    both, seen2 = spark.createDataFrame([("gfs", 1, 3), ("nbm", 1, 2)], dim), spark.createDataFrame([("gfs", 1, 3, "a"), ("nbm", 1, 2, "a")], dim + ", tag string")
    assert not incremental.can_update(ledger, stored, both, seen2, "a")
    assert {(r.model, r.month, r.n_missing) for r in incremental.completeness(stored, both).collect()} == {("gfs", 1, 0), ("nbm", None, 2)}


def test_sums_of_a_new_statistic_reach_every_rollup(spark):
    worst = Statistic("worst", {"n": F.lit(1).cast("long"), "sum_wet": (F.col("o") > 0).cast("long")}, lambda c: c["sum_wet"] / c["n"])
    known = [*statistics(), worst]
    day = dt.date(2020, 1, 1)
    fc = spark.createDataFrame([("gfs", day, k, day + dt.timedelta(days=k), 0, 2.0) for k in range(1, 15)], SCHEMA)
    obs = spark.createDataFrame([(day + dt.timedelta(days=k), 0, float(k % 2)) for k in range(1, 15)], "valid_date date, cell_id int, value double")
    stored, _ = incremental.update(*incremental.update(None, None, fc.where("lead < 5"), obs, known), fc, obs, known)
    got = {(r.period, r.lead_key): r.value for r in pairing.layers(stored, registry.lead_windows(spark), names=["worst"], registered=known).collect()}
    assert got["yearly", "1"] == 1.0 and got["yearly", "2"] == 0.0 and got["yearly", "1_10"] == 0.5
    assert "worst" in pairing.finalize_wide(pairing.by_period(stored, registered=known), known).columns
    with pytest.raises(ValueError, match="different sums"):
        all_sums([worst, Statistic("other", {"sum_wet": F.col("m")}, lambda c: c["sum_wet"])])


def test_blend_is_clamped_to_the_leads_there_are(spark):
    rows = spark.createDataFrame([(0, lead, 10 * lead, 0, 0, 255) for lead in (1, 2, 14)], "px int, lead int, r int, g int, b int, a int")
    for at, r in ((14.3, 140.0), (0.2, 10.0), (1.5, 15.0)):
        out = publish.blended(rows, F.lit(at), ["px"]).first()
        assert (out.r, out.a) == (r, 255.0)


def test_curve_at_any_lead(spark):
    rows = [(1, "gfs", "nmad", lead, v) for lead, v in ((1, 2.0), (2, 4.0), (3, None), (4, 8.0))]
    curve = spark.createDataFrame(rows, "region_id int, model string, statistic string, lead int, value double")
    for at, value in ((0.1, 2.0), (1.25, 2.5), (2.5, 4.0), (3.5, 8.0), (9.0, 8.0), (2.0, 4.0)):
        assert panel.at_lead(curve, F.lit(at)).first().value == value


def test_inventory_files_with_odd_lines(spark, tmp_path):
    text = "1:0:d=1:TMP:surface:x:\n1.1:50:d=1: APCP :surface: 0-6 hour acc fcst :prob >1\nshort line\n2:100:d=1: APCP :surface : 0-6 hour acc fcst:\n3:oops\n4:300:d=1:APCP:surface:0-6 hour acc fcst:\n\n"
    (tmp_path / "a.idx").write_text(text)
    lines = scans.inventory_lines(spark, str(tmp_path))
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [1, 2, 3, 4, 5, 6]
    got = ingest.byte_ranges(lines, "APCP", "surface", F.lit("0-6 hour acc fcst")).first()
    assert (got.line_no, got.begin, got.end) == (4, 100, None)
    assert {r.line_no: r.end for r in ingest.inventory(lines).collect()} == {1: 49, 2: None, 4: None, 6: None}


def test_stored_tables_and_small_readers(spark, tmp_path):
    acc = spark.createDataFrame([("gfs", 1)], "model string, month int")
    acc.write.parquet(str(tmp_path / "acc"))
    assert scans.stored_accumulators(spark, str(tmp_path / "acc"), ["model"]).count() == 1 and scans.stored_accumulators(spark, str(tmp_path / "acc"), ["lead"]) is None
    files = spark.createDataFrame([("a.npy",), ("b.npy.part",)], "path string")
    assert [r.path for r in scans.complete_files(files).collect()] == ["a.npy"] and scans.count_partial(files).first().n_partial == 1
    raw = spark.createDataFrame([(bytearray(b"GRIBxx"), 6), (bytearray(b"x"), 2)], "content binary, size int")
    assert [tuple(r) for r in raw.select(scans.has_grib_magic(F.col("content")), scans.length_matches(F.col("content"), F.col("size"))).collect()] == [(True, True), (False, False)]
    zips = spark.createDataFrame([("12345", 1.0), ("12399", 2.0)], "zip string, lat double")
    sinks.write_zip_directory(zips, str(tmp_path / "z"))
    assert spark.read.json(str(tmp_path / "z")).where("prefix = 123").count() == 2
    sinks.write_grid_metadata(fx.axes(spark), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).where("model = 'nbm'").first().transform == [8.0, 0.0, -124.0, 0.0, 5.0, 22.5]
    sinks.write_json(sinks.grid_export(fx.axes(spark)), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_pixels(spark.createDataFrame([("gfs", "bias", "yearly", 1)], "model string, statistic string, period string, px int"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first().px == 1
    mixed = grid.crop(spark.createDataFrame([(25.0, -120.0), (60.0, -120.0)], "lat double, lon double"), -130, 20, -60, 55)
    assert mixed.count() == 1


def test_requests_are_checked(spark):
    rows = [(1, "gfs", "3", None, None, 7, "circle", "yearly"), (2, "gfs", "3", None, None, None, "point", None), (3, "gfs", None, 1, None, 7, "point", "yearly"), (4, None, "3", None, None, 7, "point", "yearly")]
    asked = spark.createDataFrame(rows, "request_id int, model string, lead string, min_lead int, max_lead int, region_id int, region_type string, period string").withColumn("statistics", F.array(F.lit("bias")))
    assert {r.request_id: r.error for r in query.validated(asked, ["gfs"], ["bias"]).collect()} == {1: "unknown region type", 2: "no region", 3: "a range needs both ends", 4: None}


def test_raw_sources(spark, tmp_path):
    run = tmp_path / "2020" / "20200101_12z"
    run.mkdir(parents=True)
    (tmp_path / "2020" / "20200101_00z").mkdir()
    np.save(run / "f024_surface.npy", np.array([[1.0, np.nan], [3.0, 4.0]], np.float32))
    np.save(tmp_path / "2020" / "20200101_00z" / "f024_surface.npy", np.zeros((2, 2), np.float32))
    (run / "f048_surface.npy.part").write_bytes(b"x")
    got = sorted((r.lead, r.cell_id, r.value) for r in scans.forecast_fields(spark, str(tmp_path), "gfs", 2, 2).collect())
    assert got == [(1, 0, 1.0), (1, 1, None), (1, 2, 3.0), (1, 3, 4.0)]
    with pytest.raises(Exception, match="the grid is"):
        scans.forecast_fields(spark, str(tmp_path), "gfs", 3, 2).collect()
    np.array([1, 2], "<f4").tofile(tmp_path / "a.bin")
    assert [r.value for r in scans.flat_layers(spark, str(tmp_path), 2).orderBy("cell_id").collect()] == [1.0, 2.0]
    (tmp_path / "z.csv").write_text("zip,lat,lon,min_lon,min_lat,max_lon,max_lat\n 123456 ,1.23456789,2,3,4,5,6\n99,1,1,1,1,1,1\n")
    assert [(r.zip, r.lat) for r in scans.zip_csv(spark, str(tmp_path / "z.csv")).collect()] == [("12345", 1.234568)]
    arrays = spark.createDataFrame([(1, [1.0, 2.0])], "k int, values array<double>")
    assert scans.array_fields(arrays, 1, 2).count() == 2
    with pytest.raises(Exception, match="another size"):
        scans.array_fields(arrays, 2, 2).collect()


def test_sinks(spark, tmp_path):
    stats = fx.stats(spark, "/root/testdata/sf0.001", ("yearly",), ["bias"]).limit(50)
    sinks.write_stats(stats, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("period = 'yearly'").count() == 50
    assert sinks.grid_export(fx.axes(spark)).where("model = 'gfs'").first().n_lon == 6
    sinks.write_panel_csv(spark.createDataFrame([(1, 'a "b", c', None)], "lead int, s string, v double"), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_bytes()
    assert text.startswith(b"lead,s,v\r\n")


def test_scalars(spark):
    row = spark.range(1).select(
        fn.resolve_model(F.lit(" "), F.lit(" NBM ")).alias("m"), fn.season_of(F.lit(12)).alias("s"), fn.lead_label(F.lit("1_7")).alias("l"),
        fn.t_label(F.lit("2020-01-02").cast("date"), F.lit("2020-01-02").cast("date")).alias("t"), fn.blend_weight(F.lit(0.501)).alias("w"), fn.interpolate(F.lit(None).cast("double"), F.lit(2.0), F.lit(0.5)).alias("i"),
        fn.rgba(F.lit("diverging"), F.lit(0.5)).alias("c"), fn.rgba(F.lit("x"), F.lit(None).cast("double")).alias("n"),
    ).first()
    assert (row.m, row.s, row.l, row.t, row.w, row.i) == ("nbm", "djf", "1–7 Day Average", "T+0d", 0.5, 2.0)
    assert tuple(row.c) == (255, 255, 255, 255) and row.n.a == 0
