"""Scan lines, summed-area tables, the field data source, guarded publishing and stream merging, each against a plain version."""

import datetime as dt
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.functions.statistics import Statistic
from skillgrid.operators import areas, grid, incremental, pairing, publish, query, sketches
from skillgrid.operators.regions import axis_step, polygon_cells, region_cells
from skillgrid.plans import registry
from skillgrid.sources import scans, sinks
from skillgrid.sources.fields import FieldReader
from skillgrid.sources.scratch import Scratch
from skillgrid.streaming import pairing as streaming

REGIONS = "region_id int, type string, coordinates array<array<double>>, bounds array<double>"


def axes(spark, lats, lons):
    rows = [("gfs", a, i, float(v)) for a, values in (("lat", lats), ("lon", lons)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "model string, axis string, idx int, center double")


def inside(ring, x, y):
    """Parity by every edge, for one point."""
    odd = False
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if (yi > y) != (yj > y) and x < xi + (xj - xi) * (y - yi) / (yj - yi):
            odd = not odd
    return odd


def edges(axis):
    mid = [(a + b) / 2 for a, b in zip(axis, axis[1:], strict=False)]
    low = [axis[0] - (axis[1] - axis[0]) / 2, *mid]
    return low, [*mid, axis[-1] + (axis[-1] - axis[-2]) / 2]


@pytest.mark.parametrize("lons", [[-120.0 + 2.5 * k for k in range(17)], [-120.0, -119.0, -115.5, -114.0, -109.0, -108.5, -100.0, -90.0, -81.0]])
def test_scan_lines_equal_points(spark, lons):
    """Even and uneven axes; rings that cross themselves, pass through centres, or hold no centre."""
    lats, rng = [25.0 + 1.5 * k for k in range(11)], random.Random(4)
    rings = [[[rng.uniform(-125, -78), rng.uniform(22, 43)] for _ in range(rng.randint(3, 12))] for _ in range(60)]
    rings += [[[lons[1], 25.0], [lons[5], 25.0], [lons[5], 34.0], [lons[1], 34.0]], [[lons[0], 26.5], [lons[3], 31.0], [lons[6], 26.5]], [[-119.9, 25.2], [-119.8, 25.2], [-119.8, 25.4]], [[200.0, 1.0], [201.0, 1.0], [201.0, 2.0]]]
    both = spark.createDataFrame([(k, "polygon", r, None) for k, r in enumerate(rings)], REGIONS).crossJoin(grid.axis_arrays(axes(spark, lats, lons)).withColumn("lon_step", axis_step(F.col("lons"))))
    assert (both.first().lon_step is None) == (len(lons) == 9)
    (south, north), (west, east) = edges(lats), edges(lons)
    for row in both.select("region_id", polygon_cells().alias("centers"), polygon_cells(corners=True).alias("corners")).collect():
        ring = rings[row.region_id]
        spots = lambda r, c: [(lons[c], lats[r])], lambda r, c: [(lons[c], lats[r]), *((x, y) for x in (west[c], east[c]) for y in (south[r], north[r]))]
        for got, of in zip((row.centers, row.corners), spots, strict=True):
            assert got == [r * len(lons) + c for r in range(len(lats)) for c in range(len(lons)) if any(inside(ring, x, y) for x, y in of(r, c))]


def test_a_ring_of_many_vertices(spark):
    """10,000 vertices on the whole quarter-degree grid: rows times edges, where cells times edges would take hours."""
    turn = [2 * math.pi * k / 10_000 for k in range(10_000)]
    ring = [[-95 + 30 * math.cos(t) + 0.3 * math.cos(90 * t), 38 + 14 * math.sin(t) + 0.3 * math.sin(70 * t)] for t in turn]
    lats, lons = np.arange(20, 55.25, 0.25), np.arange(-130, -59.75, 0.25)
    regions = spark.createDataFrame([(1, "polygon", ring, None)], REGIONS)
    began = time.time()
    found = region_cells(regions, grid.axis_arrays(axes(spark, lats, lons))).first()
    assert time.time() - began < 60
    rng = random.Random(1)
    cells = set(found.cells)
    for _ in range(300):
        r, c = rng.randrange(len(lats)), rng.randrange(len(lons))
        assert (r * len(lons) + c in cells) == inside(ring, lons[c], lats[r])
    assert found.how == "centers" and len(cells) > 15_000


def test_rectangles_from_summed_areas(spark):
    """Missing cells, missing layers, large and small values side by side; no cell list is joined for rectangles."""
    rng = np.random.default_rng(2)
    lats, lons = [float(v) for v in range(12)], [float(v) for v in range(15)]
    layers = [("gfs", "bias", "yearly", "", str(k), c, float(v)) for k in range(3) for c, v in enumerate(rng.normal(0, 1, 180) * rng.choice([1e-3, 1.0, 1e12], 180)) if k == 0 or (c * 7 + k) % 5]
    stats = spark.createDataFrame(layers, "model string, statistic string, period string, period_key string, lead_key string, cell_id int, value double")
    bounds = [(k, "rectangle", None, [float(w), float(s), float(w + rng.uniform(0, 9)), float(s + rng.uniform(0, 8))]) for k, (w, s) in enumerate(zip(rng.uniform(-1, 13, 40), rng.uniform(-1, 10, 40), strict=True))]
    regions = spark.createDataFrame([*bounds, (100, "point", [[3.0, 4.0]], None), (101, "polygon", [[1.0, 1.0], [9.0, 1.5], [5.0, 9.0]], None)], REGIONS)
    ax = axes(spark, lats, lons)
    cells = region_cells(regions, grid.axis_arrays(ax))
    plain = {(r.region_id, r.lead_key): (r.value, r.n_cells) for r in query.region_means(stats, cells).collect()}
    fast = {(r.region_id, r.lead_key): (r.value, r.n_cells) for r in query.region_means(stats, cells, grid.cells(ax)).collect()}
    assert fast.keys() == plain.keys() and len(plain) > 100
    for k, (value, n) in plain.items():
        assert fast[k][1] == n and fast[k][0] == pytest.approx(value, rel=1e-9, abs=1e-9)
    found = areas.rectangle_means(stats, cells.where("how = 'overlap'"), grid.cells(ax), ["model", "statistic", "period", "period_key", "lead_key"], {"value": F.col("value")})
    assert "explode(cells" not in found._jdf.queryExecution().toString()


def test_summary_with_and_without_grid(spark):
    ax = axes(spark, [0.0, 1.0, 2.0], [0.0, 1.0, 2.0, 3.0])
    wide = spark.createDataFrame([("gfs", lead, c, None if c == 5 else float(c - 4 * lead), None if lead == 2 else 2.0 * c) for lead in (1, 2) for c in range(12)], "model string, lead int, cell_id int, bias double, sacc double")
    cells = region_cells(spark.createDataFrame([(1, "rectangle", None, [0.6, 0.6, 1.4, 1.4]), (2, "rectangle", None, [-5.0, -5.0, 9.0, 9.0]), (3, "point", [[1.0, 1.0]], None)], REGIONS), grid.axis_arrays(ax))
    rows = [sorted(map(tuple, query.region_summary(wide, cells, ["bias", "sacc"], g).collect()), key=repr) for g in (None, grid.cells(ax))]
    assert rows[0] == rows[1] and len(rows[0]) == 6


def test_fields_open_what_is_asked(spark, tmp_path):
    """Files of other cycles, days and hours hold no array, so opening one would fail."""
    day = dt.date(2020, 1, 30)
    rows = [(day + dt.timedelta(days=k), 24 * lead, [float(k), None, 3.0, float("nan"), 5.0, float(lead)]) for k in range(4) for lead in (1, 2)]
    scans.write_fields(spark.createDataFrame(rows, "init_date date, fhour int, values array<double>"), str(tmp_path), 2, 3)
    for at in ("2020/20200130_00z/f024_surface.npy", "2019/20191231_12z/f024_surface.npy", "2020/20200130_12z/f072_surface.npy", "2020/20200130_12z/notes.txt", "2020/20200130_12z/f024_surface.npy.part", "spare/20200130_12z/f024_surface.npy"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_bytes(b"no array")
    fields = scans.forecast_fields(spark, str(tmp_path), "gfs", 2, 3)
    asked = fields.where((F.col("init_date") >= day) & F.col("lead").isin(1, 2) & (F.col("cell_id") != 1))
    got = {(r.init_date, r.fhour, r.lead, r.cell_id): r.value for r in asked.collect()}
    assert got == {(i, h, h // 24, c): None if v is None or v != v else v for i, h, values in rows for c, v in enumerate(values) if c != 1}
    assert asked.where(F.col("init_date") == day + dt.timedelta(days=2)).select("init_date").distinct().count() == 1
    with pytest.raises(Exception, match="pickle|magic|Failed|read"):
        fields.where("fhour = 72").collect()
    assert fields.where("lead = 9").count() == 0
    with pytest.raises(Exception, match="cells, the grid is"):
        scans.write_fields(spark.createDataFrame(rows, "init_date date, fhour int, values array<double>"), str(tmp_path), 2, 4)


def test_fields_list_only_wanted_years(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    for year in (2018, 2019, 2020):
        (tmp_path / f"{year}" / f"{year}0601_12z").mkdir(parents=True)
        for hour in (24, 48):
            (tmp_path / f"{year}" / f"{year}0601_12z" / f"f{hour:03d}_surface.npy").write_bytes(b"")

    def found(*filters):
        reader = FieldReader({"path": str(tmp_path), "model": "gfs", "n_lat": "1", "n_lon": "1", "files_per_task": "1"})
        left = list(reader.pushFilters(list(filters)))
        return left, sorted((f[1].year, f[2]) for p in reader.partitions() for f in p.found)

    assert found(GreaterThan(("init_date",), dt.date(2018, 12, 31)), LessThan(("init_date",), dt.date(2020, 1, 1))) == ([], [(2019, 24), (2019, 48)])
    other = EqualTo(("cell_id",), 3)
    assert found(EqualTo(("lead",), 2), other) == ([other], [(2018, 48), (2019, 48), (2020, 48)])


def test_fields_take_their_place(spark):
    """A field that came north to south and in 0..360 is wrapped, sorted and cropped as a whole."""
    lats, lons = [40.0, 35.0, 30.0], [140.0, 180.0, 220.0, 300.0]
    raw = axes(spark, lats, lons)
    turned = grid.orientation(raw, (-180.0, 30.0, -60.0, 36.0))
    row = turned.first()
    assert (row.lats, row.lons) == ([30.0, 35.0], [-180.0, -140.0, -60.0])
    field = spark.createDataFrame([("gfs", 1, [float(v) for v in range(12)])], "model string, lead int, values array<double>")
    assert grid.oriented(field, turned).first().values == [9.0, 10.0, 11.0, 5.0, 6.0, 7.0]
    whole = grid.orientation(raw).first()
    assert whole.lats == [30.0, 35.0, 40.0] and whole.lons == [-180.0, -140.0, -60.0, 140.0]


def test_forecast_tree_and_calendar(spark, tmp_path):
    for model, key, values in (("gfs", "1", [1.0, 2.0]), ("gfs", "1_7", [3.0, np.inf])):
        (tmp_path / model).mkdir(exist_ok=True)
        np.array(values, "<f4").tofile(tmp_path / model / f"lead_{key}.bin")
    np.array([1, 2], "<f4").tofile(tmp_path / "gfs" / "other.bin")
    got = sorted(tuple(r) for r in scans.layer_tree(spark, str(tmp_path), 2).collect())
    assert got == [("gfs", "1", 0, 1.0), ("gfs", "1", 1, 2.0), ("gfs", "1_7", 0, 3.0), ("gfs", "1_7", 1, None)]
    documents = spark.createDataFrame([('{"gfs": {"initDate": "2020-02-01", "leadMin": 1, "leadMax": 14}, "nbm": null}',), ('{"gfs": {"init',), (None,), ('{"nbm": {"initDate": "soon", "leadMin": 1}}',)], "value string")
    assert sorted(map(tuple, scans.read_calendar(documents).collect()), key=repr) == [("gfs", dt.date(2020, 2, 1), 1, 14), ("nbm", None, 1, None)]


def test_one_model_is_published_alone(spark, tmp_path):
    schema = "model string, statistic string, period string, period_key string, lead_key string, cell_id int, value double, sample_count long"
    rows = [(m, "bias", "yearly", "", "1", c, 1.0 * c, 5) for m in ("gfs", "nbm") for c in range(4)]
    path = tmp_path / "stats"
    sinks.write_stats(spark.createDataFrame(rows, schema), str(path))
    before = {f: f.read_bytes() for f in path.glob("model=nbm/**/*.parquet")}
    sinks.write_stats(spark.createDataFrame([("gfs", "bias", "yearly", "", "1", 0, 9.0, 6)], schema), str(path))
    assert before and before == {f: f.read_bytes() for f in path.glob("model=nbm/**/*.parquet")}
    assert [tuple(r) for r in spark.read.parquet(str(path)).where("model = 'gfs'").select("cell_id", "value").collect()] == [(0, 9.0)]


def test_refresh_starts_anew_when_leads_change(spark, tmp_path):
    day = dt.date(2020, 1, 1)
    fc = spark.createDataFrame([("gfs", day, k, day + dt.timedelta(days=k), 0, 2.0) for k in (1, 2)], "model string, init_date date, lead int, valid_date date, cell_id int, value double")
    obs = spark.createDataFrame([(day + dt.timedelta(days=k), 0, 1.0) for k in (1, 2)], "valid_date date, cell_id int, value double")
    models = lambda top: spark.createDataFrame([("gfs", 1, top)], "model string, lead_min int, lead_max int")
    first = incremental.refresh(fc, obs, str(tmp_path), models(2), "a")
    same = incremental.refresh(fc, obs, str(tmp_path), models(2), "a")
    assert (first.number, same.number) == (1, 2) and same.acc.agg(F.sum("n")).first()[0] == 2
    wider = incremental.refresh(fc, obs, str(tmp_path), models(3), "a")  # stored sums lack lead 3, so nothing is added to them
    assert wider.number == 3 and wider.acc.agg(F.sum("n")).first()[0] == 2


def test_batches_are_merged_once(spark, tmp_path):
    path, schema = str(tmp_path / "acc"), "model string, init_date date, lead int, valid_date date, cell_id int, m double, o double"
    batch = lambda k: spark.createDataFrame([("gfs", dt.date(2020, 1, 1), 1, dt.date(2020, 1, 2), c, 1.0 + k, 1.0) for c in (0, 1)], schema)
    for epoch in (0, 1, 1, 0, 2, 3):  # some are run again
        streaming.merge_batch(batch(epoch), path, epoch)
    rows = {r.cell_id: (r.n, r.sum_error) for r in streaming.accumulated(spark, path).collect()}
    assert rows == {0: (4, 6.0), 1: (4, 6.0)}
    assert len(list((tmp_path / "acc").glob("sums-*"))) == 2  # one that readers have, and the one before
    with pytest.raises(FileExistsError):
        sinks.claim(spark, f"{path}/current", 4, "late")


def test_buckets_and_windows_need_each_once(spark):
    hours = {1: [6, 12, 18, 24], 2: [6, 6, 12, 18], 3: [6, 12, 18], 4: [18, 24, 30, 36], 5: [6, 6, 12, 18, 24]}
    b = spark.createDataFrame([(c, h, 1.0) for c, own in hours.items() for h in own], "cell_id int, fhour int, value double")
    assert {r.cell_id: r.value for r in pairing.daily_from_buckets(b, ["cell_id"]).collect()} == {1: 4.0, 2: None, 3: None, 4: 4.0, 5: None}
    day = dt.date(2020, 1, 1)
    fc = spark.createDataFrame([("gfs", day, lead, c, 1.0) for c, own in {0: [1, 2, 3], 1: [1, 1, 3], 2: [1, 3]}.items() for lead in own], "model string, init_date date, lead int, cell_id int, value double")
    windows = spark.createDataFrame([("gfs", 1, 3, "1_3")], "model string, start int, end int, lead_key string")
    assert {r.cell_id: r.value for r in pairing.window_means(fc, windows).collect()} == {0: 1.0, 1: None, 2: None}


def test_regrid_keeps_every_key(spark):
    target = spark.createDataFrame([(0, 0.5, 0.5), (1, 0.5, 1.5), (2, 0.5, 9.5)], "cell_id int, lat double, lon double")
    source = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("b", 0, 0, 3.0)], "day string, src_row int, src_col int, value double")
    got = {(r.day, r.cell_id): r.value for r in grid.regrid(target, source, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)).collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 2.0, ("a", 2): None, ("b", 0): 3.0, ("b", 1): None, ("b", 2): None}


def test_a_statistic_without_the_count(spark):
    """A user's statistic that names only its own sum."""
    worst = Statistic("squares", {"sum_squares": F.col("m") * F.col("m")}, lambda c: c["sum_squares"])
    paired = spark.createDataFrame([("gfs", dt.date(2020, 1, 2), 1, 0, 3.0, 1.0), ("gfs", dt.date(2020, 1, 3), 1, 0, 4.0, 1.0)], "model string, valid_date date, lead int, cell_id int, m double, o double")
    out = pairing.finalize(pairing.by_period(pairing.accumulate(paired, [worst]), ("yearly",), [worst]), [worst]).first()
    assert (out.value, out.sample_count) == (25.0, 2)


def test_scratch_drops_only_its_own(spark):
    scratch = Scratch(spark)
    kept = [scratch.keep(spark.range(k + 1)) for k in range(3)]
    for _ in range(200):  # frames that come and go may get ids that were used before
        scratch.drop(spark.range(1))
    assert [df.count() for df in kept] == [1, 2, 3]
    scratch.drop(kept[0])
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{scratch.base}/0").count()


def test_stored_tables_pair_without_a_shuffle(spark, tmp_path):
    rng = random.Random(5)
    start = dt.date(2024, 1, 1)
    fc = [("gfs", start, lead, start + dt.timedelta(days=lead), cell, float(rng.randint(0, 9))) for lead in range(1, 8) for cell in range(50)]
    obs = [(start + dt.timedelta(days=k), cell, float(rng.randint(0, 9))) for k in range(1, 8) for cell in range(50)]
    forecast = spark.createDataFrame(fc, "model string, init_date date, lead int, valid_date date, cell_id int, value double")
    observed = spark.createDataFrame(obs, "valid_date date, cell_id int, value double")
    keys = ["valid_date", "cell_id"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = [sinks.write_bucketed(df, str(tmp_path / n), keys, 4) for n, df in (("f", forecast), ("o", observed))]
        paired = pairing.pairs(*stored)
        plan = paired._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "Exchange" in pairing.pairs(forecast, observed)._jdf.queryExecution().executedPlan().toString()
        assert sorted(pairing.accumulate(paired).collect()) == sorted(pairing.accumulate(pairing.pairs(forecast, observed)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_extract_of_days_and_windows_counts_what_is_there(spark):
    """A lead that is missing, null or there twice leaves its window without a value; days stand by themselves."""
    day = dt.date(2024, 1, 1)
    rows = [("gfs", day, lead, cell, float(lead * 10 + cell)) for cell in range(4) for lead in range(1, 6) if (cell, lead) != (1, 2)]
    rows += [("gfs", day, 3, 2, 7.0), ("gfs", day, 1, 9, None)]
    rows = [(*r[:4], None) if r[2:4] == (4, 3) else r for r in rows]
    df = spark.createDataFrame(rows, "model string, init_date date, lead int, cell_id int, value double")
    spans = spark.createDataFrame([("gfs", str(k), k, k) for k in range(1, 6)] + [("gfs", "1_3", 1, 3), ("gfs", "2_5", 2, 5)], "model string, lead_key string, start int, end int")
    by = {}
    for _, _, lead, cell, value in rows:
        by.setdefault((cell, lead), []).append(value)
    wanted = {}
    for cell in {r[3] for r in rows}:
        for key, lo, hi in [(str(k), k, k) for k in range(1, 6)] + [("1_3", 1, 3), ("2_5", 2, 5)]:
            good = [by[cell, k][0] for k in range(lo, hi + 1) if len(by.get((cell, k), [])) == 1 and by[cell, k][0] is not None]
            if good:
                wanted[cell, key] = (len(good), sum(good) / len(good) if len(good) == hi - lo + 1 else None)
    got = {(r.cell_id, r.lead_key): (r.found, r.value) for r in pairing.lead_extract(df, spans, 5).collect()}
    assert got == wanted and any(v[1] is None for v in wanted.values())
    assert pairing.lead_extract(df.where("false"), spans, 5).count() == 0


LAYERS = "model string, statistic string, period string, period_key string, lead_key string, cell_id int, value double"
SPEC = [("bias", "diverging"), ("nmad", "sequential")]


def layer(lead, values, statistic="bias", key=""):
    return [("gfs", statistic, "yearly", key, lead, k, v) for k, v in enumerate(values)]


def test_sketches_follow_layers(spark, tmp_path):
    """A new layer moves the range without the old layers' values; one computed anew replaces its sketch alone."""
    path, spec = str(tmp_path / "sketches"), spark.createDataFrame(SPEC, "statistic string, colormap string")
    put = lambda rows: sketches.store_sketches(sketches.layer_sketches(spark.createDataFrame(rows, LAYERS)), path)
    ranges = lambda **k: {(r.statistic, r.period_key): (r.low, r.high) for r in sketches.sketched_ranges(sketches.stored_sketches(spark, path), spec, **k).collect()}
    put(layer("1", range_of(0, 100)) + layer("1", [None, None], key="03") + layer("1", [0.25, 0.5], "nmad") + layer("2", [-1.0, None], "nmad", "03"))
    assert ranges() == {("bias", ""): (1.0, 97.0), ("bias", "03"): (-1.0, 1.0), ("nmad", ""): (0.0, 1.0), ("nmad", "03"): (0.0, 1.0)}
    assert ranges(mode="tile")["nmad", ""] == (0.0, 0.5) and ranges(fixed={"bias": (-9.0, 9.0)})["bias", ""] == (-9.0, 9.0)
    files = {p: p.read_bytes() for p in tmp_path.glob("sketches/**/statistic=nmad/**/*.parquet")}
    put(layer("2", range_of(1000, 1100)))
    assert ranges()["bias", ""] == (3.0, 1095.0) and len(files) == 1 and all(p.read_bytes() == b for p, b in files.items())
    put(layer("2", [5.0, 5.0]))
    assert ranges()["bias", ""] == (2.0, 97.0)
    assert sketches.sketched_ranges(sketches.layer_sketches(spark.createDataFrame([], LAYERS)), spec).count() == 0


def range_of(low, high):
    return [float(v) for v in range(low, high)]


def test_sketch_rank_error(spark):
    """17 leads of 60,000 cells, dealt unevenly: merged percentiles are within the stated share of the exact ones' ranks."""
    rows = spark.range(17 * 60_000, numPartitions=16).select(F.lit("gfs").alias("model"), F.lit("bias").alias("statistic"), F.lit("yearly").alias("period"), F.lit("").alias("period_key"), (F.col("id") % 17).cast("string").alias("lead_key"), F.pow(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40), F.col("id") % 17 + 1).alias("value"))
    found = sketches.sketch_percentiles(sketches.layer_sketches(rows), ("model", "statistic"), (0.02, 0.5, 0.98)).first()
    exact = publish.percentiles(rows, ("model", "statistic"), (0.02, 0.98)).first()
    ranks = rows.agg(*(F.avg((F.col("value") <= v).cast("double")) for v in found.p)).first()
    assert found.n == 17 * 60_000 and all(abs(r - s) <= 2.3 / sketches.K**0.9 for r, s in zip(ranks, (0.02, 0.5, 0.98), strict=True))
    assert found.p[2] == pytest.approx(exact.p[1], abs=0.01)


def test_geometry_keys_of_all_kinds(spark):
    from skillgrid.functions.scalars import geometry_key

    rows = spark.createDataFrame([("point", [[-120.0, 25.000004]], None), ("rectangle", None, [-1.0, 2.0, 3.5, 4.25]), ("polygon", [[1.0, 2.0], [3.0, 4.0]], None)], "type string, coordinates array<array<double>>, bounds array<double>")
    numbers = F.when(F.col("type") == "rectangle", F.col("bounds")).otherwise(F.flatten("coordinates"))
    assert [r[0] for r in rows.select(geometry_key(F.col("type"), numbers)).collect()] == ["point:-120.00000,25.00000", "rectangle:-1.00000,2.00000,3.50000,4.25000", "polygon:1.00000,2.00000,3.00000,4.00000"]


def test_scratch_scope(spark):
    """Tables of a scope are deleted when it ends, also where it ends by an error; others stay."""
    from skillgrid.sources.sinks import exists

    outer = Scratch(spark)
    kept = outer.keep(spark.range(3))
    with pytest.raises(ValueError), Scratch(spark) as scratch:
        inner = scratch.keep(spark.range(2))
        assert inner.count() == 2 and exists(spark, f"{scratch.base}/0")
        raise ValueError
    assert not exists(spark, f"{scratch.base}/0") and kept.count() == 3


def test_winners_are_found_once_for_regions_of_one_shape(spark, tmp_path, monkeypatch):
    """Copies of customers 7,700 keys apart have the same cells: their requests are answered from the same losses."""
    given, copies = "/root/testdata/sf0.001", 9
    again = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    for name, key in (("customer", "c_custkey"), ("orders", "o_custkey")):
        spark.read.parquet(f"{given}/{name}.parquet").withColumn("copy", again).withColumn(key, F.col(key) + F.col("copy") * 7700).drop("copy").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.read.parquet(f"{given}/lineitem.parquet").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows, plain = [], query.lead_winners

    def counted(losses, places=None):
        rows.append(losses.count())
        return plain(losses, places)

    monkeypatch.setattr(query, "lead_winners", counted)
    monkeypatch.setattr(registry.fx, "wide", lambda s, d, periods=("yearly",), base=None, wide=registry.fx.wide: wide(s, given, periods, base))
    one, many = (registry.winner_requests(spark, d).select("region_id", "request_id", "lead", "model", "loss", "n_models").collect() for d in (given, str(tmp_path)))
    assert rows[0] == rows[1] > 0
    assert sorted((r.region_id % 7700, *r[1:]) for r in many) == sorted(tuple(r) for r in one for _ in range(copies))


def test_requests_for_winners_on_odd_regions(spark):
    """Regions with the same cells on one grid only, none, or listed twice; leads without a layer; both ends of a range."""
    cells = spark.createDataFrame([(k, m, "overlap" if k < 3 else "centers", c) for k, m, c in ((1, "gfs", [0, 1]), (1, "nbm", [0]), (2, "gfs", [0, 1]), (2, "nbm", [1]), (3, "gfs", [0, 1]), (3, "gfs", [0, 1]), (3, "nbm", []), (4, "nbm", [0]))], "region_id int, model string, how string, cells array<int>")
    layer = [(m, "yearly", "", lead, c, v) for m, lead, c, v in (("gfs", 1, 0, 2.0), ("gfs", 1, 1, 4.0), ("nbm", 1, 0, 3.0), ("nbm", 1, 1, 2.5), ("gfs", 3, 0, 1.0), ("nbm", 2, 1, None))]
    wide = spark.createDataFrame(layer, "model string, period string, period_key string, lead int, cell_id int, nmad double")
    asked = spark.createDataFrame([(10 * k + e, k, "nmad", None, None, None, 1, e) for k in (1, 2, 3, 4, 5) for e in (1, 3)] + [(99, 1, "bias", None, None, None, 1, 1), (98, 1, "nmad", "yearly", None, None, 2, 1)], "request_id int, region_id int, statistic string, period string, month string, season string, min_lead int, max_lead int")
    square = spark.createDataFrame([(m, c, 0, c) for m in ("gfs", "nbm") for c in (0, 1)], "model string, cell_id int, row int, col int")
    for grid_or_none in (square, None):
        got = query.run_winner_requests(asked, wide, query.region_shapes(cells), ["nmad"], month=4, grid=grid_or_none, places=6)
        assert sorted((r.request_id, r.lead, r.model, r.loss, r.n_models) for r in got.collect()) == [(11, 1, "gfs", 3.0, 2), (13, 1, "gfs", 3.0, 2), (13, 3, "gfs", 1.0, 1), (21, 1, "nbm", 2.5, 2), (23, 1, "nbm", 2.5, 2), (23, 3, "gfs", 1.0, 1), (31, 1, "gfs", 3.0, 1), (33, 1, "gfs", 3.0, 1), (33, 3, "gfs", 1.0, 1), (41, 1, "nbm", 3.0, 1), (43, 1, "nbm", 3.0, 1)]
    assert {r.request_id: r.error for r in query.winner_rejects(asked, ["nmad"], month=4).collect()} == {98: "range of leads ends before it begins", 99: "unknown statistic"}


VALUES = "is_forecast boolean, model string, lead int, day timestamp, cell_id int, value double"
ODD = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0]


def values(rng, days, n, odd):
    draw = lambda: rng.choice(ODD) if odd and rng.random() < 0.2 else round(rng.uniform(-5, 5), 1)
    rows = [(True, rng.choice(["gfs", "nbm"]), rng.choice([1, 2]), rng.choice(days), rng.randint(0, 3), draw()) for _ in range(n)]
    rows += [(False, None, None, rng.choice(days), rng.randint(0, 3), draw()) for _ in range(n)]
    return rows + [(True, "gfs", 1, None, 0, 1.0), (False, None, None, None, 0, 1.0), (False, None, None, days[0], None, 1.0), (True, "gfs", 3, dt.datetime(2019, 12, 31), 0, 1.0)]


def by_pairs(spark, rows):
    """The sums from the pairs themselves."""
    both = spark.createDataFrame(rows, VALUES)
    left = both.where("is_forecast").select("model", "lead", F.to_date("day").alias("valid_date"), "cell_id", F.col("value").alias("m"))
    right = both.where("not is_forecast").select(F.to_date("day").alias("valid_date"), "cell_id", F.col("value").alias("o"))
    return pairing.accumulate(left.join(right, ["valid_date", "cell_id"]))


def equal_sums(got, wanted):
    got, wanted = ({tuple(r[k] for k in pairing.KEYS): r for r in df.collect()} for df in (got, wanted))
    assert set(got) == set(wanted) and wanted
    for k, w in wanted.items():
        for c, v in w.asDict().items():
            assert got[k][c] == v if v is None or not isinstance(v, float) else got[k][c] == pytest.approx(v, rel=1e-9, abs=1e-9, nan_ok=True), (k, c)


@pytest.mark.parametrize("odd", [False, True])
def test_paired_sums_equal_pairs(spark, tmp_path, odd):
    """In one batch, in batches of which some run again, with equal, null and non-finite values and keys without a day or cell."""
    rng, days = random.Random(8), [dt.datetime(2020, 1, 30) + dt.timedelta(days=k) for k in range(4)]
    batches = [values(rng, days[:3], 60, odd), values(rng, days[1:], 40, odd), [], values(rng, days, 50, odd)]
    path = str(tmp_path / "acc")
    for epoch in (0, 1, 1, 2, 0, 3):
        streaming.merge_values(spark, spark.createDataFrame(batches[epoch], VALUES), path, epoch)
    equal_sums(streaming.accumulated(spark, path), by_pairs(spark, [r for b in batches for r in b]))
    left = {p.name.partition("-")[0] for p in (tmp_path / "acc").iterdir()}
    assert left == {"current", "sums", "open"} and len(list((tmp_path / "acc").glob("open-*"))) == 2


def test_values_beyond_the_delay_leave(spark, tmp_path):
    path, day = str(tmp_path / "acc"), lambda k: dt.datetime(2020, 3, 1) + dt.timedelta(days=k)
    put = lambda epoch, *rows: streaming.merge_values(spark, spark.createDataFrame([(f, "gfs" if f else None, 1 if f else None, day(k), 0, 2.0) for f, k in rows], VALUES), path, epoch, "5 days")
    n = lambda: streaming.accumulated(spark, path).agg(F.sum("n")).first()[0]
    put(0, (True, 0), (True, 30))
    put(1, (False, 0), (False, 10))  # forecasts were alone, so that nothing was too old
    assert n() == 1
    put(2, (False, 0), (False, 6), (True, 6))  # observations have come to day 10: day 0 is too old, day 6 is not
    assert n() == 2
    kept = spark.read.parquet(*(str(p) for p in sorted((tmp_path / "acc").glob("open-*"))[-1:]))
    assert {r.day for r in kept.collect()} == {day(6), day(10), day(30)}


def test_distances_between_close_values_keep_their_digits(spark):
    """Values that differ by a ten-millionth of their size, where a difference of sums of squares would leave nothing."""
    day, schema = dt.datetime(2020, 1, 1), "day timestamp, cell_id int, value double, n long"
    fc = spark.createDataFrame([(day, 0, 3e8 + k, 1) for k in (1.0, 2.0)], schema).selectExpr("'gfs' AS model", "1 AS lead", "*")
    got = pairing.counted_sums(fc, spark.createDataFrame([(day, 0, 3e8, 2), (day, 0, 3e8 + 1.5, 1)], schema)).first()
    assert (got.n, got.sum_error, got.sum_abs_error, got.sum_squared_error) == (6, 6.0, 7.0, 10.5)
    huge = spark.createDataFrame([(day, 0, 1e200, 1)], schema).selectExpr("'gfs' AS model", "1 AS lead", "*")
    got = pairing.counted_sums(huge, spark.createDataFrame([(day, 0, v, 1) for v in (-1.0, 1e200)], schema)).first()
    assert (got.n, got.sum_error, got.sum_abs_error, got.sum_squared_error) == (2, 1e200, 1e200, math.inf)


def test_a_day_and_cell_of_many_values_is_streamed(spark, tmp_path):
    """400,000 events of one day and user are 38 billion pairs, as a stream; made one by one they would take hours."""
    kind = F.when(F.col("id") % 5 < 2, "view").otherwise("error")
    events = spark.range(400_000).select(F.col("id").alias("event_id"), F.lit("2024-01-05 12:00:00").cast("timestamp").alias("ts"), F.lit(7).cast("long").alias("user_id"), kind.alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("").alias("props"))
    events.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "sf").mkdir()
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "sf" / "events.parquet")
    began = time.perf_counter()
    (row,) = registry.streaming_pairing(spark, str(tmp_path / "sf")).collect()
    forecasts, observations = ([k for k in range(400_000) if (k % 5 < 2) == is_forecast] for is_forecast in (True, False))
    assert row.n == len(forecasts) * len(observations)
    assert row.sum_error == pytest.approx(sum(forecasts) * len(observations) - sum(observations) * len(forecasts), rel=1e-12)
    assert time.perf_counter() - began < 300
