"""Grids and regridding: axes, cells, edges, and index arithmetic instead of spatial joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0


def cells(axes: DataFrame) -> DataFrame:
    """``model, cell_id, row, col, lat, lon`` from ``model, axis, idx, center``; cells count along rows."""
    lat = axes.where("axis = 'lat'").select("model", F.col("idx").alias("row"), F.col("center").alias("lat"))
    lon = axes.where("axis = 'lon'").select("model", F.col("idx").alias("col"), F.col("center").alias("lon"))
    width = lon.groupBy("model").agg(F.count("*").alias("width"))
    return lat.join(lon, "model").join(width, "model").select("model", (F.col("row") * F.col("width") + F.col("col")).cast("int").alias("cell_id"), "row", "col", "lat", "lon")


def edges(axes: DataFrame) -> DataFrame:
    """Adds ``low`` and ``high``: halfway to the neighbours, as far beyond at the ends, and 0.5 for a single cell."""
    w = Window.partitionBy("model", "axis").orderBy("idx")
    before, after, c = F.lag("center").over(w), F.lead("center").over(w), F.col("center")
    low = F.coalesce((before + c) / 2, c - (after - c) / 2, c - 0.5)
    high = F.coalesce((c + after) / 2, c + (c - before) / 2, c + 0.5)
    return axes.withColumns({"low": low, "high": high})


def axis_arrays(axes: DataFrame) -> DataFrame:
    """One row a model: ``lats, lons`` as arrays of ``struct<c, low, high>``. A grid's axes are short."""

    def axis(name: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("axis") == name, F.struct("idx", F.col("center").alias("c"), "low", "high")))), lambda s: F.struct(s["c"].alias("c"), s["low"].alias("low"), s["high"].alias("high")))

    return edges(axes).groupBy("model").agg(axis("lat").alias("lats"), axis("lon").alias("lons"))


def affine(lats: str, lons: str) -> Column:
    """Six-value transform ``a, b, c, d, e, f`` of centre axes: corner at half a cell before the first centre; a single cell is 1 wide."""

    def axis(name: str) -> tuple[Column, Column]:
        first = F.get(F.col(name), F.lit(0))
        step = F.coalesce(F.get(F.col(name), F.lit(1)) - first, F.lit(1.0))
        return step, first - step / 2

    (a, c), (e, f) = axis(lons), axis(lats)
    return F.array(a, F.lit(0.0), c, F.lit(0.0), e, f)


def wrap_longitudes(axis: DataFrame) -> DataFrame:
    """Longitudes of models whose axis passes 180 go to -180..180; the axis is then put in order again."""
    top = F.max("center").over(Window.partitionBy("model"))
    wrapped = axis.withColumn("center", F.when(top > 180, F.pmod(F.col("center") + 180, F.lit(360.0)) - 180).otherwise(F.col("center")))
    return wrapped.withColumn("idx", (F.row_number().over(Window.partitionBy("model").orderBy("center")) - 1).cast("int"))


def orientation(axes: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One row a model: ``lats, lons`` of its grid when wrapped to -180..180, south to north, west to east and cropped to ``box``, and ``place``.

    ``place`` is the one permutation that does all of that to a field: where each of its cells is in the
    field as it came. ``box`` is west, south, east, north, of centres, ends included.
    """
    west, south, east, north = box or (-math.inf, -math.inf, math.inf, math.inf)

    def axis(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("axis") == name, F.struct(F.col("center").alias("c"), F.col("idx").alias("i")))))

    wrapped = wrap_longitudes(axes.where("axis = 'lon'").withColumn("raw", F.col("idx"))).select("model", "axis", F.col("raw").alias("idx"), "center")
    arrays = axes.where("axis = 'lat'").select("model", "axis", "idx", "center").unionByName(wrapped).groupBy("model").agg(axis("lat").alias("a"), axis("lon").alias("o"))
    within = arrays.select("model", F.size("o").alias("width"), F.filter("a", lambda s: s["c"].between(south, north)).alias("a"), F.filter("o", lambda s: s["c"].between(west, east)).alias("o"))
    place = F.flatten(F.transform("a", lambda r: F.transform("o", lambda c: (r["i"] * F.col("width") + c["i"]).cast("int"))))
    return within.select("model", F.col("a.c").alias("lats"), F.col("o.c").alias("lons"), place.alias("place"))


def oriented(fields: DataFrame, orientations: DataFrame) -> DataFrame:
    """Fields with ``values`` moved to their place: whole arrays, one permutation a model. ``orientations`` is a fixed dimension."""
    joined = fields.join(F.broadcast(orientations.select("model", "place")), "model")
    return joined.withColumn("values", F.transform("place", lambda i: F.get("values", i))).drop("place")


def crop(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells whose centre is in the box, ends included."""
    return points.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def source_index(x: Column, y: Column, transform: tuple[float, ...]) -> dict[str, Column]:
    """Row and column of the source cell that holds a point, by the inverse of an affine without rotation."""
    a, _, c, _, e, f = transform
    return {"src_row": F.floor((y - f) / e).cast("int"), "src_col": F.floor((x - c) / a).cast("int")}


def regrid(target: DataFrame, source: DataFrame, transform: tuple[float, ...], x: Column | None = None, y: Column | None = None) -> DataFrame:
    """Nearest values of ``source`` (``src_row, src_col, value`` and keys) for every target cell and key; null where the source has none.

    The index is arithmetic on the target grid, a fixed dimension that is broadcast; every key of the
    source meets all its cells, and the large source is joined by equality.
    """
    placed = target.withColumns(source_index(x if x is not None else F.col("lon"), y if y is not None else F.col("lat"), transform))
    keys = [c for c in source.columns if c not in ("src_row", "src_col", "value")]
    if not keys:
        return placed.join(source, ["src_row", "src_col"], "left")
    wanted = source.select(*keys).distinct().crossJoin(F.broadcast(placed))
    return wanted.join(source, [*keys, "src_row", "src_col"], "left")


def lambert(lat: Column, lon: Column, lat0: float, lon0: float, lat1: float, lat2: float, radius: float = 6371200.0) -> tuple[Column, Column]:
    """Forward Lambert conformal conic on a sphere (Snyder's published formulas)."""
    p0, p1, p2 = map(math.radians, (lat0, lat1, lat2))
    half = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else math.log(math.cos(p1) / math.cos(p2)) / math.log(half(p2) / half(p1))
    f = math.cos(p1) * half(p1) ** n / n
    rho0 = radius * f / half(p0) ** n
    rho = F.lit(radius * f) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(n))
    turn = F.lit(n) * F.radians(lon - F.lit(lon0))
    return rho * F.sin(turn), F.lit(rho0) - rho * F.cos(turn)


def mercator_pixels(spark, west: float, south: float, east: float, north: float, width: int, height: int) -> DataFrame:
    """``px, py, lat, lon`` of pixel centres of a Mercator image; rows go north to south."""
    y = lambda lat: EARTH_RADIUS * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
    top, bottom = y(north), y(south)
    ids = spark.range(width * height).select((F.col("id") % width).cast("int").alias("px"), F.expr(f"cast(id div {width} as int)").alias("py"))
    my = F.lit(top) - (F.col("py") + 0.5) * ((top - bottom) / height)
    return ids.select("px", "py", F.degrees(F.atan(F.sinh(my / EARTH_RADIUS))).alias("lat"), (F.lit(west) + (F.col("px") + 0.5) * ((east - west) / width)).alias("lon"))


def check_single_grid(grids: DataFrame) -> DataFrame:
    """``model, n_grids, consistent``: a model must have one transform, CRS and size."""
    return grids.groupBy("model").agg(F.count_distinct("transform", "crs", "n_lat", "n_lon").alias("n_grids")).withColumn("consistent", F.col("n_grids") == 1)


def require_single_grid(grids: DataFrame) -> DataFrame:
    """The audit as a guard: it raises when a model has several grids."""
    checked = check_single_grid(grids)
    return checked.withColumn("consistent", F.when(F.col("consistent"), True).otherwise(F.raise_error(F.concat(F.lit("several grids for "), F.col("model"))).cast("boolean")))
