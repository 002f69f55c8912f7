"""Cells of a region: point, rectangle or polygon.

A grid's axes are short arrays, joined by model. All cell choices are then expressions over a
region's row: index ranges from the axes, scan lines through the ring, and the chain of fallbacks.

A polygon is filled by scan lines: for each grid row that its bounding box reaches, the ring's edges
are crossed once with the row's latitude, the crossings are sorted, and between each two of them
lies a range of columns. Its work is rows times edges, and not cells times edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring_bbox(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def vertex_mean(ring: Column, axis: int) -> Column:
    return F.try_divide(F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis]), F.size(ring).cast("double"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crossings(ring: Column, lat: Column) -> Column:
    """Sorted longitudes where the edges of a ring cross a latitude, half open: an edge counts where exactly one end is above it."""
    n = F.size(ring)

    def cut(k: Column) -> Column:
        p, q = F.get(ring, k), F.get(ring, F.pmod(k + n - 1, n))
        xi, yi, xj, yj = p[0], p[1], q[0], q[1]
        return F.when((yi > lat) != (yj > lat), xi + (xj - xi) * F.try_divide(lat - yi, yj - yi))

    return F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), cut)))


def axis_step(axis: Column) -> Column:
    """Distance of an ascending axis' places if it is the same all along, to a quarter of it; else null."""
    n = F.size(axis)
    first, last = F.get(axis, F.lit(0))["c"], F.get(axis, n - 1)["c"]
    step = F.try_divide(last - first, (n - 1).cast("double"))
    even = F.forall(F.transform(axis, lambda a, i: F.abs(a["c"] - first - step * i)), lambda d: d <= step / 4)
    return F.when((n > 1) & (step > 0) & even, step)


def _below(axis: Column, side: str, step: Column, x: Column) -> Column:
    """How many of the axis' ``side``s are less than ``x``: by arithmetic, and one comparison to each side, where the axis is even."""
    n = F.size(axis)
    guess = F.least(F.greatest(F.ceil((x - F.get(axis, F.lit(0))[side]) / step), F.lit(0)), n).cast("int")

    def mended(g: Column) -> Column:
        over = (g > 0) & (F.get(axis, F.greatest(g - 1, F.lit(0)))[side] >= x)
        under = (g < n) & (F.get(axis, F.least(g, n - 1))[side] < x)
        return g - over.cast("int") + under.cast("int")

    return F.when(step.isNotNull(), _let(guess, mended)).otherwise(F.size(F.filter(axis, lambda a: a[side] < x)))


def _filled(cuts: Column, axis: Column, sides: tuple[str, ...], step: Column) -> Column:
    """Indices whose place, by any of ``sides``, is between the first and second crossing, the third and fourth, and so on."""

    def ranges(sorted_cuts: Column) -> Column:
        pairs = F.filter(F.sequence(F.lit(0), F.size(sorted_cuts)), lambda j: (j % 2 == 0) & (j + 1 < F.size(sorted_cuts)))
        each = lambda j, side: F.struct(_below(axis, side, step, F.get(sorted_cuts, j)).alias("lo"), _below(axis, side, step, F.get(sorted_cuts, j + 1)).alias("hi"))
        spans = F.filter(F.flatten(F.transform(pairs, lambda j: F.array(*(each(j, side) for side in sides)))), lambda r: r["lo"] < r["hi"])
        return F.flatten(F.transform(spans, lambda r: F.sequence(r["lo"], r["hi"] - 1)))

    return _let(cuts, ranges)


def _index(axis: Column, keep) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(axis) - 1), lambda i: keep(F.get(axis, i)))


def rectangle_cells() -> Column:
    """Ids of cells whose edges overlap ``bounds`` (w, s, e, n), ends included."""
    b = F.col("bounds")
    rows = _index(F.col("lats"), lambda a: (a["low"] <= b[3]) & (a["high"] >= b[1]))
    cols = _index(F.col("lons"), lambda a: (a["low"] <= b[2]) & (a["high"] >= b[0]))
    return _let(cols, lambda chosen: F.flatten(F.transform(rows, lambda r: F.transform(chosen, lambda c: (r * F.size("lons") + c).cast("int")))))


def polygon_cells(corners: bool = False) -> Column:
    """Ids of cells whose centre, or also a corner, is in the polygon ``coordinates``; needs ``lon_step`` of ``axis_step``."""
    ring, lats, lons, step = F.col("coordinates"), F.col("lats"), F.col("lons"), F.col("lon_step")
    _, s, _, n = ring_bbox(ring)
    rows = _index(lats, lambda a: (a["low"] <= n) & (a["high"] >= s) if corners else a["c"].between(s, n))

    def row_cells(r: Column) -> Column:
        lat = F.get(lats, r)
        cols = _filled(crossings(ring, lat["c"]), lons, ("c",), step)
        if corners:
            cols = F.concat(cols, *(_filled(crossings(ring, lat[y]), lons, ("low", "high"), step) for y in ("low", "high")))
        return F.transform(F.array_sort(F.array_distinct(cols)), lambda c: (r * F.size(lons) + c).cast("int"))

    found = F.flatten(F.transform(rows, row_cells))
    return F.when(F.size(ring) >= 3, found).otherwise(F.array().cast("array<int>"))


def nearest_cell(lon: Column, lat: Column) -> Column:
    """The closest centre on each axis by itself; the lowest index on ties; however far."""

    def closest(axis: Column, x: Column) -> Column:
        # index over nothing but the axis, as (distance, index) pairs
        best = F.array_min(F.transform(axis, lambda a, i: F.struct(F.abs(a["c"] - x).alias("d"), i.alias("i"))))
        return best["i"]

    lats, lons = F.col("lats"), F.col("lons")
    return (closest(lats, lat) * F.size(lons) + closest(lons, lon)).cast("int")


def region_cells(regions: DataFrame, axes: DataFrame) -> DataFrame:
    """``region_id, model, how, cells``: the cells of each region on each model's grid.

    ``axes``: one row a model, of ``grid.axis_arrays``. A rectangle takes the cells it overlaps,
    else the one nearest to its middle; a polygon the cells whose centre it holds, else those
    with a corner in it, else the one nearest to its mean vertex; a point the nearest. An
    unknown type has no cell.
    """
    both = regions.crossJoin(F.broadcast(axes.withColumn("lon_step", axis_step(F.col("lons")))))  # one row for each model
    b, ring = F.col("bounds"), F.col("coordinates")
    kind = F.col("type")
    tries = both.withColumns({
        "__rect": F.when(kind == "rectangle", rectangle_cells()),
        "__centers": F.when(kind == "polygon", polygon_cells()),
    }).withColumn("__corners", F.when((kind == "polygon") & (F.size("__centers") == 0), polygon_cells(corners=True)))
    x = F.when(kind == "rectangle", (b[0] + b[2]) / 2).when(kind == "polygon", vertex_mean(ring, 0)).when(kind == "point", F.get(ring, F.lit(0))[0])
    y = F.when(kind == "rectangle", (b[1] + b[3]) / 2).when(kind == "polygon", vertex_mean(ring, 1)).when(kind == "point", F.get(ring, F.lit(0))[1])
    some = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    how = F.when(some("__rect"), "overlap").when(some("__centers"), "centers").when(some("__corners"), "corners").when(x.isNotNull(), "nearest").otherwise("none")
    chosen = F.when(some("__rect"), F.col("__rect")).when(some("__centers"), F.col("__centers")).when(some("__corners"), F.col("__corners")).when(x.isNotNull(), F.array(nearest_cell(x, y))).otherwise(F.array().cast("array<int>"))
    return tries.select("region_id", "model", how.alias("how"), chosen.alias("cells"))
