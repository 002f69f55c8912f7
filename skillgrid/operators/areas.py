"""Rectangle means from summed-area tables.

For each layer, the sums and counts of values over all cells south and west of a cell, itself included, are kept by
row and column. A rectangle's sum is then four of them, added and taken away, whatever its size; its
cells are never listed. Sums are decimals of 18 places, so that a difference of large sums loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SUM = "decimal(38,18)"


def summed_areas(layers: DataFrame, grid: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """The ``keys`` of a layer (``model`` is one), ``row, col``, and for each of ``values`` its sum and ``{name}_n``, its number of values.

    ``grid``: ``model, cell_id, row, col`` of every cell, a fixed dimension that is broadcast. Cells that a layer lacks add nothing.
    """
    rows = layers.select(*keys, "cell_id", *(v.cast(_SUM).alias(n) for n, v in values.items()))
    cells = rows.select(*keys).distinct().join(F.broadcast(grid.select("model", "cell_id", "row", "col")), "model")
    dense = cells.join(rows, [*keys, "cell_id"], "left")
    along, up = Window.partitionBy(*keys, "row").orderBy("col"), Window.partitionBy(*keys, "col").orderBy("row")
    lines = dense.select(*keys, "row", "col", *(c for n in values for c in (F.sum(n).over(along).alias(n), F.count(n).over(along).alias(f"{n}_n"))))
    return lines.select(*keys, "row", "col", *(c for n in values for c in (F.coalesce(F.sum(n).over(up), F.lit(0).cast(_SUM)).alias(n), F.sum(f"{n}_n").over(up).alias(f"{n}_n"))))


def boxes(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """``region_id, model, box`` of regions whose ``cells`` are a block of rows and columns, in their order; ``box`` is its first and last row and column."""
    width = grid.groupBy("model").agg((F.max("col") + 1).alias("width"))
    first, last = F.get("cells", F.lit(0)), F.element_at("cells", -1)
    place = [F.floor(first / F.col("width")), F.pmod(first, F.col("width")), F.floor(last / F.col("width")), F.pmod(last, F.col("width"))]
    names = ["south", "west", "north", "east"]
    return cells.join(F.broadcast(width), "model").select("region_id", "model", F.struct(*(p.cast("int").alias(n) for p, n in zip(place, names, strict=True))).alias("box"))


def rectangle_sums(areas: DataFrame, wanted: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``box``, the ``keys`` of each layer, and for each of ``names`` the sum and number of values in the box. ``wanted``: ``model, box``."""
    b = F.col("box")
    corner = lambda row, col, plus: F.struct(row.alias("row"), col.alias("col"), F.lit(plus).alias("plus"))
    corners = F.array(corner(b["north"], b["east"], True), corner(b["south"] - 1, b["east"], False), corner(b["north"], b["west"] - 1, False), corner(b["south"] - 1, b["west"] - 1, True))
    asked = wanted.distinct().select("model", "box", F.inline(F.filter(corners, lambda c: (c["row"] >= 0) & (c["col"] >= 0))))
    met = asked.join(areas, ["model", "row", "col"])
    signed = lambda c: F.sum(F.when(F.col("plus"), F.col(c)).otherwise(-F.col(c)))
    return met.groupBy("box", *keys).agg(*(e for n in names for e in (signed(n).alias(n), signed(f"{n}_n").alias(f"{n}_n"))))


def rectangle_means(layers: DataFrame, cells: DataFrame, grid: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """``region_id``, the ``keys`` of each layer, and for each of ``values`` its mean over the region and ``{name}_n``.

    Regions are blocks of cells. A layer that has none of a region's cells gives it no row.
    """
    asked = boxes(cells, grid)
    areas = summed_areas(layers, grid, keys, values | {"here": F.lit(1)})
    sums = rectangle_sums(areas, asked.select("model", "box"), keys, [*values, "here"]).where("here_n > 0")
    means = [e for n in values for e in (F.try_divide(F.col(n).cast("double"), F.col(f"{n}_n").cast("double")).alias(n), F.col(f"{n}_n"))]
    return asked.join(sums, ["model", "box"]).select("region_id", *keys, *means)
