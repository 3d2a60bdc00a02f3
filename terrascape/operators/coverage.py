"""How much of each pixel polygons cover, from the outline of their union alone.

The outline is cut where it crosses pixel lines. Within a row of pixels each piece adds its height,
times the part of the pixel to its right, to its own pixel, and its height to every pixel
further right: a running sum along the row. So the work grows with the length of the outlines,
and pixels inside come from the gaps between pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascape.grid import Grid
from terrascape.operators.edges import cut_at_lines, in_pixels
from terrascape.operators.overlay import union_edges


def pixel_coverage(polygon: DataFrame, grid: Grid) -> DataFrame:
    """row, col, value: share of each touched pixel, 0 to 1, that polygons cover; pixels not listed have 0.

    Where polygons overlap, what they cover together counts once; the rings of one polygon
    should not cross. An empty polygon table, or one off the grid, gives no rows.
    """
    return covered(union_edges(in_pixels(polygon, grid)), grid)


def covered(edges: DataFrame, grid: Grid) -> DataFrame:
    """row, col, value of x1, y1, x2, y2: closed lines in pixels that don't cross, with the inside on one side of all."""
    rows = cut_at_lines(edges, "y", grid.nrows, "row").where((F.col("row") >= 0) & (F.col("row") < grid.nrows) & (F.col("y1") != F.col("y2")))
    pieces = cut_at_lines(rows, "x", grid.ncols, "col")
    right = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("col") + 1 - (F.col("x1") + F.col("x2")) / 2))
    right = F.when(F.col("col") < 0, 1.0).when(F.col("col") >= grid.ncols, 0.0).otherwise(right)
    high = F.col("y2") - F.col("y1")
    own = pieces.groupBy("row", "col").agg(F.sum(high).alias("high"), F.sum(high * right).alias("part"))
    along = Window.partitionBy("row").orderBy("col")
    # what lies to the left of a pixel counts in full; between two touched pixels all have that
    left = F.sum("high").over(along)
    spans = own.select("row", "col", (left - F.col("high") + F.col("part")).alias("own"), left.alias("after"), F.lead("col", 1, grid.ncols).over(along).alias("next"))
    single = spans.where((F.col("col") >= 0) & (F.col("col") < grid.ncols)).select("row", "col", F.col("own").alias("value"))
    gaps = spans.where((F.abs("after") > 1e-9) & (F.col("next") > F.col("col") + 1))
    inside = gaps.select("row", F.explode(F.sequence(F.greatest(F.col("col") + 1, F.lit(0)), F.col("next") - 1)).alias("col"), F.col("after").alias("value"))
    # rows run down: the turn of a ring and the sense of the sum are the same for all, so the sign is settled here
    each = single.unionByName(inside).withColumn("value", F.least(F.lit(1.0), F.abs("value")))
    return each.where("value > 1e-9").select("row", "col", F.col("value").cast("float").alias("value"))
