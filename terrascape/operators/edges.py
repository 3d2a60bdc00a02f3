"""Edges of polygons as rows, and their parts between the lines of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascape.functions.geometry import pixel
from terrascape.functions.polygons import follower, once, signed_area
from terrascape.grid import Grid


def in_pixels(polygon: DataFrame, grid: Grid) -> DataFrame:
    """Rings with vertices in continuous (column, row) coordinates; rings of fewer than 3 vertices and null ones are left out."""

    def moved(v: Column) -> Column:
        x, y = pixel(grid, v["x"], v["y"])
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return once(polygon.where(F.size("vertices") >= 3), "vertices", F.transform("vertices", moved))


def segments(rings: DataFrame, *more: str) -> DataFrame:
    """poly_id, ring_id, sign, x1, y1, x2, y2, and `more` of the ring's columns: edges, with the sign that makes exteriors count up and holes down."""
    turn = F.signum(signed_area(F.col("vertices"))) * F.when(F.col("is_hole"), -1.0).otherwise(1.0)
    edge = F.zip_with("vertices", follower(F.col("vertices")), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    return rings.select("poly_id", "ring_id", turn.alias("sign"), *more, F.inline(edge))


def cut_at_lines(rows: DataFrame, axis: str, n: int, index: str) -> DataFrame:
    """Segments cut at whole numbers of an axis, with the index of the strip each piece lies in; pieces outside 0 to n are held at its ends."""
    a, b = F.col(f"{axis}1"), F.col(f"{axis}2")
    first, last = F.floor(F.least(a, b)), F.ceil(F.greatest(a, b)) - 1
    spread = F.sequence(F.greatest(F.least(first, F.lit(n)), F.lit(-1)).cast("int"), F.greatest(F.lit(-1), F.least(F.greatest(first, last), F.lit(n))).cast("int"))
    each = rows.withColumn(index, F.explode(spread))
    i = F.col(index)
    low = F.when(i <= -1, F.lit(float("-inf"))).otherwise(i.cast("double"))
    high = F.when(i >= n, F.lit(float("inf"))).otherwise((i + 1).cast("double"))
    hold = lambda v: F.greatest(low, F.least(high, v))
    other = "y" if axis == "x" else "x"
    slope = F.when(b != a, (F.col(f"{other}2") - F.col(f"{other}1")) / F.when(b != a, b - a)).otherwise(0.0)
    place = lambda v: F.when(b != a, F.col(f"{other}1") + slope * (v - a))
    p, q = hold(a), hold(b)
    return each.withColumns({"_p": p, "_q": q, "_s": F.coalesce(place(p), F.col(f"{other}1")), "_t": F.coalesce(place(q), F.col(f"{other}2"))}).withColumns(
        {f"{axis}1": F.col("_p"), f"{axis}2": F.col("_q"), f"{other}1": F.col("_s"), f"{other}2": F.col("_t")}
    ).drop("_p", "_q", "_s", "_t")
