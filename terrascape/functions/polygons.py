"""Columns over rings, which are arrays of (x, y) structs; open or closed, either way round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once, and not again for each use: as the one element of an array that is exploded, it can't be merged into what follows."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name)).select(*[F.col(f"`{c}`") for c in [*df.columns, *([] if name in df.columns else [name])]])


def follower(ring: Column) -> Column:
    """The ring from its second vertex on, with the first at the end."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive where x turns towards y; 0 for fewer than 3 vertices."""
    parts = F.zip_with(ring, follower(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(ring) >= 3, F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2).otherwise(0.0)


def shoelace(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def clipped(ring: Column, axis: str, bound: Column | float, keep_above: bool) -> Column:
    """The ring's part on one side of the line axis = bound: each edge gives its start if that is inside, and where it crosses."""
    side = (lambda v: v >= bound) if keep_above else (lambda v: v <= bound)

    def edge(p: Column, q: Column) -> Column:
        t = (F.lit(bound) - p[axis]) / (q[axis] - p[axis]) if not isinstance(bound, Column) else (bound - p[axis]) / (q[axis] - p[axis])
        cross = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        start = F.struct(p["x"].alias("x"), p["y"].alias("y"))
        none = F.slice(F.array(start), 1, 0)
        crosses = side(p[axis]) != side(q[axis])
        return F.concat(F.when(side(p[axis]), F.array(start)).otherwise(none), F.when(crosses, F.array(F.when(crosses, cross))).otherwise(none))

    return F.flatten(F.zip_with(ring, follower(ring), edge))


def clip_to_box(ring: Column, x0: Column | float, x1: Column | float, y0: Column | float, y1: Column | float) -> Column:
    """The ring's part in a box (its area is right; its outline may run along the box)."""
    out = ring
    for axis, bound, above in (("y", y0, True), ("y", y1, False), ("x", x0, True), ("x", x1, False)):
        # as an array's only element, so that a ring is worked out once and not for each use
        out = F.get(F.transform(F.array(out), lambda r: clipped(r, axis, bound, above)), F.lit(0))  # noqa: B023
    return out


def index_within(x: Column, n: int) -> Column:
    """floor(x) as an index, held within 0 to n."""
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(n)).cast("int")
