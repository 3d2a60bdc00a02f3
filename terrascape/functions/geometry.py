"""Columns for places, distances, and the overlap of cells with rings around a source."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrascape.grid import Grid

EARTH_M = 6_371_000.0


def world(grid: Grid, row: Column, col: Column, level: int | Column = 1) -> tuple[Column, Column]:
    """x and y of a cell's centre; row and col are indices at the level."""
    a, b, c, d, e, f = grid.transform
    r, q = (row + 0.5) * level, (col + 0.5) * level
    return a * q + b * r + c, d * q + e * r + f


def pixel(grid: Grid, x: Column, y: Column) -> tuple[Column, Column]:
    """Continuous column and row of a place: the inverse transform."""
    a, b, c, d, e, f = grid.transform
    det = a * e - b * d
    if det == 0:
        raise ValueError("the transform has no inverse")
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def level_key(index: Column, level: int | Column) -> Column:
    return F.floor(index / level).cast("int")


def node_id(level: Column, gi: Column, gj: Column) -> Column:
    """16 bits of level, 24 of row and 24 of column in a long; raises beyond them."""
    packed = F.shiftleft(level.cast("long"), 48).bitwiseOR(F.shiftleft(gi.cast("long"), 24)).bitwiseOR(gj.cast("long"))
    fits = (gi >= 0) & (gj >= 0) & (gi < 1 << 24) & (gj < 1 << 24) & (level < 1 << 15)
    return F.when(F.assert_true(fits, F.lit("cell index out of range")).isNull(), packed)


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def distance_km(grid: Grid, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of two places, as a float: great circle for degrees, else in the plane, whose unit is taken to be the metre."""
    metres = haversine if grid.is_geo else euclidean
    return (metres(x1, y1, x2, y2) / 1000).cast("float")


def cosine_weight(grid: Grid, row: Column, col: Column) -> Column:
    """Relative area of a pixel of a geographic grid."""
    return F.abs(F.cos(F.radians(world(grid, row, col)[1])))


def arc(t: Column, r: float | Column) -> Column:
    """Twice the area between the axis and the circle of radius r from 0 to t, with the sign of t; beyond the circle it stays."""
    m = F.greatest(-r, F.least(t, r))
    return m * F.sqrt(r * r - m * m) + r * r * F.asin(m / F.greatest(r, F.lit(1e-300)))


def corner(p: Column, q: Column, arc_p: Column, arc_q: Column, r: float | Column) -> Column:
    """Area, with its sign, of the rectangle from the centre to (p, q) within the circle of radius r: all of it where the corner lies inside, else what the arcs of its two sides leave of the quarter circle."""
    s, t = F.signum(p), F.signum(q)
    return F.when(p * p + q * q <= r * r, p * q).otherwise((t * arc_p + s * arc_q - s * t * r * r * (math.pi / 2)) / 2)


def circle_overlap(a: Column, b: Column, c: Column, d: Column, arcs: tuple[Column, Column, Column, Column], r: float | Column) -> Column:
    """Area of the rectangle [a, b] x [c, d] within the circle of radius r about 0: four corners' areas, added and taken away; arcs: those of a, b, c and d."""
    e, f, g, h = arcs
    return corner(b, d, f, h, r) - corner(a, d, e, h, r) - corner(b, c, f, g, r) + corner(a, c, e, g, r)


def square_overlap(i0: Column, i1: Column, j0: Column, j1: Column, ci: Column, cj: Column, r: float | Column) -> Column:
    """Area of the rectangle within the square of half-width r about (ci, cj)."""
    side = lambda a, b, c: F.greatest(F.lit(0.0), F.least(b, c + r) - F.greatest(a, c - r))
    return side(i0, i1, ci) * side(j0, j1, cj)


def meets_circle(i0: Column, i1: Column, j0: Column, j1: Column, ci: Column, cj: Column, r: float | Column) -> Column:
    """Whether the circle's line runs through the rectangle."""
    a, b, c, d = i0 - ci, i1 - ci, j0 - cj, j1 - cj
    near = F.pow(F.greatest(a, -b, F.lit(0.0)), 2) + F.pow(F.greatest(c, -d, F.lit(0.0)), 2)
    far = F.pow(F.greatest(F.abs(a), F.abs(b)), 2) + F.pow(F.greatest(F.abs(c), F.abs(d)), 2)
    eps = (r * r + 1) * 1e-12
    return (near <= r * r + eps) & (far >= r * r - eps)


def exponential(d: Column, scale: float | Column) -> Column:
    return F.exp(-d / scale)


#: Fixed value of the squared-exponential kernel.
GAUSS = 283.465


def gaussian(d: Column, scale: float | Column) -> Column:
    return F.exp(-(d / scale) * (d / scale) / GAUSS)


def similarity(a: Column, b: Column) -> Column:
    """exp of minus the sum of absolute differences of two arrays; null if any element is null or lengths differ."""
    return F.exp(-F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x))


def edge_weight(trav: Column, max_cost: float) -> Column:
    """Cost of a km into a cell: max_cost at traversal 0, 1 at traversal 1."""
    return (1 - max_cost) * trav + max_cost


def quantised(km: Column) -> Column:
    """Hundredths of a km, half away from zero."""
    return F.round(km.cast("double") * 100).cast("int")


