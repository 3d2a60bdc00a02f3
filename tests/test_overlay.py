"""Unions of polygons against counts of sample points and coverage by plain arithmetic."""

import math
import random

import pytest

from terrascape.grid import Grid
from terrascape.operators import coverage, overlay
from terrascape.sources.vector import polygons


def ring_area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def inside(shape, x, y):
    odd = False
    for ring in shape:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
                odd = not odd
    return odd


def rings(df):
    return [(r.is_hole, [(v.x, v.y) for v in r.vertices]) for r in df.collect()]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_boxes(spark):
    cases = [
        ([[box(0, 0, 2, 2)], [box(1, 1, 3, 3)]], 7.0, 1, 0),  # overlap
        ([[box(0, 0, 1, 1)], [box(1, 0, 2, 1)]], 2.0, 1, 0),  # a shared side goes
        ([[box(0, 0, 1, 1)], [box(1, 1, 2, 2)]], 2.0, 2, 0),  # a shared corner stays two rings
        ([[box(0, 0, 4, 4)], [box(1, 1, 2, 2)]], 16.0, 1, 0),  # one within the other
        ([[box(0, 0, 4, 4), box(1, 1, 3, 3)]], 12.0, 1, 1),  # a hole stays
        ([[box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(0.5, 0.5, 3.5, 2)]], 14.0, 1, 1),  # half of it filled
        ([[box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(1, 1, 3, 3)]], 16.0, 1, 0),  # all of it filled
        ([[box(0, 0, 1, 1)]] * 5, 1.0, 1, 0),  # equal ones
        ([[box(0, 0, 3, 1)], [box(0, 2, 3, 3)], [box(0, 0, 1, 3)], [box(2, 0, 3, 3)]], 8.0, 1, 1),  # a frame of four
        ([[box(0, 0, 1, 1)[::-1]], [box(3, 0, 4, 1)]], 2.0, 2, 0),  # either way round
        ([[[(0, 0), (1, 1)]], [[(0, 0), (1, 0), (2, 0)]]], 0.0, 0, 0),  # no area
    ]
    moved = lambda shape, k: [[(x + 8 * k, y) for x, y in ring] for ring in shape]
    found = rings(overlay.dissolved(polygons(spark, [moved(s, k) for k, (shapes, *_) in enumerate(cases) for s in shapes])))
    for k, (shapes, area, outer, holes) in enumerate(cases):
        mine = [(h, r) for h, r in found if 8 * k - 1 < r[0][0] < 8 * k + 6]
        assert sum(ring_area(r) for _, r in mine) == pytest.approx(area), shapes
        assert (sum(not h for h, _ in mine), sum(h for h, _ in mine)) == (outer, holes), shapes
    assert all(len(r) == 4 for _, r in found if 24 - 1 < r[0][0] < 24 + 6)
    assert overlay.dissolved(polygons(spark, [[box(0, 0, 1, 1)]]).limit(0)).count() == 0


@pytest.mark.parametrize("seed, many", [(1, 12), (3, 200)])
def test_union_of_random_polygons(spark, seed, many):
    rnd = random.Random(seed)
    shapes = []
    for _ in range(many):
        x, y, k = rnd.uniform(0, 20), rnd.uniform(0, 20), rnd.choice([3, 4, 5, 9])
        radius = rnd.uniform(0.5, 4)
        star = [(x + radius * rnd.uniform(0.4, 1) * math.cos(2 * math.pi * i / k), y + radius * rnd.uniform(0.4, 1) * math.sin(2 * math.pi * i / k)) for i in range(k)]
        hole = [(x + (a - x) * 0.3, y + (b - y) * 0.3) for a, b in star][::-1]
        shapes.append([star, hole] if rnd.random() < 0.5 else [star])
    df = polygons(spark, shapes)
    found = rings(overlay.dissolved(df))
    for _ in range(1500):
        p = rnd.uniform(-3, 23), rnd.uniform(-3, 23)
        assert inside([r for _, r in found], *p) == any(inside(s, *p) for s in shapes)
    assert all((ring_area(r) < 0) == h for h, r in found)
    grid = Grid(28, 28, (1.0, 0.0, -4.0, 0.0, -1.0, 24.0))
    cover = {(r["row"], r["col"]): r["value"] for r in coverage.pixel_coverage(df, grid).collect()}
    assert sum(cover.values()) == pytest.approx(sum(ring_area(r) for _, r in found), rel=1e-5)
    n = 20
    for i, j in rnd.sample(sorted(cover), 12):
        hits = sum(any(inside(s, -4 + j + (a + 0.5) / n, 24 - i - (b + 0.5) / n) for s in shapes) for a in range(n) for b in range(n))
        assert cover[i, j] == pytest.approx(hits / n**2, abs=0.06)


def test_one_place_with_very_many_outlines(spark):
    rnd = random.Random(9)
    shapes = [[box(0, 0, 64, 64)]] + [[box(x := 40 + rnd.randrange(64) / 64, y := 40 + rnd.randrange(64) / 64, x + 1 / 32, y + 1 / 32)] for _ in range(800)] + [[box(70 + i % 3, 70, 70.5 + i % 3, 71)] for i in range(300)]
    found = rings(overlay.dissolved(polygons(spark, shapes)))
    assert sum(ring_area(r) for _, r in found) == pytest.approx(64 * 64 + 1.5) and len(found) == 4
