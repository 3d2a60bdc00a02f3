"""Projections, polygons as text, covers and margins against plain arithmetic."""

import math
import random

import pytest
from pyspark.sql import functions as F

import terrascape as ts
from terrascape.functions import projections
from terrascape.grid import Grid
from terrascape.operators import aoi, tiles
from terrascape.sources import cells as table
from terrascape.sources import vector

SYSTEMS = ["EPSG:32631", "EPSG:32755", "EPSG:28355", "EPSG:7855", "EPSG:3857", "EPSG:2154", "EPSG:3112", "EPSG:3577", "EPSG:5070", "EPSG:4326"]


def test_known_places(spark):
    def at(crs, lon, lat):
        x, y = projections.projection(crs).forward(F.lit(float(lon)), F.lit(float(lat)))
        return tuple(spark.range(1).select(x, y).head())

    assert at("EPSG:32631", 3, 0) == pytest.approx((500000, 0), abs=1e-6)
    assert at("EPSG:32631", 3, 45) == pytest.approx((500000, 4982950.400), abs=1e-3)
    assert at("EPSG:32755", 147, 0) == pytest.approx((500000, 1e7), abs=1e-6)
    assert at("EPSG:3857", 180, 0) == pytest.approx((20037508.342789244, 0), abs=1e-6)
    assert at("EPSG:2154", 3, 46.5) == pytest.approx((700000, 6600000), abs=1e-6)
    assert at("EPSG:3577", 132, 0) == pytest.approx((0, 0), abs=1e-6)
    assert at("EPSG:4326", 12.5, -3) == (12.5, -3)
    with pytest.raises(ValueError):
        projections.projection("EPSG:1")


@pytest.mark.parametrize("crs", SYSTEMS)
def test_there_and_back_within_a_millimetre(spark, crs):
    p = projections.projection(crs)
    lon0, lat0 = {"EPSG:32631": (3, 40), "EPSG:2154": (3, 46), "EPSG:5070": (-96, 38)}.get(crs, (147, -36))
    rows = [(lon0 + a / 2, lat0 + b * 1.5) for a in range(-5, 6) for b in range(-5, 6)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "lon double, lat double")
    x, y = p.forward(F.col("lon"), F.col("lat"))
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("u"), lat.alias("v")).collect():
        assert math.hypot((r.u - r.lon) * math.cos(math.radians(r.lat)), r.v - r.lat) * 111_320 < 1e-3


def test_equal_areas_and_right_angles(spark):
    # an equal-area conic keeps areas; a conformal one keeps the shape of a small square
    side = 1e-4
    for crs, kind in (("EPSG:3577", "area"), ("EPSG:5070", "area"), ("EPSG:3112", "shape"), ("EPSG:2154", "shape"), ("EPSG:32755", "shape")):
        p, lon, lat = projections.projection(crs), *((147.3, -33.2) if crs != "EPSG:5070" else (-90.0, 41.0))
        a, e2 = 6378137.0, p.ellipsoid.e**2
        w = math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)
        east, north = math.radians(side) * a * math.cos(math.radians(lat)) / w, math.radians(side) * a * (1 - e2) / w**3
        at = [tuple(spark.range(1).select(*p.forward(F.lit(lon + i * side), F.lit(lat + j * side))).head()) for i, j in ((0, 0), (1, 0), (0, 1))]
        (dx, dy), (ex, ey) = ((q[0] - at[0][0], q[1] - at[0][1]) for q in at[1:])
        if kind == "area":
            assert dx * ey - dy * ex == pytest.approx(east * north, rel=1e-5)
        else:
            assert math.hypot(dx, dy) / east == pytest.approx(math.hypot(ex, ey) / north, rel=1e-5) and abs(dx * ex + dy * ey) < 1e-4 * east * north


def test_polygons_in_another_system_are_taken(spark, tmp_path):
    grid = Grid(40, 40, (1000.0, 0.0, 4.8e5, 0.0, -1000.0, 5.42e6), False, crs="EPSG:32755")
    table.write_cells(spark.range(1600).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), F.lit(0.5).alias("value")), grid, f"{tmp_path}/c")
    laid = vector.box(spark, 4.85e5, 5.39e6, 5.05e5, 5.41e6).withColumn("crs", F.lit("urn:ogc:def:crs:EPSG::32755"))
    degrees = vector.reprojected(laid, "EPSG:32755", "EPSG:4326")
    assert degrees.head().crs == "EPSG:4326" and degrees.select(F.size("vertices")).head()[0] > 200
    got, want = (ts.pixel_coverage(spark, p, f"{tmp_path}/c").toPandas().sort_values(["row", "col"]) for p in (degrees, laid))
    assert abs(got.value.sum() - want.value.sum()) < 0.05 and abs(want.value.sum() - 400) < 1e-6
    ts.pixel_coverage(spark, degrees, f"{tmp_path}/c", filename=f"{tmp_path}/out")
    assert table.read_cells(spark, f"{tmp_path}/out")[0].count() == len(got)
    with pytest.raises(ValueError):
        vector.fitted(laid.withColumn("crs", F.lit("EPSG:1")), grid)
    assert vector.reprojected(vector.polygons(spark, []), "EPSG:4326", "EPSG:3857").count() == 0


def test_wkt_and_geojson_give_the_same_rings(spark, tmp_path):
    text = ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "  MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5),(5.2 5.1,5.4 5.1,5.4 5.2,5.2 5.1)))", "srid=4326;Polygon Z ((0 0 9, 1 0 9, -1.5e1 1 9, 0 0 9))", "POINT (1 2)", "POLYGON EMPTY", None]
    rows = vector.from_wkt(spark.createDataFrame(list(enumerate(text)), "poly_id long, wkt string")).collect()
    found = sorted((r.is_hole, r.ring_id, [(v.x, v.y) for v in r.vertices]) for r in rows)
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]],[[5.2,5.1],[5.4,5.1],[5.4,5.2],[5.2,5.1]]]]}}, {"geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[-15,1],[0,0]]]}}]}')
    want = sorted((r.is_hole, r.ring_id, [(v.x, v.y) for v in r.vertices]) for r in vector.read_geojson(spark, f"{tmp_path}/a.json").collect())
    assert len(found) == 6 and found == want and len({r.poly_id for r in rows}) == 4


def plain_touched(shape, i, j):
    """Whether the closed pixel square meets a polygon: a corner of either in the other, or edges that cross."""
    def inside(x, y):
        odd = False
        for ring in shape:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
                    odd = not odd
        return odd

    def meets(a, b):  # a segment and the square, by clipping
        t0, t1 = 0.0, 1.0
        for p, d, low in ((a[0], b[0] - a[0], j), (a[1], b[1] - a[1], i)):
            if d == 0:
                if not low <= p <= low + 1:
                    return False
            else:
                u, v = sorted(((low - p) / d, (low + 1 - p) / d))
                t0, t1 = max(t0, u), min(t1, v)
        return t0 <= t1

    return inside(j + 0.5, i + 0.5) or any(meets(a, b) for ring in shape for a, b in zip(ring, ring[1:] + ring[:1]))


@pytest.fixture(scope="module")
def shapes():
    rnd = random.Random(12)
    out = []
    for _ in range(25):
        x, y, k, r = rnd.uniform(-20, 220), rnd.uniform(-20, 170), rnd.choice([3, 5, 8]), rnd.choice([0.3, 2, 9, 60])
        star = [(x + r * rnd.uniform(0.5, 1) * math.cos(2 * math.pi * i / k), y + r * rnd.uniform(0.5, 1) * math.sin(2 * math.pi * i / k)) for i in range(k)]
        out.append([star, [(x + (a - x) * 0.4, y + (b - y) * 0.4) for a, b in star]] if r > 5 else [star])
    return out + [[[(3, 3), (140, 3), (140, 140), (3, 140)]], [[(10.0, 10.0), (12.0, 10.0), (12.0, 12.0), (10.0, 12.0)]]]


def test_cover_is_exact(spark, shapes):
    grid = Grid(150, 200, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))
    for some in (shapes, shapes[:8], shapes[-1:]):
        df = vector.polygons(spark, some)
        want = {(i, j) for i in range(150) for j in range(200) if any(plain_touched(s, i, j) for s in some)}
        assert {tuple(r) for r in aoi.touched(df, grid).collect()} == want
        cells = spark.range(150 * 200).select((F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"))
        assert {(r["row"], r["col"]) for r in aoi.marked(cells, aoi.cover(df, grid), "_in").where("_in").collect()} == want
    blocks = aoi.cover(vector.polygons(spark, shapes[-2:-1]), grid)
    assert blocks.where("bits IS NULL").count() == 1 and blocks.count() == 9  # of nine blocks the middle one isn't looked into
    assert aoi.touched(vector.polygons(spark, []), grid).count() == 0


def test_margin_is_exact(spark, shapes):
    grid, some, margin = Grid(60, 70, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)), shapes[:6] + shapes[-1:], 4.25
    cells = spark.range(60 * 70).select((F.col("id") / 70).cast("int").alias("row"), (F.col("id") % 70).cast("int").alias("col"))

    def apart(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)))
        return math.dist(p, (a[0] + t * d[0], a[1] + t * d[1]))

    def close(i, j):
        for shape in some:
            for ring in shape:
                for a, b in zip(ring, ring[1:] + ring[:1]):
                    if plain_touched([[a, b]], i, j) or min(*(apart((j + u, i + v), a, b) for u in (0, 1) for v in (0, 1)), *(math.hypot(max(j - x, x - j - 1, 0), max(i - y, y - i - 1, 0)) for x, y in (a, b))) <= margin:
                        return True
        return False

    got = {(r["row"], r["col"]) for r in aoi.near(cells, vector.polygons(spark, some), grid, margin, "edge").where("edge").collect()}
    assert got == {(i, j) for i in range(60) for j in range(70) if close(i, j)}


def plain_breaks(costs, parts, align_to, size):
    run = [round(sum(costs[: i + 1]), 9) for i in range(len(costs))]
    at = [0]
    for k in range(1, parts):
        aim = run[-1] * k / parts
        reach = next(i for i, v in enumerate(run) if v >= round(aim, 9)) + 1
        allowed = [min(max(b, at[-1] + 1), len(costs) - (parts - k)) for b in (reach, reach - 1) if b > 0]
        at.append(min(allowed, key=lambda b: round(abs(run[b - 1] - aim), 9)))
    return [min(b * align_to, size) for b in at] + [size]


def test_breaks_by_running_costs(spark, monkeypatch):
    monkeypatch.setattr(tiles, "CHUNK", 3)
    rnd = random.Random(5)
    bands = [[1, 1, 1, 5], [5, 1, 1, 1], [0, 0, 0, 7], [9, 0, 0, 0], *[[rnd.choice([0, 0.1, 1, 30]) + 0.1 for _ in range(4)] for _ in range(12)]]
    for parts in (1, 2, 3, 4):
        df = spark.createDataFrame([(b, i, float(c)) for b, row in enumerate(bands) for i, c in enumerate(row)], "band int, block int, cost double")
        got = tiles.balanced_breaks(df, parts, 10, 38)
        assert got == {b: plain_breaks(row, parts, 10, 38) for b, row in enumerate(bands)}
    zero = spark.createDataFrame([(0, i, 0.0) for i in range(4)], "band int, block int, cost double")
    assert tiles.balanced_breaks(zero, 2, 10, 40) == {0: [0, 20, 40]}
    with pytest.raises(ValueError):
        tiles.balanced_breaks(zero, 5, 10, 40)


def test_short_texts_of_numbers(spark):
    from terrascape.grid import compact

    values = [0.0, 1.0, 7.25, 12.3456, 999.96, 99.996, 9.9996, 0.99996, 0.012345, 0.0012345, 0.00012345, 1.5e-7, 123.0, 999.0, 1000.0, 1234.5, 2.5e6, 7.123e9, 3.0e5]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(tiles.compact_text(F.col("v"))).collect()
    assert [r[0] for r in got] == [compact(v) for v in values]


def test_short_texts_round_the_values_themselves(spark):
    # as doubles these lie below what they are written as, so a last digit of 5 is dropped
    texts = {1005.0: "1.00K", 2.675e6: "2.67M", 1.2355e-05: "1.235e-05", 1.2345e-05: "1.234e-05", 8.3485: "8.348", -12.5: "-12.5", None: None}
    got = spark.createDataFrame([(v,) for v in texts], "v double").select("v", tiles.compact_text(F.col("v"))).collect()
    assert dict(map(tuple, got)) == texts
