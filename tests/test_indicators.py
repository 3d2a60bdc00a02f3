"""Closed-form results, equality of the two engines, properties, and the registered queries against SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascape.functions import geometry as geo
from terrascape.functions.polygons import clip_to_box, shoelace
from terrascape.grid import Grid, Params, nearest_power_of_two, pyramid_levels, window_mode
from terrascape.operators import aoi, coverage, paths, surfaces, tiles
from terrascape.operators import pyramid as pyr
from terrascape.operators.window import sources, window
from terrascape.plans import indicators
from terrascape.sources import cells as table
from terrascape.sources import datasets, geotiff, rasters, vector

NAN = float("nan")
SMALL = Params(levels=(2,), option=1)


def grid_of(values):
    return Grid(len(values), len(values[0]))


def run(spark, values, params=SMALL, engine="tiled", **how):
    layers = {k: table.from_array(spark, v) if isinstance(v, list) else v for k, v in how.items()}
    g = grid_of(values)
    return table.to_array(indicators.connectedness(table.from_array(spark, values), g, params, engine=engine, **layers), g)


@pytest.mark.parametrize("engine", ["tiled", "relational"])
def test_closed_forms(spark, engine):
    near = lambda a, b: np.allclose(a, b, atol=2e-6)
    pair = [[0.8, 0.5]]
    assert near(run(spark, pair, engine=engine), [[0.4586023, 0.7717034]])
    assert near(run(spark, pair, Params(levels=(2,), option=3), engine=engine)[0, 0], 0.6057077)
    assert near(run(spark, [[0.4]], engine=engine), 0.3611024)
    assert near(run(spark, [[0.4]], pa=[[1.0]], pa_to_pa=True, engine=engine), 0.0)
    assert near(run(spark, [[1, 0, 1]], engine=engine)[0, :2], [0.3963264, 1.0])
    assert near(run(spark, pair, resistance=[[NAN, 0.75]], engine=engine)[0, 0], 0.4411235)


def test_quantised_diagonals(spark):
    assert np.allclose(run(spark, [[1, 1], [1, 1]]), 0.9997715, atol=2e-6)


@pytest.mark.parametrize("engine", ["tiled", "relational"])
def test_resilience_closed_form(spark, engine):
    bands = lambda rows: spark.createDataFrame(rows, "row int, col int, bands array<double>")
    present, future = bands([(0, 0, [0.0, 0.0]), (0, 1, [0.1, 0.2])]), bands([(0, 0, [0.0, 0.0]), (0, 1, [0.4, 0.4])])
    g = Grid(1, 2)
    got = table.to_array(indicators.beri(table.from_array(spark, [[0.8, 0.5]]), [present, future], g, 2, SMALL, engine=engine), g)
    assert abs(got[0, 0] - 0.3523182) < 2e-6


def random_layers(seed, n=22, m=19):
    rng = np.random.default_rng(seed)
    cond = rng.random((n, m)).round(2)
    cond[rng.random((n, m)) < 0.2] = NAN
    return cond, np.where(rng.random((n, m)) < 0.3, rng.random((n, m)).round(2), 0.0), rng.random((n, m)).round(2)


@pytest.mark.parametrize("mode", ["circular", "square"])
@pytest.mark.parametrize("is_geo", [False, True])
def test_engines_agree(spark, mode, is_geo):
    cond, pa, res = random_layers(4)
    g = Grid(22, 19, (1 / 120, 0.0, 145.0, 0.0, -1 / 120, -41.0), True, "degrees") if is_geo else Grid(22, 19)
    params = Params(levels=(2, 4), window_mode=mode, outer_window=5)
    layers = {k: table.from_array(spark, v) for k, v in (("c", cond), ("pa", pa), ("res", res))}
    only = spark.createDataFrame([(r, c) for r in range(0, 22, 5) for c in range(0, 19, 4)], "row int, col int")
    out = [table.to_array(indicators.connectedness(layers["c"], g, params, pa=layers["pa"], pa_to_pa=True, resistance=layers["res"], sources_only=only, engine=e), g) for e in ("tiled", "relational")]
    assert np.isfinite(out[0]).any() and np.allclose(out[0], out[1], atol=1e-5, equal_nan=True)


def test_properties(spark):
    cond, _, _ = random_layers(9, 14, 14)
    params = Params(levels=(2, 4), option=1)
    plain = run(spark, cond.tolist(), params)
    assert (np.isnan(plain) == np.isnan(cond)).all()
    assert np.allclose(run(spark, cond.tolist(), params, resistance=(1 - cond).tolist()), plain, atol=1e-6, equal_nan=True)
    dear = run(spark, cond.tolist(), Params(levels=(2, 4), option=1, max_cost=4.0))
    assert (dear[~np.isnan(cond)] <= plain[~np.isnan(cond)] + 1e-6).all()
    assert np.nanmax(run(spark, np.where(np.isnan(cond), NAN, 0.0).tolist(), params)) == 0
    assert np.nanmax(run(spark, cond.tolist(), Params(levels=(2, 4), option=1, lambdas=()))) == 0


def test_empty_and_missing_input(spark):
    none = spark.createDataFrame([], "row int, col int, value double")
    assert indicators.connectedness(none, Grid(3, 3), SMALL).count() == 0
    assert np.isnan(run(spark, [[NAN, NAN]])).all()


def test_areas_of_interest(spark):
    cond, _, _ = random_layers(7, 16, 16)
    g = Grid(16, 16)
    cells = table.from_array(spark, cond)
    area = vector.box(spark, 4200, -9800, 9800, -4200)  # columns 4 to 9, rows 4 to 9
    whole = table.to_array(indicators.connectedness(cells, g, SMALL), g)
    opened = indicators.connectedness(cells, g, SMALL, polygon=area)
    rows = {(r.row, r.col): r.value for r in opened.collect()}
    assert set(rows) == {(r, c) for r in range(4, 10) for c in range(4, 10)}
    assert all((v is None and np.isnan(whole[k])) or abs(v - whole[k]) < 1e-6 for k, v in rows.items())
    shut = table.to_array(indicators.connectedness(cells, g, SMALL, polygon=area, closed_border=True), g)
    own = table.to_array(indicators.connectedness(cells.where("row BETWEEN 4 AND 9 AND col BETWEEN 4 AND 9"), g, SMALL), g)
    assert np.allclose(shut[4:10, 4:10], own[4:10, 4:10], atol=1e-6, equal_nan=True) and np.isnan(shut[:4]).all()
    with pytest.raises(ValueError):
        aoi.pixel_box(vector.box(spark, -9e6, -9e6, -8e6, -8e6), g)


def test_ring_shares_fill_the_disc(spark):
    g, params = Grid(50, 70), Params(levels=(2, 4, 8))
    cells = spark.range(3500).select((F.col("id") / 70).cast("int").alias("row"), (F.col("id") % 70).cast("int").alias("col"), F.lit(1.0).alias("cond"), F.lit(1.0).alias("trav"), F.lit(False).alias("protected"), F.lit(True).alias("source"))
    src = sources(cells).where("row = 20 AND col = 33")
    total = window(src, pyr.pyramid(cells, g, params.levels), g, params).agg(F.sum("area")).head()[0]
    x, y = np.meshgrid((np.arange(7000) + 0.5) / 100, (np.arange(5000) + 0.5) / 100)
    assert abs(total - ((x - 33.5) ** 2 + (y - 20.5) ** 2 <= 72**2).mean() * 3500) < 1


def test_circle_facts(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    within = lambda sides, r: geo.circle_overlap(*sides, tuple(geo.arc(t, r) for t in sides), r)
    row = spark.range(1).select(
        within(lit(-1, 1, -1, 1), F.lit(3.0)).alias("inside"), within(lit(0, 3, 0, 3), F.lit(3.0)).alias("quarter"),
        geo.meets_circle(*lit(-0.5, 0.5, 2.5, 3.5, 0, 0), 3.0).alias("rim"), geo.meets_circle(*lit(-0.5, 0.5, 0.5, 1.5, 0, 0), 3.0).alias("core"),
        geo.haversine(*lit(0, 0, 1, 0)).alias("degree"), geo.quantised(F.lit(0.125)).alias("half"),
    ).head()
    assert abs(row.inside - 4) < 1e-12 and abs(row.quarter - math.pi * 9 / 4) < 1e-12 and row.rim and not row.core
    assert abs(row.degree - 111194.927) < 0.01 and row.half == 13


def test_area_weights_use_their_rows(spark):
    g = Grid(2, 1, (1.0, 0.0, 0.0, 0.0, -1.0, 80.0), True)
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0)], "row int, col int, cond double")
    got = {r.gi: r.area for r in pyr.overview(cells, [1], area=pyr.area(g, "cond")).collect()}
    assert abs(got[0] - math.cos(math.radians(79.5))) < 1e-6 and abs(got[1] - math.cos(math.radians(78.5))) < 1e-6


def test_paths_sum_what_they_pass(spark):
    edges = spark.createDataFrame([(0, 0, 1, 3.0, 2.0), (0, 1, 2, 5.0, 4.0), (0, 0, 2, 9.0, 7.0)], "src long, u long, v long, adj double, geo double")
    src = spark.createDataFrame([(0,)], "src long")
    for found in (paths.solved(edges), paths.paths_by_rounds(edges, src), paths.staged(edges, src, [0])):
        assert {r.node: (r.adj, r.geo) for r in found.collect()} == {1: (3.0, 2.0), 2: (8.0, 6.0)}


def test_staged_paths_equal_those_of_blocks(spark):
    cond, _, res = random_layers(6)
    g = Grid(22, 19, (1 / 120, 0.0, 145.0, 0.0, -1 / 120, -41.0), True, "degrees")
    cells = surfaces.prepared(surfaces.aligned(table.from_array(spark, cond), None, table.from_array(spark, res)), False)
    only = spark.createDataFrame([(r, c) for r in range(0, 22, 3) for c in range(19)], "row int, col int")
    params = Params(levels=(2, 4), outer_window=5)
    blocks, levels = (indicators.targets(cells, g, params, False, only, engine=e, rows=12)[2].collect() for e in ("relational", "staged"))
    a, b = ({(r.src, r.node): (r.adj, r.geo) for r in found} for found in (blocks, levels))
    assert len(a) == len(blocks) == len(levels) > 1000 and a.keys() == b.keys()
    assert np.allclose([a[k] for k in a], [b[k] for k in a])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("staged_")]
    with pytest.raises(RuntimeError):
        links = spark.createDataFrame([(0, i, i + 1, 1.0, 1.0) for i in range(6)], "src long, u long, v long, adj double, geo double")
        paths.staged(links, spark.createDataFrame([(0,)], "src long"), [0], most=3)


def test_staged_rounds_shuffle_only_what_moved(spark):
    links = spark.createDataFrame([(0, i, i + 1, 1.0, 1.0) for i in range(6)], "src long, u long, v long, adj double, geo double")
    work = paths._Tables(links, ("src", "node"), "staged-test")
    flat = links.select("src", "u", "v", F.lit(100).cast("long").alias("q_adj"), F.col("adj").alias("km"), F.lit(100).cast("long").alias("q_geo"))
    known = spark.createDataFrame([(0, 0, (0, 0.0), 0, True, True)], "src long, node long, adj struct<cost: long, total: double>, geo long, moved_adj boolean, moved_geo boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        best, within = work.write(known, "known", work.keys), work.write(flat, "links", ("src", "u"))
        new = paths._onward(best.where("moved_adj"), within).withColumnsRenamed({"adj": "new_adj", "geo": "new_geo"})
        plan = best.join(new, ["src", "node"], "full")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for place in list(work.names):
            work.forget(place)
    # that of the aggregation, by target
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_coverage(spark):
    g = Grid(2, 2, (1.0, 0.0, 0.0, 0.0, -1.0, 2.0))
    read = lambda p: np.nan_to_num(table.to_array(coverage.pixel_coverage(p, g), g))
    assert np.allclose(read(vector.polygons(spark, [[[(0, 2), (2, 2), (0, 0)]]])), [[1, 0.5], [0.5, 0]])
    frame = [[(0, 0), (2, 0), (2, 2), (0, 2)], [(0.5, 0.5), (0.5, 1.5), (1.5, 1.5), (1.5, 0.5)]]
    assert np.allclose(read(vector.polygons(spark, [frame])), 0.75)
    assert coverage.pixel_coverage(vector.box(spark, 5, 5, 6, 6), g).count() == 0
    assert coverage.pixel_coverage(vector.polygons(spark, []), g).count() == 0
    rng = np.random.default_rng(1)
    g = Grid(6, 7, (1.0, 0.0, 0.0, 0.0, -1.0, 6.0))
    for _ in range(3):  # a star around a point, some of it off the grid, against clipping each pixel
        turn = np.sort(rng.random(9)) * 2 * np.pi
        ring = [(float(3.3 + r * np.cos(t)), float(3.1 + r * np.sin(t))) for t, r in zip(turn, 1 + 3 * rng.random(9), strict=True)]
        p = vector.polygons(spark, [[ring]])
        got = np.nan_to_num(table.to_array(coverage.pixel_coverage(p, g), g))
        pixels = spark.range(42).select((F.col("id") / 7).cast("int").alias("row"), (F.col("id") % 7).cast("int").alias("col")).crossJoin(p.select("vertices"))
        x0, y1 = F.col("col").cast("double"), 6.0 - F.col("row").cast("double")
        want = table.to_array(pixels.select("row", "col", shoelace(clip_to_box(F.col("vertices"), x0, x0 + 1, y1 - 1, y1)).alias("value")), g)
        assert np.allclose(got, want, atol=1e-6)
        touched = {(r.row, r.col) for r in aoi.touched(p, g).collect()}
        assert {tuple(x) for x in np.argwhere(want > 1e-9).tolist()} <= touched


def test_coverage_of_overlapping_polygons(spark):
    g = Grid(4, 5, (1.0, 0.0, 0.0, 0.0, -1.0, 4.0))
    read = lambda p: np.nan_to_num(table.to_array(coverage.pixel_coverage(p, g), g))
    box = lambda x0, y0, x1, y1: [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]
    got = read(vector.polygons(spark, [box(0.25, 3.25, 0.75, 3.75), box(0.5, 3.0, 1.0, 3.5), box(0.25, 3.25, 0.75, 3.75)]))
    assert abs(got[0, 0] - 0.4375) < 1e-6 and got.sum() == got[0, 0]
    got = read(vector.polygons(spark, [[[(0, 0), (1, 0), (0, 1)]], [[(0, 0), (1, 0), (1, 1)]]]))
    assert abs(got[3, 0] - 0.75) < 1e-6
    # a frame, a polygon in its hole and one over both, against points
    rng = np.random.default_rng(6)
    rings = [[[(0.3, 0.2), (4.6, 0.4), (4.4, 3.7), (0.5, 3.8)], [(1.2, 1.1), (1.3, 3.1), (3.4, 3.2), (3.6, 0.9)]], [[(1.5, 1.4), (2.9, 1.6), (2.2, 2.8)]]]
    rings += [[[tuple(map(float, v)) for v in rng.random((3, 2)) * (5, 4)]] for _ in range(4)]
    k = 200
    x, y = np.meshgrid((np.arange(5 * k) + 0.5) / k, 4 - (np.arange(4 * k) + 0.5) / k)
    covered = np.zeros(x.shape, bool)
    for polygon in rings:
        odd = np.zeros(x.shape, bool)
        for ring in polygon:
            for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
                if ay != by:
                    odd ^= ((ay > y) != (by > y)) & (x < ax + (bx - ax) * (y - ay) / (by - ay))
        covered |= odd
    want = covered.reshape(4, k, 5, k).mean(axis=(1, 3))
    assert np.allclose(read(vector.polygons(spark, rings)), want, atol=2e-3)


def test_levels_and_parameters():
    assert [nearest_power_of_two(x) for x in (3, 5, 6, 7, 12, 24, 33, 48, 49)] == [2, 4, 4, 8, 8, 16, 32, 32, 64]
    assert pyramid_levels([2, 4, 8]) == [1, 2, 4, 8] and window_mode(" Circular ") == "circular"
    for bad in (lambda: pyramid_levels([4]), lambda: Params(window_size=4), lambda: Params(option=4), lambda: window_mode("oval"), lambda: nearest_power_of_two(0), lambda: Params(margin_px=10_000)):
        with pytest.raises(ValueError):
            bad()
    assert Params(window_size=11, outer_window=5).outer_window == 11
    with pytest.raises(ValueError):
        Grid(2, 2).require_same_shape(Grid(2, 3), "the resistance")


def test_breaks_and_tiles(spark):
    assert tiles.aligned_breaks(516, 4, 32) == [0, 128, 256, 384, 516] and tiles.aligned_breaks(588, 4, 32) == [0, 160, 288, 448, 588]
    with pytest.raises(ValueError):
        tiles.aligned_breaks(32, 2, 32)
    g = Grid(8, 8)
    cells = table.from_array(spark, np.where(np.arange(64).reshape(8, 8) < 32, 1.0, NAN))
    plan = tiles.make_tiles(cells, g, 2, 2, align_to=2, balanced=True).orderBy("id").collect()
    assert [(r.row_start, r.row_stop) for r in plan][::2] == [(0, 2), (2, 8)] and abs(sum(r.cost for r in plan) - 38.4) < 1e-9
    one = tiles.make_tile(cells, g, 2, 2, 3)
    assert one.head().id == 3 and aoi.pixel_box(tiles.tile_polygon(one), g) == (4, 8, 4, 8)


def test_resolution_table(spark):
    g = Grid(516, 588, (1 / 120, 0.0, 143.8, 0.0, -1 / 120, -39.4), True)
    rows = tiles.resolution_info(spark, g, outer_window=9).collect()
    assert [(r.level, r.width, r.height, r.reach_text) for r in rows][:3] == [(1, 588, 516, "8.349 km"), (2, 294, 258, "16.7 km"), (4, 147, 129, "33.4 km")]
    assert [r.note for r in rows].count("small grid; review") == 4


def test_rasters(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = rng.random((150, 90)).astype(np.float32)
    values[rng.random((150, 90)) < 0.1] = NAN
    g = Grid(150, 90, (30.0, 0.0, 5e5, 0.0, -30.0, 6e6), False, nodata=-9999.0, crs="EPSG:28355")
    path = f"{tmp_path}/a.tif"
    geotiff.write_geotiff(table.from_array(spark, values), g, path)
    cells, back = geotiff.read_geotiff(spark, path)
    assert (back.nrows, back.ncols, back.transform, back.is_geo, back.nodata, back.crs) == (150, 90, g.transform, False, -9999.0, "EPSG:28355")
    assert np.array_equal(table.to_array(cells, back), values, equal_nan=True)
    table.write_cells(cells, back, f"{tmp_path}/cells", tile=32)
    part, _ = table.read_cells(spark, f"{tmp_path}/cells", (40, 70), (10, 20))
    assert part.count() == 300 and np.array_equal(table.to_array(part, back)[40:70, 10:20], values[40:70, 10:20], equal_nan=True)
    area = vector.box(spark, 5e5 + 600, 6e6 - 1500, 5e5 + 900, 6e6 - 1200)
    found = rasters.read_raster(spark, path, area, (2,), scale=2.0, expand_px=1)
    assert found.box == (30, 60, 10, 40) and found.cells.where("NOT masked").count() == np.isfinite(values[39:51, 19:31]).sum()
    assert rasters.read_raster(spark, path, area, (2,), closed=True).cells.where("value IS NOT NULL").count() == np.isfinite(values[40:50, 20:30]).sum()


def test_functions_by_path(spark, tmp_path):
    import terrascape as ts

    cond, pa, res = random_layers(4)[:3]
    n, m = np.asarray(cond, float).shape
    g = Grid(n, m, (1000.0, 0.0, 5e5, 0.0, -1000.0, 6e6), False, crs="EPSG:28355")
    files = {}
    for name, layer in (("cond", cond), ("pa", pa), ("res", res)):
        files[name] = f"{tmp_path}/{name}.tif"
        geotiff.write_geotiff(table.from_array(spark, layer), g, files[name])
    p = Params(levels=(2, 4))
    same = lambda a, b: np.allclose(table.to_array(a, g), table.to_array(b, g), equal_nan=True, atol=1e-6)
    layers = {k: table.from_array(spark, np.asarray(v, np.float32)) for k, v in (("c", cond), ("p", pa), ("r", res))}
    got = ts.connectedness(spark, files["cond"], files["pa"], levels=(2, 4), filename=f"{tmp_path}/out")
    assert same(got, indicators.connectedness(layers["c"], g, p, pa=layers["p"]))
    back, grid = table.read_cells(spark, f"{tmp_path}/out")
    assert same(got, back) and grid.crs == "EPSG:28355"
    if np.isnan(np.asarray(res, float)[~np.isnan(np.asarray(cond, float))]).any():
        with pytest.warns(UserWarning, match="no resistance"):
            got = ts.connectedness(spark, files["cond"], resistance_file=files["res"], levels=(2, 4))
    else:
        got = ts.connectedness(spark, files["cond"], resistance_file=files["res"], levels=(2, 4))
    assert same(got, indicators.connectedness(layers["c"], g, p, resistance=layers["r"]))
    assert ts.beri(spark, files["cond"], files["pa"], [files["res"]], levels=(2, 4)).count() == n * m
    table.write_cells(table.from_array(spark, [[0.5]]), Grid(1, 1), f"{tmp_path}/one")
    with pytest.raises(ValueError, match="cells"):
        ts.connectedness(spark, files["cond"], f"{tmp_path}/one")
    table.write_cells(layers["p"], Grid(n, m, g.transform, False, crs="EPSG:3577"), f"{tmp_path}/other")
    with pytest.raises(ValueError, match="reproject"):
        ts.connectedness(spark, files["cond"], f"{tmp_path}/other")
    foreign = vector.box(spark, 5e5, 6e6 - 3000, 5e5 + 3000, 6e6).withColumn("crs", F.lit("urn:ogc:def:crs:EPSG::1"))
    with pytest.raises(ValueError, match="no projection"):
        ts.connectedness(spark, files["cond"], polygon_mask=foreign)
    with pytest.raises(ValueError, match="no projection"):
        ts.pixel_coverage(spark, foreign, files["cond"])
    assert ts.pixel_coverage(spark, foreign.withColumn("crs", F.lit("EPSG:28355")), files["cond"]).count() == 9
    assert ts.make_tiles(spark, files["cond"], 2, 2).count() == 4 and ts.make_tile(spark, files["cond"], 2, 2, 1).count() == 1
    assert ts.resolution_info(spark, files["cond"], [1, 2]).count() == 2


def test_bands_of_cell_tables_are_stored(spark, tmp_path):
    cells = table.from_array(spark, np.arange(4000.0).reshape(100, 40))
    table.write_cells(cells, Grid(100, 40), f"{tmp_path}/t", tile=32)
    assert table.read_cells(spark, f"{tmp_path}/t", (60, 80))[0].count() == 20 * 40
    area = vector.box(spark, 5000, -79000, 8000, -61000)
    assert rasters.read_raster(spark, f"{tmp_path}/t", area, (2,), closed=True).cells.where("value IS NOT NULL").count() == 18 * 3


def test_paths_end_or_say_that_they_do_not(spark):
    edges = spark.createDataFrame([(0, i, i + 1, 1.0, 1.0) for i in range(6)] + [(0, 0, 6, 99.0, 99.0)], "src long, u long, v long, adj double, geo double")
    start = spark.createDataFrame([(0,)], "src long")
    got = {r.node: (r.cost, r.total) for r in paths.relaxed(edges, start, "adj").collect()}
    assert got == {i: (100 * i, float(i)) for i in range(1, 7)}
    with pytest.raises(RuntimeError):
        paths.relaxed(edges, start, "adj", most=3)


def test_folder_of_geojson(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.json").write_text('{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:28355"}}, "features": [' + ", ".join('{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0,0],[2,0],[2,2],[0,0]]]}}' for _ in range(2)) + "]}")
    rows = vector.read_geojson(spark, str(tmp_path)).collect()
    assert len(rows) == 10 and len({r.poly_id for r in rows}) == 10 and {r.crs for r in rows} == {"EPSG:28355"}
    assert [vector.epsg(x) for x in ("urn:ogc:def:crs:EPSG::4326", "urn:ogc:def:crs:OGC:1.3:CRS84", None, "epsg:3577")] == ["EPSG:4326", "EPSG:4326", None, "EPSG:3577"]


def test_predictors_and_tiles():
    import struct
    import zlib

    data = np.arange(32 * 32, dtype="<f4").reshape(32, 32) * 1.5
    planes = np.ascontiguousarray(data.astype(">f4")).view(np.uint8).reshape(32, 32, 4).transpose(0, 2, 1).reshape(32, -1)
    coded = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8)
    raw = zlib.compress(coded.tobytes())
    fields = [(256, 3, 32), (257, 3, 32), (258, 3, 32), (259, 3, 8), (277, 3, 1), (317, 3, 3), (322, 3, 32), (323, 3, 32), (324, 4, 8 + 2 + 12 * 11 + 4), (325, 4, len(raw)), (339, 3, 3)]
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields))
    head += b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I" if k == 4 else "<HH", *((v,) if k == 4 else (v, 0))) for t, k, v in fields) + struct.pack("<I", 0)
    (row, col, block), *more = geotiff.blocks(head + raw)
    assert (row, col, more) == (0, 0, []) and np.array_equal(block[:, :, 0].astype("<f4"), data)


def test_geojson_and_names(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[2,0],[2,2],[0,0]],[[0.5,0.2],[1,0.2],[1,0.4],[0.5,0.2]]], [[[5,5],[6,5],[6,6],[5,5]]]]}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 1]}}]}')
    rows = vector.read_geojson(spark, str(tmp_path / "a.json")).collect()
    assert sorted((r.ring_id, r.is_hole, len(r.vertices)) for r in rows) == [(0, False, 4), (0, False, 4), (1, True, 4)]
    assert datasets.example_data_path("transgrids/1990", "/d") == "/d/transgrids/1990.tif"
    with pytest.raises(ValueError):
        datasets.example_data_path("nothing")


def test_surfaces(spark):
    df = spark.createDataFrame([(0, 0, 0.5, 0.7, 0.2), (0, 1, 0.5, None, None), (0, 2, None, 0.9, 0.1), (0, 3, float("inf"), 0.0, 2.0), (0, 4, 0.4, 0.0, 2.0)], "row int, col int, cond double, pa double, res double")
    got = {r.col: r for r in surfaces.prepared(df, True).collect()}
    assert (round(got[0].cond, 6), round(got[0].trav, 6), got[0].source) == (0.7, 0.8, True)
    assert [got[c].cond for c in (1, 2, 3)] == [None] * 3 and got[4].trav == 0 and not got[4].source
    assert surfaces.resistance_gaps(df).head().gaps == 1
