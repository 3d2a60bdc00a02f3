"""Steps that grew faster than their input, or that larger and odd tables showed to be wrong."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascape.grid import Grid, Params
from terrascape.operators import aoi, metrics, overlay, window
from terrascape.plans import catalog
from terrascape.sources.vector import polygons

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode", ["circular", "square"])
def test_windows_along_borders_are_shared_and_not_broadcast(spark, mode):
    grid, params = Grid(90, 9), Params(levels=(1, 2), window_mode=mode)
    cells = spark.range(810).select(F.floor(F.col("id") / 9).cast("int").alias("row"), (F.col("id") % 9).cast("int").alias("col"))
    src = cells.select((F.col("row") * 1000 + F.col("col")).cast("long").alias("src"), "row", "col")
    found = window.rings(src, grid, params)
    key = lambda df: sorted(map(tuple, df.select(*found.columns).collect()))
    assert key(found) == key(window._ring(src, grid, params))
    pyramid = found.select("level", "gi", "gj").distinct().withColumns({c: F.lit(1.0) for c in ("cond", "weight", "trav", "pa")})
    assert "BroadcastExchange" not in plan(window.window(src, pyramid, grid, params))[1]


def test_similarities_of_blocks(spark):
    rnd = np.random.default_rng(4)
    bands = {(i, j): [None if rnd.random() < 0.02 else float(x) for x in rnd.random(3)] for i in range(20) for j in range(20) if rnd.random() < 0.9}
    present = spark.createDataFrame([(i, j, b) for (i, j), b in bands.items()], "row int, col int, bands array<double>")
    layers = spark.createDataFrame([(1, i, j, [b, None if i == 3 else [1.0 - (x or 0.0) for x in b]]) for (i, j), b in bands.items()], "level int, gi int, gj int, sim_bands array<array<double>>")
    rows = [(i * 100 + j, i, j, 1, i + a, j + b) for i in range(20) for j in range(20) for a, b in ((0, 1), (-2, 3))]
    targets = spark.createDataFrame(rows, "src long, row int, col int, level int, gi int, gj int")
    got = metrics.similarities(targets, targets, present, layers, 2, 3).collect()
    assert len(got) == len(rows)

    def like(a, b):
        return None if a is None or b is None or None in a or None in b else math.exp(-sum(abs(x - y) for x, y in zip(a, b)))

    for r in got:
        a, b = bands.get((r["row"], r["col"])), bands.get((r.gi, r.gj))
        want = [like(a, b), like(a, None if b is None or r.gi == 3 else [1.0 - (x or 0.0) for x in b])]
        assert r.sims == [None if w is None else pytest.approx(w) for w in want]


@tables
def test_masked_cells_without_a_value_equal_the_sql(spark, tmp_path):
    import duckdb

    os.symlink(f"{SF}/customer.parquet", tmp_path / "customer.parquet")
    rows = spark.range(128 * 60).select(F.col("id").alias("l_orderkey"), F.floor(F.col("id") / 128).alias("l_partkey"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("l_suppkey"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(f'SELECT "row", "col", value, masked FROM ({catalog.oracle_sql()["a5_masked_cells"]})').fetchall()
    got = catalog.QUERIES["a5_masked_cells"](spark, str(tmp_path)).select("row", "col", "value", "masked").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(v is None and not m for _, _, v, m in want)


def test_target_of_the_ratio_is_every_text_labelled_as_good(spark, tmp_path, monkeypatch):
    from terrascape.llm import queries
    from terrascape.llm.common import held_out

    spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(3).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(queries.llr, "log_ratios", lambda documents, trusted: seen.append(trusted.count()) or np.zeros(16))
    queries.op7_llr_rules(spark, str(tmp_path))
    assert seen == [spark.range(30_000).where(~held_out("id")).count()] and seen[0] > 12_000


def test_texts_that_labels_cannot_name_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Held-out texts stay where they are, and the join is the same at every size."""
    from terrascape.llm import llr, queries
    from terrascape.llm.common import held_out

    n = 300
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    texts = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one two"), F.col("id"), F.col("id") % 7).alias("text"))
    texts.union(spark.createDataFrame([(None, "no id"), (1, None)], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(queries.llr, "log_ratios", lambda documents, trusted: seen.append((documents, trusted)) or np.zeros(16))
    queries.op7_llr_rules(spark, str(tmp_path))
    monkeypatch.undo()
    ((documents, trusted),) = seen
    assert {r.doc_id for r in documents.where("learnable").collect()} - {None} == {r.id for r in spark.range(n).where(~held_out("id")).collect()}
    for most in ("-1", "1g"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            physical = plan(llr.trusted_texts(documents, trusted))[1]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert physical.count("ShuffledHashJoin") == 1 and "Broadcast" not in physical and "SortMergeJoin" not in physical
    assert llr.trusted_texts(documents, trusted).count() == trusted.count() + 1  # doc_id 1 has two rows
    assert np.array_equal(llr.log_ratios(documents, trusted), llr.log_ratios(documents.drop("learnable"), trusted))
    assert np.any(llr.log_ratios(documents, trusted))


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_equal_edges_and_polygons_count_once(spark):
    many = polygons(spark, [[box(0, 0, 3, 2)]] * 40 + [[box(0, 0, 3, 2)[::-1]]] + [[box(0, 0, 4, 4), box(1, 1, 2, 2)]] * 3)
    assert sorted(r.n for r in overlay.directed(many).collect()) == [3] * 8 + [41] * 4
    shapes = aoi.different(many)
    assert sorted((r.poly_id, r.is_hole) for r in shapes.collect()) == [(0, False), (40, False), (41, False), (41, True)]


@pytest.mark.parametrize("margin", [0.4, 2.5, 7.5])
def test_margin_without_comparing_pixels_and_edges(spark, margin):
    rnd, grid = random.Random(7), Grid(40, 50, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))
    shapes = [[[(rnd.uniform(-5, 55), rnd.uniform(-5, 45)) for _ in range(3)]] for _ in range(3)] + [[box(20, 20, 22, 23)]]
    cells = spark.range(2000).select(F.floor(F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"))
    found = aoi.near(cells, polygons(spark, shapes), grid, margin, "edge")
    assert plan(found)[0].count("Join") == 1  # pixels with blocks, and none with edges

    def apart(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    def meets(a, b, j, i):
        t0, t1 = 0.0, 1.0
        for p, d, low in ((a[0], b[0] - a[0], j), (a[1], b[1] - a[1], i)):
            if d == 0:
                if not low <= p <= low + 1:
                    return False
            else:
                u, v = sorted(((low - p) / d, (low + 1 - p) / d))
                t0, t1 = max(t0, u), min(t1, v)
        return t0 <= t1

    edges = [(a, b) for shape in shapes for ring in shape for a, b in zip(ring, ring[1:] + ring[:1])]
    for r in found.collect():
        i, j = r["row"], r["col"]
        least = min(0.0 if meets(a, b, j, i) else min([apart((j + x, i + y), a, b) for x in (0, 1) for y in (0, 1)] + [math.hypot(max(j - x, x - j - 1, 0), max(i - y, y - i - 1, 0)) for x, y in (a, b)]) for a, b in edges)
        assert r.edge == (least <= margin + 1e-9), (i, j, least)


@tables
def test_rings_are_clipped_and_reprojected_once(spark):
    assert plan(catalog.QUERIES["h6_h8_clipped_rings"](spark, SF))[0].count("zip_with") < 20
    assert "Join" not in plan(catalog.QUERIES["a13_reprojected"](spark, SF))[0]


@tables
@pytest.mark.parametrize("name", ["a5_masked_cells", "a8_touched_pixels"])
def test_plots_of_a_key_that_repeats_or_without_corners_equal_the_sql(spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    some = f"SELECT * FROM '{SF}/customer.parquet' WHERE c_custkey % 15 IN (0, 5, 7)"
    rows = {"repeated": f"{some} UNION ALL {some} UNION ALL SELECT * REPLACE ((c_nationkey + 1)::INT AS c_nationkey) FROM ({some}) WHERE c_custkey % 2 = 0", "unknown": f"SELECT * REPLACE (CASE WHEN c_custkey > 20 THEN c_nationkey END AS c_nationkey) FROM ({some})"}
    for kind, sql in rows.items():
        os.makedirs(tmp_path / kind)
        con.sql(f"COPY ({sql}) TO '{tmp_path}/{kind}/customer.parquet'")
        os.symlink(f"{SF}/lineitem.parquet", tmp_path / kind / "lineitem.parquet")
        con.sql(f"CREATE OR REPLACE VIEW customer AS SELECT * FROM '{tmp_path}/{kind}/customer.parquet'")
        got = catalog.QUERIES[name](spark, str(tmp_path / kind))
        want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), kind


def test_polygons_with_one_id_each_count(spark):
    """Holes take away from the polygon they lie in, and not from what covers them with the same id."""
    grid = Grid(24, 24, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))
    ringed, over = [box(0, 0, 20, 20), box(6, 6, 14, 14)], [box(3, 8, 24, 12)]
    apart = polygons(spark, [ringed, ringed, over])
    together = apart.withColumn("poly_id", F.lit(0).cast("long"))
    assert sorted(aoi.touched(together, grid).collect()) == sorted(aoi.touched(apart, grid).collect())


@pytest.mark.parametrize("mode, geo, levels", [("circular", False, (1, 2)), ("square", False, (1, 2)), ("circular", True, (1, 2, 4))])
def test_links_and_paths_of_a_block_equal_those_of_joins(spark, mode, geo, levels):
    """A block's nodes give the same paths as links that are joined and shuffled, and their bands the same likeness."""
    from terrascape.operators import paths, pyramid
    from terrascape.plans import indicators
    from terrascape.sources import cells as table

    rnd = np.random.default_rng(8)
    values = np.where(rnd.random((21, 26)) < 0.35, np.nan, rnd.random((21, 26)))
    values[:5, :5] = np.nan
    values[2, 2] = 0.4  # a source that stands alone
    grid = Grid(21, 26, (0.01, 0.0, 146.0, 0.0, -0.01, -42.0), True, unit="degrees") if geo else Grid(21, 26)
    params = Params(levels=levels, window_mode=mode)
    cells = indicators._prepare(table.from_array(spark, values), grid, None, None, None, None, None, False)
    src, nodes, far = indicators.targets(cells, grid, params)
    want = {(r.src, r.node): (r.adj, r.geo) for r in far.collect()}
    solved = paths.within(grid, params)(nodes.select("src", "node", "trav", "rim").toArrow())
    got = {(r["src"], r["node"]): (r["adj"], r["geo"]) for r in solved.to_pylist()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    alone = 1 << 48 | 2 << 24 | 2
    assert [k for k in got if k[0] == alone] == [(alone, alone)]
    bands = {(i, j): [float(x) for x in rnd.random(3)] for i in range(21) for j in range(26) if rnd.random() < 0.9}
    layers = [spark.createDataFrame([(i, j, [x * k for x in b]) for (i, j), b in bands.items()], "row int, col int, bands array<double>") for k in (1.0, 0.5)]
    known = pyramid.gathered([pyramid.band_overview(x, levels, 3) for x in layers])
    at = far.join(nodes.select("src", "node", "row", "col", "level", "gi", "gj", "cond", "area"), ["src", "node"])
    told = metrics.similarities(at, nodes, layers[0], known, 2, 3)
    found = metrics.reached_similarities(nodes, window.seen(nodes, src, grid, params, metrics.BLOCK), layers[0], known, grid, params, 2, 3)
    flat = lambda df: sorted((r.src, *(round(x, 9) for x in (r.adj, r.geo, r.cond, r.area)), *(-1 if s is None else round(s, 9) for s in r.sims)) for r in df.collect())
    assert flat(found) == flat(told)


def test_links_of_climate_resilience_are_not_shuffled(spark):
    """At size they and the paths were the most that went to disk: nodes and bands are shuffled to blocks, and a level's overview shares its shuffle."""
    from terrascape.plans import indicators

    cells = spark.range(1500).select(F.floor(F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col"))
    layers = [cells.withColumn("bands", F.array(F.col("row") * k / 50.0)) for k in (1, 2)]
    out = indicators.beri(cells.withColumn("value", F.lit(0.5)), layers, Grid(50, 30), 1, Params(levels=(2,), lambdas=(2.0,), option=1))
    assert out.where("value > 0").count() == 1500
    # queen neighbours were eight for each node; here nothing that grows with nodes is made before blocks take them
    optimized, physical = plan(out)
    assert "v_node" not in optimized and "FlatMapGroupsInArrow" not in physical and physical.count("FlatMapCoGroupsInArrow") == 1
