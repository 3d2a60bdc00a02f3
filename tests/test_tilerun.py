"""Tiled runs that are stopped, versions of cell tables, folded overviews and window templates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascape.grid import Grid, Params
from terrascape.operators import pyramid as pyr
from terrascape.operators import window
from terrascape.plans import indicators, tilerun
from terrascape.sources import cells as table

PARAMS = Params(levels=(2,), lambdas=(2.0,), window_size=3, outer_window=3)


def random_cells(spark, rows, cols, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.random((rows, cols)).round(2)
    v[rng.random((rows, cols)) < 0.15] = np.nan
    return table.from_array(spark, v)


def test_a_stopped_run_is_taken_up(spark, tmp_path, monkeypatch):
    grid = Grid(36, 30)
    cells = random_cells(spark, 36, 30)
    table.write_cells(cells, grid, f"{tmp_path}/cond", 8)
    whole = {(r.row, r.col): r.value for r in indicators.connectedness(cells, grid, PARAMS).collect()}
    real, settled = tilerun._settle, []

    def settle(spark, condition, out, batch, *rest):
        if len(settled) == 2:
            raise KeyboardInterrupt
        settled.append([t["id"] for t in batch])
        real(spark, condition, out, batch, *rest)

    monkeypatch.setattr(tilerun, "_settle", settle)
    with pytest.raises(KeyboardInterrupt):
        tilerun.run(spark, f"{tmp_path}/cond", f"{tmp_path}/out", 3, 2, PARAMS, together=1)
    assert tilerun.done(spark, f"{tmp_path}/out") == {0, 1} and 0 < tilerun.values(spark, f"{tmp_path}/out").count() < len(whole)
    # a tile that was written but not noted is written again
    spark.createDataFrame([(1, 1, 9.0, 3)], "row int, col int, value float, tile int").write.mode("append").partitionBy("tile").parquet(f"{tmp_path}/out/values")
    settled.clear()
    monkeypatch.setattr(tilerun, "_settle", lambda *a: (settled.append([t["id"] for t in a[3]]), real(*a)))
    got = tilerun.run(spark, f"{tmp_path}/cond", f"{tmp_path}/out", 3, 2, PARAMS, together=2).collect()
    assert settled == [[2, 3], [4, 5]]
    assert len(got) == len(whole) and {(r.row, r.col): r.value for r in got} == whole
    settled.clear()
    assert tilerun.run(spark, f"{tmp_path}/cond", f"{tmp_path}/out", 3, 2, PARAMS).count() == len(whole) and not settled
    with pytest.raises(ValueError):
        tilerun.run(spark, f"{tmp_path}/cond", f"{tmp_path}/out", 3, 1, PARAMS)


def test_an_aborted_write_leaves_the_old_table(spark, tmp_path):
    path, grid = f"{tmp_path}/t", Grid(4, 5)
    table.write_cells(random_cells(spark, 4, 5), grid, path)
    before = table.read_cells(spark, path)[0].count()
    bad = random_cells(spark, 4, 5).withColumn("value", F.when(F.col("row") == 3, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        table.write_cells(bad, Grid(9, 9), path)
    cells, read = table.read_cells(spark, path)
    assert (cells.count(), read.nrows) == (before, 4) and len(table.versions(spark, path)) == 1
    table.write_cells(random_cells(spark, 6, 5, 2), Grid(6, 5), path)
    assert cells.count() == before  # who has read the old version still can
    assert table.read_cells(spark, path)[1].nrows == 6 and len(table.versions(spark, path)) == 2
    table.drop_old_versions(spark, path)
    assert table.read_cells(spark, path)[0].count() == 30
    with pytest.raises(Exception):
        cells.count()


def test_overviews_are_folded(spark):
    cells = random_cells(spark, 21, 19, 3).withColumn("bands", F.array("value", F.col("row").cast("double")))
    geo = Grid(21, 19, (0.5, 0.0, 10.0, 0.0, -0.5, 40.0), True)
    for levels in ((1, 2, 4, 8), (2, 6), (3, 2)):
        found = pyr.overview(cells, levels, a=pyr.average("value"), n=pyr.count("value"), s=pyr.total("value"), w=pyr.area(geo, "value"), every=pyr.rows())
        plain = [(v, *r) for v in levels for r in cells.groupBy(F.floor(F.col("row") / v), F.floor(F.col("col") / v)).agg(F.avg("value"), F.count("value"), F.sum("value"), F.count("*")).collect()]
        got = {(r.level, r.gi, r.gj): (r.a, r.n or 0, r.s, r.every) for r in found.collect()}
        assert set(got) == {p[:3] for p in plain}
        for v, i, j, *want in plain:
            assert got[v, i, j] == pytest.approx(want) if want[0] is not None else got[v, i, j][:3] == (None, 0, None)
        bands = {(r.level, r.gi, r.gj): r.bands for r in pyr.band_overview(cells, levels, 2).collect()}
        assert all(bands[p[:3]][0] == pytest.approx(p[3]) for p in plain if p[3] is not None)
    plan = pyr.overview(cells, (1, 2, 4), a=pyr.average("value"))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert len({line.strip() for line in text.split("Initial Plan")[0].splitlines() if " Exchange " in line}) <= 3  # one shuffle, which all levels read


@pytest.mark.parametrize("mode", ["circular", "square"])
def test_templates_give_the_same_windows(spark, mode):
    params = Params(levels=(2, 4), window_size=3, outer_window=5, window_mode=mode)
    grid = Grid(70, 66)
    assert min(grid.nrows, grid.ncols) > 2 * (params.reach + 4)
    src = spark.range(70 * 66).select(F.col("id").alias("src"), F.floor(F.col("id") / 66).cast("int").alias("row"), (F.col("id") % 66).cast("int").alias("col")).where("row % 3 = 0 OR row BETWEEN 30 AND 36")
    names = [c for c in ("src", "level", "gi", "gj", "fraction", "rim") if c != "rim" or mode == "circular"]
    a, b = window.rings(src, grid, params).select(*names), window._ring(src, grid, params).select(*names)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    assert window.rings(src.where("row BETWEEN 32 AND 34 AND col BETWEEN 32 AND 33"), grid, params).count() > 0
