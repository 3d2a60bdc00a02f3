"""The indicators: connectedness, its protected-area form, and climate resilience.

Inputs are cell tables (row, col, value) with a Grid; results are row, col, value, null where a
cell is no source. engine 'relational' makes each step a join or an aggregation of DataFrames,
but for the paths of a block of sources, which a task relaxes together; 'staged' joins and
aggregates for paths too, level by level, and takes sources in batches of rows; 'tiled' solves all
of a tile of sources in a task and is the faster one for large rasters.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from terrascape.grid import Grid, Params
from terrascape.operators import aoi, graph, metrics, paths, surfaces, tiled
from terrascape.operators.pyramid import band_overview, gathered, pyramid, with_scenarios
from terrascape.operators.window import seen, sources, window
from terrascape.sources.cells import shared_dir, stored

#: Sources whose paths the staged engine settles at a time.
TOGETHER = 1 << 20


def _areas(cells: DataFrame, grid: Grid, polygon: DataFrame | None, closed: bool) -> DataFrame:
    """Cells with valid false outside the area of interest's core; closed: cells outside lose their values."""
    if polygon is None:
        return cells
    out = aoi.marked(cells, aoi.cover(polygon, grid), "inside")
    if closed:
        out = out.withColumn("cond", F.when(F.col("inside"), F.col("cond")))
    return out.withColumn("source", F.col("source") & F.col("inside")).drop("inside")


def _output(values: DataFrame, cells: DataFrame, grid: Grid, polygon: DataFrame | None, closed: bool) -> DataFrame:
    """All cells with their values; with an open area of interest, those of its bounding box."""
    every = cells.select("row", "col")
    if polygon is not None and not closed:
        every = aoi.crop(every, polygon, grid)
    return every.join(values, ["row", "col"], "left").withColumn("value", F.col("value").cast("float"))


def _prepare(condition, grid, pa, resistance, scale, resistance_scale, polygon, closed_border):
    pair = scale if isinstance(scale, tuple) else (scale, None)
    cells = surfaces.aligned(condition, pa, resistance)
    cells = cells.withColumns({"cond": surfaces.rescaled(F.col("cond"), pair[0]), "pa": surfaces.rescaled(F.col("pa"), pair[1]), "res": surfaces.rescaled(F.col("res"), resistance_scale)})
    # gaps are counted as the cells are written, not by a scan of their own
    facts = Observation()
    if resistance is not None:
        cells = cells.observe(facts, surfaces.gaps().alias("gaps"))
    out = stored(_areas(surfaces.prepared(cells, pa is not None), grid, polygon, closed_border), "cells")
    if resistance is not None and facts.get["gaps"]:
        warnings.warn(f"{facts.get['gaps']} cells have a condition and no resistance; the condition takes its place there", stacklevel=3)
    return out


def _reached(src: DataFrame, nodes: DataFrame, grid: Grid, params: Params, pa_to_pa: bool, engine: str) -> DataFrame:
    """What each source reaches, with its adjusted and intact distance."""
    links = graph.edges(nodes, grid, params.max_cost, params.levels[-1])
    found = paths.staged(links, src, params.levels) if engine == "staged" else paths.solved(links)
    alone = graph.isolated(nodes, grid, params.max_cost)
    far = found.join(alone.select("src"), "src", "left_anti")
    return far if pa_to_pa else far.unionByName(alone)


def _sources(cells: DataFrame, only: DataFrame | None) -> DataFrame:
    src = sources(cells)
    return src if only is None else src.join(only, ["row", "col"], "left_semi").select("src", "row", "col")


def targets(cells: DataFrame, grid: Grid, params: Params, pa_to_pa: bool = False, only: DataFrame | None = None, engine: str = "relational", rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, nodes (written, as links, targets and sums all take them), and what each source reaches with its adjusted and intact distance; only: (row, col) of sources to take.

    engine 'staged': sources of `rows` rows of the grid at a time (None: about TOGETHER sources),
    so that links, which are the most, are there for one batch only; nodes and what they reach are kept.
    """
    pyr = pyramid(cells, grid, params.levels)
    src = _sources(cells, only)
    if engine != "staged":
        nodes = stored(window(src, pyr, grid, params, pa_to_pa), "nodes")
        return src, nodes, _reached(src, nodes, grid, params, pa_to_pa, engine)
    spark, path = cells.sparkSession, f"{shared_dir(cells.sparkSession)}/batches-{uuid.uuid4().hex}"
    pyr, rows = stored(pyr, "pyramid"), rows or max(1, TOGETHER // grid.ncols)

    def kept(df: DataFrame, name: str, first: int) -> DataFrame:
        df.write.parquet(f"{path}/{name}/batch={first}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}/batch={first}")

    for first in range(0, grid.nrows, rows):
        some = src.where(F.col("row").between(first, first + rows - 1))
        nodes = kept(window(some, pyr, grid, params, pa_to_pa), "nodes", first)
        far = kept(_reached(some, nodes, grid, params, pa_to_pa, engine), "far", first)
    every = lambda df, name: spark.read.schema(df.schema).parquet(f"{path}/{name}").drop("batch")
    return src, every(nodes, "nodes"), every(far, "far")


def connectedness(
    condition: DataFrame,
    grid: Grid,
    params: Params = Params(),
    *,
    pa: DataFrame | None = None,
    pa_to_pa: bool = False,
    resistance: DataFrame | None = None,
    scale: float | tuple[float | None, float | None] | None = None,
    resistance_scale: float | None = None,
    polygon: DataFrame | None = None,
    closed_border: bool = False,
    engine: str = "relational",
    sources_only: DataFrame | None = None,
) -> DataFrame:
    """Connected habitat of each cell or, with pa, connectedness of protected cells.

    Null cells have null results; a cell that reaches nothing has 0. pa_to_pa counts protected
    targets only and does nothing without pa. params.option is for connected habitat alone.
    """
    pa_to_pa = pa_to_pa and pa is not None
    cells = _prepare(condition, grid, pa, resistance, scale, resistance_scale, polygon, closed_border)
    if engine != "tiled":
        src, nodes, far = targets(cells, grid, params, pa_to_pa, sources_only, engine)
        reach = far.join(nodes.select("src", "node", "cond", "pa", "area"), ["src", "node"])
        values = metrics.scale_mean(metrics.connectedness(reach, params.lambdas), src)
    else:
        own = cells.where("source AND cond IS NOT NULL").select("row", "col")
        own = own if sources_only is None else own.join(sources_only, ["row", "col"], "left_semi")
        values = tiled.tiled(own, pyramid(cells, grid, params.levels), grid, params, pa_to_pa)
    if pa is None:
        cond = cells.select("row", "col", "cond")
        values = values.join(cond, ["row", "col"]).select("row", "col", surfaces.connected_habitat(F.col("value"), F.col("cond"), params.option).alias("value"))
    return _output(values, cells, grid, polygon, closed_border)


def beri(
    condition: DataFrame,
    scenarios: Sequence[DataFrame],
    grid: Grid,
    bands: int,
    params: Params = Params(),
    *,
    resistance: DataFrame | None = None,
    scale: float | None = None,
    resistance_scale: float | None = None,
    polygon: DataFrame | None = None,
    closed_border: bool = False,
    engine: str = "relational",
    sources_only: DataFrame | None = None,
) -> DataFrame:
    """Resilience of each cell under scenarios, each (row, col, bands array), the present climate first."""
    if not scenarios:
        raise ValueError("the present climate is needed")
    cells = _prepare(condition, grid, None, resistance, scale[0] if isinstance(scale, tuple) else scale, resistance_scale, polygon, closed_border)
    layers = [band_overview(s, params.levels, bands) for s in scenarios]
    present = scenarios[0].select("row", "col", F.transform("bands", lambda x: x.cast("double")).alias("bands"))
    if engine == "relational":
        pyr, src = pyramid(cells, grid, params.levels), _sources(cells, sources_only)
        nodes, met = window(src, pyr, grid, params), seen(pyr, src, grid, params, metrics.BLOCK)
        sims = metrics.reached_similarities(nodes, met, present, gathered(layers), grid, params, len(layers), bands)
        values = metrics.scale_mean(metrics.beri(sims, params.lambdas), src)
    elif engine != "tiled":
        src, nodes, far = targets(cells, grid, params, False, sources_only, engine)
        at = far.join(nodes.select("src", "node", "row", "col", "level", "gi", "gj", "cond", "area"), ["src", "node"])
        sims = metrics.similarities(at, nodes, present, gathered(layers), len(layers), bands)
        values = metrics.scale_mean(metrics.beri(sims, params.lambdas), src)
    else:
        own = cells.where("source AND cond IS NOT NULL").select("row", "col")
        own = own if sources_only is None else own.join(sources_only, ["row", "col"], "left_semi")
        own = own.join(present, ["row", "col"], "left")
        values = tiled.tiled(own, with_scenarios(pyramid(cells, grid, params.levels), layers), grid, params, False, len(scenarios), bands)
    return _output(values, cells, grid, polygon, closed_border)
