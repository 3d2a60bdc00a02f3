"""The public functions by path: read rasters, check that they fit, compute, and write the result.

Rasters are GeoTIFFs (.tif, .tiff) or cell tables (sources/cells.py); results are written as the
name says. Everything in between is the DataFrame functions of plans/indicators.py.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascape.grid import Grid, Params
from terrascape.operators import coverage, tiles
from terrascape.plans import indicators
from terrascape.sources.cells import write_cells
from terrascape.sources.geotiff import write_geotiff
from terrascape.sources.rasters import Raster, read_raster
from terrascape.sources.vector import fitted, read_geojson


def _polygon(spark: SparkSession, polygon: DataFrame | str | None) -> DataFrame | None:
    """Polygons as given, or of a GeoJSON file or folder by path."""
    return read_geojson(spark, polygon) if isinstance(polygon, str) else polygon


def _params(lambdas, max_cost, window_size, outer_window, window_mode, levels, option, margin_px) -> Params:
    if levels is None:
        raise ValueError("levels are needed")
    return Params(tuple(lambdas), max_cost, window_size, outer_window, window_mode, tuple(levels), option, margin_px)


def _read(spark: SparkSession, path: str, params: Params, polygon: DataFrame | None, closed: bool, scale: float | None, like: Raster | None = None, what: str = "") -> Raster:
    """A raster around the polygon; ValueError if its rows, columns or reference system aren't those of `like`."""
    found = read_raster(spark, path, polygon, params.levels[1:] or (1,), scale, params.outer_window, closed, params.margin_px)
    if like is not None:
        like.grid.require_same_shape(found.grid, what or path)
    return found


def _save(out: DataFrame, grid: Grid, filename: str) -> DataFrame:
    if filename.lower().endswith((".tif", ".tiff")):
        write_geotiff(out, grid, filename)
    elif filename:
        write_cells(out, grid, filename)
    return out


def connectedness(
    spark: SparkSession,
    condition_file: str,
    pa_file: str | None = None,
    pa_to_pa: bool = False,
    polygon_mask: DataFrame | str | None = None,
    closed_border: bool = False,
    margin_px: int | None = None,
    lambdas: Sequence[float] = (2, 20, 200),
    max_cost: float = 2.0,
    window_size: int = 3,
    outer_window: int = 9,
    window_mode: str = "circular",
    levels: Sequence[int] = (2, 4, 8, 16, 32),
    scale: float | tuple[float | None, float | None] | None = None,
    resistance_file: str | None = None,
    resistance_scale: float | None = None,
    option: int = 3,
    filename: str = "",
    engine: str = "tiled",
) -> DataFrame:
    """Connected habitat, or with pa_file connectedness of protected cells, of rasters by path: row, col, value; written to filename, if given.

    polygon_mask: polygons, or a GeoJSON path; those in another reference system are reprojected.
    Rasters of another shape or reference system than the condition's are refused before anything is computed.
    """
    params = _params(lambdas, max_cost, window_size, outer_window, window_mode, levels, option, margin_px)
    pair = scale if isinstance(scale, tuple) else (scale, None)
    polygon_mask = _polygon(spark, polygon_mask)
    cond = _read(spark, condition_file, params, polygon_mask, closed_border, pair[0])
    polygon_mask = polygon_mask if polygon_mask is None else fitted(polygon_mask, cond.grid)
    pa = _read(spark, pa_file, params, polygon_mask, closed_border, pair[1], cond).cells if pa_file else None
    res = _read(spark, resistance_file, params, polygon_mask, closed_border, resistance_scale, cond).cells if resistance_file else None
    out = indicators.connectedness(cond.cells, cond.grid, params, pa=pa, pa_to_pa=pa_to_pa, resistance=res, polygon=polygon_mask, closed_border=closed_border, engine=engine)
    return _save(out, cond.grid, filename)


def beri(
    spark: SparkSession,
    condition_file: str,
    current_file: str,
    future_files: Sequence[str] = (),
    polygon_mask: DataFrame | str | None = None,
    closed_border: bool = False,
    margin_px: int | None = None,
    lambdas: Sequence[float] = (2, 20, 200),
    max_cost: float = 2.0,
    window_size: int = 3,
    outer_window: int = 9,
    window_mode: str = "circular",
    levels: Sequence[int] = (2, 4, 8, 16, 32),
    scale: float | None = None,
    resistance_file: str | None = None,
    resistance_scale: float | None = None,
    filename: str = "",
    engine: str = "tiled",
) -> DataFrame:
    """Resilience of each cell of a condition raster under climates by path, the present one and future ones; see connectedness."""
    params = _params(lambdas, max_cost, window_size, outer_window, window_mode, levels, 3, margin_px)
    polygon_mask = _polygon(spark, polygon_mask)
    cond = _read(spark, condition_file, params, polygon_mask, closed_border, scale)
    polygon_mask = polygon_mask if polygon_mask is None else fitted(polygon_mask, cond.grid)
    layers, bands = [], None
    for path in (current_file, *(future_files or ())):
        layer = _read(spark, path, params, polygon_mask, closed_border, None, cond)
        if bands not in (None, layer.grid.bands):
            raise ValueError(f"{path} has {layer.grid.bands} bands, the present climate {bands}")
        bands = layer.grid.bands
        cells = layer.cells if "bands" in layer.cells.columns else layer.cells.withColumn("bands", F.array("value"))
        layers.append(cells.select("row", "col", "bands"))
    res = _read(spark, resistance_file, params, polygon_mask, closed_border, resistance_scale, cond).cells if resistance_file else None
    out = indicators.beri(cond.cells, layers, cond.grid, bands, params, resistance=res, polygon=polygon_mask, closed_border=closed_border, engine=engine)
    return _save(out, cond.grid, filename)


def pixel_coverage(spark: SparkSession, polygon: DataFrame | str, raster_file: str, filename: str = "") -> DataFrame:
    """row, col, value: share of each pixel of a raster that polygons (or those of a GeoJSON path) cover; written to filename, if given.

    Polygons in another reference system are reprojected; pixels that none covers aren't listed.
    """
    grid = read_raster(spark, raster_file).grid
    return _save(coverage.pixel_coverage(fitted(_polygon(spark, polygon), grid), grid), grid, filename)


def make_tiles(spark: SparkSession, raster_file: str, nrows: int, ncols: int, align_to: int = 1, balanced: bool = False, io_weight: float = 0.1) -> DataFrame:
    """Tiles of a raster, of about equal size or, if balanced, equal cost."""
    found = read_raster(spark, raster_file)
    return tiles.make_tiles(found.cells, found.grid, nrows, ncols, align_to, balanced, io_weight)


def make_tile(spark: SparkSession, raster_file: str, nrows: int, ncols: int, tile_id: int, align_to: int = 1, balanced: bool = False, io_weight: float = 0.1) -> DataFrame:
    """One of make_tiles()."""
    found = read_raster(spark, raster_file)
    return tiles.make_tile(found.cells, found.grid, nrows, ncols, tile_id, align_to=align_to, balanced=balanced, io_weight=io_weight)


def resolution_info(spark: SparkSession, raster_file: str, levels: Sequence[int] | None = None, min_dimension: int = 16, outer_window: int = 5) -> DataFrame:
    """Size, resolution and reach of a raster's candidate levels."""
    return tiles.resolution_info(spark, read_raster(spark, raster_file).grid, levels, min_dimension, outer_window)


#: The name under which it was known before.
overview_info = resolution_info
