"""Reading of rasters, whole or around an area of interest, with what a window needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascape.grid import Grid, pyramid_levels
from terrascape.operators import aoi
from terrascape.operators.pyramid import finite
from terrascape.operators.surfaces import rescaled
from terrascape.sources.cells import read_cells
from terrascape.sources.geotiff import read_geotiff
from terrascape.sources.vector import fitted


@dataclass(frozen=True)
class Raster:
    """cells: row, col, value (or bands), masked (no source here); box: rows and columns that were read, ends excluded."""

    cells: DataFrame
    grid: Grid
    transforms: dict[int, tuple[float, ...]]
    box: tuple[int, int, int, int]


def read_raster(spark: SparkSession, path: str, polygon: DataFrame | None = None, levels: tuple[int, ...] = (2, 4, 8, 16, 32), scale: float | None = None, expand_px: int = 0, closed: bool = False, margin_px: float = 0) -> Raster:
    """Cells of a GeoTIFF (.tif, .tiff) or a cell table; with a polygon, those that its windows can reach, indices staying global.

    closed: cells outside the polygon lose their values. masked cells have no value or lie outside,
    with an open border by more than margin_px pixels; the polygon is reprojected if it has to be.
    """
    levels = tuple(pyramid_levels(levels))
    tiff = path.lower().endswith((".tif", ".tiff"))
    cells, grid = read_geotiff(spark, path) if tiff else read_cells(spark, path)
    box = (0, grid.nrows, 0, grid.ncols)
    if polygon is not None:
        polygon = fitted(polygon, grid)
        box = aoi.pixel_box(polygon, grid) if closed else aoi.read_box(polygon, grid, levels, expand_px)
        cells = aoi.within(cells, box) if tiff else read_cells(spark, path, box[:2], box[2:])[0]
    transforms = {v: grid.level_transform(v) for v in levels}
    if "bands" in cells.columns:
        clean = F.transform("bands", lambda x: rescaled(finite(x, grid.nodata), scale))
        cells = cells.withColumn("bands", clean).withColumn("masked", F.exists("bands", lambda x: x.isNull()))
    else:
        cells = cells.withColumn("value", rescaled(finite(F.col("value"), grid.nodata), scale)).withColumn("masked", F.col("value").isNull())
    if polygon is not None:
        cells = aoi.marked(cells, aoi.cover(polygon, grid), "_in")
        cells = aoi.near(cells, polygon, grid, margin_px, "_near") if margin_px and not closed else cells.withColumn("_near", F.col("_in"))
        cells = cells.withColumn("masked", F.col("masked") | ~(F.col("_in") | F.col("_near"))).drop("_near")
        if closed:
            name = "bands" if "bands" in cells.columns else "value"
            cells = cells.withColumn(name, F.when(F.col("_in"), F.col(name)))
        cells = cells.drop("_in")
    return Raster(cells, grid, transforms, box)
