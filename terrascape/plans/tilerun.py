"""Connectedness of a large cell table tile by tile, which can be stopped and taken up again.

The plan of tiles is written first, with the parameters. A batch of tiles at a time, the cells of
its tiles and what their windows can reach are read (other bands of rows are skipped) and its
values written, each tile a partition of the result, replaced as a whole. Then the tiles are
noted as done. A later run with the same plan does only what isn't noted; what a stopped run
left half done is written over.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascape.grid import Grid, Params
from terrascape.operators import aoi, tiles
from terrascape.plans import indicators
from terrascape.sources.cells import files_exist, read_cells

_BOX = ("row_start", "row_stop", "col_start", "col_stop")


def manifest(spark: SparkSession, condition: str, out: str, nrows: int, ncols: int, params: Params, more: dict, balanced: bool = False) -> list[dict]:
    """The tiles of a run; those of `out`, where it has some of the same plan. ValueError if its plan is another."""
    cells, grid = read_cells(spark, condition)
    plan = json.dumps({"rows": nrows, "cols": ncols, "balanced": balanced, "grid": asdict(grid), "params": asdict(params), **more}, sort_keys=True)
    if files_exist(spark, f"{out}/plan/_SUCCESS"):
        if spark.read.text(f"{out}/plan").head()[0] != plan:
            raise ValueError(f"{out} has results of another plan")
    else:
        made = tiles.make_tiles(cells, grid, nrows, ncols, params.levels[-1], balanced)
        made.coalesce(1).write.mode("overwrite").parquet(f"{out}/tiles")
        spark.createDataFrame([(plan,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/plan")
    return [r.asDict() for r in spark.read.parquet(f"{out}/tiles").orderBy("id").collect()]


def done(spark: SparkSession, out: str) -> set[int]:
    """Tiles of a run whose values are complete."""
    return {r.tile for r in spark.read.schema("tile int").parquet(f"{out}/done").distinct().collect()} if files_exist(spark, f"{out}/done") else set()


def _window(batch: list[dict], grid: Grid, params: Params) -> tuple[int, int, int, int]:
    """Rows and columns that a batch's windows can reach, to whole cells of the coarsest level."""
    top = params.levels[-1]
    pad = (params.outer_window + 3) * top
    low = lambda name: max(0, (min(t[name] for t in batch) - pad) // top * top)
    high = lambda name, n: min(n, -(-(max(t[name] for t in batch) + pad) // top) * top)
    return low("row_start"), high("row_stop", grid.nrows), low("col_start"), high("col_stop", grid.ncols)


def run(spark: SparkSession, condition: str, out: str, nrows: int, ncols: int, params: Params = Params(), *, together: int = 4, balanced: bool = False, pa: str | None = None, pa_to_pa: bool = False, resistance: str | None = None, engine: str = "relational") -> DataFrame:
    """row, col, value of all cells, once all tiles are done; condition, pa and resistance: cell tables by path.

    together: tiles of a batch, which are neighbours in a row of tiles. Results don't depend on it,
    nor on the tiles: each source has all that its window can hold.
    """
    plan = manifest(spark, condition, out, nrows, ncols, params, {"condition": condition, "pa": pa, "pa_to_pa": pa_to_pa, "resistance": resistance}, balanced)
    grid = read_cells(spark, condition)[1]
    left = [t for t in plan if t["id"] not in done(spark, out)]
    while left:
        batch = [t for t in left[:together] if t["row"] == left[0]["row"]]
        left = left[len(batch) :]
        _settle(spark, condition, out, batch, grid, params, pa, pa_to_pa, resistance, engine)
    return values(spark, out)


def _settle(spark: SparkSession, condition: str, out: str, batch: list[dict], grid: Grid, params: Params, pa: str | None, pa_to_pa: bool, resistance: str | None, engine: str) -> None:
    box = _window(batch, grid, params)
    layer = lambda path: read_cells(spark, path, box[:2], box[2:])[0] if path else None
    cells = layer(condition)
    tile = F.lit(None).cast("int")
    for t in batch:
        r0, r1, c0, c1 = (t[k] for k in _BOX)
        tile = F.when((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1), t["id"]).otherwise(tile)
    mine = aoi.within(cells, (min(t["row_start"] for t in batch), max(t["row_stop"] for t in batch), min(t["col_start"] for t in batch), max(t["col_stop"] for t in batch)))
    found = indicators.connectedness(cells, grid, params, pa=layer(pa), pa_to_pa=pa_to_pa, resistance=layer(resistance), engine=engine, sources_only=mine.select("row", "col"))
    placed = found.withColumn("tile", tile).where("tile IS NOT NULL").repartition("tile")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(f"{out}/values")
    spark.createDataFrame([(t["id"],) for t in batch], "tile int").coalesce(1).write.mode("append").parquet(f"{out}/done")


def values(spark: SparkSession, out: str) -> DataFrame:
    """row, col, value of the tiles that are done."""
    ready = sorted(done(spark, out))
    return spark.read.schema("row int, col int, value float, tile int").parquet(f"{out}/values").where(F.col("tile").isin(ready)).drop("tile")
