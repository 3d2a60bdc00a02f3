"""Plans of tiles: equal in size or in cost, along lines of a block size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascape.grid import KM_A_DEGREE, UNIT_KM, Grid, compact
from terrascape.sources.cells import stored


def _positive(value: int, name: str) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} is a positive integer, not {value!r}")


def aligned_breaks(size: int, parts: int, align_to: int) -> list[int]:
    """Ends of parts of about equal size that lie on multiples of align_to."""
    for value, name in ((size, "size"), (parts, "parts"), (align_to, "align_to")):
        _positive(value, name)
    lines = (size - 1) // align_to  # lines between blocks
    if lines < parts - 1:
        raise ValueError(f"{size} can't be cut into {parts} parts along multiples of {align_to}")
    at = [0]
    for k in range(1, parts):
        ideal = int(k * size / (parts * align_to) + 0.5)
        at.append(max(at[-1] + 1, min(ideal, lines - (parts - k - 1))))
    return [x * align_to for x in at] + [size]


#: Neighbouring blocks whose costs a task adds up in a row.
CHUNK = 4_096


def running_costs(costs: DataFrame) -> DataFrame:
    """costs (band, block, cost) with run, the cost of a band's blocks up to this one; blocks are numbered from 0 without a gap.

    Sums of chunks come first, then running sums over chunks, then those within each: no task has all blocks of a band.
    """
    chunked = costs.withColumn("chunk", F.floor(F.col("block") / CHUNK))
    before = Window.partitionBy("band").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunked.groupBy("band", "chunk").agg(F.sum("cost").alias("all")).select("band", "chunk", F.coalesce(F.sum("all").over(before), F.lit(0.0)).alias("start"))
    along = Window.partitionBy("band", "chunk").orderBy("block")
    return chunked.join(sums, ["band", "chunk"]).select("band", "block", "cost", F.round(F.col("start") + F.sum("cost").over(along), 9).alias("run"))


def balanced_breaks(costs: DataFrame, parts: int, align_to: int, size: int) -> dict[int, list[int]]:
    """By band, ends of parts of about equal cost; costs: band, block, cost, of the same blocks in each band. A band without any cost is cut as by aligned_breaks.

    Only what the breaks need comes to the driver: a row a band and break, for the block at which
    the running cost reaches its share, and further ones where breaks push each other along.
    """
    _positive(parts, "parts")
    blocks = -(-size // align_to)
    if blocks < parts:
        raise ValueError(f"{blocks} blocks can't be cut into {parts} parts")
    runs = stored(running_costs(costs), "running-costs")
    totals = {r.band: r.total for r in runs.groupBy("band").agg(F.max("run").alias("total")).collect()}
    total = runs.groupBy("band").agg(F.max("run").alias("total"))
    aim = F.round(F.col("total") * F.col("k") / parts, 9)
    breaks = F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("k")
    met = runs.join(total, "band").where("run > 0").select("band", "block", "run", "cost", "total", breaks).where((F.col("run") >= aim) & (F.col("run") - F.col("cost") < aim + 1e-9))
    reached = {(r.band, r.k): r.block for r in met.groupBy("band", "k").agg(F.min("block").alias("block")).collect()}
    wanted = {(band, at) for (band, _), block in reached.items() for at in (block, block - 1) if at >= 0}
    run = {(r.band, r.block): r.run for r in runs.join(F.broadcast(_pairs(runs, wanted)), ["band", "block"]).select("band", "block", "run").collect()}

    def value(band: int, ends: int) -> float:
        if (band, ends - 1) not in run:
            run[band, ends - 1] = runs.where((F.col("band") == band) & (F.col("block") == ends - 1)).head().run
        return run[band, ends - 1]

    out = {}
    for band, whole in totals.items():
        if whole <= 0:
            out[band] = aligned_breaks(size, parts, align_to)
            continue
        at = [0]
        for k in range(1, parts):
            reach = reached[band, k] + 1
            allowed = [min(max(b, at[-1] + 1), blocks - (parts - k)) for b in (reach, reach - 1) if b > 0]
            # the later of equals comes first
            at.append(min(allowed, key=lambda b: round(abs(value(band, b) - whole * k / parts), 9)))
        out[band] = [min(b * align_to, size) for b in at] + [size]
    return out


def _pairs(like: DataFrame, pairs: set[tuple[int, int]]) -> DataFrame:
    return like.sparkSession.createDataFrame(sorted(pairs) or [(-1, -1)], "band int, block int")


def block_costs(cells: DataFrame, grid: Grid, align_to: int, io_weight: float = 0.1) -> DataFrame:
    """block_row, block_col, cost: valid pixels of each block, and io_weight for each of its pixels; cells: row, col, value."""
    if io_weight < 0:
        raise ValueError("io_weight can't be below 0")
    spark = cells.sparkSession
    rows, cols = -(-grid.nrows // align_to), -(-grid.ncols // align_to)
    blocks = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("block_row"), (F.col("id") % cols).cast("int").alias("block_col"))
    valid = cells.groupBy(F.floor(F.col("row") / align_to).cast("int").alias("block_row"), F.floor(F.col("col") / align_to).cast("int").alias("block_col")).agg(F.count("value").alias("valid"))
    side = lambda b, n: F.least(F.lit(n) - F.col(b) * align_to, F.lit(align_to))
    area = side("block_row", grid.nrows) * side("block_col", grid.ncols)
    return blocks.join(valid, ["block_row", "block_col"], "left").select("block_row", "block_col", (F.coalesce("valid", F.lit(0)) + area * float(io_weight)).alias("cost"))


def make_tiles(cells: DataFrame, grid: Grid, nrows: int, ncols: int, align_to: int = 1, balanced: bool = False, io_weight: float = 0.1) -> DataFrame:
    """id, row, col, row_start, row_stop, col_start, col_stop, align_to, xmin, ymin, xmax, ymax and, if balanced, cost.

    Balanced: rows of tiles are cut by the cost of whole rows of blocks, then each is cut by
    columns for itself. Costs come from one aggregation to (rows of tiles) x (columns of blocks).
    """
    for value, name in ((nrows, "nrows"), (ncols, "ncols"), (align_to, "align_to")):
        _positive(value, name)
    if grid.transform[1] or grid.transform[3]:
        raise ValueError("tiles need a north-up grid without rotation")
    spark = cells.sparkSession
    records = []
    if balanced:
        costs = stored(block_costs(cells, grid, align_to, io_weight), "block-costs")
        by_row = costs.groupBy(F.lit(0).alias("band"), F.col("block_row").alias("block")).agg(F.sum("cost").alias("cost"))
        row_breaks = balanced_breaks(by_row, nrows, align_to, grid.nrows)[0]
        starts = F.array(*[F.lit(-(-b // align_to)) for b in row_breaks[1:-1]]).cast("array<int>")
        band = F.size(F.filter(starts, lambda b: b <= F.col("block_row")))
        by_col = costs.groupBy(band.alias("band"), F.col("block_col").alias("block")).agg(F.sum("cost").alias("cost"))
        col_ends = balanced_breaks(by_col, ncols, align_to, grid.ncols)
    else:
        row_breaks = aligned_breaks(grid.nrows, nrows, align_to)
    for i in range(nrows):
        col_breaks = col_ends[i] if balanced else aligned_breaks(grid.ncols, ncols, align_to)
        for j in range(ncols):
            r0, r1, c0, c1 = row_breaks[i], row_breaks[i + 1], col_breaks[j], col_breaks[j + 1]
            records.append((i * ncols + j, i, j, r0, r1, c0, c1, align_to, *map(float, grid.box(r0, r1, c0, c1))))
    out = spark.createDataFrame(records, "id int, row int, col int, row_start int, row_stop int, col_start int, col_stop int, align_to int, xmin double, ymin double, xmax double, ymax double")
    if not balanced:
        return out
    # each block is told its tile by the ends of the tiles before it
    ends = F.create_map(*[x for i in range(nrows) for x in (F.lit(i), F.array(*[F.lit(-(-b // align_to)) for b in col_ends[i][1:-1]]).cast("array<int>"))])
    tile = (band * ncols + F.size(F.filter(F.element_at(ends, band), lambda b: b <= F.col("block_col")))).cast("int")
    return out.join(costs.groupBy(tile.alias("id")).agg(F.sum("cost").alias("cost")), "id", "left").select(*out.columns, F.coalesce("cost", F.lit(0.0)).alias("cost"))


def make_tile(cells: DataFrame, grid: Grid, nrows: int, ncols: int, tile_id: int, **how) -> DataFrame:
    if not 0 <= tile_id < nrows * ncols:
        raise ValueError(f"tile_id is from 0 to {nrows * ncols - 1}, not {tile_id!r}")
    return make_tiles(cells, grid, nrows, ncols, **how).where(F.col("id") == tile_id)


def tile_polygon(tiles: DataFrame) -> DataFrame:
    """Tiles as polygons, for use as areas of interest."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return tiles.select(F.col("id").alias("poly_id"), F.lit(0).alias("ring_id"), F.lit(False).alias("is_hole"), F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax")).alias("vertices"))


def resolutions(grids: DataFrame, levels: Sequence[int] | None = None, min_dimension: int = 16, outer_window: int = 5) -> DataFrame:
    """A row for each raster and candidate level: level, width, height, cells, pct_base, x_res, y_res, reach, reach_km, reach_text, note after the columns of grids.

    grids: nrows, ncols, x_res, y_res (of a cell, above 0), is_geo, unit, middle (the latitude of
    its centre); these are replaced or dropped, others stay. reach_km is null for an unknown unit.
    """
    levels = sorted({int(x) for x in (levels if levels is not None else [2**k for k in range(10)])})
    if not levels or levels[0] <= 0:
        raise ValueError(f"levels are positive integers, not {levels}")
    min_dimension, outer_window = max(1, int(min_dimension)), max(1, int(outer_window))
    own = ["nrows", "ncols", "x_res", "y_res", "is_geo", "unit", "middle"]
    level, rows, cols = F.col("level"), F.col("nrows").cast("long"), F.col("ncols").cast("long")
    factor = F.element_at(F.create_map(*[F.lit(x) for pair in UNIT_KM.items() for x in pair]), F.lower("unit"))
    a_degree = F.lit(KM_A_DEGREE)
    km = F.when(F.col("is_geo"), F.greatest(F.col("x_res") * a_degree * F.abs(F.cos(F.radians("middle"))), F.col("y_res") * a_degree)).otherwise(F.greatest("x_res", "y_res") * factor)
    each = grids.withColumns({"_km": km, "level": F.explode(F.array(*map(F.lit, levels)))})
    width, height = F.ceil(cols / level), F.ceil(rows / level)
    share = F.when((rows > 0) & (cols > 0), 100.0 * (width * height) / (rows * cols)).otherwise(0.0)
    reach_km = outer_window * level * F.col("_km")
    return each.select(
        *[c for c in grids.columns if c not in own], "level", width.alias("width"), height.alias("height"), (width * height).alias("cells"), share.alias("pct_base"),
        (F.col("x_res") * level).alias("x_res"), (F.col("y_res") * level).alias("y_res"), (outer_window * level * F.greatest("x_res", "y_res")).alias("reach"), reach_km.alias("reach_km"),
        F.when(reach_km.isNull(), "-").otherwise(F.concat(compact_text(reach_km), F.lit(" km"))).alias("reach_text"), F.when(F.least(width, height) < min_dimension, "small grid; review").otherwise("").alias("note"),
    )


def compact_text(value: Column) -> Column:
    """compact() as a column, null for null: Spark's own formats round a double by its shortest text, and not by its value."""
    return F.udf(lambda v: None if v is None else compact(v), "string")(value.cast("double"))


def resolution_info(spark, grid: Grid, levels: Sequence[int] | None = None, min_dimension: int = 16, outer_window: int = 5) -> DataFrame:
    """level, width, height, cells, pct_base, x_res, y_res, reach, reach_km, reach_text, note of candidate levels."""
    (x, y), (_, bottom, _, top) = grid.resolution, grid.bounds
    one = spark.createDataFrame([(grid.nrows, grid.ncols, float(x), float(y), grid.is_geo, grid.unit, (bottom + top) / 2.0)], "nrows long, ncols long, x_res double, y_res double, is_geo boolean, unit string, middle double")
    return resolutions(one, levels, min_dimension, outer_window)


#: The name under which it was known before.
overview_info = resolution_info
