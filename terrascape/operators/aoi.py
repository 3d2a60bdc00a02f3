"""Areas of interest: pixels that polygons touch, and bounding boxes in pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascape.grid import Grid
from terrascape.operators.edges import in_pixels, segments
from terrascape.sources.cells import stored

#: Pixels a side of a block of cover(): the bits of a long.
SIDE = 64


def _through(edges: DataFrame, grid: Grid) -> DataFrame:
    """row, low, high (and poly_id, if edges have it): columns of each row of pixels that an edge runs through, ends touched included."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    on_grid = edges.where((F.greatest(y1, y2) >= 0) & (F.least(y1, y2) <= grid.nrows))
    span = F.sequence(F.greatest(F.ceil(F.least(y1, y2)) - 1, F.lit(0)).cast("int"), F.least(F.floor(F.greatest(y1, y2)), F.lit(grid.nrows - 1)).cast("int"))
    rows = on_grid.withColumn("row", F.explode(span))
    # the part of the edge in the row, and so its columns
    flat = y1 == y2
    cut = lambda y: F.when(flat, x1).otherwise(x1 + (x2 - x1) * (y - y1) / F.when(flat, 1.0).otherwise(y2 - y1))
    top, bottom = F.greatest(F.least(y1, y2), F.col("row").cast("double")), F.least(F.greatest(y1, y2), (F.col("row") + 1).cast("double"))
    a, b = F.when(flat, x1).otherwise(cut(top)), F.when(flat, x2).otherwise(cut(bottom))
    part = rows.withColumns({"a": F.least(a, b), "b": F.greatest(a, b)}).where((F.col("b") >= 0) & (F.col("a") <= grid.ncols))
    kept = [c for c in edges.columns if c == "poly_id"]
    return part.select(*kept, "row", F.greatest(F.ceil("a") - 1, F.lit(0)).cast("int").alias("low"), F.least(F.floor("b"), F.lit(grid.ncols - 1)).cast("int").alias("high"))


def _inside(edges: DataFrame, grid: Grid, side: int) -> DataFrame:
    """poly_id, row, low, high: of blocks of side x side pixels, runs along each row whose centres lie inside: within more exteriors than holes."""
    x1, y1, x2, y2 = (F.col(c) / side for c in ("x1", "y1", "x2", "y2"))
    nrows, ncols = -(-grid.nrows // side), -(-grid.ncols // side)
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    lines = F.sequence(F.greatest(F.ceil(low - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(high - 0.5) - 1, F.lit(nrows - 1)).cast("int"))
    fits = edges.where((F.floor(low + 0.5) != F.floor(high + 0.5)) & (high > 0.5) & (low <= nrows - 0.5))
    crossing = fits.withColumn("row", F.explode(lines)).select("poly_id", "ring_id", "up", "row", (x1 + (x2 - x1) * (F.col("row") + 0.5 - y1) / (y2 - y1)).alias("x"))
    # a ring is met an even number of times, so every other meeting leaves one, whichever rings come before it
    line = Window.partitionBy("poly_id", "row")
    turns = crossing.withColumn("step", F.when(F.row_number().over(line.orderBy("ring_id", "x")) % 2 == 1, F.col("up")).otherwise(-F.col("up")))
    along = line.orderBy("x", F.desc("step"))
    runs = turns.select("poly_id", "row", F.sum("step").over(along).alias("n"), F.col("x").alias("a"), F.lead("x").over(along).alias("b")).where("n > 0 AND b IS NOT NULL")
    runs = runs.withColumns({"low": F.greatest(F.ceil(F.col("a") - 0.5), F.lit(0)).cast("int"), "high": F.least(F.floor(F.col("b") - 0.5), F.lit(ncols - 1)).cast("int")})
    return runs.where("low <= high").select("poly_id", "row", "low", "high")


def _bits(low, high):
    """A long with the bits low to high set; a column each, 0 to 63."""
    ones = F.when(high - low == 63, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (high - low + 1).cast("int")) - 1)
    return F.call_function("shiftleft", ones, low.cast("int"))


def _masked(runs: DataFrame, *by: str) -> DataFrame:
    """row, block_col, mask, and `by`: runs (row, low, high) as the bits of blocks, together."""
    start = F.col("block_col") * SIDE
    held = _bits(F.greatest(F.col("low") - start, F.lit(0)), F.least(F.col("high") - start, F.lit(SIDE - 1)))
    each = runs.withColumn("block_col", F.explode(F.sequence(F.shiftright("low", 6), F.shiftright("high", 6))))
    return each.groupBy(*by, "row", "block_col").agg(F.bit_or(held).alias("mask"))


def _blocks(rows: DataFrame) -> DataFrame:
    """block_row, block_col, bits of row, block_col, mask."""
    at = F.struct(F.col("row").bitwiseAND(SIDE - 1).alias("at"), "mask")
    masks = rows.groupBy(F.shiftright("row", 6).alias("block_row"), "block_col").agg(F.map_from_entries(F.collect_list(at)).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))
    return masks.select("block_row", "block_col", each.alias("bits"))


def different(polygon: DataFrame) -> DataFrame:
    """poly_id, ring_id, is_hole, vertices, n: of polygons with the same rings one; poly_id is the least of theirs.

    Rows of one poly_id are one polygon; if its table has an id more than once, equal rings are one with
    their number n.
    """
    each = polygon.repartition("poly_id").groupBy("poly_id", "is_hole", "vertices").agg(F.count("*").alias("n"))
    rings = F.sort_array(F.collect_list(F.struct("is_hole", "vertices", "n")))
    shapes = each.groupBy("poly_id").agg(rings.alias("rings")).groupBy("rings").agg(F.min("poly_id").alias("poly_id"))
    return shapes.select("poly_id", F.posexplode("rings").alias("ring_id", "r")).select("poly_id", "ring_id", "r.is_hole", "r.vertices", "r.n")


def cover(polygon: DataFrame, grid: Grid) -> DataFrame:
    """block_row, block_col, bits: the blocks of SIDE x SIDE pixels that polygons touch, together.

    bits is null where a polygon holds all of a block, and else has a long for each of its rows,
    with a bit for each pixel whose closed square meets a polygon: an edge runs through it, or its
    centre lies inside. Polygons with the same
    rings count once, and of several with one poly_id each counts. Only blocks that an edge runs through are looked at row by row, so the
    work grows with the outlines, and with the area by whole blocks alone. Polygons of a block
    meet as bits, in partial aggregations, however many there are.
    """
    # written once: its edges are asked for four times
    shapes = different(polygon).withColumn("up", F.when(F.col("is_hole"), -F.col("n")).otherwise(F.col("n")))
    edges = stored(segments(in_pixels(shapes, grid), "up"), "edges")
    block = lambda c: F.shiftright(c, 6)
    pieces = _masked(_through(edges, grid), "poly_id")
    start = F.col("block_col") * SIDE
    edged = pieces.select("poly_id", block("row").alias("block_row"), "block_col").distinct()
    # rows of blocks with an edge, where they lie within the polygon
    inner = _inside(edges, grid, 1).withColumn("block_row", block("row")).join(edged, ["poly_id", "block_row"])
    held = _bits(F.greatest(F.col("low") - start, F.lit(0)), F.least(F.col("high") - start, F.lit(SIDE - 1)))
    inner = inner.where((F.col("high") >= start) & (F.col("low") < start + SIDE)).select("row", "block_col", held.alias("mask"))
    rows = pieces.select("row", "block_col", "mask").unionByName(inner).groupBy("row", "block_col").agg(F.bit_or("mask").alias("mask"))
    whole = _inside(edges, grid, SIDE).select("poly_id", F.col("row").alias("block_row"), F.explode(F.sequence("low", "high")).alias("block_col"))
    whole = whole.join(edged, ["poly_id", "block_row", "block_col"], "left_anti").select("block_row", "block_col").distinct()
    partly = _blocks(rows).join(whole, ["block_row", "block_col"], "left_anti")
    return partly.unionByName(whole.select("block_row", "block_col", F.lit(None).cast("array<long>").alias("bits")))


def marked(cells: DataFrame, covered: DataFrame, name: str) -> DataFrame:
    """cells (row, col, ...) with boolean `name`: whether cover() has the pixel; one join by block, and a bit is looked up."""
    at = cells.withColumns({"_block_row": F.shiftright("row", 6), "_block_col": F.shiftright("col", 6)})
    blocks = covered.select(F.col("block_row").alias("_block_row"), F.col("block_col").alias("_block_col"), F.struct("bits").alias("_block"))
    bit = F.call_function("shiftright", F.element_at("_block.bits", F.col("row").bitwiseAND(SIDE - 1) + 1), F.col("col").bitwiseAND(SIDE - 1)).bitwiseAND(1) == 1
    found = at.join(blocks, ["_block_row", "_block_col"], "left")
    return found.select(*cells.columns, (F.col("_block").isNotNull() & (F.col("_block.bits").isNull() | F.coalesce(bit, F.lit(False)))).alias(name))


def _beside(pieces: DataFrame, grid: Grid, margin: float) -> DataFrame:
    """row, low, high: columns of each row of pixels whose closed squares lie within `margin` pixels of a segment.

    What lies within the margin of a segment is convex, so in a row of pixels it is one run. Its
    left end is taken at the height, within the row, that is nearest to the segment's left end,
    and is the least of three: the circles about both ends and the side between them.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    m = F.lit(float(margin) + 1e-9)
    first, last = F.greatest(F.ceil(F.least(y1, y2) - m) - 1, F.lit(0)), F.least(F.floor(F.greatest(y1, y2) + m), F.lit(grid.nrows - 1))
    fits = pieces.where((first <= last) & (F.greatest(x1, x2) + m >= 0) & (F.least(x1, x2) - m <= grid.ncols))
    rows = fits.withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    long = F.hypot(x2 - x1, y2 - y1)

    def end(sign: int):
        """How far the run goes to the left (-1) or right (1) in the row."""
        tip = F.when((x2 - x1) * sign > 0, y2).otherwise(y1)
        at = F.least(F.greatest(tip, F.col("row").cast("double")), (F.col("row") + 1).cast("double"))
        round_ = lambda x, y: F.when(F.abs(at - y) <= m, x + sign * F.sqrt(F.greatest(m * m - (at - y) * (at - y), F.lit(0.0))))
        # the side that faces this way: the segment moved by the margin across itself
        turn = F.when((y2 - y1) * sign >= 0, 1.0).otherwise(-1.0)
        dx, dy = turn * m * (y2 - y1) / F.when(long > 0, long), turn * m * (x1 - x2) / F.when(long > 0, long)
        within = (at >= F.least(y1, y2) + dy) & (at <= F.greatest(y1, y2) + dy)
        side = F.when(within & (y1 != y2), x1 + dx + (x2 - x1) * (at - y1 - dy) / F.when(y1 != y2, y2 - y1))
        return F.least(round_(x1, y1), round_(x2, y2), side) if sign < 0 else F.greatest(round_(x1, y1), round_(x2, y2), side)

    found = rows.select("row", end(-1).alias("a"), end(1).alias("b"))
    found = found.select("row", F.greatest(F.ceil("a") - 1, F.lit(0)).cast("int").alias("low"), F.least(F.floor("b"), F.lit(grid.ncols - 1)).cast("int").alias("high"))
    return found.where("low <= high")


def near(cells: DataFrame, polygon: DataFrame, grid: Grid, margin: float, name: str) -> DataFrame:
    """cells (row, col, ...) with boolean `name`: whether a pixel's closed square lies within `margin` pixels of a polygon's outline.

    Each different edge gives runs of pixels, row by row, which meet as bits in blocks of SIDE x SIDE
    pixels, as in cover(). So the work grows with the outlines times the margin, and no pixel is
    compared with an edge. Pixels deep inside a polygon are far from its outline: see cover().
    """
    edges = segments(in_pixels(polygon, grid)).select("x1", "y1", "x2", "y2").distinct()
    runs = _beside(edges, grid, margin).unionByName(_through(edges, grid).select("row", "low", "high")).distinct()
    return marked(cells, _blocks(_masked(runs)), name)


def pixels(covered: DataFrame, grid: Grid) -> DataFrame:
    """row, col of the pixels that cover() has."""
    lines = covered.select("block_row", "block_col", F.posexplode(F.coalesce("bits", F.array_repeat(F.lit(-1).cast("long"), SIDE))).alias("i", "mask")).where("mask <> 0")
    each = lines.select((F.col("block_row") * SIDE + F.col("i")).alias("row"), "block_col", "mask", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("j"))
    bit = F.call_function("shiftright", F.col("mask"), F.col("j")).bitwiseAND(1) == 1
    return each.where(bit).select("row", (F.col("block_col") * SIDE + F.col("j")).alias("col")).where((F.col("row") < grid.nrows) & (F.col("col") < grid.ncols))


def touched(polygon: DataFrame, grid: Grid) -> DataFrame:
    """row, col of pixels whose closed square meets a polygon: an edge runs through it, or its centre lies inside."""
    return pixels(cover(polygon, grid), grid)


def pixel_box(polygon: DataFrame, grid: Grid, buffer_px: float = 0.0) -> tuple[int, int, int, int]:
    """Rows and columns (ends excluded) of the polygons' bounding box, held within the grid; ValueError if none is left."""
    v = in_pixels(polygon, grid).select(F.explode("vertices").alias("v"))
    low_x, high_x, low_y, high_y = v.agg(F.min("v.x"), F.max("v.x"), F.min("v.y"), F.max("v.y")).head()
    if low_x is None:
        raise ValueError("the area of interest is empty")
    hold = lambda x, n: int(max(0, min(n, x)))
    box = hold((low_y - buffer_px) // 1, grid.nrows), hold(-((-high_y - buffer_px) // 1), grid.nrows), hold((low_x - buffer_px) // 1, grid.ncols), hold(-((-high_x - buffer_px) // 1), grid.ncols)
    if box[0] >= box[1] or box[2] >= box[3]:
        raise ValueError("the area of interest lies off the grid")
    return box


def read_box(polygon: DataFrame, grid: Grid, levels: tuple[int, ...], expand_px: int) -> tuple[int, int, int, int]:
    """The window to read for an open border: the box, widened by what windows can reach, to whole cells of the coarsest level."""
    top = max(levels)
    r0, r1, c0, c1 = pixel_box(polygon, grid, (expand_px + 3) * top + 0.5)
    snap = lambda a, b, n: (a // top * top, min(n, -(-b // top) * top))
    return *snap(r0, r1, grid.nrows), *snap(c0, c1, grid.ncols)


def within(cells: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Cells of a range of rows and columns; Parquet readers skip what the range leaves out."""
    return cells.where((F.col("row") >= box[0]) & (F.col("row") < box[1]) & (F.col("col") >= box[2]) & (F.col("col") < box[3]))


def crop(cells: DataFrame, polygon: DataFrame, grid: Grid) -> DataFrame:
    return within(cells, pixel_box(polygon, grid))
