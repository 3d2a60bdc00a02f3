"""Windows around sources: which cells of each level count, by how much, and which lie on the rim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrascape.functions.geometry import arc, circle_overlap, meets_circle, node_id, square_overlap
from terrascape.grid import Grid, Params
from terrascape.sources.cells import dealt, stored

#: Coarsest level up to which the template is broadcast: at most its square times a window's cells.
MOST_BROADCAST = 32


def sources(cells: DataFrame) -> DataFrame:
    """src, row, col of the cells that are sources and valid."""
    rows = cells.where("source AND cond IS NOT NULL").select("row", "col")
    return rows.select(node_id(F.lit(1), F.col("row"), F.col("col")).alias("src"), "row", "col")


def _box(grid: Grid) -> tuple[Column, Column, Column, Column]:
    """A cell's rectangle in pixels, within the grid."""
    level, gi, gj = F.col("level"), F.col("gi"), F.col("gj")
    to = lambda k, n: F.least((k + 1) * level, F.lit(n)).cast("double")
    return (gi * level).cast("double"), to(gi, grid.nrows), (gj * level).cast("double"), to(gj, grid.ncols)


def with_fraction(cells: DataFrame, grid: Grid, mode: str) -> DataFrame:
    """Adds fraction, the share of a cell's rectangle within the ring from inner to outer, as a float, and leaves out cells without one; columns row, col, level, gi, gj, inner, outer.

    The arcs of the rectangle's sides and the share are generated (as arrays of one element), as
    otherwise the filter would work all of it out again for each use.
    """
    i0, i1, j0, j1 = _box(grid)
    ci, cj, inner, outer = F.col("row") + 0.5, F.col("col") + 0.5, F.col("inner"), F.col("outer")
    full = (i1 - i0) * (j1 - j0)
    if mode == "circular":
        sides = {"a": i0 - ci, "b": i1 - ci, "c": j0 - cj, "d": j1 - cj}
        arcs = [arc(t, r).alias(f"{n}_{r_name}") for r_name, r in (("outer", outer), ("inner", inner)) for n, t in sides.items()]
        out = cells.select("*", F.inline(F.array(F.struct(*[t.alias(n) for n, t in sides.items()], *arcs, full.alias("full")))))
        at = [F.col(n) for n in sides]
        within = lambda r: circle_overlap(*at, tuple(F.col(f"{n}_{r}") for n in sides), F.col(r))
        share = F.least(F.lit(1.0), (within("outer") - within("inner")) / F.col("full"))
    else:
        out = cells
        share = F.least(F.lit(1.0), (square_overlap(i0, i1, j0, j1, ci, cj, outer) - square_overlap(i0, i1, j0, j1, ci, cj, inner)) / full)
    # less than 1e-12 is what rounding leaves of nothing
    return out.select(*cells.columns, F.explode(F.array(share)).alias("share")).where("share > 1e-12").withColumn("fraction", F.col("share").cast("float")).drop("share")


def candidates(src: DataFrame, grid: Grid, params: Params) -> DataFrame:
    """src, row, col, level, inner, outer, gi, gj: every cell of each level that the ring's bounding square meets."""
    rings = F.array(*[F.struct(F.lit(v).alias("level"), F.lit(params.radii(v)[0]).alias("inner"), F.lit(params.radii(v)[1]).alias("outer")) for v in params.levels])
    out = src.select("src", "row", "col", F.inline(rings))

    def span(place: str, n: int) -> Column:
        centre = F.col(place) + 0.5
        first = F.floor(F.greatest(centre - F.col("outer"), F.lit(0.0)) / F.col("level"))
        last = F.floor((F.ceil(F.least(centre + F.col("outer"), F.lit(float(n)))) - 1) / F.col("level"))
        return F.sequence(first.cast("int"), last.cast("int"))

    return out.withColumn("gi", F.explode(span("row", grid.nrows))).withColumn("gj", F.explode(span("col", grid.ncols)))


def template(spark: SparkSession, params: Params) -> DataFrame:
    """phase_row, phase_col, level, di, dj, fraction, rim: the ring cells of a source far from any border.

    They depend only on where in a block of the coarsest level the source lies; di and dj count
    from the source's own cell of the level. A table of levels[-1] ** 2 windows, whatever the raster.
    """
    top = params.levels[-1]
    away = (params.reach // top + 2) * top
    wide = Grid(2 * away + top, 2 * away + top)
    at = dealt(spark.range(top * top), "id").select(F.col("id").alias("src"), (away + F.floor(F.col("id") / top)).cast("int").alias("row"), (away + F.col("id") % top).cast("int").alias("col"))
    ring = _ring(at, wide, params)
    own = lambda c: F.floor(F.col(c) / F.col("level")).cast("int")
    kept = ring.select((F.col("row") % top).alias("phase_row"), (F.col("col") % top).alias("phase_col"), "level", (F.col("gi") - own("row")).alias("di"), (F.col("gj") - own("col")).alias("dj"), "fraction", *(["rim"] if params.window_mode == "circular" else []))
    return stored(kept, "windows")


def _ring(src: DataFrame, grid: Grid, params: Params) -> DataFrame:
    """Cells of each source's rings with their shares, by the formula."""
    ring = with_fraction(candidates(src, grid, params), grid, params.window_mode)
    if params.window_mode == "circular":
        ring = ring.withColumn("rim", meets_circle(*_box(grid), F.col("row") + 0.5, F.col("col") + 0.5, F.col("outer")))
    return ring


def rings(src: DataFrame, grid: Grid, params: Params) -> DataFrame:
    """src, row, col, level, gi, gj, fraction and, in circular mode, rim: the ring cells of each source.

    Sources whose windows no border cuts take them from a template by their phase, in one join.
    Of the others, those that differ by whole blocks along a border have windows of one shape: the
    formula is worked out for one of each shape, and the others take its cells, moved.
    """
    names = ["src", "row", "col", "level", "gi", "gj", "fraction", *(["rim"] if params.window_mode == "circular" else [])]
    top, margin = params.levels[-1], params.reach + params.levels[-1]
    base = -(-margin // top) * top

    def alike(c: str, n: int) -> Column:
        """Of the rows or columns whose windows don't reach an end of this axis, the first of the same phase; others stay."""
        if base + top > n - margin:
            return F.col(c)
        return F.when(F.col(c).between(margin, n - 1 - margin), base + F.pmod(F.col(c) - base, F.lit(top))).otherwise(F.col(c)).cast("int")

    def shared(some: DataFrame) -> DataFrame:
        stand = some.select("src", "row", "col", alike("row", grid.nrows).alias("own_row"), alike("col", grid.ncols).alias("own_col"))
        shapes = stand.select("own_row", "own_col").distinct().select(F.lit(0).cast("long").alias("src"), F.col("own_row").alias("row"), F.col("own_col").alias("col"))
        cells = _ring(dealt(shapes, "row", "col"), grid, params).select(*names).drop("src").withColumnsRenamed({"row": "own_row", "col": "own_col"})
        both = ["own_row", "own_col"]
        met = dealt(stand, *both).join(dealt(cells, *both).hint("merge"), both)
        moved = lambda k, c: (F.col(k) + ((F.col(c) - F.col(f"own_{c}")) / F.col("level"))).cast("int").alias(k)
        return met.select("src", "row", "col", "level", moved("gi", "row"), moved("gj", "col"), *names[6:])

    if base + top > max(grid.nrows, grid.ncols) - margin:
        return _ring(dealt(src, "src"), grid, params).select(*names)
    if min(grid.nrows, grid.ncols) <= 2 * margin:
        return shared(src)
    inner = F.col("row").between(margin, grid.nrows - 1 - margin) & F.col("col").between(margin, grid.ncols - 1 - margin)
    windows = template(src.sparkSession, params)
    windows = F.broadcast(windows) if top <= MOST_BROADCAST else windows
    phased = dealt(src, "src").where(inner).select("src", "row", "col", (F.col("row") % top).alias("phase_row"), (F.col("col") % top).alias("phase_col")).join(windows, ["phase_row", "phase_col"])
    at = lambda c, d: (F.floor(F.col(c) / F.col("level")) + F.col(d)).cast("int")
    near = phased.withColumns({"gi": at("row", "di"), "gj": at("col", "dj")}).select(*names)
    return near.unionByName(shared(src.where(~inner)))


def window(src: DataFrame, pyramid: DataFrame, grid: Grid, params: Params, pa_to_pa: bool = False) -> DataFrame:
    """Nodes of each source: src, row, col, node, level, gi, gj, fraction, area, cond, trav, pa, rim.

    The ring's share of each cell is worked out before the equi-join with the pyramid, so only
    cells that count are joined.
    """
    # rings are shuffled: a plan that judges them by the size of their sources would broadcast them
    ring = rings(src, grid, params)
    nodes = ring.hint("merge").join(pyramid, ["level", "gi", "gj"])
    if params.window_mode == "square":  # the rim of what was admitted
        w = Window.partitionBy("src", "level")
        edge = lambda k: (F.col(k) == F.min(k).over(w)) | (F.col(k) == F.max(k).over(w))
        nodes = nodes.withColumn("rim", edge("gi") | edge("gj"))
    return nodes.select(
        "src", "row", "col", node_id(F.col("level"), F.col("gi"), F.col("gj")).alias("node"), "level", "gi", "gj", "fraction",
        (F.col("weight") * F.col("fraction")).alias("area"), "cond", F.coalesce("trav", "cond").alias("trav"),
        (F.coalesce(F.col("pa"), F.lit(0.0)) if pa_to_pa else F.lit(1.0)).alias("pa"), "rim",
    )


def seen(pyramid: DataFrame, src: DataFrame, grid: Grid, params: Params, side: int) -> DataFrame:
    """block_i, block_j, level, gi, gj: cells of the pyramid that windows of a block of side x side sources can hold, by the outer radius; blocks with sources alone."""
    outer = F.element_at(F.create_map(*[F.lit(x) for v in params.levels for x in (v, params.radii(v)[1])]), F.col("level"))

    def span(index: str, n: int) -> Column:
        first = F.greatest(F.ceil(F.col(index) * F.col("level") - outer - 0.5), F.lit(0))
        last = F.least(F.floor((F.col(index) + 1) * F.col("level") + outer - 0.5), F.lit(n - 1))
        return F.sequence(F.floor(first / side), F.floor(last / side))

    each = pyramid.select("level", "gi", "gj", F.explode(span("gi", grid.nrows)).alias("block_i")).withColumn("block_j", F.explode(span("gj", grid.ncols)))
    held = src.select(F.floor(F.col("row") / side).alias("block_i"), F.floor(F.col("col") / side).alias("block_j")).distinct()
    return each.join(held, ["block_i", "block_j"], "left_semi").select("block_i", "block_j", "level", "gi", "gj")
