"""Overviews of cell tables: sums of each level folded into the next, keyed by global indices."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascape.functions.geometry import cosine_weight, level_key
from terrascape.grid import Grid


def finite(value: Column, nodata: float | None = None) -> Column:
    """A cell's value as float; null where it is null, not a number, infinite or nodata."""
    v = value.cast("float")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    if nodata is not None:
        bad = bad | (v == F.lit(nodata).cast("float"))
    return F.when(~bad, v)


KEYS = ("level", "gi", "gj")


@dataclass(frozen=True)
class State:
    """An aggregate whose parts add up: of cells, of blocks of a level into those of the next, and so on."""

    parts: tuple[Column, ...]
    result: Callable[..., Column]

    def as_double(self) -> State:
        return State(self.parts, lambda *p: self.result(*p).cast("double"))


def _known(column: Column) -> Column:
    return F.when(column.isNotNull(), F.lit(1).cast("long"))


def average(column: str | Column) -> State:
    c = F.col(column) if isinstance(column, str) else column
    return State((c.cast("double"), _known(c)), lambda s, n: F.when(n > 0, s / n))


def count(column: str) -> State:
    return State((_known(F.col(column)),), lambda n: n)


def area(grid: Grid, column: str) -> State:
    return State((F.when(F.col(column).isNotNull(), cosine_weight(grid, F.col("row"), F.col("col"))),), lambda s: s)


def total(column: str | Column) -> State:
    c = F.col(column) if isinstance(column, str) else column
    return State((c.cast("double"),), lambda s: s)


def rows() -> State:
    return State((F.lit(1).cast("long"),), lambda n: n)


def overview(cells: DataFrame, levels: Sequence[int], **aggregates: State) -> DataFrame:
    """level, gi, gj and the named aggregates of the cells of each block.

    Cells are shuffled once, by the blocks of which those of every level are parts. There each
    level's sums are added up from those of a finer one, so a cell counts once, and not once a level.
    """
    levels = sorted(set(levels))
    top = math.lcm(*levels)
    names = [f"_{n}_{i}" for n, s in aggregates.items() for i in range(len(s.parts))]
    at = {f"_{k}": level_key(F.col(c), top) for k, c in (("ti", "row"), ("tj", "col"))}
    base = cells.select("row", "col", *[a.alias(n) for n, a in at.items()], *[p.alias(n) for n, p in zip(names, [p for s in aggregates.values() for p in s.parts], strict=True)])
    base = base.repartition("_ti", "_tj").select("_ti", "_tj", F.col("row").alias("gi"), F.col("col").alias("gj"), *names)
    found: dict[int, DataFrame] = {}
    for level in levels:
        below = max((v for v in found if level % v == 0), default=1)
        fold = lambda c: level_key(F.col(c), level // below).alias(c)  # noqa: B023, E731
        found[level] = found.get(below, base).groupBy("_ti", "_tj", fold("gi"), fold("gj")).agg(*[F.sum(n).alias(n) for n in names])
    out = []
    for level, states in found.items():
        each = iter(names)
        out.append(states.select(F.lit(level).alias("level"), "gi", "gj", *[s.result(*[F.col(next(each)) for _ in s.parts]).alias(n) for n, s in aggregates.items()]))
    return reduce(DataFrame.unionByName, out)


def band_overview(cells: DataFrame, levels: Sequence[int], bands: int, method: str = "average") -> DataFrame:
    """level, gi, gj, bands: each band's average or sum over a block, apart from the others; cells: row, col, bands array."""
    if method not in ("average", "sum"):
        raise ValueError(f"bands are averaged or summed, not {method!r}")
    one = average if method == "average" else total
    each = {f"b{b}": one(F.get("bands", F.lit(b))) for b in range(bands)}
    return overview(cells, levels, **each).select(*KEYS, F.array(*each).alias("bands"))


def gathered(overviews: Sequence[DataFrame]) -> DataFrame:
    """level, gi, gj, sim_bands: the bands of each scenario's overview, null where it has none, in one aggregation whatever their number."""
    # keys that are never null: else joins push a filter of their own below each level's shuffle, and levels don't share one
    known = [F.coalesce(k, F.lit(-1)).alias(k) for k in KEYS]
    each = reduce(DataFrame.unionByName, [o.select(*known, F.lit(k).alias("scenario"), "bands") for k, o in enumerate(overviews)])
    of = lambda k: F.first(F.when(F.col("scenario") == k, F.col("bands")), ignorenulls=True)
    return each.groupBy(*KEYS).agg(F.array(*[of(k) for k in range(len(overviews))]).alias("sim_bands"))


def with_scenarios(cells: DataFrame, overviews: Sequence[DataFrame]) -> DataFrame:
    """cells with sim_bands: the bands of each scenario's overview at their level, gi, gj; cells are joined once."""
    none = F.array_repeat(F.lit(None).cast("array<double>"), len(overviews))
    return cells.join(gathered(overviews), list(KEYS), "left").withColumn("sim_bands", F.coalesce("sim_bands", none))


def pa_indicator(cond: Column, masked: Column) -> Column:
    """Null where the condition is; 1 for protected (unmasked) cells, else 0."""
    return F.when(cond.isNotNull(), F.when(~masked, 1.0).otherwise(0.0))


def pyramid(cells: DataFrame, grid: Grid, levels: Sequence[int]) -> DataFrame:
    """Nodes-to-be: level, gi, gj, cond (average), weight (pixels, or their area on a geographic grid), trav, pa.

    cells: row, col, cond, trav, protected (boolean). Blocks without a valid pixel are left out.
    """
    valid = cells.where(F.col("cond").isNotNull()).withColumn("own", pa_indicator(F.col("cond"), ~F.col("protected")))
    weight = area(grid, "cond") if grid.is_geo else count("cond").as_double()
    return overview(valid, levels, cond=average("cond"), weight=weight, trav=average("trav"), pa=average("own"))


def dimensions(grid: Grid, level: Column) -> tuple[Column, Column]:
    """Columns and rows of a level."""
    return F.ceil(F.lit(grid.ncols) / level), F.ceil(F.lit(grid.nrows) / level)
