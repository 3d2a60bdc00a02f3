"""Cell surfaces made of the input rasters: alignment, masks, protected areas, traversal, options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascape.operators.pyramid import finite


def rescaled(value: Column, scale: float | None) -> Column:
    """Divided by the scale, unless that is None, 0 or 1."""
    return value if scale in (None, 0, 1) else value / F.lit(float(scale))


def aligned(condition: DataFrame, pa: DataFrame | None = None, resistance: DataFrame | None = None) -> DataFrame:
    """row, col, cond, pa, res from rasters (row, col, value): one equi-join each on the cell."""
    out = condition.select("row", "col", F.col("value").alias("cond"))
    for name, other in (("pa", pa), ("res", resistance)):
        if other is None:
            out = out.withColumn(name, F.lit(None).cast("float"))
        else:
            out = out.join(other.select("row", "col", F.col("value").alias(name)), ["row", "col"], "left")
    return out


def with_pa(cond: Column, pa: Column) -> Column:
    """The greater of condition and protection; null where either is."""
    return F.when(cond.isNotNull() & pa.isNotNull(), F.greatest(cond, pa))


def pa_source(cond: Column, pa: Column) -> Column:
    """Whether a cell is a source of the protected-area indicator: some protection, and a valid combined condition."""
    return F.coalesce((pa > 0) & with_pa(cond, pa).isNotNull(), F.lit(False))


def traversal(cond: Column, res: Column) -> Column:
    """1 - resistance within 0 to 1; the condition where resistance is missing; null where the condition is."""
    open_to = F.when(res.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - res)))  # greatest and least pass over nulls
    return F.when(cond.isNotNull(), F.coalesce(open_to, cond))


def gaps() -> Column:
    """Number of cells with a condition and without a resistance."""
    return F.count_if(F.col("cond").isNotNull() & F.col("res").isNull())


def resistance_gaps(cells: DataFrame) -> DataFrame:
    """One row, gaps."""
    return cells.agg(gaps().alias("gaps"))


def prepared(cells: DataFrame, parc: bool) -> DataFrame:
    """row, col, cond, trav, protected, source from aligned cells; parc: protected cells are the sources."""
    raw = cells.select("row", "col", *[finite(F.col(c)).alias(c) for c in ("cond", "pa", "res")])
    source = pa_source(F.col("cond"), F.col("pa")) if parc else F.col("cond").isNotNull()
    cond = with_pa(F.col("cond"), F.col("pa")) if parc else F.col("cond")
    return raw.select("row", "col", cond.cast("double").alias("cond"), F.col("res").cast("double").alias("res"), source.alias("source"), source.alias("protected")).select(
        "row", "col", "cond", traversal(F.col("cond"), F.col("res")).alias("trav"), "protected", "source"
    )


def connected_habitat(value: Column, cond: Column, option: int) -> Column:
    """1: the value, 2: times condition, 3: the root of that."""
    if option == 1:
        return value
    if option == 2:
        return value * cond
    if option == 3:
        return F.sqrt(value * cond)
    raise ValueError(f"option is 1, 2 or 3, not {option!r}")
