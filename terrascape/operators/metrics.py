"""Sums over the targets of each source, by distance kernels, and their means over kernel scales."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascape.functions.geometry import exponential, gaussian
from terrascape.grid import Grid, Params
from terrascape.operators.paths import within
from terrascape.operators.pyramid import KEYS


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom; 0 where bottom isn't above 0."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def reached(paths: DataFrame, nodes: DataFrame, alone: DataFrame) -> DataFrame:
    """src, adj, geo and what each target brings: cond, pa, area; of isolated sources only their own target."""
    mine = nodes.select("src", "node", "cond", "pa", "area")
    far = paths.join(alone.select("src"), "src", "left_anti").unionByName(alone)
    return far.join(mine, ["src", "node"])


def per_scale(targets: DataFrame, lambdas: Sequence[float]) -> DataFrame:
    return targets.withColumn("scale", F.explode(F.array(*[F.lit(float(x)) for x in lambdas])))


def connectedness(targets: DataFrame, lambdas: Sequence[float]) -> DataFrame:
    """src, scale, value."""
    d = lambda c: exponential(F.col(c), F.col("scale"))
    sums = per_scale(targets, lambdas).groupBy("src", "scale").agg(
        F.sum(d("adj") * F.col("cond") * F.col("pa") * F.col("area")).alias("top"), F.sum(d("geo") * F.col("area")).alias("bottom")
    )
    return sums.select("src", "scale", ratio(F.col("top"), F.col("bottom")).alias("value"))


def minimax(values: Column | str) -> Column:
    """Half of mean and least, as an aggregate."""
    return 0.5 * (F.avg(values) + F.min(values))


#: Rows and columns of a block of sources whose similarities are worked out together.
BLOCK = 16


def _blocks(df: DataFrame) -> DataFrame:
    """df with block_i, block_j, the block of sources of its row, col."""
    return df.withColumns({f"block_{k}": F.floor(F.col(c) / BLOCK) for k, c in (("i", "row"), ("j", "col"))})


def _vectors(met: DataFrame, present: DataFrame, layers: DataFrame, bands: int) -> DataFrame:
    """block_i, block_j, level, gi, gj, bands: what the cells that a block meets have, all scenarios in a row, and at level 0 what its sources have."""
    nan = F.lit(float("nan"))
    dense = lambda b: F.slice(F.concat(F.coalesce(F.transform(b, lambda x: F.coalesce(x.cast("double"), nan)), F.array()), F.array_repeat(nan, bands)), 1, bands)
    there = met.toDF("block_i", "block_j", *KEYS).join(layers.toDF(*KEYS, "sim_bands"), list(KEYS)).withColumn("bands", F.flatten(F.transform("sim_bands", dense)))
    here = _blocks(present).select("block_i", "block_j", F.lit(0).alias("level"), F.col("row").alias("gi"), F.col("col").alias("gj"), dense(F.col("bands")).alias("bands"))
    return there.select(*here.columns).unionByName(here).toDF(*here.columns)


def _packed(level, gi, gj) -> np.ndarray:
    level, gi, gj = (np.asarray(x, np.int64) for x in (level, gi, gj))
    return (level << 48) | (gi << 24) | gj


def _alike(focal: np.ndarray, met: np.ndarray, known: pa.Table, scenarios: int, bands: int) -> pa.Array:
    """For each pair of packed places and each scenario exp of minus the sum of absolute differences; null if any is missing."""
    sims = np.full((len(focal), scenarios), np.nan)
    if len(known) and len(focal):
        flat = known.column("bands").combine_chunks()
        first, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False)
        keys = _packed(*(known.column(c).to_numpy() for c in KEYS))
        order = np.argsort(keys)

        def place(k: np.ndarray) -> np.ndarray:
            at = order[np.minimum(np.searchsorted(keys, k, sorter=order), len(keys) - 1)]
            return np.where(keys[at] == k, at, -1)

        focal, met = place(focal), place(met)
        both = np.flatnonzero((focal >= 0) & (met >= 0))
        step = max(1, (1 << 20) // max(1, bands))
        for i in range(0, len(both), step):
            rows = both[i : i + step]
            a = values[first[focal[rows]][:, None] + np.arange(bands)]
            for k in range(scenarios):
                sims[rows, k] = np.exp(-np.abs(a - values[first[met[rows]][:, None] + k * bands + np.arange(bands)]).sum(axis=1))
    found = pa.array(sims.ravel(), pa.float64(), mask=np.isnan(sims.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sims) + 1, dtype=np.int32) * scenarios), found)


def similarities(targets: DataFrame, nodes: DataFrame, present: DataFrame, layers: DataFrame, scenarios: int, bands: int) -> DataFrame:
    """targets with sims: for each scenario exp of minus the sum of absolute differences between a source's bands and its target's; null if any is missing.

    targets: src, node, row, col (the source's), level, gi, gj, ..., of `nodes`; present: row, col, bands; layers:
    level, gi, gj, sim_bands. Bands are many times as wide as a pair, so each goes once to every
    block of sources that has it as source or target, and not to every pair.
    """
    at = _blocks(targets)
    vectors = _vectors(_blocks(nodes).select("block_i", "block_j", *KEYS).distinct(), present, layers, bands)

    def run(pairs: pa.Table, known: pa.Table) -> pa.Table:
        here, there = (_packed(*(pairs.column(c).to_numpy() for c in names)) for names in (("row", "row", "col"), KEYS))
        return pairs.drop_columns(["block_i", "block_j"]).append_column("sims", _alike(here & ((1 << 48) - 1), there, known, scenarios, bands))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in targets.schema.fields)
    return at.groupBy("block_i", "block_j").cogroup(vectors.groupBy("block_i", "block_j")).applyInArrow(run, f"{schema}, sims array<double>")


def reached_similarities(nodes: DataFrame, met: DataFrame, present: DataFrame, layers: DataFrame, grid: Grid, params: Params, scenarios: int, bands: int) -> DataFrame:
    """src, adj, geo, cond, area, sims of what each source reaches, as similarities() has them.

    nodes: of window(); met: block_i, block_j, level, gi, gj, of which nodes are a part: see seen().
    A node's links, paths and bands are all with its block of sources, so nodes and bands are
    shuffled to blocks once, and links, which are the most by far, and paths never.
    """
    rows = _blocks(nodes).select("block_i", "block_j", "src", "node", "cond", "area", F.col("trav").cast("double").alias("trav"), "rim")
    solve = within(grid, params)

    def run(some: pa.Table, known: pa.Table) -> pa.Table:
        found = solve(some.drop_columns(["block_i", "block_j"]))
        src, node = (found.column(c).to_numpy() for c in ("src", "node"))
        sims = _alike(src & ((1 << 48) - 1), node, known, scenarios, bands)
        return found.select(["src", "adj", "geo", "cond", "area"]).append_column("sims", sims)

    vectors = _vectors(met, present, layers, bands)
    return rows.groupBy("block_i", "block_j").cogroup(vectors.groupBy("block_i", "block_j")).applyInArrow(run, "src long, adj double, geo double, cond double, area double, sims array<double>")


def beri(targets: DataFrame, lambdas: Sequence[float]) -> DataFrame:
    """src, scale, value; targets: with sims, a similarity for each scenario, the present one first; a null one counts as 0."""
    d = lambda c: gaussian(F.col(c), F.col("scale"))
    each = per_scale(targets, lambdas).select("src", "scale", F.posexplode("sims").alias("scenario", "sim"), (d("adj") * F.col("cond") * F.col("area")).alias("top"), (d("geo") * F.col("area")).alias("bottom"))
    sim = F.coalesce("sim", F.lit(0.0))
    sums = each.groupBy("src", "scale", "scenario").agg(F.sum(F.col("top") * sim).alias("top"), F.sum(F.when(F.col("scenario") == 0, F.col("bottom") * sim)).alias("bottom"))
    return sums.groupBy("src", "scale").agg(minimax("top").alias("top"), F.max("bottom").alias("bottom")).select("src", "scale", ratio(F.col("top"), F.col("bottom")).alias("value"))


def scale_mean(values: DataFrame, sources: DataFrame) -> DataFrame:
    """row, col, value of every source: the mean over scales; 0 where nothing is reached or there is no scale."""
    mean = values.groupBy("src").agg(F.avg("value").alias("value"))
    return sources.join(mean, "src", "left").select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))
