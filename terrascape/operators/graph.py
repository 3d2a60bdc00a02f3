"""The directed graph of each source's window: queen neighbours within a level, and links up a level from the rim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascape.functions.geometry import distance_km, edge_weight, world
from terrascape.grid import Grid

_QUEEN = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def _end(prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}_{c}") for c in ("node", "level", "gi", "gj")]


def costed(pairs: DataFrame, grid: Grid, max_cost: float) -> DataFrame:
    """src, u, v, adj, geo: km between the centres, and that times what the target costs; pairs: u_* and v_* with v_trav."""
    at = lambda p: world(grid, F.col(f"{p}_gi"), F.col(f"{p}_gj"), F.col(f"{p}_level"))
    geo = distance_km(grid, *at("u"), *at("v")).cast("double")
    return pairs.select("src", F.col("u_node").alias("u"), F.col("v_node").alias("v"), (edge_weight(F.col("v_trav"), max_cost) * geo).alias("adj"), geo.alias("geo"))


def _joined(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """The pairs whose target is a node of the same source."""
    to = nodes.select(F.col("src"), F.col("node").alias("v_node"), F.col("level").alias("v_level"), F.col("gi").alias("v_gi"), F.col("gj").alias("v_gj"), F.col("trav").alias("v_trav"))
    return targets.join(to, ["src", "v_level", "v_gi", "v_gj"])


def queen_targets(nodes: DataFrame) -> DataFrame:
    step = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in _QUEEN])
    each = nodes.select("src", *_end("u"), F.inline(step))
    return each.select("src", "u_node", "u_level", "u_gi", "u_gj", F.col("u_level").alias("v_level"), (F.col("u_gi") + F.col("di")).alias("v_gi"), (F.col("u_gj") + F.col("dj")).alias("v_gj"))


def fringe_targets(nodes: DataFrame, coarsest: int) -> DataFrame:
    """From rim cells to the cells of the next level over their 3 x 3 neighbourhood."""
    half = lambda k, s: F.floor((F.col(f"u_{k}") + s) / 2).cast("int").alias(f"v_{k}")
    parents = F.array(*[F.struct(half("gi", i), half("gj", j)) for i in (-1, 1) for j in (-1, 1)])
    each = nodes.where(F.col("rim") & (F.col("level") < coarsest)).select("src", *_end("u"))
    return each.select("*", (F.col("u_level") * 2).alias("v_level"), F.inline(parents))


def edges(nodes: DataFrame, grid: Grid, max_cost: float, coarsest: int) -> DataFrame:
    """Both kinds of links, in one join of their targets with the nodes."""
    return costed(_joined(nodes, queen_targets(nodes).unionByName(fringe_targets(nodes, coarsest))), grid, max_cost)


def isolated(nodes: DataFrame, grid: Grid, max_cost: float) -> DataFrame:
    """Targets of sources without a level-1 neighbour: the source itself, one row step away; columns of paths()."""
    first = nodes.where("level = 1")
    beside = first.where((F.abs(F.col("gi") - F.col("row")) <= 1) & (F.abs(F.col("gj") - F.col("col")) <= 1))
    alone = beside.groupBy("src").agg(F.count("*").alias("n"), F.max_by("trav", F.col("node") == F.col("src")).alias("trav"), F.max("row").alias("row"), F.max("col").alias("col")).where("n = 1")
    x1, y1 = world(grid, F.col("row"), F.col("col"))
    x2, y2 = world(grid, F.col("row") + 1, F.col("col"))
    km = distance_km(grid, x1, y1, x2, y2).cast("double")
    return alone.select("src", F.col("src").alias("node"), (edge_weight(F.col("trav"), max_cost) * km).alias("adj"), (F.round(km * 100) / 100).alias("geo"))
