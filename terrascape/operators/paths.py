"""Least-cost paths from each source over its graph.

Costs are hundredths of a km. The adjusted path of a target is the one of least (cost, sum of
adjusted km), and that sum is reported; the intact one reports its cost. Each of four ways gives
these: solved() relaxes the edges of a block of sources at a time in one task, within() does so for
nodes, whose links it finds itself, staged() goes up level by level by joins and aggregations of what
changed, relaxed() does so over all levels at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascape.functions.geometry import quantised
from terrascape.grid import Grid, Params
from terrascape.operators.tiled import cents, km
from terrascape.sources.cells import deleted, shared_dir

#: Rows and columns of a block of sources that is solved at a time.
BLOCK = 8


def relaxed(edges: DataFrame, sources: DataFrame, km: str, most: int = 10_000) -> DataFrame:
    """src, node, cost, total: by rounds of join and minimum, each written to the shared folder, until a round changes no row; RuntimeError beyond `most` rounds."""
    spark = edges.sparkSession
    path = f"{shared_dir(spark)}/paths-{uuid.uuid4().hex}"
    links = edges.select("src", "u", "v", quantised(F.col(km)).alias("q"), F.col(km).alias("km"))
    links.write.parquet(f"{path}/links")
    links = spark.read.parquet(f"{path}/links")
    best = sources.select("src", F.col("src").alias("node"), F.lit(0).alias("cost"), F.lit(0.0).alias("total"), F.lit(True).alias("changed"))
    best.write.parquet(f"{path}/0")
    for i in range(most):
        best = spark.read.parquet(f"{path}/{i}")
        if best.where("changed").isEmpty():
            return best.where("node <> src").drop("changed")
        # only what changed in the last round can lead further
        moved = best.where("changed").drop("changed")
        further = moved.join(links, (moved.src == links.src) & (moved.node == links.u)).select(moved.src, F.col("v").alias("node"), (F.col("cost") + F.col("q")).alias("cost"), (F.col("total") + F.col("km")).alias("total"))
        both = best.withColumn("changed", F.lit(False)).unionByName(further.withColumn("changed", F.lit(True)))
        # of equals the row that was there before wins, so it doesn't count as changed
        least = both.groupBy("src", "node").agg(F.min(F.struct("cost", "total", "changed")).alias("m"))
        least.select("src", "node", "m.cost", "m.total", "m.changed").write.parquet(f"{path}/{i + 1}")
    raise RuntimeError(f"paths weren't settled after {most} rounds")


def paths_by_rounds(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """src, node, adj, geo of every target that is reached."""
    there = relaxed(edges, sources, "adj").select("src", "node", F.col("total").alias("adj"))
    intact = relaxed(edges, sources, "geo").select("src", "node", (F.col("cost") / 100).alias("geo"))
    return there.join(intact, ["src", "node"])


class _Tables:
    """Bucketed tables of one run below a folder of the shared one: joined and aggregated on their keys without a shuffle."""

    def __init__(self, df: DataFrame, keys: tuple[str, str], folder: str):
        self.spark, self.path, self.names = df.sparkSession, f"{shared_dir(df.sparkSession)}/{folder}-{uuid.uuid4().hex}", {}
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys = keys

    def write(self, df: DataFrame, place: str, keys: tuple[str, str] | None = None, by: Sequence[str] = ()) -> DataFrame:
        """df as a table at `place`; without keys its rows already lie by the run's keys."""
        self.names[place] = f"staged_{uuid.uuid4().hex}"
        rows = df.repartition(self.buckets, *keys) if keys else df
        out = rows.write.option("path", f"{self.path}/{place}").bucketBy(self.buckets, *(keys or self.keys))
        (out.partitionBy(*by) if by else out).saveAsTable(self.names[place])
        return self.spark.table(self.names[place])

    def forget(self, place: str, files: bool = True) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(place)}")
        if files:
            deleted(self.spark, f"{self.path}/{place}")


def _onward(at: DataFrame, links: DataFrame) -> DataFrame:
    """src, node, adj, geo: the least that the links from rows of `at` lead to, of what moved there."""
    met = at.join(links, (at.src == links.src) & (at.node == links.u))
    there = F.when(F.col("moved_adj"), F.struct((F.col("adj.cost") + F.col("q_adj")).alias("cost"), (F.col("adj.total") + F.col("km")).alias("total")))
    each = met.select(at.src, F.col("v").alias("node"), there.alias("adj"), F.when(F.col("moved_geo"), F.col("geo") + F.col("q_geo")).alias("geo"))
    return each.groupBy("src", "node").agg(F.min("adj").alias("adj"), F.min("geo").alias("geo"))


def staged(edges: DataFrame, sources: DataFrame, levels: Sequence[int], most: int = 10_000) -> DataFrame:
    """src, node, adj, geo of every target that is reached, level by level; RuntimeError if a level isn't settled after `most` rounds.

    Links lead within a level or up to the next, so a level is settled for good before the next
    one starts with what its rim hands on. Links are written once, by level, in buckets of (source,
    from); what is known is in equal buckets of (source, node). So in a round only what the links
    of changed rows lead to, added up per target, is shuffled; links and known rows stay in place.
    """
    work = _Tables(edges, ("src", "node"), "staged-paths")
    level = lambda c: F.shiftright(c, 48)
    flat = edges.select("src", "u", "v", quantised(F.col("adj")).alias("q_adj"), F.col("adj").alias("km"), quantised(F.col("geo")).alias("q_geo"), level("u").alias("level"), (level("v") > level("u")).alias("up"))
    try:
        links = work.write(flat, "links", ("src", "u"), ("level", "up"))
        start = sources.select("src", F.col("src").alias("node"), F.struct(F.lit(0).cast("long").alias("cost"), F.lit(0.0).alias("total")).alias("adj"), F.lit(0).cast("long").alias("geo"))
        everywhere = {"moved_adj": F.lit(True), "moved_geo": F.lit(True)}
        done = []
        for v in levels:
            within = links.where((F.col("level") == v) & ~F.col("up"))
            place = f"level-{v}-0"
            best = work.write(start.withColumns(everywhere), place, work.keys)
            for i in range(most):
                moved = best.where("moved_adj OR moved_geo")
                if moved.isEmpty():
                    break
                further = _onward(moved, within).select("src", "node", F.col("adj").alias("new_adj"), F.col("geo").alias("new_geo"))
                both = best.select("src", "node", "adj", "geo").join(further, ["src", "node"], "full")
                less = lambda new, old: F.coalesce(F.col(new) < F.col(old), F.col(new).isNotNull() & F.col(old).isNull())
                after = both.select("src", "node", F.least("adj", "new_adj").alias("adj"), F.least("geo", "new_geo").alias("geo"), less("new_adj", "adj").alias("moved_adj"), less("new_geo", "geo").alias("moved_geo"))
                best = work.write(after, f"level-{v}-{i + 1}")
                work.forget(place)
                place = f"level-{v}-{i + 1}"
            else:
                raise RuntimeError(f"paths of level {v} weren't settled after {most} rounds")
            done.append(place)
            start = _onward(best.withColumns(everywhere), links.where((F.col("level") == v) & F.col("up")))
        schema = best.schema
        work.forget("links")
    finally:
        for place in list(work.names):
            work.forget(place, files=False)
    out = edges.sparkSession.read.schema(schema).parquet(*[f"{work.path}/{place}" for place in done])
    return out.where("node <> src").select("src", "node", F.col("adj.total").alias("adj"), (F.col("geo") / 100).alias("geo"))


def _least(n: int, start: np.ndarray, u: np.ndarray, v: np.ndarray, q: np.ndarray, km: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, sum of km) of the least path to each node from the start of its own source."""
    far = np.iinfo(np.int64).max // 4
    cost = np.full(n, far)
    cost[start] = 0
    while True:
        before = cost.copy()
        np.minimum.at(cost, v, cost[u] + q)
        if (cost == before).all():
            break
    tight = (cost[u] + q == cost[v]) & (cost[u] < far)
    u, v, km = u[tight], v[tight], km[tight]
    total = np.full(n, np.inf)
    total[start] = 0
    while True:
        before = total.copy()
        np.minimum.at(total, v, total[u] + km)
        if (total == before).all():
            return np.where(cost < far, cost, -1), total


def solved(edges: DataFrame) -> DataFrame:
    """src, node, adj, geo of every target that is reached; a task holds the edges of a block of sources."""
    row, col = F.shiftright("src", 24).bitwiseAND(F.lit((1 << 24) - 1)), F.col("src").bitwiseAND(F.lit((1 << 24) - 1))
    rows = edges.withColumns({"block_i": F.floor(row / BLOCK), "block_j": F.floor(col / BLOCK)})

    def run(group: pa.Table) -> pa.Table:
        src, u, v = (group.column(c).to_numpy() for c in ("src", "u", "v"))
        # a (source, node) as one number, by their places among the block's sources and nodes
        starts, mine = np.unique(src, return_inverse=True)
        nodes, at = np.unique(np.concatenate([u, v, src]), return_inverse=True)
        pairs, place = np.unique(np.tile(mine.ravel(), 3) * len(nodes) + at.ravel(), return_inverse=True)
        place, ends = place.ravel(), np.stack([starts[pairs // len(nodes)], nodes[pairs % len(nodes)]], 1)
        start = np.flatnonzero(ends[:, 0] == ends[:, 1])
        iu, iv = place[: len(src)], place[len(src) : 2 * len(src)]
        cents = lambda km: np.floor(km * 100 + 0.5).astype(np.int64)
        adj, geo = group.column("adj").to_numpy(), group.column("geo").to_numpy()
        _, total = _least(len(ends), start, iu, iv, cents(adj), adj)
        cost, _ = _least(len(ends), start, iu, iv, cents(geo), geo)
        hit = (cost >= 0) & (ends[:, 0] != ends[:, 1])
        return pa.table({"src": ends[hit, 0], "node": ends[hit, 1], "adj": total[hit], "geo": cost[hit] / 100})

    return rows.groupBy("block_i", "block_j").applyInArrow(run, "src long, node long, adj double, geo double")


def _links(place: np.ndarray, level: np.ndarray, gi: np.ndarray, gj: np.ndarray, rim: np.ndarray, coarsest: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the links that graph.edges() has, as places in these nodes: queen neighbours, and up a level from the rim."""
    key = lambda at, v, i, j: (at * 16 + np.log2(v).astype(np.int64)) << 48 | i << 24 | j
    own = key(place, level, gi, gj)
    order = np.argsort(own)
    own = own[order]
    us, vs = [], []

    def add(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        u, v, i, j = (x[(i >= 0) & (j >= 0)] for x in (u, v, i, j))
        k = key(place[u], v, i, j)
        at = np.minimum(np.searchsorted(own, k), len(own) - 1)
        us.append(u[own[at] == k])
        vs.append(order[at[own[at] == k]])

    every, up = np.arange(len(place)), np.flatnonzero(rim & (level < coarsest))
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            if i or j:
                add(every, level, gi + i, gj + j)
            if i and j:
                add(up, level[up] * 2, (gi[up] + i) // 2, (gj[up] + j) // 2)
    return np.concatenate(us), np.concatenate(vs)


def within(grid: Grid, params: Params) -> Callable[[pa.Table], pa.Table]:
    """A function of the nodes of a block of sources (src, node, trav, rim, ...) that gives those that are reached, with adj and geo; of isolated sources themselves, a row step away."""
    most, coarsest, low = params.max_cost, params.levels[-1], (1 << 24) - 1

    def run(nodes: pa.Table) -> pa.Table:
        if not len(nodes):
            return nodes.append_column("adj", pa.array([], pa.float64())).append_column("geo", pa.array([], pa.float64()))
        src, node, trav = (nodes.column(c).to_numpy() for c in ("src", "node", "trav"))
        rim = nodes.column("rim").to_numpy(zero_copy_only=False).astype(bool)
        level, gi, gj = node >> 48, (node >> 24) & low, node & low
        starts, place = np.unique(src, return_inverse=True)
        weight = (1 - most) * trav + most
        u, v = _links(place, level, gi, gj, rim, coarsest)
        geo = km(grid, gi[u], gj[u], level[u], gi[v], gj[v], level[v])
        adj, start = weight[v] * geo, np.flatnonzero(src == node)
        _, total = _least(len(src), start, u, v, cents(adj), adj)
        cost, _ = _least(len(src), start, u, v, cents(geo), geo)
        row, col = (src >> 24) & low, src & low
        beside = (level == 1) & (np.abs(gi - row) <= 1) & (np.abs(gj - col) <= 1)
        alone = np.bincount(place[beside], minlength=len(starts))[place] == 1
        far = np.flatnonzero((cost >= 0) & (src != node) & ~alone)
        own = np.flatnonzero(alone & (src == node))
        step = km(grid, row[own], col[own], 1, row[own] + 1, col[own], 1)
        out = nodes.take(np.concatenate([far, own]))
        out = out.append_column("adj", pa.array(np.concatenate([total[far], weight[own] * step])))
        return out.append_column("geo", pa.array(np.concatenate([cost[far] / 100, cents(step) / 100])))

    return run
