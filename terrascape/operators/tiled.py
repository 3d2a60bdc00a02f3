"""All sources of a tile at once: Spark sends each tile its sources and the overview cells within reach.

A tile's task holds what the tile and its reach hold, whatever the size of the raster. Windows
of the same level are arrays of one shape, so that paths are relaxed for many sources together,
from the finest level to the coarsest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascape.functions.geometry import EARTH_M, GAUSS
from terrascape.grid import Grid, Params

#: Sources whose windows are held at once.
TOGETHER = 128
_FAR = 1 << 40
_STEPS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def _circle(i0, i1, j0, j1, r):
    """Area of rectangles within a circle about the origin."""

    def under(t):
        return (t * np.sqrt(np.maximum(r * r - t * t, 0)) + r * r * np.arcsin(np.minimum(t / r, 1))) / 2

    def corner(i, j):
        x, y = np.minimum(np.abs(i), r), np.abs(j)
        full = np.sqrt(np.maximum(r * r - y * y, 0))
        part = np.minimum(x, full) * y + np.where(x > full, under(x) - under(np.minimum(full, r)), 0)
        return np.sign(i) * np.sign(j) * np.where(y >= r, under(x), part)

    return corner(i1, j1) - corner(i0, j1) - corner(i1, j0) + corner(i0, j0)


def ring(grid: Grid, params: Params, level: int, row: np.ndarray, col: np.ndarray, gi: np.ndarray, gj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of each window cell in the ring, and whether the outer circle runs through it: (sources, rows, columns)."""
    inner, outer = params.radii(level)
    clip = lambda k, n: (np.maximum(k * level, 0).astype(float), np.minimum((k + 1) * level, n).astype(float))
    (i0, i1), (j0, j1) = clip(gi, grid.nrows), clip(gj, grid.ncols)
    i0, i1 = ((x - (row + 0.5)[:, None])[:, :, None] for x in (i0, i1))
    j0, j1 = ((x - (col + 0.5)[:, None])[:, None, :] for x in (j0, j1))
    real = (i1 > i0) & (j1 > j0)
    if params.window_mode == "square":
        side = lambda a, b, r: np.maximum(0, np.minimum(b, r) - np.maximum(a, -r))
        area = lambda r: side(i0, i1, r) * side(j0, j1, r)
    else:
        area = lambda r: _circle(i0, i1, j0, j1, r)
    full = np.where(real, (i1 - i0) * (j1 - j0), 1.0)
    share = np.where(real, np.clip((area(outer) - (area(inner) if inner else 0)) / full, 0, 1), 0).astype(np.float32)
    share[share < 1e-12] = 0  # what rounding leaves of nothing
    near = np.maximum(0, np.maximum(i0, -i1)) ** 2 + np.maximum(0, np.maximum(j0, -j1)) ** 2
    far = np.maximum(np.abs(i0), np.abs(i1)) ** 2 + np.maximum(np.abs(j0), np.abs(j1)) ** 2
    eps = (outer * outer + 1) * 1e-12
    return share, (share > 0) & (near <= outer * outer + eps) & (far >= outer * outer - eps)


def km(grid: Grid, i1, j1, l1, i2, j2, l2) -> np.ndarray:
    """Distance between cell centres, as float32 values."""
    a, b, c, d, e, f = grid.transform
    at = lambda i, j, v: (a * (j + 0.5) * v + b * (i + 0.5) * v + c, d * (j + 0.5) * v + e * (i + 0.5) * v + f)
    (x1, y1), (x2, y2) = at(i1, j1, l1), at(i2, j2, l2)
    if not grid.is_geo:
        return (np.hypot(x2 - x1, y2 - y1) / 1000).astype(np.float32).astype(float)
    p1, p2 = np.radians(y1), np.radians(y2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(x2 - x1) / 2) ** 2
    return (2 * EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) / 1000).astype(np.float32).astype(float)


def cents(distance: np.ndarray) -> np.ndarray:
    """Hundredths of a km; of what is missing, more than any path has."""
    return np.where(np.isfinite(distance), np.floor(distance * 100 + 0.5), _FAR).astype(np.int64)


class Level:
    """Windows of some sources at one level, and the least paths found in them."""

    def __init__(self, dense: dict, grid: Grid, params: Params, level: int, row: np.ndarray, col: np.ndarray):
        outer = params.radii(level)[1]
        width = int(2 * outer / level) + 2
        self.level, self.grid = level, grid
        self.gi = np.floor((row + 0.5 - outer) / level).astype(np.int64)[:, None] + np.arange(width)
        self.gj = np.floor((col + 0.5 - outer) / level).astype(np.int64)[:, None] + np.arange(width)
        base_i, base_j, arrays = dense["base_i"], dense["base_j"], dense["arrays"]
        pick = (self.gi - base_i)[:, :, None], (self.gj - base_j)[:, None, :]
        self.cond, self.weight, self.trav, self.pa = (x[pick] for x in arrays[:4])
        share, rim = ring(grid, params, level, row, col, self.gi, self.gj)
        self.ok = (share > 0) & np.isfinite(self.cond)
        self.area = np.where(self.ok, self.weight * share, 0)
        if params.window_mode == "square":
            rim = np.zeros_like(self.ok)
            for axis in (1, 2):
                used = self.ok.any(axis=3 - axis)
                first, last = used.argmax(axis=1), used.shape[1] - 1 - used[:, ::-1].argmax(axis=1)
                at = np.arange(used.shape[1])
                edge = (at == first[:, None]) | (at == last[:, None])
                rim |= np.expand_dims(edge, 3 - axis)
        self.rim = rim & self.ok

    def relax(self, cost: np.ndarray, links: list[np.ndarray]) -> np.ndarray:
        """Least costs within the level, from those at hand; links: km of the step into each cell, by direction."""
        steps = [np.where(self.ok, cents(x), _FAR) for x in links]
        padded = np.full((cost.shape[0], cost.shape[1] + 2, cost.shape[2] + 2), _FAR)
        inside = padded[:, 1:-1, 1:-1]
        inside[:] = cost
        n, m = cost.shape[1:]
        while True:
            before = inside.copy()
            for (i, j), step in zip(_STEPS, steps, strict=True):
                np.minimum(inside, padded[:, 1 - i : 1 - i + n, 1 - j : 1 - j + m] + step, out=inside)
            if (before == inside).all():
                return np.minimum(before, _FAR)

    def totals(self, cost: np.ndarray, start: np.ndarray, links: list[np.ndarray]) -> np.ndarray:
        """Least sums of km along paths of least cost."""
        shape = (cost.shape[0], cost.shape[1] + 2, cost.shape[2] + 2)
        far, total = np.full(shape, _FAR), np.full(shape, np.inf)
        far[:, 1:-1, 1:-1], total[:, 1:-1, 1:-1] = cost, start
        n, m = cost.shape[1:]
        inside = total[:, 1:-1, 1:-1]
        ways = []
        for (i, j), x in zip(_STEPS, links, strict=True):
            cut = np.s_[:, 1 - i : 1 - i + n, 1 - j : 1 - j + m]
            ways.append((cut, np.where((far[cut] + cents(x) == cost) & (cost < _FAR) & self.ok, x, np.inf)))
        while True:
            before = inside.copy()
            for cut, x in ways:
                np.minimum(inside, total[cut] + x, out=inside)
            if (before == inside).all():
                return before

    def links(self, weight: np.ndarray | None) -> list[np.ndarray]:
        gi, gj = self.gi[:, :, None], self.gj[:, None, :]
        out = []
        for i, j in _STEPS:
            d = km(self.grid, gi - i, gj - j, self.level, gi, gj, self.level)
            out.append(np.broadcast_to(d, self.ok.shape) if weight is None else weight * d)
        return out


def tile_scores(src: np.ndarray, focal: np.ndarray | None, dense: dict[int, dict], grid: Grid, params: Params, pa_to_pa: bool, scenarios: int) -> np.ndarray:
    """Value of each source (row, col) of a tile."""
    row, col = src[:, 0], src[:, 1]
    n = len(row)
    every = np.arange(n)
    top = np.zeros((len(params.lambdas), max(1, scenarios), n))
    bottom = np.zeros((len(params.lambdas), n))
    kernel = (lambda d, s: np.exp(-((d / s) ** 2) / GAUSS)) if scenarios else (lambda d, s: np.exp(-d / s))
    up = None
    for level in params.levels:
        w = Level(dense[level], grid, params, level, row, col)
        weights = (1 - params.max_cost) * np.where(np.isfinite(w.trav), w.trav, w.cond) + params.max_cost
        pa_share = np.where(np.isfinite(w.pa), w.pa, 0) if pa_to_pa else 1.0
        start = np.zeros(w.ok.shape, bool)
        if up is None:
            si, sj = row - w.gi[:, 0], col - w.gj[:, 0]
            start[every, si, sj] = True
            near = np.zeros(n, np.int64)
            for i, j in _STEPS:
                near += w.ok[every, si + i, sj + j]
            alone = near == 0
        found = []
        for weighted in (True, False):
            links = w.links(weights if weighted else None)
            cost, total = np.full(w.ok.shape, _FAR), np.full(w.ok.shape, np.inf)
            ends = None
            if up is None:
                cost[start], total[start] = 0, 0
            else:
                below, old_cost, old_total = up[0], *up[1 + (not weighted)]
                s, a, b = np.nonzero(below.rim & (old_cost < _FAR))
                gi, gj = below.gi[s, a], below.gj[s, b]
                ends = []
                for i in (-1, 1):
                    for j in (-1, 1):
                        pi, pj = (gi + i) // 2, (gj + j) // 2
                        vi, vj = pi - w.gi[s, 0], pj - w.gj[s, 0]
                        fits = (vi >= 0) & (vj >= 0) & (vi < w.ok.shape[1]) & (vj < w.ok.shape[2])
                        fits[fits] = w.ok[s[fits], vi[fits], vj[fits]]
                        at = s[fits], vi[fits], vj[fits]
                        d = km(grid, gi[fits], gj[fits], below.level, pi[fits], pj[fits], level)
                        d = weights[at] * d if weighted else d
                        ends.append((at, old_cost[s, a, b][fits] + cents(d), old_total[s, a, b][fits] + d))
                for at, c, _ in ends:
                    np.minimum.at(cost, at, c)
            cost = w.relax(cost, links)
            if weighted:
                for at, c, t in ends or ():
                    same = c == cost[at]
                    np.minimum.at(total, tuple(x[same] for x in at), t[same])
                total = w.totals(cost, total, links)
            found.append((cost, total))
        up = (w, *found)
        hit = (found[0][0] < _FAR) & (found[1][0] < _FAR) & ~start & ~alone[:, None, None]
        adj, geo = np.where(hit, found[0][1], 0), np.where(hit, found[1][0], 0) / 100
        sims = [np.ones(w.ok.shape)]
        if scenarios:
            # only of cells that count, from sources that have bands
            wanted = hit | (start & alone[:, None, None]) if level == 1 else hit
            s, a, b = np.nonzero(wanted & np.isfinite(focal).all(axis=1)[:, None, None])
            sims = [np.zeros(w.ok.shape) for _ in range(scenarios)]
            for sim, x in zip(sims, dense[level]["arrays"][4:], strict=True):
                met = np.exp(-np.abs(x[w.gi[s, a] - dense[level]["base_i"], w.gj[s, b] - dense[level]["base_j"]] - focal[s]).sum(axis=1))
                sim[s, a, b] = np.where(np.isfinite(met), met, 0)
        for k, scale in enumerate(params.lambdas):
            near, far = np.where(hit, kernel(adj, scale) * w.cond * pa_share * w.area, 0), np.where(hit, kernel(geo, scale) * w.area, 0)
            bottom[k] += (far * sims[0]).sum(axis=(1, 2))
            for z, sim in enumerate(sims):
                top[k, z] += (near * sim).sum(axis=(1, 2))
        if level == 1 and alone.any() and not pa_to_pa:
            at = np.flatnonzero(alone)
            spot = at, si[at], sj[at]
            d = km(grid, row[at], col[at], 1, row[at] + 1, col[at], 1)
            for k, scale in enumerate(params.lambdas):
                for z, sim in enumerate(sims):
                    top[k, z, at] = kernel(weights[spot] * d, scale) * w.cond[spot] * w.area[spot] * sim[spot]
                bottom[k, at] = kernel(cents(d) / 100, scale) * w.area[spot] * sims[0][spot]
    best = 0.5 * (top.mean(axis=1) + top.min(axis=1)) if scenarios else top[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(bottom > 0, best / bottom, 0)
    return value.mean(axis=0) if len(params.lambdas) else np.zeros(n)


def _dense(bands, n: int):
    """n bands as numbers, not a number where they are missing."""
    nan = F.lit(math.nan)
    return F.coalesce(F.transform(bands, lambda x: F.coalesce(x, nan)), F.array_repeat(nan, n))


def _stacked(column: pa.ChunkedArray, *shape: int) -> np.ndarray:
    """A column of lists of equal length as one array."""
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), *shape)


def tiled(sources: DataFrame, pyramid: DataFrame, grid: Grid, params: Params, pa_to_pa: bool = False, scenarios: int = 0, bands: int = 0) -> DataFrame:
    """row, col, value of each source; with scenarios, sources have bands (that many) and the pyramid sim_bands, an array of bands a scenario."""
    if grid.is_geo and (grid.transform[1] or grid.transform[3]):
        raise ValueError("a rotated geographic grid needs engine='relational'")
    size = max(64, params.levels[-1])
    last = (grid.nrows - 1) // size, (grid.ncols - 1) // size

    def spread(k: str, n: int):
        low = F.expr("CASE " + " ".join(f"WHEN level = {v} THEN {k} * {v} - {int(params.radii(v)[1]) + v + 1}" for v in params.levels) + " END")
        high = F.expr("CASE " + " ".join(f"WHEN level = {v} THEN ({k} + 1) * {v} + {int(params.radii(v)[1]) + v + 1}" for v in params.levels) + " END")
        return F.sequence(F.greatest(F.floor(low / size), F.lit(0)).cast("int"), F.least(F.floor(high / size), F.lit(n)).cast("int"))

    near = pyramid.withColumn("ti", F.explode(spread("gi", last[0]))).withColumn("tj", F.explode(spread("gj", last[1])))
    own = sources.withColumns({"ti": F.floor(F.col("row") / size).cast("int"), "tj": F.floor(F.col("col") / size).cast("int")})

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"row": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), "value": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        ti, tj = (k.as_py() for k in key)
        level, gi, gj = (right.column(c).to_numpy() for c in ("level", "gi", "gj"))
        columns = [right.column(c).to_numpy() for c in ("cond", "weight", "trav", "pa")]
        stacks = []
        if scenarios:
            stacks = list(np.moveaxis(_stacked(right.column("sim_bands"), scenarios, bands), 1, 0))
        dense = {}
        for v in params.levels:
            reach = int(params.radii(v)[1]) // v + 3
            base = ti * size // v - reach, tj * size // v - reach
            shape = size // v + 2 * reach + 2, size // v + 2 * reach + 2
            mine = (level == v) & (gi >= base[0]) & (gj >= base[1]) & (gi < base[0] + shape[0]) & (gj < base[1] + shape[1])
            at = gi[mine] - base[0], gj[mine] - base[1]
            arrays = []
            for c in columns:
                x = np.full(shape, np.nan)
                x[at] = c[mine].astype(float)
                arrays.append(x)
            for s in stacks:
                x = np.full((*shape, s.shape[1]), np.nan)
                x[at] = s[mine]
                arrays.append(x)
            dense[v] = {"base_i": base[0], "base_j": base[1], "arrays": arrays}
        src = np.stack([left.column("row").to_numpy(), left.column("col").to_numpy()], 1).astype(np.int64)
        focal = _stacked(left.column("bands"), bands) if scenarios else None
        values = [tile_scores(src[i : i + TOGETHER], None if focal is None else focal[i : i + TOGETHER], dense, grid, params, pa_to_pa, scenarios) for i in range(0, len(src), TOGETHER)]
        return pa.table({"row": src[:, 0].astype(np.int32), "col": src[:, 1].astype(np.int32), "value": np.concatenate(values)})

    if scenarios:
        own = own.withColumn("bands", _dense(F.col("bands"), bands))
        near = near.withColumn("sim_bands", F.flatten(F.transform("sim_bands", lambda b: _dense(b, bands))))
    return own.groupBy("ti", "tj").cogroup(near.groupBy("ti", "tj")).applyInArrow(run, "row int, col int, value double")
