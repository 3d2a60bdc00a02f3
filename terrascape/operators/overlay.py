"""Union of polygons as outlines: a planar overlay in joins by cell, and the rings of what is left.

Edges are cut at the lines of a square mesh as fine as there are edges, so each piece has one
cell, and meets only what lies in it. Pieces are cut where they meet others, so that they touch at
their ends alone; equal ones become one with a count for each direction. How many polygons cover
a cell's reference point follows from the edges to its left, as running sums along rows of
cells. From there to the middle of a piece, each piece between them adds or takes one. A piece
is on the outline of the union if nothing covers its outer side. What remains is chained: at each
end the piece follows that bounds the same part of the inside, and doubling steps name the rings.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascape.functions.polygons import signed_area
from terrascape.operators.edges import cut_at_lines, segments
from terrascape.sources.cells import stored

#: Pieces in a cell beyond which the mesh is made finer, and pieces an edge up to which it may be.
MOST_TOGETHER, MOST_PIECES = 64, 32
#: Where in a cell its reference point lies, and by how much the mesh is moved: off the places where outlines tend to be.
REFERENCE, MOVED = (0.41421356, 0.73205081), 0.38671875
#: Places are held to multiples of this share of a cell, so that what meets is equal.
GRAIN = 2.0**-30


@dataclass(frozen=True)
class Mesh:
    x0: float
    y0: float
    side: float
    rows: int
    cols: int


def directed(polygon: DataFrame) -> DataFrame:
    """x1, y1, x2, y2, n: edges with the inside on their left, whichever way the rings run, equal ones counted; rings without an area are left out."""
    edges = segments(polygon.where((F.size("vertices") >= 3) & (signed_area(F.col("vertices")) != 0)))
    turned = F.col("sign") < 0
    ends = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    return edges.select(*ends).where("x1 <> x2 OR y1 <> y2").groupBy("x1", "y1", "x2", "y2").agg(F.count("*").alias("n"))


def _pieces(edges: DataFrame, mesh: Mesh) -> DataFrame:
    """row, col, x1, y1, x2, y2 in cells, n: pieces of edges, equal ones counted."""
    grain = lambda v: F.round(v / GRAIN) * GRAIN
    to = {**{c: grain((F.col(c) - mesh.x0) / mesh.side) for c in ("x1", "x2")}, **{c: grain((F.col(c) - mesh.y0) / mesh.side) for c in ("y1", "y2")}}
    rows = cut_at_lines(edges.withColumns(to), "y", mesh.rows, "row")
    cut = cut_at_lines(rows, "x", mesh.cols, "col").withColumns({c: grain(F.col(c)) for c in ("x1", "y1", "x2", "y2")})
    return cut.where("x1 <> x2 OR y1 <> y2").groupBy("row", "col", "x1", "y1", "x2", "y2").agg(F.sum("n").alias("n"))


def _meshed(edges: DataFrame) -> tuple[Mesh, DataFrame] | None:
    """A mesh, and the pieces of edges in it; None without edges."""
    n, x0, x1, y0, y1 = edges.agg(F.count("*"), F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).head()
    if not n:
        return None
    side = 2.0 ** math.ceil(math.log2(max(x1 - x0, y1 - y0) / max(1.0, math.sqrt(n))))
    while True:
        start = [math.floor(v / side) * side - MOVED * side for v in (x0, y0)]
        mesh = Mesh(*start, side, *(math.ceil((v - s) / side) + 1 for v, s in ((y1, start[1]), (x1, start[0]))))
        found = stored(_pieces(edges, mesh), "mesh")
        most, total = found.groupBy("row", "col").count().agg(F.max("count"), F.sum("count")).head()
        if most <= MOST_TOGETHER or total * 2 > n * MOST_PIECES or max(mesh.rows, mesh.cols) > 1 << 20:
            return mesh, found
        side /= 2


def _meetings(p: DataFrame) -> DataFrame:
    """row, col, x1, y1, x2, y2, points: where pieces meet others of their cell, apart from their own ends."""
    a, b = p.drop("n").alias("a"), p.drop("n").alias("b")
    ends = lambda t: F.struct(*[F.col(f"{t}.{c}") for c in ("x1", "y1", "x2", "y2")])
    low, high = (lambda t, v: F.least(F.col(f"{t}.{v}1"), F.col(f"{t}.{v}2"))), (lambda t, v: F.greatest(F.col(f"{t}.{v}1"), F.col(f"{t}.{v}2")))
    near = ends("a") < ends("b")
    for v in "xy":
        near = near & (low("a", v) <= high("b", v)) & (low("b", v) <= high("a", v))
    pairs = a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.col") == F.col("b.col")) & near)
    c = lambda name: F.col(name)
    rx, ry, qx, qy = c("a.x2") - c("a.x1"), c("a.y2") - c("a.y1"), c("b.x2") - c("b.x1"), c("b.y2") - c("b.y1")
    dx, dy = c("b.x1") - c("a.x1"), c("b.y1") - c("a.y1")
    cross = rx * qy - ry * qx
    some = F.when(cross != 0, cross)
    t, u = (dx * qy - dy * qx) / some, (dx * ry - dy * rx) / some
    grain = lambda v: F.round(v / GRAIN) * GRAIN
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    met = F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.array(point(grain(c("a.x1") + t * rx), grain(c("a.y1") + t * ry)))).otherwise(F.array())
    inside = lambda q: (q["x"] >= F.greatest(low("a", "x"), low("b", "x"))) & (q["x"] <= F.least(high("a", "x"), high("b", "x"))) & (q["y"] >= F.greatest(low("a", "y"), low("b", "y"))) & (q["y"] <= F.least(high("a", "y"), high("b", "y")))
    four = F.array(*[point(c(f"{s}.x{k}"), c(f"{s}.y{k}")) for s in "ab" for k in (1, 2)])
    along = F.when(dx * ry - dy * rx == 0, F.filter(four, inside)).otherwise(F.array())
    points = F.when(cross == 0, along).otherwise(met)
    found = pairs.select(c("a.row").alias("row"), c("a.col").alias("col"), ends("a").alias("e"), ends("b").alias("f"), points.alias("points")).where(F.size("points") > 0)
    each = found.select("row", "col", F.explode(F.array("e", "f")).alias("e"), "points").select("row", "col", "e.*", F.explode("points").alias("p"))
    own = lambda k: (F.col("p.x") == F.col(f"x{k}")) & (F.col("p.y") == F.col(f"y{k}"))
    return each.where(~own(1) & ~own(2)).groupBy("row", "col", "x1", "y1", "x2", "y2").agg(F.collect_set("p").alias("points"))


def _atoms(p: DataFrame) -> DataFrame:
    """row, col, low, high (x, y), ahead, back: pieces that meet at their ends only, and how many edges run along each from low to high and from high to low."""
    rows = p.join(_meetings(p), ["row", "col", "x1", "y1", "x2", "y2"], "left")
    start, end = (F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2))
    # points in the order of the piece: x and y both run one way along it
    order = F.transform(F.coalesce("points", F.array()), lambda q: F.struct(((q["x"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (q["y"] - F.col("y1")) * (F.col("y2") - F.col("y1"))).alias("t"), q.alias("q")))
    line = F.concat(F.array(start), F.transform(F.array_sort(order), lambda s: s["q"]), F.array(end))
    rows = rows.select("row", "col", "n", line.alias("line"))
    steps = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = rows.select("row", "col", "n", F.inline(steps)).where("a <> b")
    ahead = F.col("a") < F.col("b")
    return each.groupBy("row", "col", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.sum(F.when(ahead, F.col("n")).otherwise(0)).alias("ahead"), F.sum(F.when(ahead, 0).otherwise(F.col("n"))).alias("back"))


def _depths(atoms: DataFrame) -> DataFrame:
    """row, col, depth: how many polygons cover the reference point of each cell that has pieces."""
    rx, ry = F.col("col") + REFERENCE[0], F.col("row") + REFERENCE[1]
    ly, hy = F.col("low.y"), F.col("high.y")
    meets = (F.least(ly, hy) <= ry) & (F.greatest(ly, hy) > ry)
    x = F.col("low.x") + (F.col("high.x") - F.col("low.x")) * (ry - ly) / F.when(hy != ly, hy - ly)
    # eastwards, an edge that goes down is the way in, and one that goes up the way out
    gain = F.when(meets, F.when(hy > ly, F.col("back") - F.col("ahead")).otherwise(F.col("ahead") - F.col("back"))).otherwise(0)
    cells = atoms.groupBy("row", "col").agg(F.sum(gain).alias("every"), F.sum(F.when(x < rx, gain).otherwise(0)).alias("before"))
    run = F.sum("every").over(Window.partitionBy("row").orderBy("col"))
    return cells.select("row", "col", (run - F.col("every") + F.col("before")).alias("depth"))


def _outer(atoms: DataFrame) -> DataFrame:
    """low, high, ahead (boolean: from low to high) of the atoms that have polygons on their left and none on their right."""
    turn = lambda a, b, q: (b["x"] - a["x"]) * (q["y"] - a["y"]) - (b["y"] - a["y"]) * (q["x"] - a["x"])
    one = atoms.where((F.col("ahead") > 0) != (F.col("back") > 0)).join(_depths(atoms), ["row", "col"])
    mid = F.struct(((F.col("low.x") + F.col("high.x")) / 2).alias("x"), ((F.col("low.y") + F.col("high.y")) / 2).alias("y"))
    ref = F.struct((F.col("col") + REFERENCE[0]).alias("x"), (F.col("row") + REFERENCE[1]).alias("y"))
    # on the side of the reference point the piece's own polygons count if that is its left one
    own = F.when((turn(F.col("low"), F.col("high"), ref) > 0) == (F.col("ahead") > 0), F.col("ahead") + F.col("back")).otherwise(0)
    one = one.select("row", "col", "low", "high", (F.col("ahead") > 0).alias("ahead"), (F.col("depth") - own).alias("depth"), mid.alias("m"), ref.alias("ref"))
    others = atoms.where("ahead <> back").select("row", "col", F.col("low").alias("a"), F.col("high").alias("b"), (F.col("ahead") - F.col("back")).alias("net"))
    m, ref, a, b = (F.col(x) for x in ("m", "ref", "a", "b"))
    apart = (a != F.col("low")) | (b != F.col("high"))
    between = ((turn(ref, m, a) >= 0) != (turn(ref, m, b) >= 0)) & ((turn(a, b, ref) >= 0) != (turn(a, b, m) >= 0))
    gain = F.when(apart & between, F.when(turn(a, b, m) >= 0, F.col("net")).otherwise(-F.col("net"))).otherwise(0)
    key = ["row", "col", "low", "high", "ahead", "depth"]
    met = one.join(others, ["row", "col"]).groupBy(*key).agg(F.sum(gain).alias("gain"))
    return met.where(F.col("depth") + F.col("gain") == 0).select("low", "high", "ahead")


def union_edges(polygon: DataFrame) -> DataFrame:
    """x1, y1, x2, y2: the outline of what polygons cover together, in pieces with the inside on their left.

    polygon: poly_id, ring_id, is_hole, vertices. Where a polygon's own rings overlap, what they
    cover counts as inside; null rings and those of fewer than 3 vertices or without an area are
    left out, and an empty table gives no rows. Places are exact to 2**-30 of a mesh cell.
    """
    edges = stored(directed(polygon), "edges")
    found = _meshed(edges)
    if found is None:
        return edges.drop("n")
    mesh, pieces = found
    outer = _outer(stored(_atoms(pieces), "atoms"))
    a, b = (F.when(F.col("ahead"), F.col(s)).otherwise(F.col(t)) for s, t in (("low", "high"), ("high", "low")))
    x, y = (lambda p: p["x"] * mesh.side + mesh.x0), (lambda p: p["y"] * mesh.side + mesh.y0)
    return outer.select(x(a).alias("x1"), y(a).alias("y1"), x(b).alias("x2"), y(b).alias("y2"))


def _chained(edges: DataFrame) -> DataFrame:
    """ring, x1, y1, x2, y2, where ring is the least edge of the closed line that an edge is part of, as a struct."""
    here = F.struct("x1", "y1", "x2", "y2")
    at = edges.select(here.alias("e"))
    turn = lambda x, y: F.atan2(y, x)
    come = at.select("e", F.col("e.x2").alias("x"), F.col("e.y2").alias("y"), turn(F.col("e.x1") - F.col("e.x2"), F.col("e.y1") - F.col("e.y2")).alias("back"))
    leave = at.select(F.col("e").alias("f"), F.col("e.x1").alias("x"), F.col("e.y1").alias("y"), turn(F.col("e.x2") - F.col("e.x1"), F.col("e.y2") - F.col("e.y1")).alias("out"))
    # the inside lies clockwise of the way back, up to the next way out
    sweep = F.pmod(F.col("back") - F.col("out"), F.lit(2 * math.pi))
    next_ = come.join(leave, ["x", "y"]).groupBy("e").agg(F.min_by("f", F.when(sweep > 0, sweep).otherwise(2 * math.pi)).alias("to"))
    links = stored(next_.select("e", "to", F.least("e", "to").alias("ring")), "links")
    while True:
        far = links.select(F.col("e").alias("to"), F.col("to").alias("on"), F.col("ring").alias("there"))
        step = stored(links.join(far, "to").select("e", F.col("on").alias("to"), F.least("ring", "there").alias("ring"), (F.col("there") < F.col("ring")).alias("less")), "links")
        links = step.drop("less")
        if step.where("less").isEmpty():
            return links.select("ring", "e.*")


def _rings(table: pa.Table) -> pa.Table:
    """The edges of one closed line as one ring; of edges that run on straight, one."""
    rows = table.select(["x1", "y1", "x2", "y2"]).to_pylist()
    out: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for r in rows:
        out.setdefault((r["x1"], r["y1"]), []).append((r["x2"], r["y2"]))
    done: list[list[tuple[float, float]]] = []
    start = min(out)
    path, line, into = [start], [], math.inf
    while len(line) < len(rows):
        here = path[-1]
        ways = out[here]
        back = math.atan2(line[-1][1] - here[1], line[-1][0] - here[0]) if line else None
        pick = min(ways, key=lambda w: (back - math.atan2(w[1] - here[1], w[0] - here[0])) % (2 * math.pi) or 2 * math.pi) if back is not None and len(ways) > 1 else ways[0]
        ways.remove(pick)
        line.append(here)
        path.append(pick)
    size = max(abs(a) + abs(b) for a, b in line)
    straight = lambda p, q, r: abs((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])) <= 1e-9 * max(size * 1e-6, math.dist(p, r)) * math.dist(p, r) and (q[0] - p[0]) * (r[0] - q[0]) + (q[1] - p[1]) * (r[1] - q[1]) > 0
    kept: list[tuple[float, float]] = []
    for q, r in zip(line, [*line[1:], line[0]], strict=True):
        if not kept or not straight(kept[-1], q, r):
            kept.append(q)
    if len(kept) > 3 and straight(kept[-1], kept[0], kept[1]):
        kept.pop(0)
    done.append(kept)
    return pa.table({"vertices": pa.array([[{"x": x, "y": y} for x, y in ring] for ring in done], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})


def dissolved(polygon: DataFrame) -> DataFrame:
    """poly_id (0), ring_id, is_hole, vertices: the union of polygons as the rings of one; see union_edges.

    Rings are closed, don't cross, and may touch at a vertex. ring_id is the hash of a ring's vertices.
    """
    chained = _chained(stored(union_edges(polygon), "outline"))
    rings = chained.groupBy("ring").applyInArrow(_rings, "vertices array<struct<x: double, y: double>>")
    return rings.select(F.lit(0).cast("long").alias("poly_id"), F.hash("vertices").alias("ring_id"), (signed_area(F.col("vertices")) < 0).alias("is_hole"), "vertices")
