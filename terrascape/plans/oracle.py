"""DuckDB SQL for the registered queries, put together from common parts."""

from __future__ import annotations

from terrascape.functions.geometry import EARTH_M, GAUSS
from terrascape.functions.projections import FROM_CONFORMAL, FROM_PLANE, Ellipsoid, projection
from terrascape.grid import Grid, Params
from terrascape.plans.fixtures import G32_SQL, GEO, GRID, LEVELS, PLOTS_SQL, SIDE, SMALL

G = f"g AS MATERIALIZED ({G32_SQL})"


def world(grid: Grid, r: str, c: str, v: str = "1") -> tuple[str, str]:
    a, b, x0, d, e, y0 = grid.transform
    i, j = f"(({r}) + 0.5)::DOUBLE * ({v})", f"(({c}) + 0.5)::DOUBLE * ({v})"
    return f"({a} * {j} + {b} * {i} + {x0})", f"({d} * {j} + {e} * {i} + {y0})"


def km(grid: Grid, p: tuple[str, str], q: tuple[str, str]) -> str:
    (x1, y1), (x2, y2) = p, q
    if not grid.is_geo:
        return f"(sqrt(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1})) / 1000)::FLOAT"
    h = f"(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))"
    return f"(2 * {EARTH_M} * atan2(sqrt({h}), sqrt(1 - {h})) / 1000)::FLOAT"


def node(v: str, i: str, j: str) -> str:
    return f"({v}::BIGINT * 281474976710656 + {i}::BIGINT * 16777216 + {j}::BIGINT)"


def leveled(levels: tuple[int, ...], table: str = "g") -> str:
    return f"(SELECT {table}.*, v AS level, CAST(floor(\"row\" / v) AS INT) AS gi, CAST(floor(\"col\" / v) AS INT) AS gj FROM {table}, (SELECT unnest({list(levels)})::INT AS v))"


def with_g(sql: str) -> str:
    return f"WITH {G}\n{sql}"


TRAV = "CASE WHEN cond IS NULL THEN NULL WHEN res IS NULL THEN cond ELSE greatest(0, least(1, 1 - res)) END"


def cells(parc: bool, resistance: bool) -> str:
    cond = "CASE WHEN cond IS NOT NULL AND pa IS NOT NULL THEN greatest(cond, pa) END" if parc else "cond"
    mine = "coalesce(pa > 0 AND cond IS NOT NULL, FALSE)" if parc else "cond IS NOT NULL"
    res = "res" if resistance else "NULL::DOUBLE"
    f = lambda x: f"({x})::FLOAT::DOUBLE"
    return f"""k AS MATERIALIZED (SELECT "row", "col", cond, {TRAV} AS trav, mine FROM
  (SELECT "row", "col", {f(cond)} AS cond, {f(res)} AS res, {mine} AS mine FROM g) x)"""


def quadrant(x: str, y: str, r: str) -> str:
    m = f"least({x}, {r})"
    full = f"sqrt(greatest({r} * {r} - {y} * {y}, 0))"
    under = lambda t: f"((({t}) * sqrt(greatest({r} * {r} - ({t}) * ({t}), 0)) + {r} * {r} * asin(least(({t}) / {r}, 1))) / 2)"
    return f"CASE WHEN {x} <= 0 OR {y} <= 0 OR {r} <= 0 THEN 0 WHEN {y} >= {r} THEN {under(m)} ELSE least({m}, {full}) * {y} + CASE WHEN {m} > {full} THEN {under(m)} - {under(full)} ELSE 0 END END"


def overlap(r: str, mode: str) -> str:
    if mode == "square":
        side = lambda a, b, c: f"greatest(0, least({b}, {c} + {r}) - greatest({a}, {c} - {r}))"
        return f"({side('i0', 'i1', 'ci')} * {side('j0', 'j1', 'cj')})"
    s = lambda a, b: f"(sign({a}) * sign({b}) * ({quadrant(f'abs({a})', f'abs({b})', r)}))"
    return f"({s('(i1 - ci)', '(j1 - cj)')} - {s('(i0 - ci)', '(j1 - cj)')} - {s('(i1 - ci)', '(j0 - cj)')} + {s('(i0 - ci)', '(j0 - cj)')})"


def nodes(params: Params, mode: str, grid: Grid, pa_to_pa: bool) -> str:
    """CTEs pyr, src, ring, nodes over k."""
    radius = lambda k: "CASE p.level " + " ".join(f"WHEN {v} THEN {params.radii(v)[k]}::DOUBLE" for v in params.levels) + " END"
    near = "pow(greatest(i0 - ci, ci - i1, 0), 2) + pow(greatest(j0 - cj, cj - j1, 0), 2)"
    far = "pow(greatest(abs(i0 - ci), abs(i1 - ci)), 2) + pow(greatest(abs(j0 - cj), abs(j1 - cj)), 2)"
    rim = f"({near} <= outr * outr + (outr * outr + 1) * 1e-12 AND {far} >= outr * outr - (outr * outr + 1) * 1e-12)"
    if mode == "square":
        w = "OVER (PARTITION BY src, level)"
        rim = f"(gi = min(gi) {w} OR gi = max(gi) {w} OR gj = min(gj) {w} OR gj = max(gj) {w})"
    weight = f"sum(abs(cos(radians({world(grid, '\"row\"', '\"col\"')[1]}))))" if grid.is_geo else "count(*)::DOUBLE"
    return f"""
pyr AS MATERIALIZED (SELECT level, gi, gj, avg(cond) AS cond, {weight} AS weight, avg(trav) AS trav, avg(CASE WHEN mine THEN 1.0 ELSE 0.0 END) AS pa
  FROM {leveled(params.levels, 'k')} x WHERE cond IS NOT NULL GROUP BY ALL),
src AS MATERIALIZED (SELECT {node('1', '"row"', '"col"')} AS src, "row", "col" FROM k WHERE mine AND cond IS NOT NULL),
ring AS MATERIALIZED (SELECT s.*, p.*, "row" + 0.5 AS ci, "col" + 0.5 AS cj, (p.gi * p.level)::DOUBLE AS i0, least((p.gi + 1) * p.level, {grid.nrows})::DOUBLE AS i1, (p.gj * p.level)::DOUBLE AS j0, least((p.gj + 1) * p.level, {grid.ncols})::DOUBLE AS j1
  FROM src s, (SELECT p.*, {radius(0)} AS inr, {radius(1)} AS outr FROM pyr p) p WHERE abs((p.gi + 0.5) * level - s."row" - 0.5) <= outr + level AND abs((p.gj + 0.5) * level - s."col" - 0.5) <= outr + level),
shared AS MATERIALIZED (SELECT *, greatest(0, least(1, ({overlap('outr', mode)} - CASE WHEN inr > 0 THEN {overlap('inr', mode)} ELSE 0 END) / ((i1 - i0) * (j1 - j0))))::FLOAT AS fraction FROM ring),
nodes AS MATERIALIZED (SELECT src, "row", "col", {node('level', 'gi', 'gj')} AS node, level, gi, gj, fraction, weight * fraction AS area, cond, coalesce(trav, cond) AS trav, {'coalesce(pa, 0)' if pa_to_pa else '1.0'} AS pa, {rim} AS rim
  FROM shared WHERE fraction > 1e-12)"""


def edges(params: Params, grid: Grid) -> str:
    u, v = world(grid, "u.gi", "u.gj", "u.level"), world(grid, "v.gi", "v.gj", "v.level")
    return f"""
edges AS MATERIALIZED (SELECT src, u, v, ((1 - {params.max_cost}) * trav + {params.max_cost}) * geo AS adj, geo FROM (
  SELECT u.src, u.node AS u, v.node AS v, v.trav, {km(grid, u, v)}::DOUBLE AS geo FROM nodes u JOIN nodes v ON u.src = v.src AND
    ((u.level = v.level AND abs(u.gi - v.gi) <= 1 AND abs(u.gj - v.gj) <= 1 AND u.node <> v.node)
     OR (u.rim AND v.level = 2 * u.level AND v.gi IN (floor((u.gi - 1) / 2), floor((u.gi + 1) / 2)) AND v.gj IN (floor((u.gj - 1) / 2), floor((u.gj + 1) / 2)))))),
alone AS MATERIALIZED (SELECT src, node, ((1 - {params.max_cost}) * trav + {params.max_cost}) * d AS adj, round(d * 100) / 100 AS geo
  FROM (SELECT n.*, {km(grid, world(grid, 'n."row"', 'n."col"'), world(grid, 'n."row" + 1', 'n."col"'))}::DOUBLE AS d FROM nodes n WHERE n.node = n.src AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = n.src AND e.u = n.src AND e.v < 562949953421312)))"""


def shortest(name: str, km_column: str) -> str:
    return f"""
{name}(src, node, best) USING KEY (src, node) AS (
  SELECT src, src, {{'c': 0::BIGINT, 't': 0.0::DOUBLE}} FROM src
  UNION
  SELECT x.src, x.node, x.best FROM (
    SELECT e.src, e.v AS node, min({{'c': p.best.c + round(e.{km_column} * 100)::BIGINT, 't': p.best.t + e.{km_column}}}) AS best FROM {name} p JOIN edges e ON e.src = p.src AND e.u = p.node GROUP BY e.src, e.v) x
  LEFT JOIN recurring.{name} r ON r.src = x.src AND r.node = x.node WHERE r.node IS NULL OR x.best < r.best)"""


#: Rounds of relaxation within a level: more than the edges of any least-cost path in a window of these queries.
ROUNDS = 16


def staged(name: str, km_column: str, levels: tuple[int, ...]) -> str:
    """Least costs without recursion: each level is relaxed ROUNDS times, from what its rim is reached with out of the level below."""
    edge = f"{{'c': p.best.c + round(e.{km_column} * 100)::BIGINT, 't': p.best.t + e.{km_column}}}"
    on = "ON e.src = p.src AND e.u = p.node"
    out, last = [], ""
    for level in levels:
        first = f"{name}{level}_0"
        start = f"SELECT src, src AS node, {{'c': 0::BIGINT, 't': 0.0::DOUBLE}} AS best FROM src" if not last else f"SELECT e.src, e.v AS node, min({edge}) AS best FROM {last} p JOIN up e {on} AND e.lv = {level} GROUP BY ALL"
        out.append(f"{first} AS MATERIALIZED ({start})")
        last = first
        for k in range(1, ROUNDS + 1):
            out.append(f"{name}{level}_{k} AS MATERIALIZED (SELECT src, node, min(best) AS best FROM (SELECT * FROM {last} UNION ALL SELECT e.src, e.v, {edge} FROM {last} p JOIN flat e {on} AND e.lv = {level}) GROUP BY ALL)")
            last = f"{name}{level}_{k}"
    every = " UNION ALL ".join(f"SELECT * FROM {name}{level}_{ROUNDS}" for level in levels)
    return ",\n".join([*out, f"{name} AS MATERIALIZED ({every})"])


def reach(params: Params, mode: str = "circular", parc: bool = False, pa_to_pa: bool = False, resistance: bool = False, grid: Grid = GRID) -> str:
    far = "" if pa_to_pa else "UNION ALL SELECT src, node, adj, geo FROM alone"
    paths = f"{shortest('pa_', 'adj')}, {shortest('pg_', 'geo')}"
    if len(params.levels) > 2:
        lv = "e.v // 281474976710656"
        paths = f"flat AS MATERIALIZED (SELECT *, {lv} AS lv FROM edges e WHERE e.u // 281474976710656 = {lv}), up AS MATERIALIZED (SELECT *, {lv} AS lv FROM edges e WHERE e.u // 281474976710656 < {lv}),\n{staged('pa_', 'adj', params.levels)},\n{staged('pg_', 'geo', params.levels)}"
    return f"""WITH RECURSIVE {G}, {cells(parc, resistance)}, {nodes(params, mode, grid, pa_to_pa)}, {edges(params, grid)}, {paths},
far AS (SELECT a.src, a.node, a.best.t AS adj, b.best.c / 100 AS geo FROM pa_ a JOIN pg_ b ON a.src = b.src AND a.node = b.node WHERE a.node <> a.src AND a.src NOT IN (SELECT src FROM alone) {far})"""


def scored(params: Params, outer: str, **how) -> str:
    lam = ", ".join(f"({x})" for x in params.lambdas)
    return f"""{reach(params, **how)},
per AS (SELECT f.src, l.s, sum(exp(-adj / l.s) * cond * pa * area) AS top, sum(exp(-geo / l.s) * area) AS bottom FROM far f JOIN nodes n ON n.src = f.src AND n.node = f.node, (VALUES {lam}) l(s) GROUP BY f.src, l.s),
one AS (SELECT src, avg(CASE WHEN bottom > 0 THEN top / bottom ELSE 0 END) AS value FROM per GROUP BY src),
val AS (SELECT "row", "col", coalesce(value, 0) AS value FROM src LEFT JOIN one ON one.src = src.src)
SELECT k."row", k."col", round(({outer})::FLOAT::DOUBLE, 5) AS value FROM k LEFT JOIN val ON val."row" = k."row" AND val."col" = k."col" """


def beri_sql(params: Params, bands: int, shifts: tuple[int, ...], cols: int) -> str:
    """All vectors; their number decides how often the condition repeats downwards."""
    lam = ", ".join(f"({x})" for x in params.lambdas)
    n = "(SELECT count(*) FROM embeddings)"
    rows = f"(SELECT greatest({SIDE}, ceil(count(*) / {cols})::INT) FROM embeddings)"
    layer = lambda s: f"SELECT {s} AS sc, CAST(floor(((vec_id - {s} + {n}) % {n}) / {cols}) AS INT) AS \"row\", CAST(((vec_id - {s} + {n}) % {n}) % {cols} AS INT) AS \"col\", embedding::DOUBLE[] AS b FROM embeddings"
    repeated = f'(SELECT CAST("row" + {SIDE} * t AS INT) AS "row", "col", cond, pa, res FROM g, (SELECT unnest(range({rows} // {SIDE} + 1)) AS t) u WHERE "row" + {SIDE} * t < {rows}) y'
    body = reach(params).replace("FROM g) x)", f"FROM {repeated}) x)", 1).replace(f"least((p.gi + 1) * p.level, {SIDE})", f"least((p.gi + 1) * p.level, {rows})")
    averaged = "[" + ", ".join(f"avg(b[{i}])" for i in range(1, bands + 1)) + "]"
    sim = "exp(-list_sum(list_transform(list_zip(f.b, t.b), lambda z: abs(z[1] - z[2]))))"
    return f"""{body},
e AS MATERIALIZED ({' UNION ALL '.join(map(layer, shifts))}),
lay AS MATERIALIZED (SELECT sc, level, gi, gj, {averaged} AS b FROM {leveled(params.levels, 'e')} x GROUP BY ALL),
sims AS (SELECT fr.src, fr.adj, fr.geo, n.cond, n.area, t.sc, {sim} AS sim FROM far fr JOIN nodes n ON n.src = fr.src AND n.node = fr.node JOIN e f ON f.sc = 0 AND f."row" = n."row" AND f."col" = n."col" JOIN lay t ON t.level = n.level AND t.gi = n.gi AND t.gj = n.gj),
per AS (SELECT src, s, sc, sum(exp(-pow(adj / s, 2) / {GAUSS}) * cond * area * sim) AS top, sum(CASE WHEN sc = 0 THEN exp(-pow(geo / s, 2) / {GAUSS}) * area * sim END) AS bottom FROM sims, (VALUES {lam}) l(s) GROUP BY ALL),
two AS (SELECT src, s, 0.5 * (avg(top) + min(top)) AS top, max(bottom) AS bottom FROM per GROUP BY ALL),
one AS (SELECT src, avg(CASE WHEN bottom > 0 THEN top / bottom ELSE 0 END) AS value FROM two GROUP BY src),
val AS (SELECT "row", "col", coalesce(value, 0) AS value FROM src LEFT JOIN one ON one.src = src.src)
SELECT k."row", k."col", round(value::FLOAT::DOUBLE, 8) AS value FROM k LEFT JOIN val ON val."row" = k."row" AND val."col" = k."col" """


def node_list(params: Params, mode: str, grid: Grid, select: str) -> str:
    return f"WITH {G}, {cells(False, True)}, {nodes(params, mode, grid, False)}\n{select}"


WINDOW = Params(levels=LEVELS)
ALL = Params()
#: Elements of a vector of the tables.
ELEMENTS = 64
AVG = f"FROM {leveled(LEVELS)} x GROUP BY level, gi, gj"

#: Quarters of a pixel that plots cover, and pixels that each plot touches.
LATTICE = f"""p AS ({PLOTS_SQL}), xs AS (SELECT *, unnest(range(x0, x1)) AS sx FROM p), ys AS (SELECT *, unnest(range(y0, y1)) AS sy FROM xs),
spots AS MATERIALIZED (SELECT DISTINCT sx, sy FROM ys WHERE u0 IS NULL OR NOT (sx >= u0 AND sx < u1 AND sy >= v0 AND sy < v1))"""
TOUCHED = f"""p AS ({PLOTS_SQL}), rs AS (SELECT *, unnest(range(greatest(0, ceil(y0 / 4)::INT - 1), least(127, y1 // 4)::INT + 1))::INT AS r FROM p),
cs AS (SELECT *, unnest(range(greatest(0, ceil(x0 / 4)::INT - 1), least(127, x1 // 4)::INT + 1))::INT AS c FROM rs),
met AS (SELECT k, r, c FROM cs WHERE u0 IS NULL OR NOT (4 * c > u0 AND 4 * c + 4 < u1 AND 4 * r > v0 AND 4 * r + 4 < v1))"""



def _series(table: tuple[tuple[float, ...], ...], ellipsoid: Ellipsoid, angle: str, terms: str) -> str:
    """Sum over j of the series' coefficients times `terms`, in which J stands for 2 * j and A for the angle."""
    return " ".join(f"+ ({c!r}) * {terms.replace('J', str(2 * j)).replace('A', angle)}" for j, c in enumerate(ellipsoid.series(table), 1))


def _reprojected() -> str:
    utm, conic = projection("EPSG:32755"), projection("EPSG:3577")
    e, (n, c, rho0) = conic.ellipsoid.e, conic.cone
    return f"""WITH p AS ({PLOTS_SQL}), r AS (SELECT k, 0 AS ring_id, x0 / 4 AS a, y0 / 4 AS b, x1 / 4 AS c, y1 / 4 AS d FROM p UNION ALL SELECT k, 1, u0 / 4, v0 / 4, u1 / 4, v1 / 4 FROM p WHERE u0 IS NOT NULL),
v AS (SELECT k, ring_id, i, (CASE WHEN i IN (0, 3) THEN a ELSE c END * 1000 + 450000)::DOUBLE AS px, (CASE WHEN i IN (0, 1) THEN b ELSE d END * -1000 + 5400000)::DOUBLE AS py FROM r, (SELECT unnest(range(4))::INT AS i)),
t AS (SELECT *, (py - {utm.northing}) / {utm.radius!r} AS xi, (px - {utm.easting}) / {utm.radius!r} AS eta FROM v),
sinh AS (SELECT *, xi - (0 {_series(FROM_PLANE, utm.ellipsoid, 'xi', 'sin(J * A) * (exp(J * eta) + exp(-J * eta)) / 2')}) AS xi1, eta - (0 {_series(FROM_PLANE, utm.ellipsoid, 'xi', 'cos(J * A) * (exp(J * eta) - exp(-J * eta)) / 2')}) AS eta1 FROM t),
chi AS (SELECT *, asin(sin(xi1) * 2 / (exp(eta1) + exp(-eta1))) AS chi, {utm.lon0} + degrees(atan2((exp(eta1) - exp(-eta1)) / 2, cos(xi1))) AS lon FROM sinh),
ll AS (SELECT *, degrees(chi {_series(FROM_CONFORMAL, utm.ellipsoid, 'chi', 'sin(J * A)')}) AS lat FROM chi),
q AS (SELECT *, sin(radians(lat)) AS s FROM ll),
m AS (SELECT *, {conic.ellipsoid.a} / ({n!r}) * sqrt({c!r} - ({n!r}) * {1 - e * e!r} * (s / (1 - {e * e!r} * s * s) + ln((1 + {e!r} * s) / (1 - {e!r} * s)) / {2 * e!r})) AS rho, ({n!r}) * radians(lon - {conic.origin[1]}) AS turn FROM q)
SELECT k AS poly_id, ring_id, i, round(lon, 8) AS lon, round(lat, 8) AS lat, round(rho * sin(turn), 2) AS x, round({rho0!r} - rho * cos(turn), 2) AS y FROM m"""


REPROJECTED = _reprojected()

ORACLE: dict[str, str] = {
    "fixture_g32": with_g('SELECT "row", "col", cond, pa, res FROM g'),
    "d1_overview_average": with_g(f"SELECT level, gi, gj, round(avg(cond), 6) AS cond {AVG}"),
    "d2_overview_count": with_g(f"SELECT level, gi, gj, CASE WHEN count(cond) > 0 THEN count(cond) END AS n {AVG}"),
    "d3_overview_area": with_g(f"SELECT level, gi, gj, round(sum(CASE WHEN cond IS NOT NULL THEN abs(cos(radians({world(GEO, '\"row\"', '\"col\"')[1]}))) END), 6) AS area {AVG}"),
    "d4_overview_sum": with_g(f"SELECT level, gi, gj, round(sum(cond), 6) AS total {AVG}"),
    "d5_band_overview": f"""WITH e AS (SELECT CAST(floor(vec_id / 20) AS INT) AS "row", CAST(vec_id % 20 AS INT) AS "col", embedding::DOUBLE[] AS b FROM embeddings)
SELECT level, gi, gj, {', '.join(f'round(avg(b[{i}]), 6) AS b{i}' for i in range(1, ELEMENTS + 1))} FROM {leveled(LEVELS, 'e')} x GROUP BY level, gi, gj""",
    "d6_pa_membership": f"WITH {G}, {cells(True, False)} SELECT level, gi, gj, round(avg(CASE WHEN mine THEN 1.0 ELSE 0.0 END), 6) AS pa FROM {leveled(LEVELS, 'k')} x WHERE cond IS NOT NULL GROUP BY level, gi, gj",
    "d13_block_cost": with_g("SELECT r::INT AS block_row, c::INT AS block_col, coalesce(n, 0) + 0.1 * least(5, 32 - 5 * r) * least(5, 32 - 5 * c)::DOUBLE AS cost FROM (SELECT unnest(range(7)) AS r) a, (SELECT unnest(range(7)) AS c) b LEFT JOIN (SELECT CAST(floor(\"row\" / 5) AS INT) AS x, CAST(floor(\"col\" / 5) AS INT) AS y, count(cond) AS n FROM g GROUP BY 1, 2) v ON v.x = r AND v.y = c"),
    "d16_gap_count": with_g("SELECT count(*) AS gaps FROM g WHERE cond IS NOT NULL AND res IS NULL"),
    "b1_pixel_to_world": with_g(f"SELECT \"row\", \"col\", round({world(GEO, '\"row\"', '\"col\"')[0]}, 6) AS x, round({world(GEO, '\"row\"', '\"col\"')[1]}, 6) AS y FROM g"),
    "b2_world_to_pixel": with_g('SELECT "row", "col", ("col" + 0.5)::DOUBLE AS c, ("row" + 0.5)::DOUBLE AS r FROM g'),
    "b4_b7_surfaces": f"WITH {G}, {cells(True, True)} SELECT \"row\", \"col\", round(cond, 6) AS cond, round(trav, 6) AS trav, mine AS source FROM k",
    "b12_connected_habitat": with_g('SELECT "row", "col", round(pa, 6) AS raw, round(pa * cond, 6) AS product, round(sqrt(pa * cond), 6) AS root FROM g'),
    "b15_node_id": with_g(f"SELECT level, gi, gj, {node('level', 'gi', 'gj')} AS node {AVG}"),
    "b16_b17_edge_cost": with_g('SELECT "row", "col", round((2 - cond) * 1.41421::FLOAT::DOUBLE, 6) AS adj, round((2 - cond) * 1.41421::FLOAT::DOUBLE * 100)::INT AS cents FROM g'),
    "b18_similarity": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS b FROM embeddings) SELECT a.vec_id, round(exp(-list_sum(list_transform(list_zip(a.b, c.b), lambda z: abs(z[1] - z[2])))), 12) AS sim FROM e a JOIN e c ON c.vec_id = (a.vec_id + 37) % (SELECT count(*) FROM embeddings)",
    "h1_h3_distance": with_g(f"SELECT \"row\", \"col\", round({km(GEO, world(GEO, '\"row\"', '\"col\"'), world(GEO, '\"row\" + 1', '\"col\"'))}::DOUBLE, 4) AS south, round({km(GEO, world(GEO, '\"row\"', '\"col\"'), world(GEO, '\"row\"', '\"col\" + 1'))}::DOUBLE, 4) AS east, round({km(GRID, world(GRID, '\"row\"', '\"col\"'), world(GRID, '\"row\" + 1', '\"col\" + 1'))}::DOUBLE, 4) AS across FROM g"),
    "h4_h5_kernels": with_g(f"SELECT \"row\", \"col\", round(exp(-cond / 2.0), 6) AS exponential, round(exp(-pow(cond * 100 / 2.0, 2) / {GAUSS}), 6) AS gaussian FROM g"),
    "e2_circular_window": node_list(WINDOW, "circular", GRID, "SELECT src, node, round(fraction::DOUBLE, 5) AS fraction, round(area, 4) AS area, rim FROM nodes"),
    "e3_e7_square_window": node_list(WINDOW, "square", GRID, "SELECT src, node, round(fraction::DOUBLE, 5) AS fraction, round(area, 4) AS area, rim FROM nodes"),
    "e2_geographic_window": node_list(WINDOW, "circular", GEO, "SELECT src, node, round(area, 4) AS area FROM nodes"),
    "c3_c4_edges": node_list(SMALL, "circular", GRID, "SELECT src, u, v, round(adj, 5) AS adj, round(geo, 5) AS geo FROM edges").replace("\nSELECT src, u", f", {edges(SMALL, GRID)}\nSELECT src, u", 1),
    "i3_isolated": node_list(SMALL, "circular", GRID, "SELECT src, node, round(adj, 5) AS adj, round(geo, 5) AS geo FROM alone").replace("\nSELECT src, node, round(adj", f", {edges(SMALL, GRID)}\nSELECT src, node, round(adj", 1),
    "i6_i7_paths": reach(SMALL, resistance=True) + "\nSELECT src, node, round(adj, 5) AS adj, round(geo, 2) AS geo FROM far",
    "d7_connectedness": scored(SMALL, "value"),
    "j2_tiled_run": scored(SMALL, "value"),
    "d7_connectedness_square": scored(SMALL, "value", mode="square"),
    "d7_connectedness_geographic": scored(SMALL, "value", grid=GEO),
    "b12_habitat_option3": scored(SMALL, "sqrt(value * k.cond)", resistance=True),
    "parc_connectedness": scored(SMALL, "value", parc=True),
    "parc_pa_to_pa": scored(SMALL, "value", parc=True, pa_to_pa=True),
    "d8_beri": beri_sql(SMALL, ELEMENTS, (0, 37, 74), 20),
    "e2_circular_window_all": node_list(ALL, "circular", GRID, "SELECT src, node, round(fraction::DOUBLE, 5) AS fraction, round(area, 4) AS area, rim FROM nodes"),
    "e3_e7_square_window_all": node_list(ALL, "square", GRID, "SELECT src, node, round(fraction::DOUBLE, 5) AS fraction, round(area, 4) AS area, rim FROM nodes"),
    "e2_geographic_window_all": node_list(ALL, "circular", GEO, "SELECT src, node, round(area, 4) AS area FROM nodes"),
    "c3_c4_edges_all": node_list(ALL, "circular", GRID, "SELECT src, u, v, round(adj, 5) AS adj, round(geo, 5) AS geo FROM edges").replace("\nSELECT src, u", f", {edges(ALL, GRID)}\nSELECT src, u", 1),
    "i3_isolated_all": node_list(ALL, "circular", GRID, "SELECT src, node, round(adj, 5) AS adj, round(geo, 5) AS geo FROM alone").replace("\nSELECT src, node, round(adj", f", {edges(ALL, GRID)}\nSELECT src, node, round(adj", 1),
    "i6_i7_paths_all": reach(ALL, resistance=True) + "\nSELECT src, node, round(adj, 5) AS adj, round(geo, 2) AS geo FROM far",
    "i9_staged_paths": reach(ALL, resistance=True) + "\nSELECT src, node, round(adj, 5) AS adj, round(geo, 2) AS geo FROM far",
    "d7_connectedness_all": scored(ALL, "value"),
    "d7_connectedness_square_all": scored(ALL, "value", mode="square"),
    "d7_connectedness_geographic_all": scored(ALL, "value", grid=GEO),
    "b12_habitat_option3_all": scored(ALL, "sqrt(value * k.cond)", resistance=True),
    "parc_connectedness_all": scored(ALL, "value", parc=True),
    "parc_pa_to_pa_all": scored(ALL, "value", parc=True, pa_to_pa=True),
    "a1_connected_map": scored(Params(levels=(2, 4, 8)), "sqrt(value * k.cond)", resistance=True),
    "d8_beri_all": beri_sql(ALL, ELEMENTS, (0, 37, 74), 20),
    "c7_pixel_coverage": f"WITH {LATTICE} SELECT (sy // 4)::INT AS \"row\", (sx // 4)::INT AS \"col\", count(*) / 16 AS value FROM spots WHERE sx BETWEEN 0 AND 511 AND sy BETWEEN 0 AND 511 GROUP BY ALL",
    "d17_union_outline": f"""WITH {LATTICE}
SELECT (SELECT count(*) / 16 FROM spots) AS area, sum(n)::DOUBLE / 4 AS outline, TRUE AS turned
FROM (SELECT 2 * count(*) - 2 * count(b.sx) AS n FROM spots a LEFT JOIN spots b ON b.sx = a.sx + 1 AND b.sy = a.sy
      UNION ALL SELECT 2 * count(*) - 2 * count(b.sx) FROM spots a LEFT JOIN spots b ON b.sx = a.sx AND b.sy = a.sy + 1)""",
    "a8_touched_pixels": f"WITH {TOUCHED} SELECT DISTINCT r AS \"row\", c AS \"col\" FROM met",
    "a5_masked_cells": f"""WITH {TOUCHED}, f AS (SELECT (l_orderkey % 128)::INT AS r, (l_partkey % 128)::INT AS c, (sum(l_suppkey) % 101)::DOUBLE AS v FROM lineitem GROUP BY 1, 2),
t AS (SELECT DISTINCT r, c FROM met WHERE k % 5 = 0)
SELECT f.r AS "row", f.c AS "col", CASE WHEN t.r IS NOT NULL THEN v END AS value, t.r IS NULL AS masked FROM f LEFT JOIN t ON t.r = f.r AND t.c = f.c""",
    "a15_cell_table": """WITH f AS (SELECT (l_orderkey % 128)::INT AS r, (l_partkey % 128)::INT AS c, (sum(l_suppkey) % 101)::DOUBLE / 4 AS value FROM lineitem GROUP BY 1, 2)
SELECT r AS "row", c AS "col", value, NOT (r BETWEEN 29 AND 60 AND c BETWEEN 20 AND 40) AS masked FROM f WHERE r BETWEEN 20 AND 69 AND c BETWEEN 12 AND 49""",
    "a9_valid_margin": f"""WITH {TOUCHED}, f AS (SELECT DISTINCT (l_orderkey % 128)::INT AS r, (l_partkey % 128)::INT AS c FROM lineitem),
b AS (SELECT k, x0 / 4 AS x0, y0 / 4 AS y0, x1 / 4 AS x1, y1 / 4 AS y1, u0 / 4 AS u0, v0 / 4 AS v0, u1 / 4 AS u1, v1 / 4 AS v1 FROM p WHERE k % 25 = 0),
n AS (SELECT DISTINCT f.r, f.c FROM f JOIN b ON sqrt(pow(greatest(0, x0 - f.c - 1, f.c - x1), 2) + pow(greatest(0, y0 - f.r - 1, f.r - y1), 2)) <= 7.5)
SELECT f.r AS "row", f.c AS "col", n.r IS NOT NULL AS valid FROM f LEFT JOIN n ON n.r = f.r AND n.c = f.c""",
    "a13_reprojected": REPROJECTED,
    "a14_wkt": f"WITH p AS ({PLOTS_SQL}) SELECT k AS poly_id, 0 AS ring_id, FALSE AS is_hole, 5 AS n, -((x1 - x0) * (y1 - y0) / 16)::DOUBLE AS area FROM p UNION ALL SELECT k, 1, TRUE, 5, -((u1 - u0) * (v1 - v0) / 16)::DOUBLE FROM p WHERE u0 IS NOT NULL",
    "h6_h8_clipped_rings": f"""WITH p AS ({PLOTS_SQL}), r AS (SELECT k, 0 AS ring_id, x0 / 4 AS a, y0 / 4 AS b, x1 / 4 AS c, y1 / 4 AS d FROM p UNION ALL SELECT k, 1, u0 / 4, v0 / 4, u1 / 4, v1 / 4 FROM p WHERE u0 IS NOT NULL)
SELECT k AS poly_id, ring_id, round((greatest(0, least(c, floor(a) + 2.25) - greatest(a, floor(a) + 0.5)) * greatest(0, least(d, floor(b) + 1.75) - greatest(b, floor(b) + 0.5)))::DOUBLE, 6) AS area, least(floor(b) + 2, 128)::INT AS "row" FROM r""",
    "a20_resolution_info": """WITH g AS (SELECT c_nationkey::BIGINT AS raster, count(*) AS n, count(*) * 3 AS m, CASE WHEN c_nationkey % 4 = 0 THEN 0.25::DOUBLE ELSE 250 END AS x, CASE WHEN c_nationkey % 4 = 0 THEN 0.125::DOUBLE ELSE 500 END AS y,
  CASE c_nationkey % 4 WHEN 0 THEN 111.32::DOUBLE WHEN 1 THEN 0.001 WHEN 2 THEN 0.0003048 END AS f FROM customer GROUP BY c_nationkey),
l AS (SELECT *, ceil(m / v)::BIGINT AS width, ceil(n / v)::BIGINT AS height FROM g, (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512]) AS v)),
k AS (SELECT *, 9 * v * f * greatest(x, y) AS km FROM l)
SELECT raster, v::INT AS level, width, height, width * height AS cells, round(100.0::DOUBLE * (width * height) / (n * m), 6) AS pct_base, x * v AS x_res, y * v AS y_res, 9 * v * greatest(x, y) AS reach, round(km, 6) AS reach_km,
  CASE WHEN km IS NULL THEN '-' WHEN km >= 1000 THEN printf('%.2fK km', km / 1000) WHEN km = floor(km) THEN km::BIGINT || ' km' ELSE printf('%.4g km', km) END AS reach_text,
  CASE WHEN least(width, height) < 16 THEN 'small grid; review' ELSE '' END AS note FROM k""",
    "j1_tiles": """WITH s AS (SELECT max(l_orderkey % 128) + 1 AS h, max(l_partkey % 128) + 1 AS w FROM lineitem),
b1 AS (SELECT h, w, greatest(1, least(floor(h / 24 + 0.5), (h - 1) // 8 - 1)) AS r1, greatest(1, least(floor(w / 32 + 0.5), (w - 1) // 8 - 2)) AS c1 FROM s),
b2 AS (SELECT *, greatest(r1 + 1, least(floor(2 * h / 24 + 0.5), (h - 1) // 8)) AS r2, greatest(c1 + 1, least(floor(2 * w / 32 + 0.5), (w - 1) // 8 - 1)) AS c2 FROM b1),
b3 AS (SELECT *, greatest(c2 + 1, least(floor(3 * w / 32 + 0.5), (w - 1) // 8)) AS c3 FROM b2),
t AS (SELECT i, j, [0, 8 * r1, 8 * r2, h] AS r, [0, 8 * c1, 8 * c2, 8 * c3, w] AS c FROM b3, (SELECT unnest(range(3)) AS i) x, (SELECT unnest(range(4)) AS j) y)
SELECT (4 * i + j)::INT AS id, i::INT AS "row", j::INT AS "col", r[i + 1]::INT AS row_start, r[i + 2]::INT AS row_stop, c[j + 1]::INT AS col_start, c[j + 2]::INT AS col_stop, 8 AS align_to,
  1000.0::DOUBLE * c[j + 1] AS xmin, -1000.0::DOUBLE * r[i + 2] AS ymin, 1000.0::DOUBLE * c[j + 2] AS xmax, -1000.0::DOUBLE * r[i + 1] AS ymax FROM t""",
    "j1_balanced_tiles": f"""WITH {G}, v AS (SELECT "row" // 4 AS r, "col" // 4 AS c, count(cond) AS n FROM g GROUP BY 1, 2),
d AS (SELECT a.r, b.c, coalesce(n, 0) + 1.6::DOUBLE AS cost FROM (SELECT unnest(range(8)) AS r) a CROSS JOIN (SELECT unnest(range(8)) AS c) b LEFT JOIN v ON v.r = a.r AND v.c = b.c),
q AS (SELECT r, sum(sum(cost)) OVER (ORDER BY r) AS run, sum(sum(cost)) OVER () AS total FROM d GROUP BY r),
rb AS (SELECT arg_min(b, (round(abs(run - total / 2), 9), -b)) AS b FROM (SELECT greatest(1, least(r + 1, 7)) AS b, run, total FROM q WHERE r + 1 BETWEEN (SELECT min(r) FROM q WHERE run >= total / 2 - 1e-9) AND (SELECT min(r) + 1 FROM q WHERE run >= total / 2 - 1e-9) AND r + 1 BETWEEN 1 AND 7)),
w AS (SELECT (r >= b)::INT AS band, c, sum(cost) AS cost FROM d, rb GROUP BY 1, 2),
u AS (SELECT band, c, sum(cost) OVER (PARTITION BY band ORDER BY c) AS run, sum(cost) OVER (PARTITION BY band) AS total FROM w),
f1 AS (SELECT band, min(c) AS first FROM u WHERE run >= total / 3 - 1e-9 GROUP BY band),
c1 AS (SELECT band, arg_min(c + 1, (round(abs(run - total / 3), 9), -c)) AS b FROM u JOIN f1 USING (band) WHERE c + 1 BETWEEN greatest(1, first) AND least(first + 1, 6) GROUP BY band),
f2 AS (SELECT band, min(c) AS first FROM u WHERE run >= 2 * total / 3 - 1e-9 GROUP BY band),
c2 AS (SELECT u.band, arg_min(c + 1, (round(abs(run - 2 * total / 3), 9), -c)) AS b FROM u JOIN f2 ON f2.band = u.band JOIN c1 ON c1.band = u.band WHERE c + 1 BETWEEN greatest(c1.b + 1, first) AND least(first + 1, 7) GROUP BY u.band),
t AS (SELECT c1.band AS i, j, [0, 4 * rb.b, 32] AS r, [0, 4 * c1.b, 4 * c2.b, 32] AS c FROM c1 JOIN c2 ON c2.band = c1.band, rb, (SELECT unnest(range(3)) AS j) y)
SELECT (3 * i + j)::INT AS id, i::INT AS "row", j::INT AS "col", r[i + 1]::INT AS row_start, r[i + 2]::INT AS row_stop, c[j + 1]::INT AS col_start, c[j + 2]::INT AS col_stop, 4 AS align_to,
  1000.0::DOUBLE * c[j + 1] AS xmin, -1000.0::DOUBLE * r[i + 2] AS ymin, 1000.0::DOUBLE * c[j + 2] AS xmax, -1000.0::DOUBLE * r[i + 1] AS ymax,
  (SELECT round(sum(cost), 6) FROM w WHERE band = i AND w.c >= t.c[j + 1] // 4 AND w.c < t.c[j + 2] // 4) AS cost FROM t""",
}
