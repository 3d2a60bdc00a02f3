"""Polygons: rings as rows, from GeoJSON or WKT, in any reference system that functions/projections.py has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascape.functions.polygons import follower, once
from terrascape.functions.projections import projection
from terrascape.grid import Grid

POLYGON = "poly_id long, ring_id int, is_hole boolean, vertices array<struct<x: double, y: double>>"
_GEOMETRY = "struct<type: string, coordinates: string>"
_CRS = "crs struct<properties: struct<name: string>>"
_FILE = f"type string, coordinates string, geometry {_GEOMETRY}, features array<struct<geometry: {_GEOMETRY}>>, {_CRS}"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """poly_id, ring_id, is_hole, vertices, crs of the polygons and multipolygons of a file or a folder of files; other geometries are left out.

    poly_id is the hash of a polygon's file and place in it. crs is what the file names, or null;
    coordinates stay as they are, see fitted().
    """
    raw = spark.read.schema(_FILE).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    single = F.coalesce(F.col("geometry"), F.struct("type", "coordinates"))
    each = raw.select("file", F.col("crs.properties.name").alias("crs"), F.posexplode(F.coalesce(F.transform("features", lambda f: f["geometry"]), F.array(single))).alias("i", "g")).select("file", "crs", "i", "g.*")
    nested = "array<array<array<array<double>>>>"
    parts = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", "array<array<array<double>>>"))).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", nested))
    rows = each.select("file", "crs", "i", F.posexplode(parts).alias("j", "rings")).withColumn("poly_id", F.xxhash64("file", "i", "j"))
    rings = rows.select("poly_id", "crs", F.posexplode("rings").alias("ring_id", "ring"))
    return rings.select("poly_id", "ring_id", (F.col("ring_id") > 0).alias("is_hole"), F.transform("ring", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("vertices"), "crs")


def epsg(name: str | None) -> str | None:
    """'EPSG:n' of the usual ways to write it, and of CRS84; other names in capitals."""
    text = (name or "").strip().upper()
    if not text:
        return None
    if text.endswith("CRS84"):
        return "EPSG:4326"
    head, _, code = text.rpartition(":")
    return f"EPSG:{code}" if "EPSG" in head and code.isdigit() else text


def reprojected(polygon: DataFrame, source: str, target: str, step: float | None = None) -> DataFrame:
    """Polygons of one reference system in another; edges longer than step (in units of the source) are cut first, so that they follow the curves that they become.

    step None: a 64th of each ring's larger side. ValueError for a system that isn't known, before
    anything is read. Null and empty rings stay as they are; other columns stay, crs becomes the target's.
    """
    there, here = projection(epsg(target)), projection(epsg(source))
    xs, ys = F.transform("vertices", lambda v: v["x"]), F.transform("vertices", lambda v: v["y"])
    side = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    size = F.lit(float(step)) if step is not None else F.when(side > 0, side / 64).otherwise(1.0)

    def along(p, q):
        n = F.greatest(F.ceil(F.hypot(q["x"] - p["x"], q["y"] - p["y"]) / size), F.lit(1)).cast("int")
        at = lambda k: F.struct((p["x"] + (q["x"] - p["x"]) * k / n).alias("x"), (p["y"] + (q["y"] - p["y"]) * k / n).alias("y"))
        return F.transform(F.sequence(F.lit(0), n - 1), at)

    point = lambda way: lambda v: F.struct(*[c.alias(n) for c, n in zip(way(v["x"], v["y"]), "xy", strict=True)])
    some = F.size("vertices") > 0
    out = once(polygon, "vertices", F.when(some, F.flatten(F.zip_with("vertices", follower(F.col("vertices")), along))).otherwise(F.col("vertices")))
    for way in (here.inverse, there.forward):
        out = once(out, "vertices", F.transform("vertices", point(way)))
    return out.withColumn("crs", F.lit(epsg(target))) if "crs" in polygon.columns else out


def fitted(polygon: DataFrame, grid: Grid) -> DataFrame:
    """Polygons in the grid's reference system: those that name another are reprojected, those that name none are taken to be in it.

    ValueError if a system isn't known, or there are more than ten.
    """
    if not grid.crs or "crs" not in polygon.columns:
        return polygon
    named = [r[0] for r in polygon.where("crs IS NOT NULL").select("crs").distinct().limit(11).collect()]
    if len(named) > 10:
        raise ValueError("the polygons are in more than ten reference systems")
    target, apart = epsg(grid.crs), [n for n in named if epsg(n) and epsg(n) != epsg(grid.crs)]
    if not apart:
        return polygon
    out = polygon.where(F.col("crs").isNull() | ~F.col("crs").isin(apart))
    for name in apart:
        out = out.unionByName(reprojected(polygon.where(F.col("crs") == name), epsg(name), target))
    return out


def from_wkt(rows: DataFrame, column: str = "wkt") -> DataFrame:
    """poly_id, ring_id, is_hole, vertices of a column of WKT polygons and multipolygons, by array functions; rows: poly_id and the column.

    Rings of z or m coordinates keep x and y. Other geometries, EMPTY ones and nulls give no rows;
    the polygons of a multipolygon have the hashes of poly_id and their place as ids.
    """
    text = F.regexp_replace(F.trim(F.regexp_replace(F.col(column), r"(?i)^\s*SRID=[0-9]+;", "")), r"\s+", " ")
    kind = F.upper(F.regexp_extract(text, r"^([A-Za-z]+)", 1))
    body = F.regexp_replace(F.regexp_extract(text, r"\((.*)\)$", 1), r"\s*([(),])\s*", "$1")
    shapes = F.when(kind == "POLYGON", F.array(body)).when(kind == "MULTIPOLYGON", F.transform(F.split(body, r"\)\),\(\("), lambda s: F.regexp_replace(s, r"^\(\(|\)\)$", "")))
    each = rows.select("poly_id", kind.alias("kind"), F.posexplode(shapes).alias("place", "shape")).where("shape <> ''")
    rings = F.split(F.regexp_replace("shape", r"^\(|\)$", ""), r"\),\(")
    each = each.select("poly_id", "kind", "place", F.posexplode(rings).alias("ring_id", "ring"))
    vertex = lambda p: F.struct(F.get(F.split(p, " "), F.lit(0)).cast("double").alias("x"), F.get(F.split(p, " "), F.lit(1)).cast("double").alias("y"))
    ident = F.when(F.col("kind") == "POLYGON", F.col("poly_id")).otherwise(F.xxhash64("poly_id", "place"))
    return each.select(ident.cast("long").alias("poly_id"), "ring_id", (F.col("ring_id") > 0).alias("is_hole"), F.transform(F.split("ring", ","), vertex).alias("vertices"))


def to_wkt(polygon: DataFrame) -> DataFrame:
    """poly_id, wkt: each polygon with its rings as POLYGON text, closed."""
    ring = F.transform(F.concat("vertices", F.slice("vertices", 1, 1)), lambda v: F.concat(v["x"].cast("string"), F.lit(" "), v["y"].cast("string")))
    rings = F.transform(F.array_sort(F.collect_list(F.struct("ring_id", F.array_join(ring, ", ").alias("text")))), lambda r: F.concat(F.lit("("), r["text"], F.lit(")")))
    return polygon.groupBy("poly_id").agg(F.concat(F.lit("POLYGON ("), F.array_join(rings, ", "), F.lit(")")).alias("wkt"))


def polygons(spark: SparkSession, shapes: list[list[list[tuple[float, float]]]]) -> DataFrame:
    """Polygons from lists of rings, the first of each its exterior."""
    rows = [(i, j, j > 0, [{"x": float(x), "y": float(y)} for x, y in ring]) for i, rings in enumerate(shapes) for j, ring in enumerate(rings)]
    return spark.createDataFrame(rows, POLYGON)


def box(spark: SparkSession, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    return polygons(spark, [[[(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)]]])
