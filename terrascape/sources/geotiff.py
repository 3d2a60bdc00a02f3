"""GeoTIFF rasters: decoded strip by strip into cells, and written from small grids.

Reading takes the bytes through Spark's own binary reader, so any file system does; a file is one
task's work and at most 2 GB, which is what that reader takes. Larger rasters belong in cell
tables (write_cells), one file a tile. Striped and tiled files of integers or floats are read,
plain or deflated, with predictors 1 to 3.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terrascape.grid import Grid
from terrascape.sources.cells import to_array

#: Fixed values of the TIFF format: tags, the sizes and codes of field types, sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, MATRIX, GEO_KEYS, GEO_ASCII, NODATA = 33550, 33922, 34264, 34735, 34737, 42113
MODEL_TYPE, GEOGRAPHIC_CRS, PROJECTED_CRS = 1024, 2048, 3072
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8)}
KINDS = {1: "u", 2: "i", 3: "f"}


def tags(content: bytes) -> tuple[dict[int, tuple], str]:
    """Tags of the first image, and the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or len(content) < 8:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", content, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), content, 8 if big else 4)[0]
    count, size, step = (*struct.unpack_from(order + "Q", content, at), 8, 20) if big else (*struct.unpack_from(order + "H", content, at), 2, 12)
    out = {}
    for i in range(count):
        entry = at + size + i * step
        tag, kind = struct.unpack_from(order + "HH", content, entry)
        n = struct.unpack_from(order + ("Q" if big else "I"), content, entry + 4)[0]
        if kind not in TYPES:
            continue
        code, width = TYPES[kind]
        inline = 8 if big else 4
        place = entry + (12 if big else 8)
        if n * width > inline:
            place = struct.unpack_from(order + ("Q" if big else "I"), content, place)[0]
        out[tag] = (content[place : place + n],) if kind == 2 else struct.unpack_from(order + code * n, content, place)
    return out, order


def described(content: bytes) -> Grid:
    """Grid of a file, by its tags."""
    t, _ = tags(content)
    if MATRIX in t:
        m = t[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in t and TIE_POINT in t:
        (sx, sy, *_), (i, j, _, x, y, *_) = t[PIXEL_SCALE], t[TIE_POINT]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    keys = t.get(GEO_KEYS, ())
    model = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    is_geo = {1: False, 2: True}.get(model.get(MODEL_TYPE))
    code = model.get(PROJECTED_CRS) or model.get(GEOGRAPHIC_CRS)
    text = t[NODATA][0].rstrip(b"\0 ").decode() if NODATA in t else ""
    return Grid(int(t[HEIGHT][0]), int(t[WIDTH][0]), tuple(map(float, transform)), is_geo, "degrees" if is_geo else "metre", float(text) if text else None, int(t.get(SAMPLES, (1,))[0]), f"EPSG:{code}" if code else None)


def blocks(content: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, samples) of each strip or tile: rows x columns x bands, cut to the image."""
    t, order = tags(content)
    height, width, bands = int(t[HEIGHT][0]), int(t[WIDTH][0]), int(t.get(SAMPLES, (1,))[0])
    dtype = np.dtype(f"{order}{KINDS[t.get(SAMPLE_FORMAT, (1,))[0]]}{t[BITS][0] // 8}")
    apart = t.get(PLANAR, (1,))[0] == 2
    compression, predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
    if compression not in (1, 8, 32946):
        raise ValueError(f"compression {compression} isn't read; store the file plain or deflated")
    if TILE_OFFSETS in t:
        bh, bw, offsets, sizes = int(t[TILE_HEIGHT][0]), int(t[TILE_WIDTH][0]), t[TILE_OFFSETS], t[TILE_BYTES]
    else:
        bh, bw, offsets, sizes = min(height, int(t.get(ROWS_PER_STRIP, (height,))[0])), width, t[STRIP_OFFSETS], t[STRIP_BYTES]
    across = -(-width // bw)
    down = -(-height // bh)
    each = 1 if apart else bands
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        at = k % (across * down)
        row, col = at // across * bh, at % across * bw
        raw = content[offset : offset + size]
        raw = zlib.decompress(raw) if compression != 1 else raw
        rows = bh if TILE_OFFSETS in t else min(bh, height - row)
        if predictor == 3:  # bytes of a row lie by their place in the number, and as differences
            b = np.cumsum(np.frombuffer(raw, np.uint8)[: rows * bw * each * dtype.itemsize].reshape(rows, -1, each), axis=1, dtype=np.uint8)
            data = np.ascontiguousarray(b.reshape(rows, dtype.itemsize, bw * each).transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, bw, each)
        else:
            data = np.frombuffer(raw, dtype)[: rows * bw * each].reshape(rows, bw, each)
            if predictor == 2:
                data = np.cumsum(data, axis=1, dtype=dtype.newbyteorder("="))
        data = data[: height - row, : width - col]
        if not apart:
            yield row, col, data
        else:
            held.setdefault((row, col), []).append(data)
            if len(held[row, col]) == bands:
                yield row, col, np.concatenate(held.pop((row, col)), axis=2)


def grid_of(spark: SparkSession, path: str) -> Grid:
    return described(bytes(spark.read.format("binaryFile").load(path).select("content").head()[0]))


def read_geotiff(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Cells (row, col, value) or, with more bands, (row, col, bands), and the grid; nodata, missing and infinite become null."""
    grid = grid_of(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for row, col, data in blocks(content.as_py()):
                    rows, cols = np.meshgrid(np.arange(data.shape[0]) + row, np.arange(data.shape[1]) + col, indexing="ij")
                    v = data.astype(np.float32).reshape(-1, data.shape[2])
                    bad = ~np.isfinite(v) if grid.nodata is None else ~np.isfinite(v) | (v == np.float32(grid.nodata))
                    value = pa.array(v[:, 0], mask=bad[:, 0])
                    if grid.bands > 1:
                        value = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.array(v.ravel(), mask=bad.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(rows.ravel().astype(np.int32)), pa.array(cols.ravel().astype(np.int32)), value], names=["row", "col", "value" if grid.bands == 1 else "bands"])

    schema = "row int, col int, " + ("value float" if grid.bands == 1 else "bands array<float>")
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema), grid


def encoded(values: np.ndarray, grid: Grid) -> bytes:
    """A deflated GeoTIFF of one float band; what is missing is nodata (not a number unless the grid names one)."""
    nodata = float("nan") if grid.nodata is None else grid.nodata
    data = np.where(np.isfinite(values), values, nodata).astype("<f4")
    strips = [zlib.compress(data[r : r + 64].tobytes()) for r in range(0, grid.nrows, 64)]
    a, b, c, d, e, f = grid.transform
    model = [1, 1, 0, 1, MODEL_TYPE, 0, 1, 2 if grid.is_geo else 1]
    if grid.crs and grid.crs.startswith("EPSG:"):
        model[3] = 2
        model += [GEOGRAPHIC_CRS if grid.is_geo else PROJECTED_CRS, 0, 1, int(grid.crs[5:])]
    fields = [
        (WIDTH, 4, [grid.ncols]), (HEIGHT, 4, [grid.nrows]), (BITS, 3, [32]), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (STRIP_OFFSETS, 4, None), (SAMPLES, 3, [1]),
        (ROWS_PER_STRIP, 4, [64]), (STRIP_BYTES, 4, list(map(len, strips))), (SAMPLE_FORMAT, 3, [3]), (MATRIX, 12, [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1]), (GEO_KEYS, 3, model), (NODATA, 2, repr(nodata).encode() + b"\0"),
    ]
    body = bytearray()
    start = 8 + 2 + 12 * len(fields) + 4
    directory = struct.pack("<H", len(fields))
    sizes = [len(s) for s in strips]
    first = start + sum(len(v) * TYPES[k][1] if v is not None else 4 * len(strips) for _, k, v in fields)
    for tag, kind, v in fields:
        v = list(np.cumsum([first, *sizes])[:-1]) if v is None else v
        raw = bytes(v) if kind == 2 else struct.pack("<" + TYPES[kind][0] * len(v), *v)
        directory += struct.pack("<HHI", tag, kind, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", start + len(body)))
        body += raw if len(raw) > 4 else b""
    gap = first - start - len(body)
    return b"II*\0" + struct.pack("<I", 8) + directory + struct.pack("<I", 0) + bytes(body) + b"\0" * gap + b"".join(strips)


def write_geotiff(cells: DataFrame, grid: Grid, path: str, most: int = 100_000_000) -> None:
    """One file of a grid of at most `most` cells, through Spark's file systems; larger ones go to write_cells or one file a tile."""
    if grid.nrows * grid.ncols > most:
        raise ValueError(f"{grid.nrows} x {grid.ncols} cells are too many for one file; use write_cells")
    spark = cells.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(encoded(to_array(cells, grid), grid)))
    finally:
        out.close()
