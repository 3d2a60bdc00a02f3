"""Cell tables: Parquet with a sidecar of grid metadata; where intermediate results go."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascape.grid import Grid


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local run makes one of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="terrascape-")
        shared_dir.own = found
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that what uses it several times doesn't work it out as often."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows over all tasks, before each becomes a long list or much work: by their own size they would be put in one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def from_array(spark: SparkSession, values) -> DataFrame:
    """row, col, value of a small 2-D array; not a number becomes null."""
    v = np.ma.filled(np.ma.masked_invalid(np.ma.asarray(values, dtype=float)), np.nan)
    rows = [(int(r), int(c), None if np.isnan(x) else float(x)) for (r, c), x in np.ndenumerate(v)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def to_array(cells: DataFrame, grid: Grid) -> np.ndarray:
    """A small grid's values as a 2-D array, for plots and tests."""
    out = np.full((grid.nrows, grid.ncols), np.nan)
    for r in cells.select("row", "col", "value").toLocalIterator():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a function that makes its paths."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark._jsc.hadoopConfiguration()), to


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    fs, to = _files(spark, path)
    fs.delete(to(path), True)


def files_exist(spark: SparkSession, path: str) -> bool:
    fs, to = _files(spark, path)
    return fs.exists(to(path))


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the published versions of a cell table, the last one last."""
    fs, to = _files(spark, path)
    at = to(f"{path}/published")
    names = sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
    return [f"{path}/versions/{n.partition('-')[2]}" for n in names if not n.startswith(("_", "."))]


def write_cells(cells: DataFrame, grid: Grid, path: str, tile: int = 256) -> None:
    """Cells in Parquet, partitioned by bands of rows so that readers skip those they don't need; the grid beside them.

    Each write is a version in a folder of its own, and is published by one rename once cells and
    grid are complete. Until then readers have the version before; a write that fails deletes
    what it wrote, and one that is killed leaves a folder that nothing reads. Of two writers at
    once the one that is published first is replaced by the other.
    """
    spark = cells.sparkSession
    fs, to = _files(spark, path)
    name = uuid.uuid4().hex
    folder = f"{path}/versions/{name}"
    try:
        banded = cells.withColumn("band", F.floor(F.col("row") / tile).cast("int"))
        banded.repartition("band").sortWithinPartitions("row", "col").write.partitionBy("band").parquet(f"{folder}/cells")
        spark.createDataFrame([(json.dumps({**asdict(grid), "tile": tile}),)], "value string").coalesce(1).write.text(f"{folder}/grid")
        fs.mkdirs(to(f"{path}/published"))
        fs.mkdirs(to(f"{folder}/ready"))
        while not fs.rename(to(f"{folder}/ready"), to(f"{path}/published/{len(versions(spark, path)):010d}-{name}")):
            pass
    except BaseException:
        fs.delete(to(folder), True)
        raise


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Delete all versions of a cell table but the last, once nothing reads them any more."""
    fs, to = _files(spark, path)
    for folder in versions(spark, path)[:-1]:
        fs.delete(to(folder), True)


def read_cells(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> tuple[DataFrame, Grid]:
    """Cells within ranges of rows and columns (the ends excluded), of the last version; the ranges reach the scan, by the bands that the table was written in."""
    path = versions(spark, path)[-1]
    facts = json.loads(spark.read.text(f"{path}/grid").head()[0])
    tile = facts.pop("tile")
    grid = Grid(**{k: tuple(v) if isinstance(v, list) else v for k, v in facts.items()})
    cells = spark.read.parquet(f"{path}/cells")
    if rows:
        cells = cells.where((F.col("band") >= rows[0] // tile) & (F.col("band") <= (rows[1] - 1) // tile) & (F.col("row") >= rows[0]) & (F.col("row") < rows[1]))
    if cols:
        cells = cells.where((F.col("col") >= cols[0]) & (F.col("col") < cols[1]))
    return cells.drop("band"), grid
