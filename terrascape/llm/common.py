"""What the operators share: tables, batches of texts, written intermediate results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from terrascape.sources.cells import shared_dir

#: Bytes of text that a Python task works on at once; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
#: Rows that Spark sends to a Python task at once: texts are long, and both sides hold them.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends no more than BATCH_ROWS rows to Python at once from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


_scratch: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """What written() writes inside is deleted at the end, unless it is to be kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for spark, path in _scratch.pop():
            _delete(spark, path)


def written(df: DataFrame, tag: str, keep: bool = False, **options) -> DataFrame:
    """df as Parquet in the shared folder, read again: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _scratch and not keep:
        _scratch[-1].append((spark, path))
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what written() wrote, once no result reads it any more."""
    _delete(df.sparkSession, df._written)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Arrow batches cut so that the texts of a piece take at most `limit` bytes, or one text."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary()).to_pylist()
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or b"") <= limit):
                size += len(texts[j] or b"")
                j += 1
            yield batch.slice(i, j - i), texts[i:j]
            i = j


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label of all labelled rows that may be learned from.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out; rows with a null doc_id or label
    don't count, and a doc_id that is labelled more than once takes its greatest label.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    return usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def labelled_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` rows of labelled(), the same ones each time: those with the smallest hashes of doc_id."""
    one = labelled(labels, label)
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def with_columns(df: DataFrame, fields: str, compute, column: str = "text") -> DataFrame:
    """df with the columns of `fields` (a DDL schema), which compute(texts) returns as arrays, one value a text.

    A column of df by one of those names is replaced; all others pass through, whatever their names.
    """
    new = StructType.fromDDL(fields)
    types = [to_arrow_type(f.dataType) for f in new.fields]
    rest = df.drop(*new.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, column):
            values = compute(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=[*batch.schema.names, *new.names])

    return in_small_batches(rest).mapInArrow(run, StructType([*rest.schema.fields, *new.fields]))
