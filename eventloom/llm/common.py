"""What the training-data operators share: reading, staging, and batch-wise mapping."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that one call of a batch function sees; it bounds a Python worker's memory.
BATCH_ROWS = 256
#: Rows of an Arrow batch between the JVM and Python, unless the session says otherwise; documents may be long.
ARROW_ROWS = "1000"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def agreed_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and its label: null ones are left out, repeated ones count once, and a doc_id whose labels differ has none."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    by = known.groupBy("doc_id").agg(F.min(column).alias(column), F.max(column).alias("_most"))
    return by.where(F.col(column) == F.col("_most")).select("doc_id", column)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may go without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="eventloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/eventloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_paths = (path,)
    return out


def union(tables: list[DataFrame]) -> DataFrame:
    """Their rows, and the staged folders that they read."""
    out = functools.reduce(DataFrame.unionAll, tables)
    out.staged_paths = tuple(p for t in tables for p in getattr(t, "staged_paths", ()))
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of tables that `staged` or `union` returned; whatever still needs them must be written by now."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in df.staged_paths:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Lower the default of ten thousand rows a batch; a value that someone chose stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, ARROW_ROWS)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Apply fn to slices of at most `rows` rows, in the Python workers."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def map_runs(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, size: int) -> DataFrame:
    """Apply fn to runs of rows of about `size` bytes at most (a longer row is alone), over the bounds of Arrow's batches."""
    bound_batches(df.sparkSession)

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows > 1 and batch.nbytes > size:
            half = batch.num_rows // 2
            yield from parts(batch.slice(0, half))
            yield from parts(batch.slice(half))
        elif batch.num_rows:
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0
        for batch in batches:
            for part in parts(batch):
                if held and total + part.nbytes > size:
                    yield fn(pa.concat_batches(held))
                    held, total = [], 0
                held.append(part)
                total += part.nbytes
        if held:
            yield fn(pa.concat_batches(held))

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null counts as the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def hash_unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) from 52 bits of the md5 of the parts, joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
