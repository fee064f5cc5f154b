"""Tables written under the folder that driver and executors share: what several branches of a plan read, and answers that cost money."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.readers import exists


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may go without it, in a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="eventloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back, so that branches don't compute it again; lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/eventloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_through(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, key: str = "cache_key") -> DataFrame:
    """The answers to requests, each distinct key asked once and kept: (key, answer columns), one row a key.

    Keys that the cache at `path` holds are read; for the others `answer` (a frame of requests to a frame with the key)
    is computed, appended in one write, and read back, so no later action or redone task asks again. A write
    is a job of its own: what it failed to commit is asked anew, what it committed isn't. A key that two
    runs added at the same time counts once (the least row).
    """
    spark = requests.sparkSession
    wanted = requests.dropDuplicates([key])
    held = spark.read.parquet(path) if exists(spark, path) else None
    fresh = wanted if held is None else wanted.join(held.select(key).distinct(), key, "left_anti")
    answer(fresh).write.mode("append").parquet(path)
    every = spark.read.parquet(path)
    rest = [c for c in every.columns if c != key]
    once = every.groupBy(key).agg(F.min(F.struct(*rest)).alias("_a")).select(key, "_a.*")
    return once.join(requests.select(key).distinct(), key, "left_semi")
