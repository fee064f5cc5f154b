"""Sinks: parquet, JSON lines, CSV, nested bundles, keyed caches, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.sources.readers import exists


def write_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_slim(df: DataFrame, path: str) -> None:
    """Doubles as floats, zstd."""
    write_parquet(df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"}), path, "zstd")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def bundles(moves: DataFrame, key: str = "ticker") -> DataFrame:
    """One JSON document for each key: its rows in order of move_date."""
    rows = F.array_sort(F.collect_list(F.struct("move_date", *[c for c in moves.columns if c not in (key, "move_date")])))
    return moves.groupBy(key).agg(F.to_json(rows).alias("bundle"))


def merge_index(old: DataFrame, new: DataFrame, key: str = "ticker") -> DataFrame:
    """Rebuilt entries replace the old ones of their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def append_missing(df: DataFrame, path: str, key: str = "cache_key", order: list | None = None) -> DataFrame:
    """Adds rows whose key the cache at `path` doesn't hold yet; returns those rows. Of a key's rows the first counts, by `order`
    or else by all other columns."""
    from pyspark.sql import Window as W

    first = W.partitionBy(key).orderBy(*(order or [c for c in df.columns if c != key] or [key]))
    fresh = df.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    if exists(df.sparkSession, path):
        fresh = fresh.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def markdown(df: DataFrame, most: int = 100) -> str:
    """A result table of at most `most` rows as Markdown, for reports on the driver."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])
