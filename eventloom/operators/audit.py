"""Checks that return the rows that fail, or a row of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordering(bars: DataFrame) -> DataFrame:
    """Bars whose high or low doesn't enclose open and close, or with a price that isn't positive."""
    return bars.where((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("low") <= 0))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unexplained_jumps(bars: DataFrame, splits: DataFrame, size: float = 0.4) -> DataFrame:
    """Bars that move by more than `size` on a day without a split."""
    moved = bars.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(W.partitionBy("ticker").orderBy("date"))) - 1)
    return moved.where(F.abs("ret") > size).join(splits.select("ticker", "date"), ["ticker", "date"], "left_anti")


def look_ahead(joined: DataFrame, used: str, at: str) -> DataFrame:
    """Rows that use something dated after the moment they speak of."""
    return joined.where(F.col(used) > F.col(at))


def renamed(names: DataFrame) -> DataFrame:
    """Tickers under which more than one name is on record."""
    return names.groupBy("ticker").agg(F.countDistinct("name").alias("n_names")).where("n_names > 1")


def expectations(rows: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """Many row-wise expectations in one aggregate: check, n (rows), failed, share, and sample (the least key that fails).

    A check that is null for a row doesn't speak of it.
    """
    cells = [
        F.struct(
            F.lit(name).alias("check"),
            F.count(ok).alias("n"),
            F.count_if(~ok).alias("failed"),
            F.coalesce(F.try_divide(F.count_if(~ok), F.count(ok)), F.lit(0.0)).alias("share"),
            F.min(F.when(~ok, F.col(key))).alias("sample"),
        )
        for name, ok in checks.items()
    ]
    return rows.agg(F.array(*cells).alias("c")).select(F.explode_outer("c").alias("x")).select("x.*")
