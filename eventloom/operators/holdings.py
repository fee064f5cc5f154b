"""Positions over periods: roll-ups, changes, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def roll_up(lines: DataFrame, fund: str, asset: str) -> DataFrame:
    """Shares and value of each asset of a fund, and its share of the fund in percent (3 places; by 1 where the total is 0)."""
    by = lines.groupBy(fund, asset).agg(F.sum("shares").alias("shares"), F.sum("market_value").alias("market_value"))
    total = F.sum("market_value").over(W.partitionBy(fund))
    return by.withColumn("percent", F.round(100.0 * F.col("market_value") / F.when(total == 0, 1).otherwise(total), 3))


def classify(before: Column, after: Column) -> Column:
    """NEW, EXITED, INCREASED, REDUCED; null for no change."""
    return F.when(before.isNull(), "NEW").when(after.isNull(), "EXITED").when(after > before, "INCREASED").when(after < before, "REDUCED")


def deltas(current: DataFrame, prior: DataFrame, fund: str, asset: str) -> DataFrame:
    """Changes of the shares and value of each asset of each fund with current holdings; unchanged ones go."""
    funds = current.select(fund).distinct()
    a = current.select(fund, asset, F.col("shares").alias("current_shares"), F.col("market_value").alias("_v"))
    b = prior.join(funds, fund, "left_semi").select(fund, asset, F.col("shares").alias("prior_shares"), F.col("market_value").alias("_w"))
    both = a.join(b, [fund, asset], "full_outer")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = both.withColumns({"action": classify(F.col("prior_shares"), F.col("current_shares")), "shares_change": n("current_shares") - n("prior_shares"), "market_value_change": n("_v") - n("_w")})
    return out.where("action is not null").select(fund, asset, "action", "prior_shares", "current_shares", "shares_change", "market_value_change")


def latest_period(lines: DataFrame, fund: str, date: str, as_of) -> DataFrame:
    """Rows of each fund's newest date up to as_of."""
    last = lines.where(F.col(date) <= as_of).groupBy(fund).agg(F.max(date).alias(date))
    return lines.join(last, [fund, date], "left_semi")
