"""Series operators over a panel with one row per (ticker, date).

A ticker's daily bars are few by nature (ten thousand in forty years), so windows are partitioned by
ticker; all columns a chain of them needs come from one shuffle. Series of another kind can pass their own
key and order columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY, ORDER = "ticker", "date"


def series(key: str = KEY, order: str = ORDER):
    return W.partitionBy(key).orderBy(order)


def trailing(n: int, key: str = KEY, order: str = ORDER):
    """The n rows before the current one."""
    return series(key, order).rowsBetween(-n, -1)


def require(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def simple_return(value: str = "close", w=None) -> Column:
    """value / previous - 1; null on a first bar and where the previous is 0."""
    w = w or series()
    return F.try_divide(F.col(value), F.lag(value).over(w)) - 1


def log_return(value: str = "close", w=None) -> Column:
    """ln(value / previous); null unless both are positive."""
    w = w or series()
    before = F.lag(value).over(w)
    return F.when((F.col(value) > 0) & (before > 0), F.log(F.col(value) / before))


def trailing_vol(ret: str, n: int, w=None) -> Column:
    """Sample deviation of the n returns before the current one; null unless all n are there."""
    w = w if w is not None else trailing(n)
    return F.when(F.count(ret).over(w) == n, F.stddev_samp(ret).over(w))


def trailing_rank(ret: str, n: int, w=None) -> Column:
    """Share of the n absolute returns before the current one that are smaller; null unless all n are there."""
    w = w if w is not None else trailing(n)
    before = F.collect_list(F.abs(F.col(ret))).over(w)
    return F.when(F.size(before) == n, F.size(F.filter(before, lambda x: x < F.abs(F.col(ret)))) / F.lit(float(n)))


def significant_moves(prices: DataFrame, lookback_vol: int = 30, lookback_rank: int = 60, vol_mult: float = 2.0, least_rank: float = 0.95) -> DataFrame:
    """Bars whose return exceeds vol_mult trailing deviations or ranks among the largest of the trailing window.

    Windows end at the bar before. One row per flagged bar: ticker, move_date, return_pct, vol_zscore (0.0
    where the deviation is 0 or unknown), magnitude_rank, is_significant (true: a row is flagged).
    """
    require(prices, "ticker", "date", "close")
    w = series()
    stepped = prices.select("ticker", "date", "close").withColumn("ret", simple_return("close", w))
    # one frame serves both windows: the shorter one is its tail, so the series is sorted and read once
    measured = stepped.select(
        "ticker",
        "date",
        "ret",
        trailing_vol("ret", lookback_vol, w.rowsBetween(-lookback_vol, -1)).alias("vol"),
        trailing_rank("ret", lookback_rank, w.rowsBetween(-lookback_rank, -1)).alias("rank"),
    )
    size = F.abs(F.col("ret"))
    by_vol = F.coalesce((F.col("vol") > 0) & (size > vol_mult * F.col("vol")), F.lit(False))
    by_rank = F.coalesce(F.col("rank") >= least_rank, F.lit(False))
    return measured.where(F.col("ret").isNotNull() & (by_vol | by_rank)).select(
        "ticker",
        F.col("date").alias("move_date"),
        F.col("ret").alias("return_pct"),
        F.coalesce(F.when(F.col("vol") > 0, F.col("ret") / F.col("vol")), F.lit(0.0)).alias("vol_zscore"),
        F.col("rank").alias("magnitude_rank"),
        F.lit(True).alias("is_significant"),
    )


def annualised_vol(prices: DataFrame, n: int = 30, days: int = 252) -> DataFrame:
    """Deviation of each ticker's last n returns times sqrt(days); null for shorter series."""
    w = series()
    back = W.partitionBy("ticker").orderBy(F.desc("date"))
    last = prices.withColumn("ret", simple_return("close", w)).where("ret is not null").withColumn("k", F.row_number().over(back)).where(F.col("k") <= n)
    return last.groupBy("ticker").agg(F.when(F.count("ret") == n, F.stddev_samp("ret") * F.sqrt(F.lit(float(days)))).alias("vol"))


def volume_zscore(n: int = 20, value: str = "volume") -> Column:
    """(value - mean) / deviation of the n rows before; 0.0 where they don't vary, null unless all n are there."""
    w = trailing(n)
    mean, dev = F.avg(value).over(w), F.stddev_samp(value).over(w)
    return F.when(F.count(value).over(w) == n, F.when(dev > 0, (F.col(value) - mean) / dev).otherwise(0.0))


def bar_ordinal(w=None) -> Column:
    """0-based place of the bar in its series."""
    return F.row_number().over(w or series()) - 1


def forward_return(value: str, n: int, w=None) -> Column:
    """value n bars ahead / value - 1; null past the end and for values that aren't positive."""
    w = w or series()
    ahead = F.lead(value, n).over(w)
    return F.when((F.col(value) > 0) & (ahead > 0), ahead / F.col(value) - 1)


def next_n_day_return(value: str, n: int, w=None) -> Column:
    """From the first bar after to the n-th bar after, so over n - 1 steps; null if there are fewer bars."""
    w = w or series()
    return F.try_divide(F.lead(value, n).over(w), F.lead(value, 1).over(w)) - 1


def to_places(value: Column, places: int) -> Column:
    """Rounded half up. Noise in the last bits of a double is taken off first, so that it decides no tie."""
    return F.round(F.round(value, 9), places)


def adjust_dividends(prices: DataFrame, dividends: DataFrame, places: int | None = 4) -> DataFrame:
    """adj_close: each bar's close times (c - d) / c of every later ex-date that is a bar, with 0 < d < c.

    dividends: ticker, date, amount.
    """
    paid = dividends.groupBy("ticker", "date").agg(F.sum("amount").alias("amount"))
    joined = prices.join(paid, ["ticker", "date"], "left")
    factor = F.when((F.col("amount") > 0) & (F.col("amount") < F.col("close")), (F.col("close") - F.col("amount")) / F.col("close")).otherwise(1.0)
    later = W.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, -1)
    adjusted = F.col("close") * F.coalesce(F.product("factor").over(later), F.lit(1.0))
    return joined.withColumn("factor", factor).withColumn("adj_close", adjusted if places is None else to_places(adjusted, places)).drop("amount", "factor")


def split_factor(text: Column) -> Column:
    """"a:b" as b / a; null for anything else."""
    parts = F.split(text, ":")
    return F.try_divide(F.try_to_number(F.get(parts, F.lit(1)), F.lit("999999.999")).cast("double"), F.try_to_number(F.get(parts, F.lit(0)), F.lit("999999.999")).cast("double"))


def adjust_splits(prices: DataFrame, splits: DataFrame, columns: tuple[str, ...] = ("close",)) -> DataFrame:
    """Prices of dates before an ex-date times its b / a; factors compound, volume stays. The ex-date need not be a bar.

    splits: ticker, date, split_factor. Bars and ex-dates are merged in one sorted series, so no bar meets
    every split of its ticker.
    """
    steps = splits.select("ticker", "date", split_factor(F.col("split_factor")).alias("f"), F.lit(0).alias("bar"))
    rows = prices.withColumns({"f": F.lit(1.0), "bar": F.lit(1)}).unionByName(steps, allowMissingColumns=True)
    # an ex-date's factor counts for strictly earlier dates: it comes after its date's bar going forward
    later = W.partitionBy("ticker").orderBy(F.desc("date"), F.desc("bar")).rowsBetween(W.unboundedPreceding, -1)
    total = F.coalesce(F.product("f").over(later), F.lit(1.0))
    return rows.withColumn("_f", total).where("bar = 1").withColumns({c: F.col(c) * F.col("_f") for c in columns}).drop("_f", "f", "bar")


def synthetic_index(returns: DataFrame, key: str, ret: str = "log_return", clip: float = 0.5) -> DataFrame:
    """exp of the running sum of the mean clipped return of each (key, date); equally weighted."""
    clipped = F.when(F.col(ret).isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col(ret))))
    daily = returns.groupBy(key, "date").agg(F.avg(clipped).alias("mean_return"))
    w = W.partitionBy(key).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("level", F.exp(F.sum(F.coalesce("mean_return", F.lit(0.0))).over(w)))


def gap_summary(prices: DataFrame, over: int = 7, most: int = 20) -> DataFrame:
    """Per ticker the number and the largest of the gaps between bars of more than `over` days; the `most` with most gaps."""
    gaps = prices.withColumn("gap", F.datediff("date", F.lag("date").over(series()))).where(F.col("gap") > over)
    return gaps.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_gaps"), F.max("gap").alias("max_gap")).orderBy(F.desc("n_gaps"), "ticker").limit(most)


def date_ranges(prices: DataFrame, stale: int = 90) -> DataFrame:
    """First and last bar of each ticker, and whether it ended more than `stale` days before the panel."""
    ranges = prices.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_bars"))
    end = ranges.agg(F.max("last_date").alias("end"))
    return ranges.crossJoin(F.broadcast(end)).select("ticker", "first_date", "last_date", "n_bars", (F.col("last_date") < F.date_sub("end", stale)).alias("ended"))  # one row


def period_spikes(rows: DataFrame, value: str, over: float = 0.20, w=None) -> DataFrame:
    """Rows whose value grew by more than `over` against a positive previous one; prior and change are added."""
    w = w or series()
    prior = F.lag(value).over(w)
    return rows.withColumn("prior", prior).withColumn("change", F.when(F.col("prior") > 0, (F.col(value) - F.col("prior")) / F.col("prior"))).where(F.col("change") > over)


def drawdown(value: str, w) -> Column:
    """Running value less its running maximum (never positive); w runs from the first row to the current one."""
    return F.col(value) - F.max(value).over(w)


def predicted_overlay(bars: DataFrame) -> DataFrame:
    """predicted: close times the product of (1 + predicted) / (1 + realised) over the moves so far; null before the first.

    bars: ticker, date, close, and on move dates predicted_return and realized_return.
    """
    w = series().rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("predicted_return").isNotNull(), F.try_divide(1 + F.col("predicted_return"), 1 + F.col("realized_return")))
    gap = F.when(F.count("predicted_return").over(w) > 0, F.product(F.coalesce(F.col("_step"), F.lit(1.0))).over(w))
    return bars.withColumn("_step", step).withColumn("predicted", F.col("close") * gap).drop("_step")


def first_bar_on_or_after(events: DataFrame, bars: DataFrame, date: str = "event_date") -> DataFrame:
    """Adds bar_ord (place of the first bar on or after the date; null past the end) and is_bar (the date is one).

    events and bars (ticker, date, ord) are merged and sorted once per ticker; nothing is compared pairwise.
    """
    marks = bars.select("ticker", F.col("date").alias("_d"), F.col("ord").alias("_o"))
    rows = events.withColumns({"_d": F.col(date), "_o": F.lit(None).cast("int"), "_e": F.lit(True)}).unionByName(marks.withColumn("_e", F.lit(False)), allowMissingColumns=True)
    # going back in time, a date's bar comes before its events, so they see it
    w = W.partitionBy("ticker").orderBy(F.desc("_d"), "_e").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("bar_ord", F.last("_o", ignorenulls=True).over(w)).withColumn("_b", F.last(F.when(~F.col("_e"), F.col("_d")), ignorenulls=True).over(w))
    return found.where("_e").withColumn("is_bar", F.coalesce(F.col("_b") == F.col("_d"), F.lit(False))).drop("_d", "_o", "_e", "_b")
