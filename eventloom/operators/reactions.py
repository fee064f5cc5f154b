"""Reaction and forward returns of dated events against a price panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators.panel import bar_ordinal, first_bar_on_or_after, forward_return, log_return, series

HORIZONS = (1, 5, 20)
MEASURES = ("fwd_1d", "fwd_5d", "fwd_20d", "vol_30d", "vol_60d")


def session_tag(minutes: Column) -> Column:
    """Minutes of the day to BMO (up to 09:30), AMC (from 16:00) or INTRADAY; null stays null."""
    return F.when(minutes <= 570, "BMO").when(minutes >= 960, "AMC").when(minutes.isNotNull(), "INTRADAY")


def with_bars(prices: DataFrame, value: str = "close", horizons: tuple[int, ...] = HORIZONS, w=None) -> DataFrame:
    """Bars with ord, previous and next values, log return, forward returns and trailing deviations; one sort for all.
    w: another series than a ticker's dates."""
    w = w if w is not None else series()
    logged = prices.withColumns({"ord": bar_ordinal(w), "log_return": log_return(value, w)})
    out = {"prev": F.lag(value).over(w), "next": F.lead(value).over(w)} | {f"fwd_{h}d": forward_return(value, h, w) for h in horizons}
    for n in (30, 60):
        back = w.rowsBetween(-n, -1)
        out[f"vol_{n}d"] = F.when(F.col("ord") >= n, F.stddev_samp("log_return").over(back))
    return logged.withColumns(out)


def reactions(events: DataFrame, prices: DataFrame, value: str = "close", measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Joins each event to its anchor bar and measures it.

    events: event_id, ticker, event_date, session. BMO measures the bar against the one before; AMC the next
    bar against it; an event on no trading day measures its first later bar against the one before. Events
    without both bars go. The anchor is the last bar of the reaction; forward returns start there. Bars and events
    go through one shuffle by ticker, in which the bars are measured and then the events placed. measures: those of
    the anchor bar that are wanted; others aren't made.
    """
    rows = prices.select("ticker", "date", value, F.lit(False).alias("_e")).unionByName(_marks(events), allowMissingColumns=True)
    # the events are a series of their own, which is not read
    return _anchored(with_bars(rows.repartition("ticker"), value, w=W.partitionBy("ticker", "_e").orderBy("date")), value, measures)


def _marks(events: DataFrame) -> DataFrame:
    return events.select("event_id", "ticker", "event_date", "session", F.col("event_date").alias("date"), F.lit(True).alias("_e"))


def place(events: DataFrame, measured: DataFrame, value: str = "close", keep: tuple[str, ...] = ()) -> DataFrame:
    """``reactions`` on bars that ``with_bars`` has measured; `keep` are columns of the anchor bar that go along."""
    marks = measured.select("ticker", "date", "prev", value, *MEASURES, *keep, F.lit(False).alias("_e"))
    return _anchored(marks.unionByName(_marks(events), allowMissingColumns=True), value, (*MEASURES, *keep))


def _anchored(rows: DataFrame, value: str, names: tuple[str, ...]) -> DataFrame:
    """Events of a merged series of measured bars and events (_e), with the named measures of their anchor bars.

    Going back in time, a date's bar comes before its events, so they see it, but after those of AMC, which see a later one.
    """
    turn = F.when(~F.col("_e"), 1).when(F.col("session") == "AMC", 0).otherwise(2)
    w = W.partitionBy("ticker").orderBy(F.desc("date"), turn).rowsBetween(W.unboundedPreceding, 0)
    bar = F.struct("date", "prev", F.col(value).alias("value"), *names)
    at = rows.withColumn("_a", F.last(F.when(~F.col("_e"), bar), ignorenulls=True).over(w)).where("_e and _a.prev > 0")
    kept = at.withColumn("reaction_return", F.col("_a.value") / F.col("_a.prev") - 1).where("reaction_return is not null")
    return kept.select("event_id", "ticker", "event_date", "session", F.col("_a.date").alias("anchor_date"), F.col("_a.prev").alias("pre_price"), "reaction_return", *(F.col(f"_a.{c}").alias(c) for c in names))


def excess(rows: DataFrame, bench: DataFrame, horizons: tuple[int, ...] = HORIZONS, date: str = "anchor_date", suffix: str = "excess") -> DataFrame:
    """Forward returns less the benchmark's of the same date; null where it has none. bench: date, fwd_*."""
    named = bench.select(F.col("date").alias(date), *(F.col(f"fwd_{h}d").alias(f"_b{h}") for h in horizons))
    return rows.join(named, date, "left").withColumns({f"fwd_{h}d_{suffix}": F.col(f"fwd_{h}d") - F.col(f"_b{h}") for h in horizons}).drop(*(f"_b{h}" for h in horizons))


def significance(reaction: Column, vol: Column, z: float = 2.5, size: float = 0.05) -> tuple[Column, Column]:
    """(z-score, flag): the flag needs |z| > z and |reaction| > size; a zero or unknown deviation gives null and false."""
    score = F.try_divide(reaction, F.nullif(vol, F.lit(0.0)))
    return score, F.coalesce((F.abs(score) > z) & (F.abs(reaction) > size), F.lit(False))


def best_filing(filings: DataFrame) -> DataFrame:
    """One filing per (ticker, date): outside market hours first, then the earliest; the other columns decide ties.

    filings: ticker, date, ts, minutes."""
    outside = (F.col("minutes") <= 570) | (F.col("minutes") >= 960)
    w = W.partitionBy("ticker", "date").orderBy(outside.desc(), "ts", *[c for c in filings.columns if c not in ("ticker", "date", "ts")])
    return filings.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def consensus_tag(tagged: DataFrame, least: float = 0.9) -> DataFrame:
    """Each ticker's most frequent tag of BMO and AMC with its share, if that is at least `least`; BMO wins a tie."""
    counts = tagged.where(F.col("tag").isin("BMO", "AMC")).groupBy("ticker", "tag").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("ticker").agg(F.sum("n").alias("total"), F.max(F.struct("n", "tag")).alias("top"))
    return per.select("ticker", F.col("top.tag").alias("tag"), (F.col("top.n") / F.col("total")).alias("share")).where(F.col("share") >= least)


def resolve_session(events: DataFrame, consensus: DataFrame) -> DataFrame:
    """Final session and its source: a missing tag takes the ticker's consensus, an intraday one is overridden by it; the rest go."""
    joined = events.join(consensus.select("ticker", F.col("tag").alias("_c")), "ticker", "left")
    session = F.when(F.col("tag").isin("BMO", "AMC"), F.col("tag")).otherwise(F.col("_c"))
    source = F.when(F.col("tag").isNull(), "ticker_consensus").when(F.col("tag") == "INTRADAY", "sec_8k_intraday_corrected").otherwise("sec_8k")
    return joined.withColumns({"session": session, "time_source": source}).where(F.col("session").isin("BMO", "AMC")).drop("_c")


def history_filter(events: DataFrame, bars: DataFrame, before: int = 60, after: int = 20) -> DataFrame:
    """Events with at least `before` bars before and `after` bars from their first bar on."""
    counted = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"))
    placed = first_bar_on_or_after(events, bars).join(counted, "ticker")
    return placed.where((F.col("bar_ord") >= before) & (F.col("_n") - F.col("bar_ord") >= after)).drop("_n")
