"""Joining moves to dated evidence over trading-day windows, and ranking it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Priority of event types, lower first.
EVENT_PRIORITY = {
    "short_report": 1,
    "earnings_release": 2,
    "analyst_rating_change": 3,
    "price_target_change": 3,
    "pdufa": 3,
    "adcomm": 3,
    "approval": 3,
    "crl": 3,
    "denial": 3,
    "news": 4,
    "short_interest_spike": 5,
    "13f_delta": 6,
    "index_change_announcement": 7,
    "index_change_effective": 7,
}
OTHER_PRIORITY, MAX_EVENTS = 8, 30


def priority(event_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EVENT_PRIORITY.items() for x in kv])
    return F.coalesce(table[event_type], F.lit(OTHER_PRIORITY))


def calendar(days: DataFrame, date: str = "date") -> DataFrame:
    """(date, ord) of distinct trading days. A calendar has 252 days a year, so one task orders it."""
    return days.select(F.col(date).alias("date")).where("date is not null").distinct().withColumn("ord", F.row_number().over(W.orderBy("date")))


def trading_windows(moves: DataFrame, days: DataFrame, before: int = 5, after: int = 1) -> DataFrame:
    """Adds window_start and window_end: so many trading days around the last one on or before the move, clipped at the ends.

    A move before the first trading day is anchored there; without any trading day both are null. The calendar
    is a bounded dimension (see ``calendar``): it becomes a row for each calendar day between its ends, 366 a
    year, which moves are joined to by date.
    """
    w = W.orderBy("date")
    ends = days.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))  # one row
    bounds = days.crossJoin(F.broadcast(ends)).select(
        "date",
        F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("date")).alias("_until"),
        F.coalesce(F.lag("date", before).over(w), F.col("_lo")).alias("window_start"),
        F.coalesce(F.lead("date", after).over(w), F.col("_hi")).alias("window_end"),
    )
    spans = bounds.select(F.explode(F.sequence("date", "_until")).alias("_day"), "window_start", "window_end")
    placed = moves.crossJoin(F.broadcast(ends)).withColumn("_day", F.least(F.greatest("move_date", "_lo"), F.col("_hi")))
    return placed.join(F.broadcast(spans), "_day", "left").drop("_day", "_lo", "_hi")


def business_day(date: Column, n: int) -> Column:
    """date moved by n weekdays (holidays unknown); from a weekend, the roll itself is the first step, forward for n = 0."""
    wd = F.weekday(date)
    if n == 0:
        return F.when(wd < 5, date).otherwise(F.date_add(date, 7 - wd))
    k = F.when(wd < 5, abs(n)).otherwise(abs(n) - 1)
    base = F.when(wd < 5, date).otherwise(F.date_sub(date, wd - 4) if n < 0 else F.date_add(date, 7 - wd))
    weeks, rest = F.floor(k / 5).cast("int") * 7, k % 5
    day = F.weekday(base)
    if n < 0:
        return F.date_sub(base, (weeks + rest + F.when(day - rest < 0, 2).otherwise(0)).cast("int"))
    return F.date_add(base, (weeks + rest + F.when(day + rest > 4, 2).otherwise(0)).cast("int"))


def window_join(moves: DataFrame, events: DataFrame, days: DataFrame, before: int = 5, after: int = 1, most: int | None = MAX_EVENTS) -> DataFrame:
    """Events of the move's ticker within its trading-day window, ranked by calendar distance, priority and id.

    moves: move_id, ticker, move_date. events: event_id, ticker, event_date, event_type. The window is
    exploded to its days, so the range becomes an equality on (ticker, date) and a busy ticker spreads over
    its dates. At most `most` rows per move are kept (the operator's cap; None keeps all).
    """
    span = trading_windows(moves, days, before, after)
    daily = span.withColumn("_day", F.explode(F.sequence("window_start", "window_end")))
    e = events.select(F.upper(F.col("ticker").cast("string")).alias("_t"), F.col("event_date").alias("_day"), "event_id", "event_type")
    joined = daily.withColumn("_t", F.upper(F.col("ticker").cast("string"))).join(e, ["_t", "_day"])
    distance = F.abs(F.datediff("_day", "move_date"))
    ranked = joined.withColumns({"distance": distance, "priority": priority(F.col("event_type"))})
    w = W.partitionBy("move_id").orderBy("distance", "priority", "event_id")
    ranked = ranked.withColumn("rank", F.row_number().over(w)).withColumnRenamed("_day", "event_date").drop("_t")
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def chunk_join(moves: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """Chunks of each move: those of its ticker dated in its window, and those its events refer to; each chunk_id once.

    moves: move_id, ticker, window_start, window_end. chunks: chunk_id, ticker, publication_date. refs:
    move_id, payload_ref.
    """
    daily = moves.withColumn("publication_date", F.explode(F.sequence("window_start", "window_end"))).select("move_id", "ticker", "publication_date")
    near = daily.join(chunks, ["ticker", "publication_date"]).select("move_id", "chunk_id", F.lit(0).alias("via"))
    named = refs.join(chunks.select("chunk_id"), refs["payload_ref"] == chunks["chunk_id"]).select("move_id", "chunk_id", F.lit(1).alias("via"))
    return near.unionByName(named).groupBy("move_id", "chunk_id").agg(F.min("via").alias("via"))


def nearest_dates(moves: DataFrame, dates: DataFrame) -> DataFrame:
    """Adds nearest: the ticker's date closest to move_date, the earlier of two; moves of tickers without dates go.

    moves: move_id, ticker, move_date. dates: ticker, other. Both are merged in one series per ticker, read
    forwards and backwards, so no move meets every date.
    """
    marks = dates.select("ticker", F.col("other").alias("_d"), F.col("other").alias("_o"), F.lit(0).alias("_m"))
    rows = moves.withColumns({"_d": F.col("move_date"), "_m": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    up = W.partitionBy("ticker").orderBy("_d", "_m").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("ticker").orderBy(F.desc("_d"), "_m").rowsBetween(W.unboundedPreceding, 0)
    both = rows.withColumns({"_a": F.last("_o", ignorenulls=True).over(up), "_b": F.last("_o", ignorenulls=True).over(down)}).where("_m = 1")
    later = F.datediff("_b", "move_date") < F.datediff("move_date", "_a")
    nearest = F.when(F.col("_a").isNull() | F.coalesce(later, F.lit(False)), F.col("_b")).otherwise(F.col("_a"))
    return both.withColumn("nearest", nearest).where("nearest is not null").drop("_d", "_o", "_m", "_a", "_b")


def flag_days(moves: DataFrame, calendar_rows: DataFrame, name: str = "earnings_day") -> DataFrame:
    """Adds whether (ticker, move_date) is in calendar_rows (ticker, date)."""
    marks = calendar_rows.select(F.upper(F.col("ticker").cast("string")).alias("_t"), F.col("date").alias("move_date")).distinct().withColumn("_m", F.lit(True))
    return moves.withColumn("_t", F.upper(F.col("ticker").cast("string"))).join(marks, ["_t", "move_date"], "left").withColumn(name, F.col("_m").isNotNull()).drop("_t", "_m")


def nested(joined: DataFrame) -> DataFrame:
    """One row per move with its ranked events as an array of structs."""
    events = F.array_sort(F.collect_list(F.struct("rank", "event_id", "event_type", "event_date")))
    return joined.groupBy("move_id", "ticker", "move_date", "window_start", "window_end").agg(events.alias("events"))
