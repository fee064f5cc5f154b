"""Streaming forms: the same rules over unbounded input, in event time, with bounded state for each key.

Rows wait in their key's state until the watermark has passed them, and are then taken in order of time, so rows that come
late within the delay give the batch's answer. An event-time timer wakes a key whose rows are due; one without rows for
`expire` is dropped. Rows later than the delay are left out, and of a key's rows of one time the first that came counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOVES = "ticker long, move_date timestamp, return_pct double, vol_zscore double, magnitude_rank double"
SPIKES = "ticker long, ts timestamp, prior double, value double"
DAY_MS = 86_400_000
#: What is known of a key: the last value, earlier returns, the time up to which rows are taken; and rows that wait.
STATE = "last double, returns array<double>, taken long, ts array<long>, value array<double>"

Fold = Callable[[float | None, list[float], float], tuple[list[float], tuple | None]]


def _in_order(rows: DataFrame, value: str, schema: str, fold: Fold, delay: str, expire_days: int) -> DataFrame:
    """fold(last value, returns, value): the returns to keep, and what to put out behind ticker and time, if anything."""
    names = [c.split()[0] for c in schema.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, returns, taken, ts, values = state.get if state.exists else (None, [], -(2**62), [], [])
        waiting = dict(zip(ts, values, strict=True))
        returns, out = list(returns), []
        if not state.hasTimedOut:
            for batch in batches:
                for t, v in zip(batch["ts"].astype("datetime64[us]").astype("int64"), batch[value], strict=True):
                    if t > taken:
                        waiting.setdefault(int(t), float(v))
        mark = state.getCurrentWatermarkMs()
        for t in sorted(waiting):
            if t > mark * 1000:
                break
            v = waiting.pop(t)
            returns, found = fold(last, returns, v)
            if found is not None:
                out.append((key[0], pd.Timestamp(t, unit="us"), *found))
            last, taken = v, t
        due = min(waiting) // 1000 if waiting else max(taken // 1000, 0) + expire_days * DAY_MS
        if not waiting and due <= mark:
            state.remove()
        else:
            state.update((last, returns, taken, sorted(waiting), [waiting[t] for t in sorted(waiting)]))
            state.setTimeoutTimestamp(max(due, mark + 1))
        yield pd.DataFrame(out, columns=names)

    return rows.withWatermark("ts", delay).groupBy("ticker").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def detect_moves(bars: DataFrame, lookback_vol: int = 30, lookback_rank: int = 60, vol_mult: float = 2.0, least_rank: float = 0.95, delay: str = "3 days", expire_days: int = 400) -> DataFrame:
    """Significant moves of a stream of bars (ticker, ts, close), as ``operators.panel.significant_moves`` finds them in a table."""

    def fold(last: float | None, returns: list[float], close: float) -> tuple[list[float], tuple | None]:
        if last is None or last == 0:
            return returns, None
        r = close / last - 1
        recent = returns[-lookback_vol:]
        vol = float(pd.Series(recent).std()) if len(recent) == lookback_vol else math.nan
        rank = sum(abs(x) < abs(r) for x in returns) / lookback_rank if len(returns) == lookback_rank else None
        flagged = (vol > 0 and abs(r) > vol_mult * vol) or (rank is not None and rank >= least_rank)
        return [*returns, r][-lookback_rank:], ((r, r / vol if vol > 0 else 0.0, rank) if flagged else None)

    return _in_order(bars, "close", MOVES, fold, delay, expire_days)


def spikes(rows: DataFrame, over: float = 0.20, delay: str = "3 days", expire_days: int = 400) -> DataFrame:
    """Growth of more than `over` against the key's value before. rows: ticker, ts, value."""

    def fold(last: float | None, returns: list[float], value: float) -> tuple[list[float], tuple | None]:
        return [], ((last, value) if last is not None and last > 0 and (value - last) / last > over else None)

    return _in_order(rows, "value", SPIKES, fold, delay, expire_days)


def dedupe(articles: DataFrame, keys: list[str], ts: str = "ts", delay: str = "14 days") -> DataFrame:
    """The first of each key within the watermark."""
    return articles.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def as_of(events: DataFrame, ts: str = "ts", lag: str = "14 days", window: str = "1 day") -> DataFrame:
    """Counts and sums per ticker and window, final once the publication lag has passed."""
    return events.withWatermark(ts, lag).groupBy(F.window(ts, window), "ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
