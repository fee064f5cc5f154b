"""Scoring, ranking, capping and interleaving of text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.scoring import HALF_LIFE, OTHER_HALF_LIFE, alignment, lookup, recency, source_quality


def score(source: Column, publisher: Column, published: Column, move_date: Column, ticker: Column, move_ticker: Column) -> Column:
    return source_quality(source, publisher) * recency(source, published, move_date) * alignment(source, ticker, move_ticker)


def filter_and_rank(scored: DataFrame, key: str = "move_id", least: float = 0.02, small: int = 5, most: int = 50, share: float = 0.75, pool: str | None = None) -> DataFrame:
    """Per key by score: pools of up to `small` stay whole; else a share of them within bounds, without those below
    `least` but never under `small`. Adds rank. Ties go by chunk_id. pool: a column with the pool's size, where `scored` holds
    only what may be kept (``best_scored``)."""
    w = W.partitionBy(key)
    size = F.count(F.lit(1)).over(w) if pool is None else F.col(pool)
    ranked = scored.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "chunk_id")), "_n": size, "_good": F.count_if(F.col("score") >= least).over(w)})
    keep = F.least(F.lit(most), F.greatest(F.lit(small), F.bround(F.col("_n") * share).cast("int")))
    limit = F.when(F.col("_n") <= small, F.col("_n")).otherwise(F.least(keep, F.greatest(F.col("_good"), F.lit(small))))
    return ranked.where(F.col("rank") <= limit).drop("_n", "_good")


def best_scored(moves: DataFrame, chunks: DataFrame, most: int = 50, small: int = 5) -> DataFrame:
    """Each move with those chunks of its ticker that ``filter_and_rank`` could keep, their score, and pool (how many there are).

    moves: move_id, ticker, move_date; chunks: ticker, chunk_id (one row each), src, publisher, published, chunk_ticker.

    A score is a weight that halves every half-life, so among chunks of one half-life that are out by then, the order is
    that of log2(weight) + day / half-life, whatever the move's date. So a month's `most` best of a ticker and half-life are
    all that a later month needs of it: the best of all earlier months (a row set bounded by the calendar) and the chunks of
    the move's own month meet the move, and no others. A move with fewer than `small` chunks of a positive score takes
    the least chunk_ids of the rest, which are among the ticker's 2 * small - 1 least.
    """
    weight = source_quality(F.col("src"), F.col("publisher")) * alignment(F.col("src"), F.col("chunk_ticker"), F.col("ticker").cast("string"))
    half = lookup(HALF_LIFE, F.col("src"), OTHER_HALF_LIFE)
    month = lambda c: F.trunc(c, "month")
    keyed = chunks.withColumns({"_half": half, "_m": month("published")}).withColumn("_key", F.log2(weight) + F.datediff("published", F.lit("1970-01-01").cast("date")) / F.col("_half"))
    first = lambda df, k, by, *order: df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")
    best = [F.desc("_key"), F.col("chunk_id")]
    dated = moves.withColumn("_mm", month("move_date"))
    # earlier months: the best of each, then of all before a month that has moves
    monthly = first(keyed, most, ("ticker", "_half", "_m"), *best)
    carried = first(monthly.join(dated.select("ticker", "_mm").distinct(), "ticker").where("_m < _mm"), most, ("ticker", "_half", "_mm"), *best)
    earlier = dated.join(carried.drop("_m"), ["ticker", "_mm"])
    same = dated.join(keyed.withColumnRenamed("_m", "_mm"), ["ticker", "_mm"]).where("published <= move_date")
    fill = first(first(keyed, 2 * small - 1, ("ticker", "_half", "_m"), "chunk_id"), 2 * small - 1, ("ticker",), "chunk_id")
    rest = dated.join(fill.drop("_m"), "ticker")
    pairs = earlier.unionByName(same).unionByName(rest).dropDuplicates(["move_id", "chunk_id"]).drop("_half", "_key", "_mm")
    counted = chunks.groupBy("ticker").agg(F.count(F.lit(1)).alias("pool"))
    s = score(F.col("src"), F.col("publisher"), F.col("published"), F.col("move_date"), F.col("chunk_ticker"), F.col("ticker").cast("string"))
    return pairs.join(counted, "ticker").withColumn("score", F.round(s, 9))


def interleave(chunks: DataFrame, key: str, source: str, date: str, id_: str, stream: str | None = None) -> DataFrame:
    """Adds place: recent first within a source, then one of each source in turn, sources in order of their stream (if given) and name."""
    inner = W.partitionBy(key, source).orderBy(F.desc(date), id_)
    turn = chunks.withColumn("_turn", F.row_number().over(inner))
    return turn.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("_turn", *([stream] if stream else []), source))).drop("_turn")


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def dedupe_present(rows: DataFrame, key: str, order: list) -> DataFrame:
    """First wins by a key that may be null; rows without it all stay."""
    return first_wins(rows.where(F.col(key).isNotNull()), [key], order).unionByName(rows.where(F.col(key).isNull()))


def override(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which rows of `over` replace those of `base` with the same keys."""
    return base.join(over.select(*keys).distinct(), keys, "left_anti").unionByName(over)


def prefix_or_cited(ranked: DataFrame, most: int = 10) -> DataFrame:
    return ranked.where((F.col("rank") <= most) | F.col("cited"))
