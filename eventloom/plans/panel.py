"""Queries over the panel: returns, deviations, adjustments, ranges, reactions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators import panel as P
from eventloom.operators import reactions as R
from eventloom.operators.quantiles import exact_quantiles
from eventloom.plans.base import DATED, DIVIDENDS, PANEL, SECTOR, SPLITS, Registry, dated_events, dividends, panel, r6, rounded, sector_of, splits, price_sql, table, with_
from eventloom.sources.staging import staged

REG = Registry()

RETS = "rets AS (SELECT *, close / lag(close) OVER w - 1 AS ret, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS lr, row_number() OVER w - 1 AS ord FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date))"


@REG.add("F01_simple_return", with_(PANEL, RETS) + "SELECT ticker, date, round(ret, 6) + 0.0 AS ret FROM rets")
def f01(spark, d):
    return panel(spark, d).select("ticker", "date", r6(P.simple_return()).alias("ret"))


@REG.add("F02_log_return", with_(PANEL, RETS) + "SELECT ticker, date, round(lr, 6) + 0.0 AS log_return FROM rets")
def f02(spark, d):
    return panel(spark, d).select("ticker", "date", r6(P.log_return()).alias("log_return"))


VOL = "CASE WHEN count(ret) OVER v30 = 30 THEN stddev_samp(ret) OVER v30 END"
RANK = "CASE WHEN len(list(abs(ret)) FILTER (WHERE ret IS NOT NULL) OVER v60) = 60 THEN len(list_filter(list(abs(ret)) FILTER (WHERE ret IS NOT NULL) OVER v60, lambda x: x < abs(ret))) / 60.0 END"
FRAMES = "WINDOW v30 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), v60 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
BEFORE = f"before AS (SELECT ticker, date, ret, {VOL} AS vol, list(abs(ret)) FILTER (WHERE ret IS NOT NULL) OVER v60 AS prior FROM rets {FRAMES})"
MEASURED = "measured AS (SELECT ticker, date, ret, vol, CASE WHEN len(prior) = 60 THEN len(list_filter(prior, lambda x: x < abs(ret))) / 60.0::double END AS rank FROM before)"
SIGNIFICANT = "significant AS (SELECT ticker, date AS move_date, ret AS return_pct, CASE WHEN vol > 0 THEN ret / vol ELSE 0.0 END AS vol_zscore, rank AS magnitude_rank FROM measured WHERE ret IS NOT NULL AND (coalesce(vol > 0 AND abs(ret) > 2.0 * vol, false) OR coalesce(rank >= 0.95, false)))"
F05 = with_(PANEL, RETS, BEFORE, MEASURED, SIGNIFICANT)


@REG.add("F03_trailing_vol", with_(PANEL, RETS, BEFORE) + "SELECT ticker, date, round(vol, 6) + 0.0 AS vol FROM before")
def f03(spark, d):
    return panel(spark, d).withColumn("ret", P.simple_return()).select("ticker", "date", r6(P.trailing_vol("ret", 30)).alias("vol"))


@REG.add("F04_trailing_rank", with_(PANEL, RETS, BEFORE, MEASURED) + "SELECT ticker, date, round(rank, 6) + 0.0 AS rank FROM measured")
def f04(spark, d):
    return panel(spark, d).withColumn("ret", P.simple_return()).select("ticker", "date", r6(P.trailing_rank("ret", 60)).alias("rank"))


@REG.add("F05_significant_moves", F05 + "SELECT ticker, move_date, round(return_pct, 6) + 0.0 AS return_pct, round(vol_zscore, 6) + 0.0 AS vol_zscore, round(magnitude_rank, 6) + 0.0 AS magnitude_rank, true AS is_significant FROM significant")
def f05(spark, d):
    return rounded(P.significant_moves(panel(spark, d)), "return_pct", "vol_zscore", "magnitude_rank")


@REG.add("F06_annualised_vol", with_(PANEL, RETS) + "SELECT ticker, round(CASE WHEN count(ret) = 30 THEN stddev_samp(ret) * sqrt(252) END, 6) + 0.0 AS vol FROM (SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM rets WHERE ret IS NOT NULL) WHERE k <= 30 GROUP BY ticker")
def f06(spark, d):
    return rounded(P.annualised_vol(panel(spark, d)), "vol")


@REG.add(
    "F07_volume_zscore",
    with_(PANEL)
    + "SELECT ticker, date, round(CASE WHEN n = 20 THEN CASE WHEN dev > 0 THEN (volume - mean) / dev ELSE 0.0 END END, 6) + 0.0 AS z FROM (SELECT ticker, date, volume, count(volume) OVER w AS n, avg(volume) OVER w AS mean, stddev_samp(volume) OVER w AS dev FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))",
)
def f07(spark, d):
    return panel(spark, d).select("ticker", "date", r6(P.volume_zscore(20)).alias("z"))


@REG.add("F08_next_n_day_return", with_(PANEL) + "SELECT ticker, date, round(lead(close, 5) OVER w / lead(close, 1) OVER w - 1, 6) + 0.0 AS ret FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def f08(spark, d):
    return panel(spark, d).select("ticker", "date", r6(P.next_n_day_return("close", 5)).alias("ret"))


@REG.add(
    "F09_dividend_adjust",
    with_(PANEL, DIVIDENDS)
    + f""", f AS (SELECT p.ticker, p.date, close, CASE WHEN amount > 0 AND amount < close THEN (close - amount) / close ELSE 1.0 END AS factor FROM panel p LEFT JOIN dividends d ON p.ticker = d.ticker AND p.date = d.date)
SELECT ticker, date, {price_sql("close * coalesce(product(factor) OVER (PARTITION BY ticker ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0)")} AS adj_close FROM f""",
)
def f09(spark, d):
    return P.adjust_dividends(panel(spark, d), dividends(spark, d)).select("ticker", "date", "adj_close")


@REG.add(
    "F10_split_adjust",
    with_(PANEL, SPLITS)
    + f"""SELECT p.ticker, p.date, {price_sql("p.close * coalesce((SELECT product(split_part(split_factor, ':', 2)::double / split_part(split_factor, ':', 1)::double) FROM splits s WHERE s.ticker = p.ticker AND s.date > p.date), 1.0)")} AS close, p.volume FROM panel p""",
)
def f10(spark, d):
    return P.adjust_splits(panel(spark, d), splits(spark, d)).select("ticker", "date", P.to_places(F.col("close"), 4).alias("close"), "volume")


FWD = "bars AS (SELECT *, lag(close) OVER w AS prev, " + ", ".join(f"CASE WHEN close > 0 AND lead(close, {h}) OVER w > 0 THEN lead(close, {h}) OVER w / close - 1 END AS fwd_{h}d" for h in (1, 5, 20)) + ", " + ", ".join(f"CASE WHEN ord >= {n} THEN stddev_samp(lr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS vol_{n}d" for n in (30, 60)) + " FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date))"


@REG.add("F11_forward_returns", with_(PANEL, RETS, FWD) + "SELECT ticker, date, round(fwd_1d, 6) + 0.0 AS fwd_1d, round(fwd_5d, 6) + 0.0 AS fwd_5d, round(fwd_20d, 6) + 0.0 AS fwd_20d FROM bars")
def f11(spark, d):
    return rounded(R.with_bars(panel(spark, d)).select("ticker", "date", "fwd_1d", "fwd_5d", "fwd_20d"), "fwd_1d", "fwd_5d", "fwd_20d")


PLACED = "placed AS (SELECT e.*, b.ord AS bar_ord, b.date AS bar_date FROM dated e ASOF JOIN bars b ON e.ticker = b.ticker AND e.event_date <= b.date)"
REACT = "react AS (SELECT p.event_id, p.ticker, p.event_date, p.session, b.date AS anchor_date, b.prev AS pre_price, CASE WHEN b.prev > 0 THEN b.close / b.prev - 1 END AS reaction_return, fwd_1d, fwd_5d, fwd_20d, vol_30d, vol_60d FROM placed p JOIN bars b ON b.ticker = p.ticker AND b.ord = p.bar_ord + CASE WHEN p.session = 'AMC' AND p.event_date = p.bar_date THEN 1 ELSE 0 END WHERE b.prev > 0)"
REACTIONS = with_(PANEL, RETS, FWD, DATED, PLACED, REACT)


@REG.add("D09_first_bar_on_or_after", with_(PANEL, RETS, FWD, DATED) + "SELECT e.event_id, e.ticker, e.event_date, b.ord AS bar_ord, coalesce(b.date = e.event_date, false) AS is_bar FROM dated e ASOF LEFT JOIN bars b ON e.ticker = b.ticker AND e.event_date <= b.date")
def d09(spark, d):
    bars = panel(spark, d).select("ticker", "date", P.bar_ordinal().alias("ord"))
    return P.first_bar_on_or_after(dated_events(spark, d), bars).select("event_id", "ticker", "event_date", F.col("bar_ord").cast("long").alias("bar_ord"), "is_bar")


ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("reaction_return", "fwd_1d", "fwd_5d", "fwd_20d", "vol_30d", "vol_60d"))


@REG.add("F12_F13_reactions", REACTIONS + f"SELECT event_id, ticker, event_date, session, anchor_date, {price_sql('pre_price')} AS pre_price, {ROUNDED} FROM react")
def f12(spark, d):
    return rounded(R.reactions(dated_events(spark, d), panel(spark, d)).withColumn("pre_price", P.to_places(F.col("pre_price"), 4)), "reaction_return", "fwd_1d", "fwd_5d", "fwd_20d", "vol_30d", "vol_60d")


INDEX = "daily AS (SELECT sector, date, avg(greatest(-0.5, least(0.5, lr))) FILTER (lr IS NOT NULL) AS mean_return FROM rets JOIN sector USING (ticker) GROUP BY 1, 2), idx AS (SELECT sector, date, mean_return, exp(sum(coalesce(mean_return, 0.0)) OVER (PARTITION BY sector ORDER BY date)) AS level FROM daily)"


def _sector_returns(spark, d):
    # the sectors' table has a row per supplier and no bound, so the join is left to statistics
    return panel(spark, d).withColumn("log_return", P.log_return()).join(sector_of(spark, d), "ticker")


@REG.add("E02_F14_sector_index", with_(PANEL, RETS, SECTOR, INDEX) + "SELECT sector, date, round(mean_return, 6) + 0.0 AS mean_return, round(level, 6) + 0.0 AS level FROM idx")
def f14(spark, d):
    return rounded(P.synthetic_index(_sector_returns(spark, d), "sector"), "mean_return", "level")


BENCH = "mkt AS (SELECT date, avg(greatest(-0.5, least(0.5, lr))) FILTER (lr IS NOT NULL) AS m FROM rets GROUP BY 1), lvl AS (SELECT date, exp(sum(coalesce(m, 0.0)) OVER (ORDER BY date)) AS level FROM mkt), bench AS (SELECT date, " + ", ".join(f"lead(level, {h}) OVER (ORDER BY date) / level - 1 AS b{h}" for h in (1, 5, 20)) + " FROM lvl)"


def benchmark(spark, d):
    """The equally weighted market's forward returns by date."""
    level = P.synthetic_index(panel(spark, d).withColumn("log_return", P.log_return()).withColumn("all", F.lit("all")), "all")
    w = W.partitionBy("all").orderBy("date")  # one row a trading day
    return level.select("date", *(P.forward_return("level", h, w).alias(f"fwd_{h}d") for h in (1, 5, 20)))


@REG.add("F15_D10_excess_returns", REACTIONS.rstrip() + ", " + BENCH + " SELECT event_id, anchor_date, round(fwd_1d - b1, 6) + 0.0 AS fwd_1d_excess, round(fwd_5d - b5, 6) + 0.0 AS fwd_5d_excess, round(fwd_20d - b20, 6) + 0.0 AS fwd_20d_excess FROM react LEFT JOIN bench ON anchor_date = date")
def f15(spark, d):
    rows = R.excess(R.reactions(dated_events(spark, d), panel(spark, d)), benchmark(spark, d))
    return rounded(rows.select("event_id", "anchor_date", "fwd_1d_excess", "fwd_5d_excess", "fwd_20d_excess"), "fwd_1d_excess", "fwd_5d_excess", "fwd_20d_excess")


SECT = "sidx AS (SELECT sector, date, exp(sum(coalesce(mean_return, 0.0)) OVER (PARTITION BY sector ORDER BY date)) AS level FROM daily), sfwd AS (SELECT sector, date, lead(level, 5) OVER (PARTITION BY sector ORDER BY date) / level - 1 AS s5 FROM sidx)"


@REG.add(
    "D11_benchmark_fallback",
    REACTIONS.rstrip() + ", " + SECTOR + ", " + INDEX.split(", idx AS")[0] + ", " + SECT + ", " + BENCH
    + " SELECT event_id, sector, round(coalesce(CASE WHEN sector <> 'ASIA' THEN b5 END, s5), 6) + 0.0 AS bench_5d, round(fwd_5d - coalesce(CASE WHEN sector <> 'ASIA' THEN b5 END, s5), 6) + 0.0 AS fwd_5d_excess FROM react JOIN sector USING (ticker) LEFT JOIN bench b ON b.date = anchor_date LEFT JOIN sfwd s USING (sector) WHERE s.date = anchor_date",
)
def d11(spark, d):
    """A sector without a listed fund (here: ASIA) takes its synthetic index.

    The panel is measured once and written with its sectors; events are placed in it, and the market's and the sectors' mean
    returns come from one sum by sector and date.
    """
    bars = staged(R.with_bars(panel(spark, d)).join(sector_of(spark, d), "ticker"), "bars")
    rows = R.place(dated_events(spark, d), bars, keep=("sector",))
    lr = F.col("log_return")
    clipped = F.when(lr.isNotNull(), F.greatest(F.lit(-0.5), F.least(F.lit(0.5), lr)))
    daily = bars.groupBy("sector", "date").agg(F.sum(clipped).alias("s"), F.count(lr).alias("n"))
    by_date = W.partitionBy("date")  # a row a sector
    market = F.try_divide(F.sum("s").over(by_date), F.sum("n").over(by_date))
    steps = daily.withColumns({"mine": F.try_divide(F.col("s"), F.col("n")), "all": market})
    one = W.partitionBy("sector").orderBy("date")  # a row a trading day
    level = lambda c: F.exp(F.sum(F.coalesce(c, F.lit(0.0))).over(one.rowsBetween(W.unboundedPreceding, 0)))
    own = steps.withColumn("level", level("mine")).withColumn("s5", P.forward_return("level", 5, one))
    listed = own.groupBy("date").agg(F.max("all").alias("all")).withColumn("k", F.lit(1))
    day = W.partitionBy("k").orderBy("date")  # a row a trading day
    listed = listed.withColumn("level", F.exp(F.sum(F.coalesce("all", F.lit(0.0))).over(day.rowsBetween(W.unboundedPreceding, 0)))).select(F.col("date").alias("anchor_date"), P.forward_return("level", 5, day).alias("b5"))
    bench = F.coalesce(F.when(F.col("sector") != "ASIA", F.col("b5")), F.col("s5"))
    out = rows.join(listed, "anchor_date", "left").join(own.select("sector", F.col("date").alias("anchor_date"), "s5"), ["sector", "anchor_date"], "left")
    return out.select("event_id", "sector", r6(bench).alias("bench_5d"), r6(F.col("fwd_5d") - bench).alias("fwd_5d_excess"))


@REG.add("F16_history_filter", with_(PANEL, RETS, FWD, DATED, PLACED) + "SELECT event_id, p.ticker, event_date FROM placed p JOIN (SELECT ticker, count(*) AS n FROM panel GROUP BY 1) USING (ticker) WHERE bar_ord >= 60 AND n - bar_ord >= 20")
def f16(spark, d):
    bars = panel(spark, d).select("ticker", "date", P.bar_ordinal().alias("ord"))
    return R.history_filter(dated_events(spark, d), bars).select("event_id", "ticker", "event_date")


@REG.add("F17_spikes", with_(PANEL) + "SELECT ticker, date, volume, prior, round(change, 6) + 0.0 AS change FROM (SELECT *, CASE WHEN prior > 0 THEN (volume - prior)::double / prior END AS change FROM (SELECT ticker, date, volume, lag(volume) OVER (PARTITION BY ticker ORDER BY date) AS prior FROM panel)) WHERE change > 0.20")
def f17(spark, d):
    return rounded(P.period_spikes(panel(spark, d), "volume").select("ticker", "date", "volume", "prior", "change"), "change")


@REG.add("F22_E03_gap_summary", with_(PANEL) + "SELECT ticker, count(*) AS n_gaps, max(gap)::int AS max_gap FROM (SELECT ticker, date_diff('day', lag(date) OVER (PARTITION BY ticker ORDER BY date), date) AS gap FROM panel) WHERE gap > 7 GROUP BY 1 ORDER BY n_gaps DESC, ticker LIMIT 20")
def e03(spark, d):
    return P.gap_summary(panel(spark, d))


@REG.add("E04_date_ranges", with_(PANEL) + "SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n_bars, max(date) < (SELECT max(date) FROM panel) - 90 AS ended FROM panel GROUP BY 1")
def e04(spark, d):
    return P.date_ranges(panel(spark, d))


@REG.add("D18_forward_by_ordinal", with_(PANEL) + "SELECT ticker, date, round(ahead / close - 1, 6) + 0.0 AS fwd FROM (SELECT *, lead(close, 10) OVER (PARTITION BY ticker ORDER BY date) AS ahead FROM panel) WHERE ahead IS NOT NULL")
def d18(spark, d):
    return panel(spark, d).select("ticker", "date", r6(P.forward_return("close", 10)).alias("fwd")).where("fwd is not null")


@REG.add(
    "F23_predicted_overlay",
    F05.rstrip() + f""", marked AS (SELECT p.ticker, p.date, close, CASE WHEN s.return_pct IS NOT NULL THEN (1 + s.return_pct / 2) / (1 + s.return_pct) END AS step FROM panel p LEFT JOIN significant s ON p.ticker = s.ticker AND p.date = s.move_date)
SELECT ticker, date, {price_sql("close * CASE WHEN count(step) OVER w > 0 THEN product(coalesce(step, 1.0)) OVER w END", 2)} AS predicted FROM marked WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def f23(spark, d):
    bars = panel(spark, d)
    found = P.significant_moves(bars).select("ticker", F.col("move_date").alias("date"), (F.col("return_pct") / 2).alias("predicted_return"), F.col("return_pct").alias("realized_return"))
    return P.predicted_overlay(bars.join(found, ["ticker", "date"], "left")).select("ticker", "date", P.to_places(F.col("predicted"), 2).alias("predicted"))


@REG.add("G06_top_moves", F05 + "SELECT ticker, move_date, round(return_pct, 6) + 0.0 AS return_pct FROM significant ORDER BY abs(return_pct) DESC, ticker, move_date LIMIT 20")
def g06(spark, d):
    return rounded(P.significant_moves(panel(spark, d)).orderBy(F.abs("return_pct").desc(), "ticker", "move_date").limit(20).select("ticker", "move_date", "return_pct"), "return_pct")


@REG.add("C10_C11_events_master", REACTIONS + "SELECT ticker || '_' || strftime(event_date, '%Y%m%d') AS event_id, event_date AS earnings_date, round(reaction_return, 6) + 0.0 AS reaction_return, round(CASE WHEN vol_30d <> 0 THEN reaction_return / vol_30d END, 6) + 0.0 AS reaction_return_zscore, coalesce(abs(reaction_return / nullif(vol_30d, 0)) > 2.5 AND abs(reaction_return) > 0.05, false) AS is_significant FROM react")
def c11(spark, d):
    rows = R.reactions(dated_events(spark, d), panel(spark, d))
    z, flag = R.significance(F.col("reaction_return"), F.col("vol_30d"))
    return rows.select(F.concat_ws("_", F.col("ticker").cast("string"), F.date_format("event_date", "yyyyMMdd")).alias("event_id"), F.col("event_date").alias("earnings_date"), r6("reaction_return").alias("reaction_return"), r6(z).alias("reaction_return_zscore"), flag.alias("is_significant"))


FOCAL = "(ticker % 10 < 5 AND abs(reaction_return) <= 0.5 AND vol_30d >= 1e-4 AND vol_30d IS NOT NULL)"


@REG.add("C06_focal_filter", REACTIONS + f"SELECT event_id, ticker, round(reaction_return, 6) + 0.0 AS reaction_return, 'company ' || (ticker % 10) AS focal_company FROM react WHERE {FOCAL}")
def c06(spark, d):
    rows = R.reactions(dated_events(spark, d), panel(spark, d)).where("ticker % 10 < 5 and abs(reaction_return) <= 0.5 and vol_30d >= 1e-4")
    return rows.select("event_id", "ticker", r6("reaction_return").alias("reaction_return"), F.concat(F.lit("company "), (F.col("ticker") % 10).cast("string")).alias("focal_company"))


@REG.add("E06_focal_rollup", REACTIONS.rstrip() + ", " + SECTOR + f" SELECT sector, session, count(*) AS n, count(DISTINCT ticker) AS n_tickers, sum(CASE WHEN {FOCAL} THEN 1 ELSE 0 END)::bigint AS n_focal FROM react JOIN sector USING (ticker) GROUP BY 1, 2")
def e06(spark, d):
    focal = F.expr("ticker % 10 < 5 and abs(reaction_return) <= 0.5 and vol_30d >= 1e-4")
    rows = R.reactions(dated_events(spark, d), panel(spark, d)).join(sector_of(spark, d), "ticker")
    return rows.groupBy("sector", "session").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("n_tickers"), F.count_if(focal).alias("n_focal"))


@REG.add("E07_describe", REACTIONS + "SELECT session, count(reaction_return) AS n, round(avg(reaction_return), 6) + 0.0 AS mean, round(stddev_samp(reaction_return), 6) + 0.0 AS std, round(min(reaction_return), 6) + 0.0 AS min, round(quantile_cont(reaction_return, 0.25), 6) + 0.0 AS p25, round(quantile_cont(reaction_return, 0.5), 6) + 0.0 AS p50, round(quantile_cont(reaction_return, 0.75), 6) + 0.0 AS p75, round(max(reaction_return), 6) + 0.0 AS max FROM react GROUP BY 1")
def e07(spark, d):
    """Quantiles are selected by rank over all tasks; the other figures are sums and extremes."""
    c = F.col("reaction_return")
    rows = staged(R.reactions(dated_events(spark, d), panel(spark, d)).select("session", "reaction_return"), "reactions")
    found = exact_quantiles(rows, "reaction_return", (0.25, 0.5, 0.75), "session")
    middle = spark.createDataFrame([(k, *v) for k, v in found.items()], "session string, p25 double, p50 double, p75 double")
    figures = rows.groupBy("session").agg(F.count(c).alias("n"), r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("std"), r6(F.min(c)).alias("min"), r6(F.max(c)).alias("max"))
    return rounded(figures.join(F.broadcast(middle), "session", "left"), "p25", "p50", "p75")  # a row a session


@REG.add("E08_null_coverage", REACTIONS + "SELECT round(100.0 * count(fwd_1d) / count(*), 6) AS fwd_1d, round(100.0 * count(fwd_5d) / count(*), 6) AS fwd_5d, round(100.0 * count(fwd_20d) / count(*), 6) AS fwd_20d, round(100.0 * count(vol_60d) / count(*), 6) AS vol_60d FROM react")
def e08(spark, d):
    return R.reactions(dated_events(spark, d), panel(spark, d)).agg(*(F.round(100.0 * F.count(c) / F.count(F.lit(1)), 6).alias(c) for c in ("fwd_1d", "fwd_5d", "fwd_20d", "vol_60d")))


@REG.add("E11_sanity_stats", REACTIONS + "SELECT round(avg(fwd_5d), 6) + 0.0 AS mean, round(quantile_cont(fwd_5d, 0.5), 6) + 0.0 AS median, round(avg(CASE WHEN fwd_5d > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, abs(avg(fwd_5d)) < 0.01 AS symmetric FROM react WHERE abs(fwd_5d) <= 0.5")
def e11(spark, d):
    rows = staged(R.reactions(dated_events(spark, d), panel(spark, d)).where("abs(fwd_5d) <= 0.5").select("fwd_5d"), "forward")
    median = exact_quantiles(rows, "fwd_5d", (0.5,)).get(0, [None])[0]
    return rows.agg(r6(F.avg("fwd_5d")).alias("mean"), r6(F.lit(median).cast("double")).alias("median"), r6(F.avg(F.when(F.col("fwd_5d") > 0, 1.0).otherwise(0.0))).alias("positive"), (F.abs(F.avg("fwd_5d")) < 0.01).alias("symmetric"))


@REG.add("C07_C04_slim_slice", REACTIONS + ", span AS (SELECT min(event_date) - 120 AS lo, max(event_date) + 45 AS hi FROM react WHERE ticker % 10 < 5) SELECT p.ticker, p.date, CLOSE_ FROM panel p, span WHERE p.ticker IN (SELECT ticker FROM react WHERE ticker % 10 < 5) AND p.date BETWEEN lo AND hi AND close > 0".replace("CLOSE_", price_sql("p.close") + " AS close"))
def c07(spark, d):
    events = R.reactions(dated_events(spark, d), panel(spark, d)).where("ticker % 10 < 5")
    span = events.agg(F.date_sub(F.min("event_date"), 120).alias("lo"), F.date_add(F.max("event_date"), 45).alias("hi"))
    rows = panel(spark, d).where("close > 0").join(events.select("ticker").distinct(), "ticker", "left_semi")
    return rows.join(F.broadcast(span), F.col("date").between(F.col("lo"), F.col("hi"))).select("ticker", "date", P.to_places(F.col("close"), 4).alias("close"))  # one row


@REG.add("E20_first_dates", with_(DATED) + "SELECT ticker, min(event_date) AS first_event FROM dated GROUP BY 1")
def e20(spark, d):
    return dated_events(spark, d).groupBy("ticker").agg(F.min("event_date").alias("first_event"))


BASKET = "SELECT ticker, date, close FROM panel WHERE ticker IN (1, 2, 3, 4)"


@REG.add(
    "K27_F19_basket",
    with_(PANEL)
    + """, days AS (SELECT DISTINCT date FROM panel WHERE ticker IN (1, 2, 3, 4)), grid AS (SELECT ticker, date FROM days, (SELECT unnest([1, 2, 3, 4]) AS ticker)),
filled AS (SELECT g.ticker, g.date, last_value(close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date) AS close FROM grid g LEFT JOIN panel p ON p.ticker = g.ticker AND p.date = g.date),
steps AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM filled),
port AS (SELECT date, sum(coalesce(ret, 0.0) * CASE WHEN ticker IN (1, 2) THEN 0.5 ELSE -0.5 END) AS ret FROM steps GROUP BY 1),
curve AS (SELECT date, ret, product(1 + ret) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM port)
SELECT count(*) AS n_days, round(ln(abs(last(equity ORDER BY date))), 4) + 0.0 AS log_equity, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) + 0.0 AS sharpe FROM curve""",
)
def k27(spark, d):
    from eventloom.operators.backtest import basket

    daily = basket(panel(spark, d), longs=[1, 2], shorts=[3, 4])
    return daily.agg(F.count(F.lit(1)).alias("n_days"), r6(F.round(F.log(F.abs(F.max_by("equity", "date"))), 4)).alias("log_equity"), r6(F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("sharpe"))


@REG.add("A03_A04_price_load", "SELECT l_suppkey::varchar AS ticker, l_shipdate::date AS date, round(l_extendedprice, 2) AS close FROM lineitem WHERE l_suppkey IN (3, 5) AND l_shipdate <= timestamp '1998-06-30'")
def a03(spark, d):
    from eventloom.sources.readers import load_panel

    raw = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("report_date"), F.col("l_extendedprice").cast("decimal(38,2)").alias("close"))
    return load_panel(raw, ["3", "5"], "1998-06-30").select("ticker", "date", F.round("close", 2).alias("close"))


CHECKS = {
    "price is positive": "pre_price > 0",
    "anchor is not before the event": "anchor_date >= event_date",
    "anchor is within a week": "date_diff('day', event_date, anchor_date) <= 7",
    "reaction is within half": "abs(reaction_return) <= 0.5",
    "forward return is within half": "abs(fwd_5d) <= 0.5",
    "forward return is known": "fwd_20d IS NOT NULL",
    "deviation is known": "vol_60d IS NOT NULL",
    "session is of the market": "session IN ('BMO', 'AMC')",
    "reaction is down": "reaction_return <= 0",
}


@REG.add("K41_audit_pass", REACTIONS + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count({x}) AS n, count(*) FILTER (NOT ({x})) AS failed, round(count(*) FILTER (NOT ({x})) / count({x}), 6) AS share, min(event_id) FILTER (NOT ({x})) AS sample FROM react" for k, x in CHECKS.items()))
def k41p(spark, d):
    """All checks of the reactions in one pass over them."""
    from eventloom.operators.audit import expectations

    c = {k: F.expr(x.replace("date_diff('day', event_date, anchor_date)", "datediff(anchor_date, event_date)")) for k, x in CHECKS.items()}
    return rounded(expectations(R.reactions(dated_events(spark, d), panel(spark, d)), c, "event_id"), "share")
