"""Trades, profit and loss, and summaries of strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HORIZONS = (1, 5, 20)


def direction(action: Column, realised: Column) -> Column:
    """lean follows the move's sign, fade goes against it, neutral is 0."""
    return F.when(action == "lean", F.signum(realised)).when(action == "fade", -F.signum(realised)).otherwise(0.0).cast("int")


def profit(trades: DataFrame, events: DataFrame, horizon: int = 5, use_excess: bool = False) -> DataFrame:
    """trades (event_id, direction, size, ...) with the event's forward return and pnl; events without one go."""
    if horizon not in HORIZONS:
        raise ValueError(f"horizon {horizon} is none of {HORIZONS}")
    name = f"fwd_{horizon}d" + ("_excess" if use_excess else "")
    known = events.where(F.col(name).isNotNull()).select("event_id", F.col(name).alias("realized_fwd_return"))
    return trades.join(known, "event_id").withColumn("pnl", F.col("direction") * F.col("size") * F.col("realized_fwd_return"))


def _within_days(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Adds _cum, the running sum of the value within a key's day, _peak, its highest so far (null before a day's first value), and _at, the row's place."""
    w = W.partitionBy(*keys, order[0]).orderBy(*(order[1:] or order)).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({"_cum": F.sum(value).over(w), "_at": F.row_number().over(w)}).withColumn("_peak", F.max("_cum").over(w))


#: Parts of a currency unit in which a curve is summed: exactly, so that it doesn't depend on how rows are dealt.
MICRO = 1_000_000


def curve(pnl: DataFrame, keys: list[str], order: list[str], notional: float = 1.0) -> DataFrame:
    """Adds cumulative pnl (amounts at 6 places, summed exactly) and the drawdown from its running maximum, which starts with the first row.

    A prefix scan: running sums within each key's day, then sums over days (a row for each day, so a calendar's worth for a
    key), then both together. order: a day and what orders its rows; keys aren't null.
    """
    amount = F.floor(F.col("pnl") * notional * MICRO + 0.5).cast("decimal(19,0)")
    at = [*keys, order[0]]
    # the join would drop them later, but on one side only
    for c in at:
        pnl = pnl.where(F.col(c).isNotNull())
    rows = _within_days(pnl, keys, order, amount)
    # a day's total is its last running sum: read from the window, so that both sides of the join share the trades' one shuffle
    days = rows.groupBy(*at).agg(F.max_by("_cum", "_at").alias("_total"), F.max("_cum").alias("_top"))
    so_far = W.partitionBy(*keys).orderBy(order[0]).rowsBetween(W.unboundedPreceding, -1)
    carried = days.withColumn("_before", F.coalesce(F.sum("_total").over(so_far), F.lit(0))).withColumn("_above", F.max(F.col("_before") + F.col("_top")).over(so_far))
    out = rows.join(carried.select(*at, "_before", "_above"), at)
    total = F.col("_before") + F.col("_cum")
    fall = total - F.greatest("_above", F.col("_before") + F.col("_peak"))
    return out.withColumns({"cumulative": total.cast("double") / MICRO, "drawdown": fall.cast("double") / MICRO}).drop("_cum", "_at", "_peak", "_before", "_above")


def cents(amount: Column) -> Column:
    """An amount of ``curve`` at 2 places, by whole numbers: a tie goes up."""
    return F.floor((F.round(amount * MICRO) + 5000) / 10000) / 100


def summarize(pnl: DataFrame, keys: list[str], order: list[str], horizon: int = 5, extra: dict[str, Column] | None = None, idle: bool = False) -> DataFrame:
    """Per key: n_trades, avg_return, sharpe (0 where undefined), hit_rate, max_drawdown, over active trades in order.

    Each key's days are summed up (sums, squares, highest and lowest point, deepest fall), which is associative, and a key's
    days, a calendar's worth, are folded in order. extra: sums over all rows, by name. idle: also keys without an active
    trade, with nulls.
    """
    active = F.when(F.col("direction") != 0, F.col("pnl"))
    rows = _within_days(pnl.withColumn("_v", active), keys, order, F.col("_v"))
    extra = extra or {}
    days = rows.groupBy(*keys, order[0]).agg(
        F.count("_v").alias("_n"),
        F.sum("_v").alias("_sum"),
        F.sum(F.col("_v") * F.col("_v")).alias("_square"),
        F.count_if(F.col("_v") > 0).alias("_hits"),
        F.max("_cum").alias("_top"),
        F.min("_cum").alias("_low"),
        F.min(F.col("_cum") - F.col("_peak")).alias("_fall"),
        *[F.sum(c).alias(k) for k, c in extra.items()],
    )
    day = F.when(F.col("_n") > 0, F.struct(F.col(order[0]).alias("day"), F.col("_sum").alias("sum"), F.col("_top").alias("top"), F.col("_low").alias("low"), F.col("_fall").alias("fall")))
    per = days.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_sum").alias("s"), F.sum("_square").alias("q"), F.sum("_hits").alias("h"), F.sort_array(F.collect_list(day)).alias("days"), *[F.sum(k).alias(k) for k in extra])
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("peak"), F.lit(None).cast("double").alias("worst"))
    fold = lambda a, d: F.struct((a["cum"] + d["sum"]).alias("cum"), F.greatest(a["peak"], a["cum"] + d["top"]).alias("peak"), F.least(a["worst"], d["fall"], a["cum"] + d["low"] - a["peak"]).alias("worst"))
    n, mean = F.col("n"), F.try_divide(F.col("s"), F.col("n"))
    # what is left of the squares after rounding is no spread
    spread = F.col("q") - F.col("s") * mean
    dev = F.when((n > 1) & (spread > 1e-12 * F.col("q")), F.sqrt(spread / (n - 1)))
    out = per if idle else per.where("n > 0")
    return out.select(
        *keys,
        n.alias("n_trades"),
        mean.alias("avg_return"),
        F.coalesce(mean / dev * F.sqrt(F.lit(252.0 / horizon)), F.lit(0.0)).alias("sharpe"),
        F.try_divide(F.col("h"), n).alias("hit_rate"),
        F.aggregate("days", start, fold)["worst"].alias("max_drawdown"),
        *extra,
    )


def basket(prices: DataFrame, longs: list, shorts: list | None = None) -> DataFrame:
    """Daily return and equity of an equally weighted basket; closes are carried forward over missing days.

    The tickers are parameters, so their grid over trading days is bounded.
    """
    shorts = shorts or []
    if not longs and not shorts:
        raise ValueError("an empty basket")
    weights = [(t, 1.0 / len(longs)) for t in longs] + [(t, -1.0 / len(shorts)) for t in shorts]
    spark = prices.sparkSession
    named = F.broadcast(spark.createDataFrame(weights, f"ticker {dict(prices.dtypes)['ticker']}, weight double"))
    own = prices.join(named.select("ticker"), "ticker", "left_semi").select("ticker", "date", "close")
    grid = own.select("date").distinct().join(named)
    w = W.partitionBy("ticker").orderBy("date")
    filled = grid.join(own, ["ticker", "date"], "left").withColumn("close", F.last("close", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    steps = filled.withColumn("ret", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)))
    daily = steps.groupBy("date").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))
    every = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one row a trading day
    return daily.withColumn("equity", F.product(1 + F.col("ret")).over(every)).withColumn("drawdown", F.try_divide(F.col("equity"), F.max("equity").over(every)) - 1)


def rank_table(summary: DataFrame) -> DataFrame:
    """Position by sharpe (3 places), then by name."""
    return summary.withColumn("position", F.row_number().over(W.orderBy(F.round("sharpe", 3).desc(), "strategy", "ablation")))  # a row per strategy


#: Names of results: strategies over attributions, and baselines that read the move alone.
STRUCTURED, BASELINE = "struct_", "baseline_"
BASELINES = ("always_lean", "always_fade", "random", "sentiment")


def run_all(attributed: DataFrame, strategy: str = "fundamental_split", horizon: int = 5, notional: float = 10_000, use_excess: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every bundle under one strategy, and every baseline: (results, profits), in one plan.

    attributed: ``attribution.by_bundle`` rows with event_date and forward returns. Results: strategy_name,
    ablation_name (null for baselines), n_trades, sharpe, hit_rate, avg_return, max_drawdown, total_dollars.
    """
    from eventloom.functions.signals import STRATEGIES

    if horizon not in HORIZONS:
        raise ValueError(f"horizon {horizon} is none of {HORIZONS}")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(STRATEGIES)}")
    # a baseline doesn't depend on the bundle, so the first one's rows carry all of them
    cell = lambda name, bundle, verdict: F.struct(F.lit(name).alias("strategy_name"), bundle.alias("ablation_name"), verdict.alias("verdict"))
    own = F.array(cell(f"{STRUCTURED}{strategy}", F.col("ablation"), STRATEGIES[strategy]()))
    plain = F.array(*[cell(f"{BASELINE}{b}", F.lit(None).cast("string"), STRATEGIES[b]()) for b in BASELINES])
    runs = attributed.withColumn("_c", F.explode(F.when(F.col("rung") == 0, F.concat(own, plain)).otherwise(own))).select("*", "_c.*")
    name = f"fwd_{horizon}d" + ("_excess" if use_excess else "")
    trades = runs.where(F.col(name).isNotNull()).select("event_id", "event_date", "strategy_name", "ablation_name", direction(F.col("verdict"), F.col("return_pct")).alias("direction"), F.col(name).alias("fwd"))
    pnl = trades.withColumn("pnl", F.col("direction") * F.col("fwd"))
    summary = summarize(pnl, ["strategy_name", "ablation_name"], ["event_date", "event_id"], horizon, {"dollars": F.col("pnl") * notional}, idle=True)
    results = summary.select("strategy_name", "ablation_name", "n_trades", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sharpe", "hit_rate", "avg_return", "max_drawdown")), F.round("dollars", 2).alias("total_dollars"))
    return results, pnl


def pnl_cards(attributed: DataFrame, horizon: int = 5, notional: float = 10_000, strategy: str = "fundamental_split") -> DataFrame:
    """The profit card of each ticker: a row for the model's strategy and each baseline.

    attributed: moves with ticker, event_date, return_pct, fwd_<horizon>d (of the bars from the move on; moves without go) and an
    attribution. Rows: ticker, strategy, n_events, n_trades, n_wins, total_dollars, hit_rate, avg_return, sharpe, and
    equity_curve, the dated dollars and their running sum over active trades (a ticker's moves are few).
    """
    from eventloom.functions.signals import STRATEGIES

    name = f"fwd_{horizon}d"
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), STRATEGIES[k]().alias("verdict")) for n, k in (("model", strategy), *((b, b) for b in BASELINES))]))
    runs = attributed.where(F.col(name).isNotNull()).withColumn("_c", cells)
    trades = runs.select("ticker", "event_id", "event_date", "_c.strategy", direction(F.col("_c.verdict"), F.col("return_pct")).alias("direction"), F.col(name).alias("fwd")).withColumn("pnl", F.col("direction") * F.col("fwd"))
    keys = ["ticker", "strategy"]
    extra = {"n_events": F.lit(1), "n_wins": F.when(F.col("pnl") > 0, 1).otherwise(0), "dollars": F.col("pnl") * notional}
    figures = summarize(trades, keys, ["event_date", "event_id"], horizon, extra, idle=True)
    points = curve(trades.where("direction <> 0"), keys, ["event_date", "event_id"], notional)
    point = F.struct("event_date", "event_id", F.col("cumulative").alias("equity"), (F.col("pnl") * notional).alias("pnl_dollars"))
    curves = points.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("_p"))
    slim = F.transform("_p", lambda p: F.struct(p["event_date"].alias("date"), cents(p["equity"]).alias("equity"), F.round(p["pnl_dollars"], 2).alias("pnl_dollars")))
    zero = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), n)
    joined = figures.join(curves, keys, "left")
    return joined.select(*keys, "n_events", "n_trades", "n_wins", F.round("dollars", 2).alias("total_dollars"), zero("hit_rate", 4).alias("hit_rate"), zero("avg_return", 6).alias("avg_return"), zero("sharpe", 4).alias("sharpe"), F.coalesce(slim, F.array().cast("array<struct<date:date,equity:double,pnl_dollars:double>>")).alias("equity_curve"))


def result_key(strategy: Column, ablation: Column) -> Column:
    """strategy__ablation for structured results, the name alone for baselines."""
    return F.when(strategy.startswith(STRUCTURED) & ablation.isNotNull(), F.concat(strategy, F.lit("__"), ablation)).otherwise(strategy)


def compare(results: DataFrame, ablation: str | None = None) -> DataFrame:
    """The structured representative (of the highest sharpe, or of the named bundle) and the baselines, ranked by sharpe.

    Columns: position, label, n_trades, sharpe and hit_rate (3 places), avg_return and max_drawdown (5), dollars
    (2), is_structured, and beaten: whether the representative's sharpe is strictly above a baseline's. A row
    for each result, so one task may order them.
    """
    structured = F.col("strategy_name").startswith(STRUCTURED)
    named = structured & (F.col("ablation_name") == ablation) if ablation else F.lit(False)
    pick = W.partitionBy(structured).orderBy(F.coalesce(named, F.lit(False)).desc(), F.desc("sharpe"), "ablation_name", "strategy_name")
    ranked = results.withColumn("_k", F.row_number().over(pick))
    rows = ranked.where((structured & (F.col("_k") == 1)) | F.col("strategy_name").startswith(BASELINE)).drop("_k")
    label = F.when(structured, F.format_string("%s (%s)", "strategy_name", "ablation_name")).otherwise(F.expr(f"substring(strategy_name, {len(BASELINE) + 1})"))
    best = F.max(F.when(structured, F.col("sharpe"))).over(W.partitionBy(F.lit(1)))
    table = rows.withColumns({"label": label, "is_structured": structured, "beaten": F.when(~structured, best > F.col("sharpe"))})
    places = {"sharpe": 3, "hit_rate": 3, "avg_return": 5, "max_drawdown": 5}
    out = table.select("label", "is_structured", "beaten", "n_trades", *(F.round(c, n).alias(c) for c, n in places.items()), F.col("total_dollars").alias("dollars"))
    return out.withColumn("position", F.row_number().over(W.orderBy(F.desc("sharpe"), F.desc("is_structured"), "label")))


def verdict(table: DataFrame) -> DataFrame:
    """One row of ``compare``'s table in words: verdict, beats, loses_to, structured_rank."""
    names = lambda won: F.array_sort(F.collect_list(F.when(F.col("beaten") == won, F.struct("position", "label"))))
    one = lambda c: F.max(F.when(F.col("is_structured"), F.col(c)))
    row = table.agg(one("label").alias("label"), one("position").alias("structured_rank"), one("sharpe").alias("sharpe"), one("hit_rate").alias("hit"), one("n_trades").alias("n"), one("dollars").alias("dollars"), F.count(F.lit(1)).alias("total"), names(True).alias("w"), names(False).alias("l"))
    row = row.withColumns({"beats": F.transform("w", lambda x: x["label"]), "loses_to": F.transform("l", lambda x: x["label"])})
    won, lost = F.size("beats"), F.size("loses_to")
    figures = F.format_string("Sharpe %+.2f, %d trades, %.0f%% of them with a gain, %+,.2f dollars", F.col("sharpe"), F.col("n"), F.col("hit") * 100, F.col("dollars"))
    alone = F.concat(F.col("label"), F.lit(" has nothing to be measured against: "), figures, F.lit("."))
    text = F.concat_ws(
        " ",
        F.concat(F.col("label"), F.format_string(" takes place %d of %d: ", "structured_rank", "total"), figures, F.lit(".")),
        F.when(won > 0, F.concat(F.lit("Its Sharpe is above that of "), F.array_join("beats", ", "), F.lit("."))),
        F.when(lost > 0, F.concat(F.lit("It is not above that of "), F.array_join("loses_to", ", "), F.lit("."))),
    )
    none = F.lit("There is no structured strategy among the results.")
    return row.select(F.when(F.col("label").isNull(), none).when(won + lost == 0, alone).otherwise(text).alias("verdict"), "beats", "loses_to", "structured_rank")
