"""Queries over attributions: signals, baselines, profit and loss, evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions import scoring as S
from eventloom.functions import signals as G
from eventloom.functions.dates import quarter_label
from eventloom.operators import attribution as A
from eventloom.operators import backtest as B
from eventloom.operators import evaluate as V
from eventloom.operators import panel as P
from eventloom.operators import reactions as R
from eventloom.plans.base import Registry, dated_events, panel, r6, rounded, with_
from eventloom.plans.panel import BENCH, F05, REACTIONS, benchmark

REG = Registry()


def _hash(*parts: str) -> str:
    return f"(concat('0x', substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 12))::bigint::double / {float(16**12)})"


KEY = "event_id::varchar"
NINE = lambda x: f"(floor(({x}) * 1e9 + 0.5) / 1e9)"
RAW = {d: f"({_hash(KEY, repr(d))} + 0.01)" for d in G.DIMENSIONS}
TOTAL = "(" + " + ".join(f"r_{d}" for d in G.DIMENSIONS) + ")"
DOMINANT = "CASE " + " ".join(f"WHEN w_{d} = greatest({', '.join(f'w_{x}' for x in G.DIMENSIONS)}) THEN '{d}'" for d in G.DIMENSIONS) + " END"
ATTR = (
    "raw AS (SELECT event_id, ticker, event_date, reaction_return AS return_pct, coalesce(reaction_return / nullif(vol_30d, 0), 0.0) AS z, fwd_1d, fwd_5d, fwd_20d, " + ", ".join(f"{x} AS r_{d}" for d, x in RAW.items()) + " FROM react),\n"
    "attr0 AS (SELECT *, " + NINE("least(1.0, greatest(0.0, 0.5 * least(1.0, abs(return_pct) / 0.15) + 0.5 * least(1.0, abs(z) / 5) + (" + _hash(KEY, "'noise'") + " - 0.5) * 0.3))") + " AS score, " + ", ".join(f"{NINE(f'r_{d} / {TOTAL}')} AS w_{d}" for d in G.DIMENSIONS) + " FROM raw),\n"
    f"attr AS (SELECT *, {DOMINANT} AS dominant, CASE WHEN score >= 0.65 THEN 'structural' WHEN score <= 0.35 THEN 'transient' ELSE 'mixed' END AS character, {NINE('0.4 + 0.5 * score')} AS confidence, CASE WHEN {_hash(KEY, repr('has'))} < 0.8 THEN {NINE(f"return_pct * ({_hash(KEY, repr('pred'))} * 3 - 0.5)")} END AS pred, CASE WHEN return_pct > 0 THEN 'positive' WHEN return_pct < 0 THEN 'negative' ELSE 'neutral' END AS direction FROM attr0)"
)
BASE = REACTIONS.rstrip() + ",\n" + ATTR


#: Measures of bars that attributions and strategies read.
READ = ("fwd_5d", "vol_30d")


def attributions(spark, d):
    rows = R.reactions(dated_events(spark, d), panel(spark, d), measures=READ)
    z = F.coalesce(F.try_divide(F.col("reaction_return"), F.nullif("vol_30d", F.lit(0.0))), F.lit(0.0))
    return A.placeholder(rows.select("event_id", "ticker", "event_date", F.col("reaction_return").alias("return_pct"), z.alias("z"), "fwd_5d"))


@REG.add("J10_K08_placeholder", BASE + f" SELECT event_id, dominant, character, direction, {', '.join(f'w_{d}' for d in G.DIMENSIONS)}, pred + 0.0 AS pred, confidence FROM attr")
def k08(spark, d):
    """As the operator gives them: at 9 places, rounded once."""
    w = [f"w_{x}" for x in G.DIMENSIONS]
    return attributions(spark, d).select("event_id", "dominant", "character", "direction", *w, (F.col("pred") + F.lit(0.0)).alias("pred"), "confidence")


WEIGHTED = "(" + " + ".join(f"w_{d} * {p}" for d, p in G.PERSISTENCE.items()) + ")"
SQL = {
    "fundamental_split": "CASE character WHEN 'structural' THEN 'lean' WHEN 'transient' THEN 'fade' ELSE 'neutral' END",
    "expected_vs_realised": "CASE WHEN pred IS NULL OR pred = 0 OR pred * return_pct <= 0 THEN 'neutral' WHEN abs(return_pct) / abs(pred) >= 1.5 THEN 'fade' WHEN abs(return_pct) / abs(pred) <= 0.5 THEN 'lean' ELSE 'neutral' END",
    "dimension_weighted": f"CASE WHEN {WEIGHTED} >= 0.2 THEN 'lean' WHEN {WEIGHTED} <= -0.2 THEN 'fade' ELSE 'neutral' END",
    "hybrid": "CASE WHEN character = 'transient' THEN 'fade' WHEN character <> 'structural' THEN 'neutral' WHEN pred <> 0 AND pred * return_pct > 0 AND abs(return_pct) >= 1.5 * abs(pred) THEN 'fade' WHEN dominant IN ('management_credibility', 'macro') THEN 'neutral' ELSE 'lean' END",
    "fade_or_follow": "CASE WHEN pred IS NULL THEN CASE character WHEN 'structural' THEN 'lean' WHEN 'transient' THEN 'fade' ELSE 'neutral' END WHEN character = 'transient' THEN CASE WHEN pred <> 0 AND abs(return_pct) > 1.5 * abs(pred) THEN 'fade' ELSE 'neutral' END WHEN character = 'structural' AND pred * return_pct > 0 THEN 'lean' ELSE 'neutral' END",
    "always_lean": "'lean'",
    "always_fade": "CASE WHEN abs(return_pct) >= 0.05 THEN 'fade' ELSE 'neutral' END",
    "random": f"CASE WHEN {_hash(KEY, repr('42'))} < 0.5 THEN 'lean' ELSE 'fade' END",
    "sentiment": f"CASE WHEN 2 * {_hash(KEY, repr('7'))} - 1 > 0.33 THEN 'lean' WHEN 2 * {_hash(KEY, repr('7'))} - 1 < -0.33 THEN 'fade' ELSE 'neutral' END",
}
VERDICTS = "verdicts AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS strategy, {x} AS verdict FROM attr" for k, x in SQL.items()) + ")"


def verdicts(spark, d):
    """A row for each event and strategy; the strategies are a constant, so one scan is exploded, not repeated."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), f().alias("verdict")) for k, f in G.STRATEGIES.items()]))
    return attributions(spark, d).withColumn("_c", cells).select("*", "_c.strategy", "_c.verdict").drop("_c")


@REG.add("K15_K22_verdicts", BASE + ", " + VERDICTS + " SELECT event_id, strategy, verdict FROM verdicts")
def k15(spark, d):
    return verdicts(spark, d).select("event_id", "strategy", "verdict")


TRADES = "trades AS (SELECT event_id, event_date AS entry_date, strategy, 1.0::double AS size, CASE verdict WHEN 'lean' THEN sign(return_pct) WHEN 'fade' THEN -sign(return_pct) ELSE 0 END::int AS direction FROM verdicts)"
PNL = "pnl AS (SELECT t.*, fwd_5d AS realized_fwd_return, t.direction * size * fwd_5d AS pnl FROM trades t JOIN attr USING (event_id) WHERE fwd_5d IS NOT NULL)"


def trades(spark, d):
    rows = verdicts(spark, d)
    return rows.select("event_id", F.col("event_date").alias("entry_date"), "strategy", F.lit(1.0).alias("size"), B.direction(F.col("verdict"), F.col("return_pct")).alias("direction"), "fwd_5d")


def pnl(spark, d):
    """Trades carry their event's forward return along, so profits need no second join with the events."""
    return trades(spark, d).where("fwd_5d is not null").withColumn("pnl", F.col("direction") * F.col("size") * F.col("fwd_5d"))


@REG.add("K20_K23_D05_profit", BASE + ", " + VERDICTS + ", " + TRADES + ", " + PNL + " SELECT event_id, direction, round(pnl, 6) + 0.0 AS pnl FROM pnl WHERE strategy = 'fundamental_split'")
def k23(spark, d):
    a = attributions(spark, d)
    t = a.select("event_id", F.lit(1.0).alias("size"), B.direction(G.split_by_character(F.col("character")), F.col("return_pct")).alias("direction"))
    return rounded(B.profit(t, a, 5).select("event_id", "direction", "pnl"), "pnl")


SUMMARY = "active AS (SELECT *, sum(pnl) OVER (PARTITION BY strategy ORDER BY entry_date, event_id) AS cum FROM pnl WHERE direction <> 0), dd AS (SELECT *, cum - max(cum) OVER (PARTITION BY strategy ORDER BY entry_date, event_id) AS drawdown FROM active), summary AS (SELECT strategy, count(*) AS n_trades, avg(pnl) AS avg_return, coalesce(CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252 / 5.0) END, 0.0) AS sharpe, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, min(drawdown) AS max_drawdown FROM dd GROUP BY 1)"
ALL = BASE + ", " + VERDICTS + ", " + TRADES + ", " + PNL + ", " + SUMMARY


def summary(spark, d):
    return B.summarize(pnl(spark, d), ["strategy"], ["entry_date", "event_id"], 5)


@REG.add("E09_K24_K25_summary", ALL + " SELECT strategy, n_trades, round(avg_return, 6) + 0.0 AS avg_return, round(sharpe, 6) + 0.0 AS sharpe, round(hit_rate, 6) + 0.0 AS hit_rate, round(max_drawdown, 6) + 0.0 AS max_drawdown FROM summary")
def e09(spark, d):
    return rounded(summary(spark, d), "avg_return", "sharpe", "hit_rate", "max_drawdown")


MICRO = "(sum(floor(pnl * 10000 * 1000000 + 0.5)::bigint) OVER (PARTITION BY strategy ORDER BY entry_date, event_id))::double"


@REG.add("F18_equity_curve", BASE + ", " + VERDICTS + ", " + TRADES + ", " + PNL + f" SELECT event_id, strategy, floor(({MICRO} + 5000) / 10000) / 100 AS cumulative FROM pnl WHERE direction <> 0")
def f18(spark, d):
    rows = B.curve(pnl(spark, d).where("direction <> 0"), ["strategy"], ["entry_date", "event_id"], 10000)
    return rows.select("event_id", "strategy", B.cents(F.col("cumulative")).alias("cumulative"))


@REG.add("E10_total_dollars", ALL + " SELECT strategy, round(sum(pnl * 10000), 2) + 0.0 AS dollars FROM pnl GROUP BY 1")
def e10(spark, d):
    return pnl(spark, d).groupBy("strategy").agg((F.round(F.sum(F.col("pnl") * 10000), 2) + F.lit(0.0)).alias("dollars"))


@REG.add("F25_K26_rank_table", ALL + " SELECT strategy, row_number() OVER (ORDER BY round(sharpe, 3) DESC, strategy)::int AS position FROM summary")
def f25(spark, d):
    return B.rank_table(summary(spark, d).withColumn("ablation", F.lit(""))).select("strategy", "position")


@REG.add("G07_G10_best_and_worst", ALL + " SELECT arg_max(strategy, sharpe) AS best, arg_min(strategy, sharpe) AS worst FROM summary")
def g10(spark, d):
    return summary(spark, d).agg(F.max_by("strategy", "sharpe").alias("best"), F.min_by("strategy", "sharpe").alias("worst"))


@REG.add("K32_calibration_floor", ALL + ", fl AS (SELECT max(hit_rate) AS floor FROM summary WHERE strategy IN ('random', 'sentiment')) SELECT strategy, round(hit_rate, 6) + 0.0 AS hit_rate, round(floor, 6) + 0.0 AS floor, round(hit_rate - floor, 6) + 0.0 AS delta, hit_rate - floor >= 0 AS passed FROM summary, fl WHERE strategy NOT IN ('random', 'sentiment')")
def k32(spark, d):
    return rounded(V.above_floor(summary(spark, d), "hit_rate"), "hit_rate", "floor", "delta")


@REG.add("G08_G09_dimensions", BASE + " SELECT event_id, dominant, list_aggregate(list_transform(list_sort([" + ", ".join(f"{{'w': -w_{d}, 'i': {i}, 'n': '{d}'}}" for i, d in enumerate(G.DIMENSIONS)) + "])[1:3], lambda x: x.n), 'string_agg', ',') AS top FROM attr")
def g09(spark, d):
    return attributions(spark, d).select("event_id", "dominant", F.array_join(G.ranked_dimensions(3), ",").alias("top"))


@REG.add("K42_C28_outcomes", BASE + " SELECT event_id, CASE WHEN ok THEN 'right' WHEN NOT ok THEN 'wrong' END AS outcome, CASE WHEN pred IS NULL THEN 'idle' WHEN sign(pred) <> sign(return_pct) THEN 'miss' WHEN pred / return_pct BETWEEN 0.5 AND 2 THEN 'match' ELSE 'partial' END AS state FROM (SELECT *, CASE character WHEN 'structural' THEN sign(return_pct) = sign(fwd_5d) WHEN 'transient' THEN sign(return_pct) <> sign(fwd_5d) END AS ok FROM attr WHERE return_pct <> 0)")
def k42(spark, d):
    rows = attributions(spark, d).where("return_pct <> 0")
    v = G.split_by_character(F.col("character"))
    return rows.select("event_id", G.outcome(v, F.col("return_pct"), F.col("fwd_5d")).alias("outcome"), G.alignment_state(F.col("pred"), F.col("return_pct")).alias("state"))


BUCKETS = {"ticker": "ticker::varchar", "quarter": "year(event_date) || 'Q' || quarter(event_date)", "direction": "CASE WHEN return_pct > 0 THEN 'up' WHEN return_pct < 0 THEN 'down' ELSE 'flat' END"}


@REG.add(
    "E12_bucket_stats",
    BASE + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS bucket_type, {x} AS bucket, count(*) AS n, round(avg((character = 'structural')::int), 6) AS structural_share, round(avg((character = 'transient')::int), 6) AS transient_share, round(avg(return_pct), 6) + 0.0 AS avg_return, round(avg(confidence), 6) AS avg_confidence, round(avg((sign(pred) = sign(return_pct))::int) FILTER (pred IS NOT NULL), 6) AS hit_rate FROM attr GROUP BY 1, 2" for k, x in BUCKETS.items()) + ")",
)
def e12(spark, d):
    keys = {"ticker": F.col("ticker"), "quarter": quarter_label(F.col("event_date")), "direction": F.when(F.col("return_pct") > 0, "up").when(F.col("return_pct") < 0, "down").otherwise("flat")}
    rows = V.bucket_stats(attributions(spark, d), keys)
    return rounded(rows.select("bucket_type", "bucket", "n", "structural_share", "transient_share", "avg_return", "avg_confidence", "hit_rate"), "structural_share", "transient_share", "avg_return", "avg_confidence", "hit_rate")


@REG.add("E13_character_distribution", BASE + " SELECT character, count(*) AS n, round(count(*)::double / sum(count(*)) OVER (), 6) AS share FROM attr GROUP BY 1")
def e13(spark, d):
    # one row per character
    by = attributions(spark, d).groupBy("character").agg(F.count(F.lit(1)).alias("n"))
    return by.select("character", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6).alias("share"))


@REG.add("K34_distribution_flags", BASE + ", d AS (SELECT max(n) / sum(n) AS s, sum(n) AS t FROM (SELECT count(*) AS n FROM attr GROUP BY dominant)), c AS (SELECT max(n) / sum(n) AS s FROM (SELECT count(*) AS n FROM attr GROUP BY character)) SELECT t::bigint AS n, round(d.s, 6) AS top_dominant_share, round(c.s, 6) AS top_character_share, d.s <= 0.95 AS dominant_ok, c.s <= 0.95 AS character_ok, t >= 3 AS coverage_ok FROM d, c")
def k34(spark, d):
    return rounded(V.sanity_flags(attributions(spark, d)), "top_dominant_share", "top_character_share")


FLAGS_SQL = """, c AS (
  SELECT 'move_character' AS bucket, character AS k, count(*) AS n FROM attr GROUP BY 2 UNION ALL SELECT 'dominant_dimension', dominant, count(*) FROM attr GROUP BY 2
  UNION ALL SELECT 'ticker', ticker::varchar, count(*) FROM attr GROUP BY 2 UNION ALL SELECT 'quarter', year(event_date) || 'Q' || quarter(event_date), count(*) FROM attr GROUP BY 2
  UNION ALL SELECT 'direction', CASE WHEN return_pct > 0 THEN 'up' WHEN return_pct < 0 THEN 'down' ELSE 'flat' END, count(*) FROM attr GROUP BY 2),
p AS (SELECT avg((v > 0)::int) AS hit, avg(v) / stddev_samp(v) AS sharpe FROM (SELECT CASE character WHEN 'structural' THEN 1 WHEN 'transient' THEN -1 END * sign(return_pct) * fwd_5d AS v FROM attr WHERE return_pct <> 0) WHERE v IS NOT NULL)
SELECT 'collapse' AS kind, bucket || '=' || k AS bucket_key, round(n / (SELECT count(*) FROM attr), 6) AS observed, 0.6::double AS threshold FROM c WHERE bucket IN ('move_character', 'dominant_dimension') AND n > 0.6 * (SELECT count(*) FROM attr)
UNION ALL SELECT 'coverage', bucket || '=' || k, n::double, 40.0 FROM c WHERE bucket IN ('ticker', 'quarter', 'direction') AND n < 40
UNION ALL SELECT 'magnitude', NULL, round(sharpe, 6), 0.5 FROM p WHERE hit > 0.5 AND sharpe < 0.5"""


@REG.add("K34_flags", BASE + FLAGS_SQL)
def k34f(spark, d):
    """What a reviewer would be told: labels that take over, thin buckets, bets too small to matter."""
    a = attributions(spark, d).withColumn("direction_", F.when(F.col("return_pct") > 0, "up").when(F.col("return_pct") < 0, "down").otherwise("flat"))
    buckets = {"ticker": F.col("ticker"), "quarter": quarter_label(F.col("event_date")), "direction": F.col("direction_")}
    side = B.direction(G.split_by_character(F.col("character")), F.col("return_pct"))
    value = F.when(side != 0, side * F.col("fwd_5d"))
    out = V.flags(a, buckets, value, collapse=0.6, coverage=40, least_sharpe=0.5)
    return out.withColumn("observed", F.when(F.col("kind") == "coverage", F.col("observed")).otherwise(r6("observed")))


CASES = "cases AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CASE event_id % 3 WHEN 0 THEN 'demand' WHEN 1 THEN 'pricing' ELSE 'macro' END END AS e_dim, CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'positive' ELSE 'negative' END END AS e_dir, CASE WHEN event_id % 7 <> 0 THEN 'structural' END AS e_char, CASE WHEN event_id % 11 = 0 THEN 'lean' END AS e_fade, CASE WHEN event_id % 13 = 0 THEN 'macro' END AS e_not FROM attr)"
MATCHES = f"m AS (SELECT event_id, CASE WHEN e_dim IS NOT NULL THEN dominant = e_dim AND NOT coalesce(dominant = e_not, false) END AS dim, direction = e_dir AS dir, character = e_char AS ch, ({SQL['fade_or_follow']}) = e_fade AS fl FROM attr JOIN cases USING (event_id))"
COMPOSITE = "comp AS (SELECT *, coalesce((CASE WHEN dim THEN 0.5 ELSE 0.0 END + CASE WHEN dir THEN 0.25 ELSE 0.0 END + CASE WHEN ch THEN 0.15 ELSE 0.0 END + CASE WHEN fl THEN 0.1 ELSE 0.0 END)::double / nullif(CASE WHEN dim IS NOT NULL THEN 0.5 ELSE 0.0 END + CASE WHEN dir IS NOT NULL THEN 0.25 ELSE 0.0 END + CASE WHEN ch IS NOT NULL THEN 0.15 ELSE 0.0 END + CASE WHEN fl IS NOT NULL THEN 0.1 ELSE 0.0 END, 0)::double, 0.0) AS composite FROM m)"


def composite(spark, d, rows=None, *keep):
    """Attributions against expected values; a case asserts some of them."""
    k = F.col("event_id")
    a = attributions(spark, d) if rows is None else rows
    dim = F.when(k % 4 != 0, F.when(k % 3 == 0, "demand").when(k % 3 == 1, "pricing").otherwise("macro"))
    way = F.when(k % 5 != 0, F.when(k % 2 == 0, "positive").otherwise("negative"))
    fade = G.fade_or_follow(F.col("character"), F.col("pred"), F.col("return_pct"))
    matches = {"dim": F.col("dominant") == dim, "dir": F.col("direction") == way, "char": F.col("character") == F.when(k % 7 != 0, "structural"), "fade_lean": fade == F.when(k % 11 == 0, "lean")}
    veto = F.col("dominant") == F.when(k % 13 == 0, "macro")
    return a.select("event_id", *keep, "dominant", V.score_case(matches, veto).alias("composite"), (F.when(dim.isNotNull(), matches["dim"] & ~F.coalesce(veto, F.lit(False)))).alias("dim_match"))


@REG.add("K29_scores", BASE + ", " + CASES + ", " + MATCHES + ", " + COMPOSITE + " SELECT event_id, round(composite, 6) + 0.0 AS composite FROM comp")
def k29(spark, d):
    return rounded(composite(spark, d).select("event_id", "composite"), "composite")


@REG.add("K35_frozen_anchor", BASE + ", " + CASES + ", " + MATCHES + ", " + COMPOSITE + " SELECT event_id, composite >= 0.67 AS passed FROM comp")
def k35(spark, d):
    return composite(spark, d).select("event_id", (F.col("composite") >= 0.67).alias("passed"))


H7 = lambda k: _hash(KEY, "ablation", repr(k))
NOISE = "noise(ablation, rung, noise) AS (VALUES " + ", ".join(f"('{n}', {i}, {x}::double)" for i, (n, x) in enumerate(A.NOISE.items())) + ")"
RUNGS = (
    NOISE
    + ", a70 AS (SELECT raw.*, ablation, rung, " + NINE("CASE WHEN " + H7("flip") + " < noise THEN " + H7("score") + " ELSE 0.5 * least(1.0, abs(return_pct) / 0.15) + 0.5 * least(1.0, abs(z) / 5) END") + " AS score, " + ", ".join(f"{NINE(f'r_{d} / {TOTAL}')} AS w_{d}" for d in G.DIMENSIONS) + " FROM raw, noise),\n"
    + "a71 AS (SELECT *, CASE WHEN score >= 0.65 THEN 'structural' WHEN score <= 0.35 THEN 'transient' WHEN " + H7("mixed") + f" < 0.3 THEN 'mixed' ELSE 'unclear' END AS character, {DOMINANT} AS dominant, CASE WHEN return_pct > 0 THEN 'positive' WHEN return_pct < 0 THEN 'negative' ELSE 'neutral' END AS direction FROM a70),\n"
    + "a7 AS (SELECT *, " + NINE("CASE character WHEN 'structural' THEN least(0.95, 0.5 + score / 2) WHEN 'transient' THEN least(0.95, 0.5 + (1 - score) / 2) WHEN 'mixed' THEN 0.5 ELSE 0.4 END") + " AS confidence, CASE WHEN character = 'structural' THEN " + NINE("return_pct * (0.4 + 0.7 * " + H7("pred") + ")") + " END AS pred FROM a71)"
)
BASE7 = BASE + ", " + RUNGS


def by_bundle(spark, d, excess: bool = False):
    rows = R.reactions(dated_events(spark, d), panel(spark, d), measures=READ)
    more = ["fwd_5d_excess"] if excess else []
    if excess:
        rows = R.excess(rows, benchmark(spark, d), (5,))
    z = F.coalesce(F.try_divide(F.col("reaction_return"), F.nullif("vol_30d", F.lit(0.0))), F.lit(0.0))
    return A.by_bundle(rows.select("event_id", "ticker", "event_date", F.col("reaction_return").alias("return_pct"), z.alias("z"), "fwd_5d", *more))


@REG.add("K08_K10_bundles", BASE7 + " SELECT event_id, ablation, character, confidence, pred + 0.0 AS pred FROM a7")
def k08b(spark, d):
    return by_bundle(spark, d).select("event_id", "ablation", "character", "confidence", (F.col("pred") + F.lit(0.0)).alias("pred"))


@REG.add("K46_chart_frame", BASE7 + " SELECT ablation AS label, (rung + 1)::int AS rank, count(*) AS n, round(avg((character = 'structural')::int), 6) + 0.0 AS structural_share, round(avg(confidence), 6) + 0.0 AS mean_confidence FROM a7 GROUP BY 1, 2")
def k46(spark, d):
    """A bar of the chart for each bundle of sources, in the ladder's order."""
    rows = by_bundle(spark, d).groupBy(F.col("ablation").alias("label"), (F.col("rung") + 1).alias("rank"))
    return rows.agg(F.count("*").alias("n"), r6(F.avg((F.col("character") == "structural").cast("int"))).alias("structural_share"), r6(F.avg("confidence")).alias("mean_confidence"))


@REG.add("K31_E15_D16_matrix", BASE7 + ", " + CASES + ", " + MATCHES.replace("event_id, CASE", "event_id, rung, CASE").replace("FROM attr JOIN", "FROM a7 JOIN") + ", " + COMPOSITE + " SELECT rung::int AS rung, round(avg(composite), 6) + 0.0 AS mean_composite, round(avg(dim::int), 6) + 0.0 AS dim_accuracy, count(*) AS n FROM comp GROUP BY 1")
def k31(spark, d):
    """Every case under every bundle of sources."""
    cells = composite(spark, d, by_bundle(spark, d), "rung")
    return cells.groupBy("rung").agg(r6(F.avg("composite")).alias("mean_composite"), r6(F.avg(F.col("dim_match").cast("int"))).alias("dim_accuracy"), F.count(F.lit(1)).alias("n"))


RUNS = ", runs AS (SELECT event_id, event_date, return_pct, fwd_5d, 'struct_fundamental_split' AS strategy_name, ablation AS ablation_name, " + SQL["fundamental_split"] + " AS verdict FROM a7 UNION ALL " + " UNION ALL ".join(f"SELECT event_id, event_date, return_pct, fwd_5d, 'baseline_{b}', NULL, {SQL[b]} FROM a7 WHERE rung = 0" for b in B.BASELINES) + ")"
PNL7 = ", pnl7 AS (SELECT *, CASE verdict WHEN 'lean' THEN sign(return_pct) WHEN 'fade' THEN -sign(return_pct) ELSE 0 END * fwd_5d AS pnl, CASE verdict WHEN 'lean' THEN sign(return_pct) WHEN 'fade' THEN -sign(return_pct) ELSE 0 END AS direction FROM runs WHERE fwd_5d IS NOT NULL)"
RESULTS = ", cum7 AS (SELECT *, sum(pnl) OVER (PARTITION BY strategy_name, ablation_name ORDER BY event_date, event_id) AS cum FROM pnl7 WHERE direction <> 0), dd7 AS (SELECT *, cum - max(cum) OVER (PARTITION BY strategy_name, ablation_name ORDER BY event_date, event_id) AS drawdown FROM cum7), sum7 AS (SELECT strategy_name, ablation_name, count(*) AS n_trades, coalesce(CASE WHEN stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252 / 5.0) END, 0.0) AS sharpe, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(pnl) AS avg_return, min(drawdown) AS max_drawdown FROM dd7 GROUP BY 1, 2), results AS (SELECT a.strategy_name, a.ablation_name, coalesce(n_trades, 0) AS n_trades, coalesce(sharpe, 0.0) AS sharpe, coalesce(hit_rate, 0.0) AS hit_rate, coalesce(avg_return, 0.0) AS avg_return, coalesce(max_drawdown, 0.0) AS max_drawdown, total_dollars FROM (SELECT strategy_name, ablation_name, round(sum(pnl * 10000), 2) AS total_dollars FROM pnl7 GROUP BY 1, 2) a LEFT JOIN sum7 b ON a.strategy_name = b.strategy_name AND a.ablation_name IS NOT DISTINCT FROM b.ablation_name)"
FIGURES = ("sharpe", "hit_rate", "avg_return", "max_drawdown")


@REG.add("K25_run_all", BASE7 + RUNS + PNL7 + RESULTS + " SELECT strategy_name, ablation_name, n_trades, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FIGURES) + ", total_dollars + 0.0 AS total_dollars FROM results")
def k25(spark, d):
    return rounded(B.run_all(by_bundle(spark, d))[0], *FIGURES, "total_dollars")


EXCESS7 = REACTIONS.rstrip() + ",\n" + BENCH + ",\nreactx AS (SELECT react.* REPLACE (fwd_5d - b5 AS fwd_5d) FROM react LEFT JOIN bench ON anchor_date = date),\n" + ATTR.replace(" FROM react)", " FROM reactx)") + ", " + RUNGS


@REG.add("K25_excess_run", EXCESS7 + RUNS + PNL7 + RESULTS + " SELECT strategy_name, ablation_name, n_trades, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FIGURES) + ", total_dollars + 0.0 AS total_dollars FROM results")
def k25x(spark, d):
    """The runner's default: returns in excess of the market's."""
    return rounded(B.run_all(by_bundle(spark, d, True), use_excess=True)[0], *FIGURES, "total_dollars")


TABLE = ", rep AS (SELECT * FROM results WHERE ablation_name IS NOT NULL ORDER BY sharpe DESC, ablation_name LIMIT 1), tab AS (SELECT strategy_name || ' (' || ablation_name || ')' AS label, true AS is_structured, NULL::boolean AS beaten, * FROM rep UNION ALL SELECT substr(r.strategy_name, 10), false, (SELECT sharpe FROM rep) > r.sharpe, r.* FROM results r WHERE ablation_name IS NULL)"


@REG.add("K26_K47_report", BASE7 + RUNS + PNL7 + RESULTS + TABLE + " SELECT label, is_structured, beaten, n_trades, round(sharpe, 3) + 0.0 AS sharpe, round(hit_rate, 3) + 0.0 AS hit_rate, round(avg_return, 5) + 0.0 AS avg_return, round(max_drawdown, 5) + 0.0 AS max_drawdown, total_dollars + 0.0 AS dollars, row_number() OVER (ORDER BY round(sharpe, 3) DESC, is_structured DESC, label)::int AS position FROM tab")
def k26(spark, d):
    return rounded(B.compare(B.run_all(by_bundle(spark, d))[0]), *FIGURES, "dollars")


@REG.add("K33_frameworks", ALL + " SELECT strategy, n_lean, n_fade, n_neutral, round(sharpe, 6) + 0.0 AS sharpe, round(hit_rate, 6) + 0.0 AS hit_rate FROM (SELECT strategy, count(*) FILTER (verdict = 'lean') AS n_lean, count(*) FILTER (verdict = 'fade') AS n_fade, count(*) FILTER (verdict = 'neutral') AS n_neutral FROM verdicts GROUP BY 1) LEFT JOIN summary USING (strategy)")
def k33f(spark, d):
    """Every strategy over the same attributions: what it says, and what that earned; an event without a forward return earns nothing."""
    rows = verdicts(spark, d).select("strategy", "verdict", "event_id", F.col("event_date").alias("entry_date"), B.direction(F.col("verdict"), F.col("return_pct")).alias("direction"), "fwd_5d")
    said = {f"n_{v}": F.when(F.col("verdict") == v, 1).otherwise(0) for v in ("lean", "fade", "neutral")}
    got = B.summarize(rows.withColumn("pnl", F.col("direction") * F.col("fwd_5d")), ["strategy"], ["entry_date", "event_id"], 5, said, idle=True)
    active = F.col("n_trades") > 0
    return rounded(got.select("strategy", *said, F.when(active, F.col("sharpe")).alias("sharpe"), F.when(active, F.col("hit_rate")).alias("hit_rate")), "sharpe", "hit_rate")


def _elimination(n: int) -> str:
    """CTEs that solve n normal equations e0 (a_i_j, b_i) by elimination; the last, x, has a column for each coefficient."""
    out, cells = [], lambda i, j: f"a_{i}_{j}"
    for k in range(n - 1):
        f = lambda i, k=k: f"{cells(i, k)} / {cells(k, k)}"
        keep = [cells(i, j) for i in range(k + 1) for j in range(i, n)] + [f"b_{i}" for i in range(k + 1)]
        step = [f"{cells(i, j)} - {f(i)} * {cells(k, j)} AS {cells(i, j)}" for i in range(k + 1, n) for j in range(k + 1, n)] + [f"b_{i} - {f(i)} * b_{k} AS b_{i}" for i in range(k + 1, n)]
        out.append(f"e{k + 1} AS (SELECT {', '.join(keep + step)} FROM e{k})")
    last = f"e{n - 1}"
    for i in reversed(range(n)):
        known = "".join(f" - {cells(i, j)} * x_{j}" for j in range(i + 1, n))
        out.append(f"s{i} AS (SELECT *, (b_{i}{known}) / {cells(i, i)} AS x_{i} FROM {last})")
        last = f"s{i}"
    return ", ".join(out)


NORMAL = "e0 AS (SELECT " + ", ".join(f"sum(w_{a} * w_{b}) AS a_{i}_{j}" for i, a in enumerate(G.DIMENSIONS) for j, b in enumerate(G.DIMENSIONS)) + ", " + ", ".join(f"sum(w_{a} * sign(return_pct) * fwd_5d) AS b_{i}" for i, a in enumerate(G.DIMENSIONS)) + " FROM attr WHERE fwd_5d IS NOT NULL AND return_pct <> 0)"
LARGEST = "greatest(" + ", ".join(f"abs(x_{i})" for i in range(len(G.DIMENSIONS))) + ")"


@REG.add("E18_persistence", BASE + ", " + NORMAL + ", " + _elimination(len(G.DIMENSIONS)) + " " + " UNION ALL ".join(f"SELECT '{x}' AS dimension, round(greatest(-1.0, least(1.0, x_{i} / {LARGEST})), 6) + 0.0 AS persistence FROM s0" for i, x in enumerate(G.DIMENSIONS)))
def e18b(spark, d):
    """The fitted coefficient of each dimension; the SQL solves the normal equations by elimination."""
    rows = attributions(spark, d).where("fwd_5d is not null and return_pct <> 0").withColumn("y", F.signum("return_pct") * F.col("fwd_5d")).withColumnsRenamed({f"w_{x}": x for x in G.DIMENSIONS})
    fitted = spark.createDataFrame(sorted(V.persistence_fit(rows, list(G.DIMENSIONS), "y", G.PERSISTENCE).items()), "dimension string, persistence double")
    return rounded(fitted, "persistence")


@REG.add("K30_E14_accuracy", BASE + ", " + VERDICTS + ", forced AS (SELECT event_id, strategy, CASE WHEN verdict <> 'neutral' THEN verdict WHEN character IN ('structural', 'mixed') THEN 'lean' ELSE 'fade' END AS v, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 2 = 1 THEN 'lean' ELSE 'fade' END AS e FROM verdicts) SELECT strategy, count(e) AS n_scored, round(avg((v = e)::int), 4) AS accuracy FROM forced GROUP BY 1")
def k30(spark, d):
    k = F.col("event_id")
    want = F.when(k % 4 != 0, F.when(k % 2 == 1, "lean").otherwise("fade"))
    rows = verdicts(spark, d).withColumn("match", G.forced(F.col("verdict"), F.col("character")) == want)
    return V.accuracy(rows, "strategy", "match")


DRAWN = "drawn AS (SELECT *, ['c' || substr(md5(event_id::varchar), 1, 1), 'c' || substr(md5(event_id::varchar), 2, 1), 'c' || substr(md5(event_id::varchar), 3, 1)][1 : (event_id % 4)] AS cites, ['c0', 'c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'c8', 'c9'] AS pool, " + " + ".join(f"w_{x}" for x in G.DIMENSIONS) + " + CASE WHEN event_id % 6 = 0 THEN 0.05 ELSE 0.0 END AS total, confidence + CASE WHEN event_id % 5 = 0 THEN 0.3 ELSE 0.0 END AS sure FROM attr)"


@REG.add("K13_J17_validation", BASE + ", " + DRAWN + " SELECT event_id, concat_ws(',', CASE WHEN NOT sure BETWEEN 0 AND 1 THEN 'confidence out of range' END, CASE WHEN abs(total - 1) > 0.02 THEN 'weights do not sum to 1' END, CASE WHEN len(cites) = 0 THEN 'no citation' END, CASE WHEN len(list_filter(cites, lambda x: NOT list_contains(pool, x))) > 0 THEN 'unknown citation' END) AS issues, array_to_string(CASE WHEN len(good) > 0 THEN list_filter(good, lambda x, i: list_position(good, x) = i) ELSE ['c0'] END, ',') AS cited, (len(cites) - len(good))::int AS dropped FROM (SELECT *, list_filter(cites, lambda x: list_contains(pool, x)) AS good FROM drawn)")
def k13(spark, d):
    """Citations drawn from the id's digest, against a pool of ten ids; weights and confidences that don't always hold."""
    k = F.col("event_id")
    digit = lambda i: F.concat(F.lit("c"), F.substring(F.md5(k.cast("string")), i, 1))
    cited = F.slice(F.array(digit(1), digit(2), digit(3)), F.lit(1), (k % 4).cast("int"))
    pool = F.array(*[F.lit(f"c{i}") for i in range(10)])
    weights = [F.col(f"w_{x}") for x in G.DIMENSIONS]
    weights[-1] = weights[-1] + F.when(k % 6 == 0, 0.05).otherwise(0.0)
    found = A.issues(weights, F.col("confidence") + F.when(k % 5 == 0, 0.3).otherwise(0.0), cited, pool)
    kept, dropped = A.sanitise(cited, pool)
    return attributions(spark, d).select("event_id", F.array_join(found, ",").alias("issues"), F.array_join(kept, ",").alias("cited"), dropped.alias("dropped"))


@REG.add("E18_ols_persistence", BASE + " SELECT count(*) AS n, " + ", ".join(f"round(sum(w_{a} * w_{b}), 6) AS {a}__{b}" for i, a in enumerate(G.DIMENSIONS) for b in G.DIMENSIONS[i:]) + ", " + ", ".join(f"round(sum(w_{a} * sign(return_pct) * fwd_5d), 6) + 0.0 AS {a}__y" for a in G.DIMENSIONS) + " FROM attr WHERE fwd_5d IS NOT NULL AND return_pct <> 0")
def e18(spark, d):
    rows = attributions(spark, d).where("fwd_5d is not null and return_pct <> 0").withColumn("y", F.signum("return_pct") * F.col("fwd_5d")).withColumnsRenamed({f"w_{x}": x for x in G.DIMENSIONS})
    m = V.ols_moments(rows, list(G.DIMENSIONS), "y")
    return rounded(m, *[c for c in m.columns if c != "n"])


@REG.add("J11_hash_normal", BASE + f" SELECT event_id, round(sqrt(-2 * ln(greatest({_hash(KEY, repr('u'))}, 1e-12))) * cos(2 * pi() * greatest({_hash(KEY, repr('v'))}, 1e-12)), 6) + 0.0 AS z FROM attr")
def j11(spark, d):
    return attributions(spark, d).select("event_id", r6(S.hash_normal(F.col("event_id").cast("string"))).alias("z"))


@REG.add("J12_E19_entropy", BASE + " SELECT event_id, round(-(" + " + ".join(f"w_{d} * ln(w_{d})" for d in G.DIMENSIONS) + f") / {math.log(5)!r}, 6) + 0.0 AS entropy FROM attr")
def j12(spark, d):
    return attributions(spark, d).select("event_id", r6(S.entropy_share([F.col(f"w_{x}") for x in G.DIMENSIONS])).alias("entropy"))


@REG.add("B07_cache_keys", BASE + " SELECT event_id, substr(sha256(concat_ws('|', ticker::varchar, event_date::varchar, '+positioning', 'v1')), 1, 24) AS cache_key FROM attr")
def b07(spark, d):
    return attributions(spark, d).select("event_id", A.cache_key(F.col("ticker").cast("string"), F.col("event_date"), F.lit("+positioning"), "v1").alias("cache_key"))


LADDER_SQL = """b(ablation, ord, s) AS (VALUES
  ('base_news', 0, ['news']),
  ('+sec', 1, ['news', 'sec_10k', 'sec_10q', 'sec_8k']),
  ('+earnings', 2, ['news', 'sec_10k', 'sec_10q', 'sec_8k', 'earnings_transcript']),
  ('+peer_news', 3, ['news', 'sec_10k', 'sec_10q', 'sec_8k', 'earnings_transcript', 'peer_news']),
  ('+sector_news', 4, ['news', 'sec_10k', 'sec_10q', 'sec_8k', 'earnings_transcript', 'peer_news', 'sector_news']),
  ('+macro', 5, ['news', 'sec_10k', 'sec_10q', 'sec_8k', 'earnings_transcript', 'peer_news', 'sector_news', 'macro']),
  ('+positioning', 6, ['news', 'sec_10k', 'sec_10q', 'sec_8k', 'earnings_transcript', 'peer_news', 'sector_news', 'macro', 'research_13f']))"""
#: Source types by the remainder of an id by their number, as the tables have none.
DRAWN_SOURCES = ("news", "sec_10k", "sec_10q", "sec_8k", "earnings_transcript", "peer_news", "sector_news", "macro", "research_13f", "thirteen_f")
DRAWN_SQL = "['news', 'sec_10k', 'sec_10q', 'sec_8k', 'earnings_transcript', 'peer_news', 'sector_news', 'macro', 'research_13f', 'thirteen_f']"


def drawn_source(key):
    return F.get(F.array(*[F.lit(x) for x in DRAWN_SOURCES]), (key % len(DRAWN_SOURCES)).cast("int"))


@REG.add("C26_ablation_filter", f"WITH {LADDER_SQL} SELECT ablation, source, count(*) AS n FROM (SELECT doc_id, {DRAWN_SQL}[doc_id % 10 + 1] AS source FROM documents), b WHERE list_contains(s, source) GROUP BY 1, 2")
def c26(spark, d):
    from eventloom.plans.base import table

    docs = table(spark, d, "documents").select(drawn_source(F.col("doc_id")).alias("source"))
    rungs = A.bundles(spark).select("ablation", F.explode("sources").alias("source"))
    return docs.join(F.broadcast(rungs), "source").groupBy("ablation", "source").agg(F.count(F.lit(1)).alias("n"))  # a few dozen rows


@REG.add("C27_smallest_bundle", f"WITH w AS (SELECT user_id || ':' || ts::date AS id, list(DISTINCT {DRAWN_SQL}[event_id % 10 + 1]) AS w FROM events GROUP BY 1), {LADDER_SQL} SELECT id, arg_min(ablation, ord) AS ablation FROM w LEFT JOIN b ON list_has_all(s, w) GROUP BY 1")
def c27(spark, d):
    """A user's day wants the sources of its events; one from a source outside the ladder has no bundle."""
    from eventloom.plans.base import table

    day = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.to_date("ts").cast("string"))
    wanted = table(spark, d, "events").groupBy(day.alias("id")).agg(F.collect_set(drawn_source(F.col("event_id"))).alias("sources"))
    return A.smallest_bundle(spark, wanted)


@REG.add("K37_once_per_evidence", "WITH r AS (SELECT user_id, event_type, list_sort(list(DISTINCT floor(value / 100)::int)) AS ids FROM events GROUP BY 1, 2) SELECT user_id, event_type, len(ids)::int AS n FROM r")
def k37(spark, d):
    from eventloom.plans.base import table

    r = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_set(F.floor(F.col("value") / 100).cast("string"))).alias("chunk_ids"))
    return A.once_per_evidence(r, lambda x: x.withColumn("n", F.size("chunk_ids"))).select("user_id", "event_type", "n")


CARD = (
    F05.rstrip()
    + """, fw AS (SELECT ticker, date, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM panel),
react AS (SELECT s.ticker * 100000 + date_diff('day', date '1990-01-01', s.move_date) AS event_id, s.ticker, s.move_date AS event_date, s.return_pct AS reaction_return, NULL::double AS vol_30d, NULL::double AS fwd_1d, fwd AS fwd_5d, NULL::double AS fwd_20d
  FROM significant s JOIN fw ON fw.ticker = s.ticker AND fw.date = s.move_date WHERE fwd IS NOT NULL), """
    + ATTR
    + ", v AS (SELECT *, 'model' AS strategy, " + SQL["fundamental_split"] + " AS verdict FROM attr UNION ALL " + " UNION ALL ".join(f"SELECT *, '{b}', {SQL[b]} FROM attr" for b in B.BASELINES) + ")"
    + """, t AS (SELECT *, CASE verdict WHEN 'lean' THEN sign(return_pct) WHEN 'fade' THEN -sign(return_pct) ELSE 0 END AS dir FROM v), p AS (SELECT *, dir * fwd_5d AS pnl FROM t)
SELECT ticker, strategy, count(*) AS n_events, count(*) FILTER (dir <> 0) AS n_trades, count(*) FILTER (pnl > 0) AS n_wins, round(sum(pnl * 10000), 2) + 0.0 AS total_dollars,
  round(coalesce(avg((pnl > 0)::int) FILTER (dir <> 0), 0.0), 4) + 0.0 AS hit_rate, round(coalesce(avg(pnl) FILTER (dir <> 0), 0.0), 6) + 0.0 AS avg_return,
  round(coalesce(CASE WHEN stddev_samp(pnl) FILTER (dir <> 0) > 0 THEN avg(pnl) FILTER (dir <> 0) / stddev_samp(pnl) FILTER (dir <> 0) * sqrt(252 / 5.0) END, 0.0), 4) + 0.0 AS sharpe,
  count(*) FILTER (dir <> 0)::int AS n_points, floor(((sum(floor(pnl * 10000 * 1000000 + 0.5)::bigint) FILTER (dir <> 0))::double + 5000) / 10000) / 100 AS last_equity FROM p GROUP BY 1, 2"""
)


@REG.add("K28_K28a_cards", CARD)
def k28a(spark, d):
    """Cards over the panel's significant moves, with the close five bars on."""
    bars = panel(spark, d)
    ahead = bars.select("ticker", "date", P.forward_return("close", 5).alias("fwd_5d"))
    found = P.significant_moves(bars).join(ahead.withColumnRenamed("date", "move_date"), ["ticker", "move_date"])
    moves = found.select((F.col("ticker") * 100000 + F.datediff("move_date", F.lit("1990-01-01").cast("date"))).alias("event_id"), "ticker", F.col("move_date").alias("event_date"), "return_pct", F.lit(0.0).alias("z"), "fwd_5d")
    cards = B.pnl_cards(A.placeholder(moves))
    last = F.element_at("equity_curve", -1)["equity"]
    out = cards.select(*[c for c in cards.columns if c != "equity_curve"], F.size("equity_curve").alias("n_points"), F.when(F.size("equity_curve") > 0, last).alias("last_equity"))
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("total_dollars", "hit_rate", "avg_return", "sharpe")})
