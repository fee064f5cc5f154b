"""Queries that join moves to evidence, score it, and unify sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import scoring as S
from eventloom.functions.dates import announcement, eastern_minutes, last_quarter_end, publication, quarter_label
from eventloom.operators import evidence as E
from eventloom.operators import holdings as H
from eventloom.operators import reactions as R
from eventloom.operators import relevance as V
from eventloom.operators import unify as U
from eventloom.operators.panel import to_places
from eventloom.plans.base import MOVES, UNIFIED, Registry, moves, r6, rounded, table, unified_events, with_

REG = Registry()

DAYS = "days AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT ts::date AS date FROM events)), top AS (SELECT max(ord) AS hi FROM days)"
WINDOWS = "windows AS (SELECT m.*, (SELECT date FROM days WHERE ord = greatest(a.ord - 5, 1)) AS window_start, (SELECT date FROM days, top WHERE ord = least(a.ord + 1, hi)) AS window_end FROM moves m JOIN days a ON a.date = m.move_date)"
PRIORITY = "CASE event_type WHEN 'short_report' THEN 1 WHEN 'earnings_release' THEN 2 WHEN 'analyst_rating_change' THEN 3 WHEN 'news' THEN 4 WHEN '13f_delta' THEN 6 ELSE 8 END"
JOINED = f"joined AS (SELECT w.move_id, w.ticker, w.move_date, w.window_start, w.window_end, e.event_id, e.event_type, e.event_date, abs(date_diff('day', w.move_date, e.event_date)) AS distance, {PRIORITY} AS priority FROM windows w JOIN unified e ON e.ticker = w.ticker AND e.event_date BETWEEN w.window_start AND w.window_end), ranked AS (SELECT *, row_number() OVER (PARTITION BY move_id ORDER BY distance, priority, event_id) AS rank FROM joined)"
BASE = with_(MOVES, UNIFIED, DAYS, WINDOWS)


def _days(spark, d):
    return E.calendar(unified_events(spark, d), "event_date")


@REG.add("J05_trading_windows", with_(MOVES, DAYS, WINDOWS) + "SELECT move_id, move_date, window_start, window_end FROM windows")
def j05(spark, d):
    return E.trading_windows(moves(spark, d), _days(spark, d)).select("move_id", "move_date", "window_start", "window_end")


@REG.add("D06_G01_window_join", with_(MOVES, UNIFIED, DAYS, WINDOWS, JOINED) + "SELECT move_id, ticker, move_date, event_id, event_type, event_date, distance::int AS distance, priority::int AS priority, rank::int AS rank FROM ranked WHERE rank <= 30")
def d06(spark, d):
    return E.window_join(moves(spark, d), unified_events(spark, d), _days(spark, d)).select("move_id", "ticker", "move_date", "event_id", "event_type", "event_date", "distance", "priority", "rank")


@REG.add("K05_joined_evidence", with_(MOVES, UNIFIED, DAYS, WINDOWS, JOINED) + "SELECT move_id, ticker, move_date, window_start, window_end, count(*) AS n_events, string_agg(event_id::varchar, ',' ORDER BY rank) AS event_ids FROM ranked WHERE rank <= 30 GROUP BY ALL")
def k05(spark, d):
    rows = E.nested(E.window_join(moves(spark, d), unified_events(spark, d), _days(spark, d)))
    return rows.select("move_id", "ticker", "move_date", "window_start", "window_end", F.size("events").cast("long").alias("n_events"), F.array_join(F.transform("events", lambda e: e["event_id"].cast("string")), ",").alias("event_ids"))


@REG.add("D08_earnings_day", with_(MOVES) + "SELECT move_id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = ticker AND o_orderdate::date = move_date) AS earnings_day FROM moves")
def d08(spark, d):
    marks = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"))
    return E.flag_days(moves(spark, d), marks).select("move_id", "earnings_day")


CHUNKS = "chunks AS (SELECT 'news_' || doc_id AS chunk_id, doc_id % 150 AS ticker, date '2024-01-01' + (doc_id % 60)::int AS publication_date, source AS publisher, text FROM documents)"


def chunks(spark, d):
    """(chunk_id, ticker, publication_date, publisher, text) from documents."""
    start = F.lit("2024-01-01").cast("date")
    return table(spark, d, "documents").select(F.concat(F.lit("news_"), F.col("doc_id").cast("string")).alias("chunk_id"), (F.col("doc_id") % 150).alias("ticker"), F.date_add(start, (F.col("doc_id") % 60).cast("int")).alias("publication_date"), F.col("source").alias("publisher"), "text")


@REG.add(
    "D07_chunk_join",
    with_(MOVES, DAYS, WINDOWS, CHUNKS)
    + "SELECT move_id, chunk_id, min(via)::int AS via FROM (SELECT move_id, chunk_id, 0 AS via FROM windows w JOIN chunks c ON c.ticker = w.ticker AND publication_date BETWEEN window_start AND window_end UNION ALL SELECT move_id, chunk_id, 1 FROM windows w JOIN chunks c ON c.chunk_id = 'news_' || (w.move_id % 1000)) GROUP BY 1, 2",
)
def d07(spark, d):
    span = E.trading_windows(moves(spark, d), _days(spark, d))
    refs = span.select("move_id", F.concat(F.lit("news_"), (F.col("move_id") % 1000).cast("string")).alias("payload_ref"))
    return E.chunk_join(span.select("move_id", "ticker", "window_start", "window_end"), chunks(spark, d), refs)


BDAYS = "bd AS (SELECT date, isodow(date) - 1 AS wd FROM (SELECT DISTINCT ts::date AS date FROM events))"


def _bday_sql(n: int) -> str:
    """The n-th weekday by counting days one by one."""
    if n == 0:
        return "(SELECT min(x) FROM range(date, date + interval 3 day, interval 1 day) t(x) WHERE isodow(x) < 6)::date"
    if n < 0:
        return f"(SELECT x FROM range(date - interval {-n * 2 + 6} day, date, interval 1 day) t(x) WHERE isodow(x) < 6 ORDER BY x DESC LIMIT 1 OFFSET {-n - 1})::date"
    return f"(SELECT x FROM range(date + interval 1 day, date + interval {n * 2 + 7} day, interval 1 day) t(x) WHERE isodow(x) < 6 ORDER BY x LIMIT 1 OFFSET {n - 1})::date"


@REG.add("J04_business_days", with_(BDAYS) + "SELECT date, " + ", ".join(f"{_bday_sql(n)} AS b{'m' if n < 0 else 'p'}{abs(n)}" for n in (-7, -5, -1, 0, 1, 6)) + " FROM bd")
def j04(spark, d):
    rows = unified_events(spark, d).select(F.col("event_date").alias("date")).distinct()
    return rows.select("date", *(E.business_day(F.col("date"), n).alias(f"b{'m' if n < 0 else 'p'}{abs(n)}") for n in (-7, -5, -1, 0, 1, 6)))


@REG.add("D12_nearest_date", with_(MOVES) + "SELECT move_id, arg_min(o_orderdate::date, abs(date_diff('day', move_date, o_orderdate::date)) * 100000 + date_diff('day', date '1990-01-01', o_orderdate::date)) AS nearest FROM moves JOIN orders ON o_custkey = ticker GROUP BY 1")
def d12(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("other"))
    return E.nearest_dates(moves(spark, d), o).select("move_id", "nearest")


@REG.add("D13_K43_latest_move", with_(MOVES, UNIFIED) + "SELECT event_id, e.ticker, event_date, max(move_date) AS last_move FROM unified e JOIN moves m ON m.ticker = e.ticker AND m.move_date <= e.event_date GROUP BY 1, 2, 3")
def d13(spark, d):
    """The latest move on or before each event, from one merged and sorted series per ticker."""
    from pyspark.sql import Window as W

    m = moves(spark, d).select("ticker", F.col("move_date").alias("at"), F.col("move_date").alias("m"), F.lit(0).alias("k"))
    rows = unified_events(spark, d).withColumns({"at": F.col("event_date"), "k": F.lit(1)}).unionByName(m, allowMissingColumns=True)
    w = W.partitionBy("ticker").orderBy("at", "k").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("last_move", F.last("m", ignorenulls=True).over(w)).where("k = 1 and last_move is not null").select("event_id", "ticker", "event_date", "last_move")


SCORED_SRC = "CASE doc_id % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'peer_news' WHEN 2 THEN 'sec_10k' ELSE 'macro' END"
PUB = "CASE source WHEN 'src1' THEN 'Reuters' WHEN 'src2' THEN 'The Motley Fool' WHEN 'src3' THEN '' ELSE source END"
SCORED = f"""scored AS (
  SELECT move_id, 'c' || doc_id AS chunk_id, src, publisher, date '2024-01-01' + (doc_id % 45)::int AS published, move_date,
    least(1.0, CASE src WHEN 'news' THEN 0.70 WHEN 'peer_news' THEN 0.55 WHEN 'sec_10k' THEN 1.00 ELSE 0.80 END *
      CASE WHEN src NOT IN ('news', 'peer_news') THEN 1.0 WHEN publisher = '' THEN 0.85 WHEN publisher = 'Reuters' THEN 1.10 WHEN publisher = 'The Motley Fool' THEN 0.65 ELSE 0.85 END) AS quality,
    CASE src WHEN 'news' THEN 7.0 WHEN 'peer_news' THEN 5.0 WHEN 'sec_10k' THEN 180.0 ELSE 21.0 END AS half_life,
    CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN src = 'peer_news' THEN 0.60 WHEN src = 'macro' THEN 0.50 ELSE 0.30 END AS align
  FROM moves JOIN (SELECT *, {SCORED_SRC} AS src, {PUB} AS publisher FROM documents) ON doc_id % 150 = ticker),
final AS (SELECT *, CASE WHEN published > move_date THEN 0.0 ELSE exp(-ln(2) * date_diff('day', published, move_date) / half_life) END AS recency FROM scored),
scores AS (SELECT *, round(quality * recency * align, 9) AS score FROM final)"""


def chunk_rows(spark, d):
    """Documents as chunks of a ticker."""
    k = F.col("doc_id")
    src = F.when(k % 4 == 0, "news").when(k % 4 == 1, "peer_news").when(k % 4 == 2, "sec_10k").otherwise("macro")
    pub = F.when(F.col("source") == "src1", "Reuters").when(F.col("source") == "src2", "The Motley Fool").when(F.col("source") == "src3", "").otherwise(F.col("source"))
    return table(spark, d, "documents").select((k % 150).alias("ticker"), F.concat(F.lit("c"), k.cast("string")).alias("chunk_id"), src.alias("src"), pub.alias("publisher"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 45).cast("int")).alias("published"), F.when(k % 3 == 0, (k % 150).cast("string")).otherwise("other").alias("chunk_ticker"))


def scored(spark, d):
    """All chunks of each move's ticker with their score."""
    rows = moves(spark, d).select("move_id", "ticker", "move_date").join(chunk_rows(spark, d), "ticker")
    s = V.score(F.col("src"), F.col("publisher"), F.col("published"), F.col("move_date"), F.col("chunk_ticker"), F.col("ticker").cast("string"))
    return rows.withColumn("score", F.round(s, 9))


def best(spark, d):
    """Of each move's chunks those that may be kept."""
    return V.best_scored(moves(spark, d).select("move_id", "ticker", "move_date"), chunk_rows(spark, d))


def kept(spark, d):
    return V.filter_and_rank(best(spark, d), pool="pool")


@REG.add("J06_J09_scores", with_(MOVES, SCORED) + "SELECT move_id, chunk_id, round(score, 6) + 0.0 AS score FROM scores")
def j09(spark, d):
    return rounded(scored(spark, d).select("move_id", "chunk_id", "score"), "score")


G02 = "kept AS (SELECT move_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY move_id ORDER BY score DESC, chunk_id) AS rank, count(*) OVER (PARTITION BY move_id) AS n, count(*) FILTER (score >= 0.02) OVER (PARTITION BY move_id) AS good FROM scores) WHERE rank <= CASE WHEN n <= 5 THEN n ELSE least(least(50, greatest(5, round_even(n * 0.75, 0))), greatest(good, 5)) END)"


@REG.add("G02_filter_and_rank", with_(MOVES, SCORED, G02) + "SELECT move_id, chunk_id, rank::int AS rank FROM kept")
def g02(spark, d):
    return kept(spark, d).select("move_id", "chunk_id", "rank")


@REG.add("I19_weight_tags", with_(MOVES, SCORED) + "SELECT move_id, chunk_id, '[EVIDENCE_WEIGHT ' || CASE WHEN s >= 0.75 THEN 'HIGH' WHEN s >= 0.40 THEN 'MED' ELSE 'LOW' END || printf(' (%.2f)] ', s) || chunk_id AS tagged FROM (SELECT *, round(score::decimal(28, 9), 2)::double AS s FROM scores)")
def i19(spark, d):
    s = to_places(F.col("score"), 2)
    old = F.concat(F.lit("[EVIDENCE_WEIGHT LOW (0.00)] "), F.col("chunk_id"))
    return scored(spark, d).select("move_id", "chunk_id", S.tag_weight(old, s).alias("tagged"))


@REG.add("G03_interleave", with_(MOVES, SCORED) + ", turns AS (SELECT *, row_number() OVER (PARTITION BY move_id, src ORDER BY published DESC, chunk_id) AS turn FROM scores) SELECT move_id, chunk_id, row_number() OVER (PARTITION BY move_id ORDER BY turn, src)::int AS place FROM turns")
def g03(spark, d):
    # a chunk's place is the same for all moves of its ticker, so the order is made once
    placed = V.interleave(chunk_rows(spark, d), "ticker", "src", "published", "chunk_id").select("ticker", "chunk_id", "place")
    return moves(spark, d).select("move_id", "ticker").join(placed, "ticker").select("move_id", "chunk_id", "place")


@REG.add("G04_G05_prefix_or_cited", with_(MOVES, SCORED, G02) + "SELECT move_id, chunk_id FROM kept WHERE rank <= 3 OR chunk_id LIKE '%7'")
def g05(spark, d):
    return V.prefix_or_cited(kept(spark, d).withColumn("cited", F.col("chunk_id").endswith("7")), 3).select("move_id", "chunk_id")


@REG.add("E16_counts_by_source", with_(MOVES, SCORED) + "SELECT move_id, src, count(*) AS n FROM scores GROUP BY 1, 2")
def e16(spark, d):
    by = chunk_rows(spark, d).groupBy("ticker", "src").agg(F.count(F.lit(1)).alias("n"))
    return moves(spark, d).select("move_id", "ticker").join(by, "ticker").select("move_id", "src", "n")


@REG.add("E21_window_bounds", with_(MOVES, SCORED, G02) + "SELECT k.move_id, min(published) AS window_start, least(max(published), any_value(move_date)) AS window_end FROM kept k JOIN scores s ON s.move_id = k.move_id AND s.chunk_id = k.chunk_id WHERE rank <= 30 GROUP BY 1")
def e21(spark, d):
    return kept(spark, d).where("rank <= 30").groupBy("move_id").agg(F.min("published").alias("window_start"), F.least(F.max("published"), F.first("move_date")).alias("window_end"))


@REG.add("H02_article_dedupe", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)), source ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def h02(spark, d):
    # the title is only a key, so its hash goes through the shuffle
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("title"), "source")
    return rows.groupBy("title", "source").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@REG.add("H03_keyed_override", "SELECT o_custkey, o_orderkey, 'orders' AS origin FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) UNION ALL SELECT c_custkey, -1, 'customer' FROM customer WHERE c_custkey % 3 = 0")
def h03(spark, d):
    base = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit("orders").alias("origin"))
    over = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("long").alias("o_orderkey"), F.lit("customer").alias("origin"))
    return V.override(base, over, ["o_custkey"])


@REG.add("H06_null_safe_dedupe", "SELECT event_id FROM (SELECT event_id, CASE WHEN value > 100 THEN user_id END AS url, row_number() OVER (PARTITION BY CASE WHEN value > 100 THEN user_id END ORDER BY event_id) AS k FROM events) WHERE url IS NULL OR k = 1")
def h06(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("value") > 100, F.col("user_id")).alias("url"))
    return V.dedupe_present(rows, "url", ["event_id"]).select("event_id")


@REG.add("H04_H07_first_wins", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def h07(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return rows.groupBy("l_suppkey").agg(F.min(F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("x")).select("l_suppkey", "x.l_orderkey", "x.l_linenumber")


@REG.add("H05_F24_evidence_rungs", "WITH r AS (SELECT user_id, event_type, list_sort(list(DISTINCT event_id)) AS ids FROM events GROUP BY 1, 2), o AS (SELECT user_id, event_type, ids, lag(ids) OVER (PARTITION BY user_id ORDER BY event_type) AS prev FROM r) SELECT user_id, event_type, len(list_filter(ids, lambda x: prev IS NULL OR NOT list_contains(prev, x)))::int AS n_new FROM o")
def f24(spark, d):
    """Ids of a rung that the one before lacks, by an anti-join; no key's ids are gathered in a set."""
    from pyspark.sql import Window as W

    ids = table(spark, d, "events").select("user_id", "event_type", "event_id").distinct()
    rungs = ids.select("user_id", "event_type").distinct().withColumn("prev", F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_type")))
    before = ids.select("user_id", F.col("event_type").alias("prev"), "event_id")
    new = ids.join(rungs, ["user_id", "event_type"]).join(before, ["user_id", "prev", "event_id"], "left_anti")
    counted = new.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("int").alias("n_new"))
    return rungs.drop("prev").join(counted, ["user_id", "event_type"], "left").fillna(0, ["n_new"])


def _union_sql() -> str:
    return """WITH e AS (
  SELECT 'earnings_' || o_custkey || '_' || o_orderdate::date AS event_id, o_custkey::varchar AS ticker, o_orderdate::date AS event_date, 'earnings_release' AS event_type, 'earnings_calendar' AS source FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'r' || event_id, user_id::varchar, ts::date, 'analyst_rating_change', 'firm ' || (event_id % 7) FROM events WHERE event_type = 'signup'
  UNION ALL SELECT 'x' || event_id || '_announcement', user_id::varchar, ts::date - 5, 'index_change_announcement', 'index' FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'x' || event_id || '_effective', user_id::varchar, ts::date, 'index_change_effective', 'index' FROM events WHERE event_type = 'view')
SELECT * FROM e WHERE event_date <= date '2024-01-20'"""


@REG.add("H01_K02_K04_unified_events", _union_sql())
def k04(spark, d):
    ev = table(spark, d, "events")
    cal = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("report_date"), F.lit("pre").alias("time"))
    rate = ev.where("event_type = 'signup'").select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("rating_id"), F.col("user_id").alias("ticker"), F.concat(F.lit("firm "), (F.col("event_id") % 7).cast("string")).alias("analyst_firm"), F.lit("upgrade").alias("action"), F.lit("Buy").alias("new_rating"), F.lit("Hold").alias("prior_rating"), F.to_date("ts").alias("action_date"))
    idx = ev.where("event_type = 'view'").select(F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("change_id"), F.lit("index").alias("index_name"), F.lit("add").alias("action"), F.col("user_id").alias("ticker"), announcement(F.to_date("ts")).alias("announcement_date"), F.to_date("ts").alias("effective_date"))
    return U.union([U.earnings(cal), U.ratings(rate), U.index_changes(idx)], F.lit("2024-01-20").cast("date")).select("event_id", "ticker", "event_date", "event_type", "source")


@REG.add("K02g_short_interest_events", "WITH s AS (SELECT l_suppkey AS ticker, l_shipdate::date AS settlement_date, sum(l_quantity::bigint)::bigint AS value FROM lineitem GROUP BY 1, 2), p AS (SELECT *, lag(value) OVER (PARTITION BY ticker ORDER BY settlement_date) AS prior FROM s) SELECT 'si_' || ticker || '_' || settlement_date AS event_id, ticker::varchar AS ticker, settlement_date + 14 AS event_date, 'short_interest_spike' AS event_type FROM p WHERE prior > 0 AND (value - prior)::double / prior > 0.2")
def k02g(spark, d):
    from eventloom.operators.panel import period_spikes, series

    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("settlement_date")).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    return U.short_interest(period_spikes(s, "value", w=series("ticker", "settlement_date"))).select("event_id", "ticker", "event_date", "event_type")


@REG.add(
    "K01_D04_holding_deltas",
    """WITH h AS (SELECT o_custkey % 40 AS fund, l_partkey % 200 AS asset, CASE WHEN o_orderdate < timestamp '1998-01-01' THEN 0 ELSE 1 END AS period, sum(l_quantity::bigint)::bigint AS shares, sum(round(l_extendedprice * 100)::bigint)::bigint AS market_value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
a AS (SELECT * FROM h WHERE period = 1), b AS (SELECT * FROM h WHERE period = 0 AND fund IN (SELECT fund FROM a))
SELECT coalesce(a.fund, b.fund) AS fund, coalesce(a.asset, b.asset) AS asset, CASE WHEN b.shares IS NULL THEN 'NEW' WHEN a.shares IS NULL THEN 'EXITED' WHEN a.shares > b.shares THEN 'INCREASED' ELSE 'REDUCED' END AS action, b.shares AS prior_shares, a.shares AS current_shares, coalesce(a.shares, 0) - coalesce(b.shares, 0) AS shares_change, coalesce(a.market_value, 0) - coalesce(b.market_value, 0) AS market_value_change
FROM a FULL JOIN b ON a.fund = b.fund AND a.asset = b.asset WHERE a.shares IS DISTINCT FROM b.shares""",
)
def k01(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select((F.col("o_custkey") % 40).alias("fund"), (F.col("l_partkey") % 200).alias("asset"), (F.col("o_orderdate") >= "1998-01-01").alias("late"), F.col("l_quantity").cast("long").alias("shares"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("market_value"))
    half = lambda late: rows.where(F.col("late") == late).groupBy("fund", "asset").agg(F.sum("shares").alias("shares"), F.sum("market_value").alias("market_value"))
    return H.deltas(half(True), half(False), "fund", "asset")


@REG.add("E05_holdings_rollup", "WITH h AS (SELECT o_custkey % 40 AS fund, l_partkey % 200 AS asset, sum(l_quantity::bigint)::bigint AS shares, sum(round(l_extendedprice * 100)::bigint)::bigint AS market_value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT fund, asset, shares, market_value, round(100.0::double * market_value / sum(market_value) OVER (PARTITION BY fund), 3) AS percent FROM h")
def e05(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select((F.col("o_custkey") % 40).alias("fund"), (F.col("l_partkey") % 200).alias("asset"), F.col("l_quantity").cast("long").alias("shares"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("market_value"))
    return H.roll_up(rows, "fund", "asset")


RATING = "CASE event_id % 6 WHEN 0 THEN 'Strong Buy' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Underweight' WHEN 3 THEN 'Peer Perform' WHEN 4 THEN 'Speculative' ELSE '' END"
BUCKET = "CASE {0} WHEN 'Strong Buy' THEN 'Buy' WHEN 'Neutral' THEN 'Hold' WHEN 'Underweight' THEN 'Sell' WHEN 'Peer Perform' THEN 'Hold' WHEN 'Speculative' THEN 'Speculative' END"
ORD = "CASE {0} WHEN 'Strong Buy' THEN 2 WHEN 'Neutral' THEN 1 WHEN 'Underweight' THEN 0 WHEN 'Peer Perform' THEN 1 END"


@REG.add(
    "C13_C14_ratings",
    f"WITH r AS (SELECT event_id, {RATING} AS prior, {RATING.replace('event_id %', '(event_id // 6) %')} AS new, CASE event_id % 5 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS hint FROM events) SELECT event_id, {BUCKET.format('prior')} AS bucket, CASE WHEN prior = '' THEN 'initiate' WHEN {ORD.format('new')} > {ORD.format('prior')} THEN 'upgrade' WHEN {ORD.format('new')} < {ORD.format('prior')} THEN 'downgrade' WHEN {ORD.format('new')} = {ORD.format('prior')} THEN 'reiterate' WHEN hint = 'up' THEN 'upgrade' WHEN hint = 'down' THEN 'downgrade' ELSE 'reiterate' END AS action FROM r",
)
def c14(spark, d):
    pick = lambda k: F.get(F.array(*[F.lit(x) for x in ("Strong Buy", "Neutral", "Underweight", "Peer Perform", "Speculative", "")]), (k % 6).cast("int"))
    k = F.col("event_id")
    rows = table(spark, d, "events").select(k, pick(k).alias("prior"), pick(F.floor(k / 6)).alias("new"), F.when(k % 5 == 0, "up").when(k % 5 == 1, "down").alias("hint"))
    return rows.select("event_id", S.rating_bucket(F.col("prior")).alias("bucket"), S.rating_action(F.col("prior"), F.col("new"), F.col("hint")).alias("action"))


@REG.add("C15_C16_targets", "WITH t AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.0 WHEN event_id % 9 = 1 THEN NULL ELSE value END AS prior, value * (0.5 + (event_id % 3) * 0.5) AS new FROM events) SELECT event_id, CASE WHEN nullif(prior, 0) IS NULL THEN 'initiate' WHEN new > prior THEN 'raise' WHEN new < prior THEN 'lower' ELSE 'maintain' END AS direction, round(CASE WHEN prior > 0 THEN (new - prior) / prior END, 6) + 0.0 AS change FROM t")
def c16(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(k, F.when(k % 9 == 0, 0.0).when(k % 9 == 1, F.lit(None)).otherwise(F.col("value")).alias("prior"), (F.col("value") * (0.5 + (k % 3) * 0.5)).alias("new"))
    return rows.select("event_id", S.target_direction(F.col("prior"), F.col("new")).alias("direction"), r6(S.target_change(F.col("prior"), F.col("new"))).alias("change"))


COERCED = "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '  ' WHEN event_id % 11 = 1 THEN ' None' WHEN event_id % 11 = 2 THEN 'NaN ' WHEN event_id % 11 = 3 THEN event_type ELSE ' ' || floor(value * 10)::bigint || '.' || (event_id % 10) END AS t FROM events"


@REG.add("C17_C18_coercion", f"SELECT event_id, CASE WHEN try_cast(trim(t) AS double) < 999 THEN try_cast(trim(t) AS double) END AS days_to_cover, CASE WHEN lower(trim(t)) NOT IN ('', 'nan', 'none', 'null') THEN trim(t) END AS optional FROM ({COERCED})")
def c17(spark, d):
    from eventloom.functions.text import optional

    k = F.col("event_id")
    number = F.concat(F.lit(" "), F.floor(F.col("value") * 10).cast("string"), F.lit("."), (k % 10).cast("string"))
    t = F.when(k % 11 == 0, "  ").when(k % 11 == 1, " None").when(k % 11 == 2, "NaN ").when(k % 11 == 3, F.col("event_type")).otherwise(number)
    return table(spark, d, "events").select("event_id", S.days_to_cover(t).alias("days_to_cover"), optional(t).alias("optional"))


@REG.add("C19_C22_dates", "SELECT event_id, d - 5 AS announced, d + 14 AS published, CASE WHEN month(d) = 12 AND day(d) = 31 THEN d ELSE (date_trunc('quarter', d) - interval 1 day)::date END AS quarter_end, year(d) || 'Q' || quarter(d) AS quarter FROM (SELECT o_orderkey AS event_id, o_orderdate::date AS d FROM orders)")
def c22(spark, d):
    c = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), announcement(c).alias("announced"), publication(c).alias("published"), last_quarter_end(c, exact=False).alias("quarter_end"), quarter_label(c).alias("quarter"))


@REG.add("J03_C09_sessions", "SELECT event_id, m::int AS minutes, CASE WHEN m <= 570 THEN 'BMO' WHEN m >= 960 THEN 'AMC' WHEN m IS NOT NULL THEN 'INTRADAY' END AS session FROM (SELECT event_id, (date_part('hour', t) * 60 + date_part('minute', t)) AS m FROM (SELECT event_id, ts - CASE WHEN ts >= timestamp '2024-03-10 07:00:00' AND ts < timestamp '2024-11-03 06:00:00' THEN interval 4 hour ELSE interval 5 hour END AS t FROM events))")
def c09(spark, d):
    rows = table(spark, d, "events").select("event_id", eastern_minutes(F.col("ts")).alias("minutes"))
    return rows.withColumn("session", R.session_tag(F.col("minutes")))


TAGGED = "tagged AS (SELECT event_id, user_id AS ticker, ts::date AS date, ts, (date_part('hour', ts) * 60 + date_part('minute', ts))::int AS minutes FROM events), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY (minutes <= 570 OR minutes >= 960) DESC, ts, event_id) AS k FROM tagged) WHERE k = 1), tag AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL WHEN minutes <= 570 THEN 'BMO' WHEN minutes >= 960 THEN 'AMC' ELSE 'INTRADAY' END AS t FROM best)"
CONS = "cons AS (SELECT ticker, arg_max(t, n * 10 + CASE t WHEN 'BMO' THEN 1 ELSE 0 END) AS tag, max(n) / sum(n) AS share FROM (SELECT ticker, t, count(*) AS n FROM tag WHERE t IN ('BMO', 'AMC') GROUP BY 1, 2) GROUP BY 1 HAVING max(n) / sum(n) >= 0.55)"


def _filings(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("ticker"), F.to_date(ts).alias("date"), ts, (F.hour(ts) * 60 + F.minute(ts)).alias("minutes"))


@REG.add("F21_best_filing", with_(TAGGED) + "SELECT ticker, date, event_id, minutes FROM best")
def f21(spark, d):
    return R.best_filing(_filings(spark, d)).select("ticker", "date", "event_id", "minutes")


def _tagged(spark, d):
    return R.best_filing(_filings(spark, d)).withColumn("tag", F.when(F.col("event_id") % 7 != 0, R.session_tag(F.col("minutes"))))


@REG.add("E01_consensus_tag", with_(TAGGED, CONS) + "SELECT ticker, tag, round(share, 6) AS share FROM cons")
def e01(spark, d):
    # BMO wins a tie of counts because it sorts last
    return R.consensus_tag(_tagged(spark, d), 0.55).select("ticker", "tag", F.round("share", 6).alias("share"))


@REG.add("C30_resolve_session", with_(TAGGED, CONS) + "SELECT event_id, CASE WHEN t IN ('BMO', 'AMC') THEN t ELSE tag END AS session, CASE WHEN t IS NULL THEN 'ticker_consensus' WHEN t = 'INTRADAY' THEN 'sec_8k_intraday_corrected' ELSE 'sec_8k' END AS time_source FROM tag LEFT JOIN cons USING (ticker) WHERE CASE WHEN t IN ('BMO', 'AMC') THEN t ELSE tag END IN ('BMO', 'AMC')")
def c30(spark, d):
    t = _tagged(spark, d)
    return R.resolve_session(t, R.consensus_tag(t, 0.55)).select("event_id", "session", "time_source")


@REG.add("E17_shared_dates", "SELECT l_shipdate::date AS date, max(CASE WHEN l_suppkey = 1 THEN 1 ELSE 0 END)::int AS a, max(CASE WHEN l_suppkey = 2 THEN 1 ELSE 0 END)::int AS b FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2")
def e17(spark, d):
    rows = table(spark, d, "lineitem").where("l_suppkey in (1, 2)").select(F.to_date("l_shipdate").alias("date"), "l_suppkey")
    return rows.groupBy("date").agg(F.max((F.col("l_suppkey") == 1).cast("int")).alias("a"), F.max((F.col("l_suppkey") == 2).cast("int")).alias("b")).where("a = 1 and b = 1")


@REG.add("F20_sequence_ids", "SELECT o_orderkey, 'ord_' || o_custkey || '_' || lpad(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::varchar, 3, '0') AS seq_id FROM orders")
def f20(spark, d):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", F.format_string("ord_%d_%03d", F.col("o_custkey"), n).alias("seq_id"))


@REG.add("K45_D15_prewarm_plan", "SELECT user_id, rung::int AS rung FROM (SELECT DISTINCT user_id FROM events), range(7) r(rung) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = q.user_id AND e.event_type = 'view' AND e.event_id % 7 = rung)".replace("FROM events), range", "FROM events) q, range"))
def k45(spark, d):
    """Each ticker and rung that the cache (here: a ticker's views) lacks; the seven rungs are a constant."""
    cells = table(spark, d, "events").select("user_id").distinct().withColumn("rung", F.explode(F.sequence(F.lit(0), F.lit(6))))
    cached = table(spark, d, "events").where("event_type = 'view'").select("user_id", (F.col("event_id") % 7).cast("int").alias("rung")).distinct()
    return cells.join(cached, ["user_id", "rung"], "left_anti")


ASSEMBLED = """, streams AS (
  SELECT ticker, chunk_id, source_type, publication_date, 0 AS stream FROM (
    SELECT doc_id % 150 AS ticker, 'k' || doc_id AS chunk_id, 'sec_10k' AS source_type, date '2024-01-01' + (doc_id % 45)::int AS publication_date FROM documents WHERE lang = 'en'
    UNION ALL SELECT doc_id % 150, 'k' || doc_id, 'sec_8k', date '2024-01-02' + (doc_id % 45)::int FROM documents WHERE lang IS DISTINCT FROM 'en')
  UNION ALL SELECT user_id, 'n' || event_id, 'news', ts::date, 1 FROM events WHERE event_type = 'click'
  UNION ALL SELECT user_id, 'f' || event_id, 'thirteen_f', ts::date, 2 FROM events WHERE event_type = 'signup'
  UNION ALL SELECT o_custkey, 't' || o_orderkey, 'earnings_transcript', o_orderdate::date, 3 FROM orders
  UNION ALL SELECT c_nationkey, 'p' || c_custkey, 'peer_news', date '2024-01-01' + (c_custkey % 30)::int, 4 FROM customer
  UNION ALL SELECT s_nationkey, 's' || s_suppkey, 'sector_news', date '2024-01-01' + (s_suppkey % 30)::int, 5 FROM supplier
  UNION ALL SELECT NULL, 'm' || n_nationkey, 'macro', date '2024-01-01' + n_nationkey::int, 6 FROM nation)
SELECT move_id, chunk_id, row_number() OVER (PARTITION BY move_id ORDER BY turn, stream, source_type)::int AS place FROM (
  SELECT move_id, chunk_id, source_type, stream, row_number() OVER (PARTITION BY move_id, source_type ORDER BY publication_date DESC, chunk_id) AS turn
  FROM moves m JOIN streams s ON (s.ticker = m.ticker OR s.source_type = 'macro') AND s.publication_date <= m.move_date)"""


@REG.add("K06_K49_assembled", with_(MOVES).rstrip() + ASSEMBLED)
def k06a(spark, d):
    """A move's chunks from eight streams over six tables: sectioned and staged filings (English documents have both), news, holdings,
    transcripts, peers' and sector's news, and macro chunks, which have no ticker. Filings are chosen before moves meet them, and a
    move's date goes along into each join, so the one shuffle by move holds only what is listed."""
    from eventloom.operators.pipelines import assemble

    m = moves(spark, d).select("move_id", "ticker", "move_date")
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), n.cast("int"))
    row = lambda rows, ticker, id_, kind, date: rows.select(ticker.alias("ticker"), id_.alias("chunk_id"), F.lit(kind).alias("source_type"), date.alias("publication_date"))
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    until = lambda rows: rows.where("publication_date <= move_date").drop("move_date")
    own = lambda rows: until(m.join(rows, "ticker").drop("ticker"))
    docs, events = table(spark, d, "documents"), table(spark, d, "events")
    k = F.col("doc_id")
    sectioned = row(docs.where("lang = 'en'"), k % 150, named("k", "doc_id"), "sec_10k", day("2024-01-01", k % 45))
    staged_ = row(docs, k % 150, named("k", "doc_id"), "sec_8k", day("2024-01-02", k % 45))
    stream = lambda kind, p, source: own(row(events.where(F.col("event_type") == kind), F.col("user_id"), named(p, "event_id"), source, F.to_date("ts")))
    macro = row(table(spark, d, "nation"), F.lit(None).cast("long"), named("m", "n_nationkey"), "macro", day("2024-01-01", F.col("n_nationkey"))).drop("ticker")
    streams = {
        "filings": own(V.override(staged_, sectioned, ["ticker", "chunk_id"])),
        "news": stream("click", "n", "news"),
        "thirteen_f": stream("signup", "f", "thirteen_f"),
        "transcripts": own(row(table(spark, d, "orders"), F.col("o_custkey"), named("t", "o_orderkey"), "earnings_transcript", F.to_date("o_orderdate"))),
        "peer": own(row(table(spark, d, "customer"), F.col("c_nationkey"), named("p", "c_custkey"), "peer_news", day("2024-01-01", F.col("c_custkey") % 30))),
        "sector": own(row(table(spark, d, "supplier"), F.col("s_nationkey"), named("s", "s_suppkey"), "sector_news", day("2024-01-01", F.col("s_suppkey") % 30))),
        "macro": until(m.drop("ticker").join(F.broadcast(macro))),  # a curated table of a few rows, which every move sees
    }
    return assemble(streams).select("move_id", "chunk_id", "place")
