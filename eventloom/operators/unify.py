"""Adapters from source records to one event envelope, and their union.

An event has event_id, ticker, event_date, event_type, source, payload_ref, text. Rows without a ticker or a
date go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = ("event_id", "ticker", "event_date", "event_type", "source", "payload_ref", "text")
SCHEMA = "event_id string, ticker string, event_date date, event_type string, source string, payload_ref string, text string"


def envelope(df: DataFrame, event_id: Column, ticker: Column, event_date: Column, event_type: Column | str, source: Column | str, payload_ref: Column, text: Column) -> DataFrame:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    t = F.upper(F.trim(ticker.cast("string")))
    out = df.select(event_id.alias("event_id"), t.alias("ticker"), event_date.cast("date").alias("event_date"), lit(event_type).alias("event_type"), lit(source).alias("source"), payload_ref.cast("string").alias("payload_ref"), text.alias("text"))
    return out.where(F.col("event_date").isNotNull() & (F.coalesce("ticker", F.lit("")) != ""))


def earnings(calendar: DataFrame) -> DataFrame:
    """ticker, report_date, time (pre / post)."""
    when = F.when(F.col("time") == "pre", " before the open").when(F.col("time") == "post", " after the close").otherwise("")
    ref = F.concat_ws("_", F.lit("earnings"), F.upper(F.trim(F.col("ticker").cast("string"))), F.col("report_date").cast("date").cast("string"))
    return envelope(calendar, ref, F.col("ticker"), F.col("report_date"), "earnings_release", "earnings_calendar", ref, F.concat(F.lit("Earnings release"), when))


def ratings(rows: DataFrame) -> DataFrame:
    """rating_id, ticker, analyst_firm, action, new_rating, prior_rating, action_date."""
    change = F.concat_ws(" to ", F.col("prior_rating"), F.col("new_rating"))
    return envelope(rows, F.col("rating_id"), F.col("ticker"), F.col("action_date"), "analyst_rating_change", F.col("analyst_firm"), F.col("rating_id"), F.concat_ws(" ", F.col("analyst_firm"), F.col("action"), change))


def targets(rows: DataFrame) -> DataFrame:
    """target_id, ticker, analyst_firm, new_target, prior_target, action_date."""
    text = F.when(F.col("prior_target") > 0, F.format_string("%s moves its target from $%,.2f to $%,.2f", "analyst_firm", "prior_target", "new_target")).otherwise(F.format_string("%s sets a target of $%,.2f", "analyst_firm", "new_target"))
    return envelope(rows, F.col("target_id"), F.col("ticker"), F.col("action_date"), "price_target_change", F.col("analyst_firm"), F.col("target_id"), text)


def approvals(rows: DataFrame) -> DataFrame:
    """event_id, event_type, event_date, sponsor_ticker, drug_name, description; rows without a sponsor go."""
    return envelope(rows, F.col("event_id"), F.col("sponsor_ticker"), F.col("event_date"), F.col("event_type"), "fda", F.col("event_id"), F.concat_ws(": ", "drug_name", "description"))


def index_changes(rows: DataFrame) -> DataFrame:
    """change_id, index_name, action, ticker, announcement_date, effective_date: an event for each of the two dates."""
    both = rows.withColumn("x", F.explode(F.array(F.struct(F.lit("announcement").alias("k"), F.col("announcement_date").alias("d")), F.struct(F.lit("effective").alias("k"), F.col("effective_date").alias("d")))))
    ref = F.concat_ws("_", "change_id", "x.k")
    return envelope(both, ref, F.col("ticker"), F.col("x.d"), F.concat(F.lit("index_change_"), F.col("x.k")), F.col("index_name"), F.col("change_id"), F.concat_ws(" ", F.col("index_name"), F.col("action"), F.col("x.k")))


def news(articles: DataFrame) -> DataFrame:
    """uuid, tickers (array), title, publisher, report_date, paragraphs (array of struct n, text): one event per ticker and paragraph."""
    fanned = articles.withColumn("_t", F.explode(F.array_distinct("tickers"))).withColumn("_p", F.explode("paragraphs"))
    ok = fanned.where(F.col("uuid").isNotNull() & F.col("_p.n").isNotNull() & (F.trim("_p.text") != ""))
    ref = F.format_string("news_%s_%03d", F.col("uuid"), F.col("_p.n"))
    return envelope(ok, ref, F.col("_t"), F.col("report_date"), "news", F.col("publisher"), ref, F.concat_ws(": ", F.col("title"), F.col("_p.text")))


def short_interest(spikes: DataFrame, settlement_mode: bool = False, lag: int = 14) -> DataFrame:
    """ticker, settlement_date, prior, value, change: dated at publication, or at settlement if so asked."""
    date = F.col("settlement_date") if settlement_mode else F.date_add("settlement_date", lag)
    ref = F.concat_ws("_", F.lit("si"), F.col("ticker").cast("string"), F.col("settlement_date").cast("string"))
    return envelope(spikes, ref, F.col("ticker"), date, "short_interest_spike", "short_interest", ref, F.format_string("Short interest up %.1f%%: %,d to %,d", F.col("change") * 100, "prior", "value"))


def short_reports(rows: DataFrame) -> DataFrame:
    return envelope(rows, F.col("chunk_id"), F.col("target_ticker"), F.col("publication_date"), "short_report", F.col("publisher"), F.col("chunk_id"), F.col("title"))


def holding_deltas(rows: DataFrame) -> DataFrame:
    """fund, ticker, filing_date, action, shares_change: dated at filing."""
    ref = F.concat_ws("_", F.lit("13f_delta"), F.col("fund").cast("string"), F.col("ticker").cast("string"), F.col("filing_date").cast("date").cast("string"))
    return envelope(rows, ref, F.col("ticker"), F.col("filing_date"), "13f_delta", F.col("fund").cast("string"), ref, F.format_string("%s %s: %+,d shares", F.col("fund").cast("string"), "action", "shares_change"))


def filings(rows: DataFrame) -> DataFrame:
    """chunk_id, ticker, form, filing_date, section, text."""
    kind = F.create_map(*[F.lit(x) for x in ("10-K", "sec_10k", "10-Q", "sec_10q", "8-K", "sec_8k")])[F.col("form")]
    return envelope(rows.where(kind.isNotNull()), F.col("chunk_id"), F.col("ticker"), F.col("filing_date"), kind, "sec", F.col("chunk_id"), F.col("text"))


def union(parts: list[DataFrame], as_of=None) -> DataFrame:
    """All events up to as_of (inclusive), as a bag."""
    out = parts[0].select(*EVENT)
    for p in parts[1:]:
        out = out.unionByName(p.select(*EVENT))
    return out if as_of is None else out.where(F.col("event_date") <= as_of)
