"""Per-source pipelines: records to events, events to citable chunks, and what is saved of each.

The twins here name event types by source and action (analyst_upgrade, fda_approval), as saved snapshots do;
``unify`` has the adapters of the joined event table. A pipeline is an entry of PIPELINES; ``run`` writes
its records, events and chunks under names that end with the as-of date.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions import scoring as S
from eventloom.functions import text as T
from eventloom.operators import relevance as V
from eventloom.operators import unify as U
from eventloom.sources import sinks

# Source types of chunks, the ticker of what has none, the section order of annual reports.
CHUNK = ("chunk_id", "ticker", "source_type", "publication_date", "period_end", "source_url", "section_name", "text", "token_count")
UNMAPPED = "_UNMAPPED"
SECTION_ORDER = ("business", "risk_factors", "mda")
#: An 8-K body shorter than this gets its exhibits.
SHORT_BODY = 500


def event_chunks(events: DataFrame, source_type: str, url: str | None = None, urls: DataFrame | None = None) -> DataFrame:
    """The events' texts as chunks with the events' ids; urls (event_id, source_url) go before the source's own."""
    known = events.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    if urls is not None:
        known = known.join(urls.select("event_id", F.col("source_url").alias("_url")), "event_id", "left")
    link = F.coalesce(F.col("_url"), F.lit(url)) if urls is not None else F.lit(url)
    return known.select(
        F.col("event_id").alias("chunk_id"),
        "ticker",
        F.lit(source_type).alias("source_type"),
        F.col("event_date").alias("publication_date"),
        F.lit(None).cast("date").alias("period_end"),
        link.cast("string").alias("source_url"),
        F.col("event_type").alias("section_name"),
        "text",
        T.word_count(F.col("text")).alias("token_count"),
    )


def holding_events(deltas: DataFrame) -> DataFrame:
    """fund, asset, ticker, period_end, filing_date, action, shares_change. Assets that resolve to one ticker get ordinals, in order of asset."""
    base = F.concat_ws("_", F.lit("13f_delta"), F.col("fund").cast("string"), F.col("ticker").cast("string"), F.col("period_end").cast("date").cast("string"))
    n = F.row_number().over(W.partitionBy("fund", "ticker", "period_end").orderBy("asset")) - 1
    numbered = deltas.withColumn("_n", n)
    ref = F.when(F.col("_n") > 0, F.concat_ws("_", base, F.col("_n").cast("string"))).otherwise(base)
    return U.envelope(numbered, ref, F.col("ticker"), F.col("filing_date"), "13f_delta", "filings", ref, F.format_string("%s %s: %+,d shares", F.col("fund").cast("string"), "action", "shares_change"))


def rating_events(rows: DataFrame) -> DataFrame:
    return U.ratings(rows).drop("event_type").join(rows.select(F.col("rating_id").alias("event_id"), F.concat(F.lit("analyst_"), "action").alias("event_type")).distinct(), "event_id").select(*U.EVENT)


def target_events(rows: DataFrame) -> DataFrame:
    return U.targets(rows).withColumn("event_type", F.lit("analyst_price_target"))


def approval_events(rows: DataFrame) -> DataFrame:
    """Approvals keep a row without a sponsor's ticker, under a name that stands for none."""
    named = rows.withColumn("sponsor_ticker", F.coalesce(T.optional(F.col("sponsor_ticker")), F.lit(UNMAPPED)))
    return U.approvals(named.withColumn("event_type", F.concat(F.lit("fda_"), "event_type")))


def report_records(rows: DataFrame, paragraphs: str = "paragraphs", most: int = 10) -> DataFrame:
    """Adds thesis_text: the first ten paragraphs of a report's page, blank ones aside."""
    shown = F.filter(F.transform(paragraphs, lambda p: F.trim(p)), lambda p: p != "")
    return rows.withColumn("thesis_text", F.array_join(F.slice(shown, 1, most), "\n\n"))


def report_chunks(rows: DataFrame) -> DataFrame:
    """The chunk twin of a short report: the id of its event, title and thesis."""
    text = F.concat_ws("\n\n", F.col("title"), F.col("thesis_text"))
    return rows.select("chunk_id", F.upper("target_ticker").alias("ticker"), F.lit("news").alias("source_type"), F.col("publication_date").cast("date").alias("publication_date"), F.lit(None).cast("date").alias("period_end"), "source_url", F.lit("short_report").alias("section_name"), text.alias("text"), T.word_count(text).alias("token_count"))


def analyst_actions(frame: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Ratings and targets of an analyst frame (ticker, graded, firm, to_grade, from_grade, action, new_target, prior_target).

    Rows without a firm or a date, or after as_of, go; a target of 0 or less counts as none.
    """
    number = lambda c: F.when(F.col(c).try_cast("double") > 0, F.col(c).try_cast("double"))
    rows = frame.withColumns({"action_date": F.to_date("graded"), "analyst_firm": T.optional(F.col("firm")), "new_rating": T.optional(F.col("to_grade")), "prior_rating": T.optional(F.col("from_grade")), "_new": number("new_target"), "_prior": number("prior_target"), "ticker": F.upper(F.trim("ticker"))})
    known = rows.where(F.col("action_date").isNotNull() & (F.col("action_date") <= as_of) & F.col("analyst_firm").isNotNull())
    kind = S.rating_action(F.col("prior_rating"), F.col("new_rating"), F.lower(F.trim("action")))
    ref = lambda *parts: F.concat_ws("_", *[p.cast("string") for p in parts])
    firm = T.slug(F.col("analyst_firm"))
    ratings = known.withColumn("action", kind).select(ref(F.lit("rating"), F.col("ticker"), firm, F.col("action_date"), F.col("action")).alias("rating_id"), "ticker", "analyst_firm", "action", "new_rating", "prior_rating", "action_date")
    targets = known.where("_new is not null").select(ref(F.lit("target"), F.col("ticker"), firm, F.col("action_date")).alias("target_id"), "ticker", "analyst_firm", F.col("_new").alias("new_target"), F.col("_prior").alias("prior_target"), S.target_change(F.col("_prior"), F.col("_new")).alias("change_pct"), "action_date")
    return ratings, targets


def transcript_chunks(rows: DataFrame, to_questions: Callable[[Column], Column], target: int = 600, overlap: int = 75) -> DataFrame:
    """Chunks of calls by section. rows: ticker, report_date, paragraphs (array of struct place, speaker, content).

    A call is prepared until the first paragraph of which to_questions holds, and questions from there on; a
    chunk lies in one section, its text keeps the speakers.
    """
    each = rows.select(F.upper("ticker").alias("ticker"), F.col("report_date").cast("date").alias("day"), F.array_sort("paragraphs").alias("ps")).where("day is not null")
    first = F.coalesce(F.array_min(F.transform(F.filter("ps", to_questions), lambda p: p["place"])), F.lit(2**31 - 1))
    said = lambda p: F.when(F.trim(p["speaker"]) != "", F.concat(F.lit("["), p["speaker"], F.lit("]: "), p["content"])).otherwise(p["content"])
    part = lambda c: F.array_join(F.transform(F.filter("ps", c), said), "\n\n")
    halves = each.withColumn("_q", first).withColumn("s", F.explode(F.array(F.struct(F.lit("prepared").alias("section"), part(lambda p: p["place"] < F.col("_q")).alias("text")), F.struct(F.lit("qa").alias("section"), part(lambda p: p["place"] >= F.col("_q")).alias("text")))))
    words = halves.select("ticker", "day", "s.section", T.word_array(F.col("s.text")).alias("ws"))
    pieces = words.select("ticker", "day", "section", F.posexplode(T.word_chunks(F.col("ws"), target, overlap)).alias("k", "text"))
    ref = F.format_string("earnings_transcript_%s_%s_%s_%03d", F.col("ticker"), F.col("day").cast("string"), F.col("section"), F.col("k") + 1)
    return pieces.select(ref.alias("chunk_id"), "ticker", F.lit("earnings_transcript").alias("source_type"), F.col("day").alias("publication_date"), F.lit(None).cast("date").alias("period_end"), F.lit(None).cast("string").alias("source_url"), F.col("section").alias("section_name"), "text", T.word_count(F.col("text")).alias("token_count"))


def annual_chunks(rows: DataFrame, target: int = 600, overlap: int = 75) -> DataFrame:
    """Chunks of annual reports (ticker, filing_date, period_end, label, text): known sections in their order, numbered from 0 through the filing."""
    named = rows.withColumn("section_name", T.section_name(F.col("label"))).where("section_name is not null")
    order = F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), F.col("section_name"))
    words = named.select(F.upper("ticker").alias("ticker"), F.col("filing_date").cast("date").alias("publication_date"), F.col("period_end").cast("date").alias("period_end"), "section_name", order.alias("_o"), T.word_array(F.col("text")).alias("ws"))
    pieces = words.select("*", F.posexplode(T.word_chunks(F.col("ws"), target, overlap)).alias("_k", "text"))
    n = F.row_number().over(W.partitionBy("ticker", "publication_date").orderBy("_o", "_k")) - 1
    ref = F.format_string("sec_10k_%s_%s_%s_%03d", F.col("ticker"), F.col("publication_date").cast("string"), F.col("section_name"), n)
    return pieces.select(ref.alias("chunk_id"), "ticker", F.lit("sec_10k").alias("source_type"), "publication_date", "period_end", F.lit(None).cast("string").alias("source_url"), "section_name", "text", T.word_count(F.col("text")).alias("token_count"))


def current_report_records(rows: DataFrame) -> DataFrame:
    """Current reports (ticker, form, accepted, body, exhibits): no amendments; a short body takes its exhibits along; items in first-seen order.

    The date is that of the acceptance in UTC, whatever the hour.
    """
    kept = rows.where(~F.coalesce(F.col("form"), F.lit("")).endswith("/A"))
    body = F.coalesce("body", F.lit(""))
    text = F.when(F.length(F.trim(body)) < SHORT_BODY, F.concat_ws("\n\n", F.array_compact(F.concat(F.array(body), F.coalesce("exhibits", F.array().cast("array<string>")))))).otherwise(body)
    return kept.select(F.upper("ticker").alias("ticker"), F.to_date("accepted").alias("publication_date"), text.alias("text"), T.item_codes(body).alias("items"))


def current_report_chunks(records: DataFrame, target: int = 600, overlap: int = 75) -> DataFrame:
    """Chunks of current reports with an item that matters; the id names the items."""
    known = records.where(T.relevant_items(F.col("items")) & (F.trim("text") != "") & F.col("publication_date").isNotNull())
    pieces = known.select("*", T.word_array(F.col("text")).alias("ws")).select("ticker", "publication_date", "items", F.posexplode(T.word_chunks(F.col("ws"), target, overlap)).alias("k", "piece"))
    code = F.array_join(F.transform("items", lambda x: F.replace(x, F.lit("."), F.lit(""))), "-")
    ref = F.format_string("sec_8k_%s_%s_%s_%03d", F.col("ticker"), F.col("publication_date").cast("string"), code, F.col("k") + 1)
    return pieces.select(ref.alias("chunk_id"), "ticker", F.lit("sec_8k").alias("source_type"), "publication_date", F.lit(None).cast("date").alias("period_end"), F.lit(None).cast("string").alias("source_url"), F.concat(F.lit("Item "), F.array_join("items", ", ")).alias("section_name"), F.col("piece").alias("text"), T.word_count(F.col("piece")).alias("token_count"))


def as_of(chunks: list[DataFrame], ticker: str, date: Column) -> DataFrame:
    """A ticker's chunks of several sources, published up to a date."""
    every = chunks[0]
    for c in chunks[1:]:
        every = every.unionByName(c)
    return every.where((F.upper("ticker") == ticker.upper()) & (F.col("publication_date") <= date))


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the primary source, and those of the fallback whose keys it lacks; `origin` tells them apart."""
    rest = fallback.join(primary.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("fallback"))
    return primary.withColumn("origin", F.lit("primary")).unionByName(rest)


def assemble(streams: dict[str, DataFrame], filings: tuple[DataFrame, DataFrame] | None = None, moves: DataFrame | None = None) -> DataFrame:
    """One ordered list of chunks per move from the streams of its sources, each a frame with move_id and CHUNK's columns.

    filings: (sectioned, staged) rows of filings, the first stream; a chunk_id that both have comes from the sectioned ones. Within
    a source type recent chunks go first, then one of each type in turn, types in the order of their streams. moves
    (move_id, move_date): chunks published after their move's date are left out. Adds place.
    """
    parts = [V.override(filings[1], filings[0], ["move_id", "chunk_id"])] if filings else []
    parts += list(streams.values())
    every = None
    for i, rows in enumerate(parts):
        numbered = rows.withColumn("_stream", F.lit(i))
        every = numbered if every is None else every.unionByName(numbered)
    if moves is not None:
        every = every.join(moves.select("move_id", F.col("move_date").alias("_until")), "move_id").where(F.col("publication_date") <= F.col("_until")).drop("_until")
    return V.interleave(every, "move_id", "source_type", "publication_date", "chunk_id", "_stream").drop("_stream")


def first_pieces(articles: DataFrame, peers: DataFrame | None = None) -> DataFrame:
    """The first piece of each article (move tickers or, by peers (ticker, peer), of other tickers): article_id, ticker, k, ..."""
    own = articles.withColumn("_k", F.row_number().over(W.partitionBy("article_id", "ticker").orderBy("k"))).where("_k = 1").drop("_k")
    if peers is None:
        return own
    pairs = peers.select("ticker", F.col("peer").alias("_p")).distinct()
    return own.withColumnRenamed("ticker", "_p").join(pairs, "_p").drop("_p")


# Sources that each dimension is repaired from, best first.
AFFINITY = {
    "demand": ("earnings_transcript", "news", "peer_news", "sector_news"),
    "pricing": ("earnings_transcript", "sec_10k", "news"),
    "competitive": ("peer_news", "sec_10k", "sector_news", "news"),
    "management_credibility": ("earnings_transcript", "sec_8k", "news"),
    "macro": ("macro", "sector_news", "news"),
}


def affine_chunk(chunks: Column, dimension: str) -> Column:
    """The id of the first chunk (array of struct chunk_id, source_type) of the dimension's best source; else the first chunk's."""
    order = F.array(*[F.lit(s) for s in AFFINITY[dimension]])
    ranked = F.transform(chunks, lambda c, i: F.struct(F.when(F.array_contains(order, c["source_type"]), F.array_position(order, c["source_type"])).otherwise(99).alias("r"), i.alias("i"), c["chunk_id"].alias("id")))
    return F.array_min(ranked)["id"]


def repair_citations(rows: DataFrame) -> DataFrame:
    """Where all dimensions cite the same ids, each cites a chunk of a source that fits it. rows: cites_* and chunks."""
    from eventloom.operators.attribution import degenerate

    bad = degenerate(F.array(*[F.col(f"cites_{d}") for d in AFFINITY])) & (F.size("chunks") > 0)
    out = rows.withColumn("repaired", bad)
    return out.withColumns({f"cites_{d}": F.when(F.col("repaired"), F.array(affine_chunk(F.col("chunks"), d))).otherwise(F.col(f"cites_{d}")) for d in AFFINITY})


# Columns of stored records, with their kinds; a ? marks what may be missing.
RECORDS = {
    "holding_delta": "fund_cik string, fund_name string, ticker string, current_filing_date date, current_period_end date, action string, shares_change long, market_value_change long, prior_shares long?, current_shares long",
    "short_interest": "ticker string, settlement_date date, shares_short long, avg_daily_volume long?, days_to_cover double?, float_short_percent double?",
    "index_change": "change_id string, index_name string, action string, ticker string, company_name string, announcement_date date, effective_date date, replacing_ticker string?, source_url string?",
    "short_report": "chunk_id string, publisher string, target_ticker string, publication_date date, title string, thesis_text string, source_url string?, token_count long?",
    "fda_event": "event_id string, event_type string, event_date date, sponsor_ticker string?, drug_name string, indication string?, description string, source_url string?",
    "rating": "rating_id string, ticker string, analyst_firm string, analyst_name string?, action string, new_rating string?, prior_rating string?, action_date date, source_url string?",
    "target": "target_id string, ticker string, analyst_firm string, analyst_name string?, new_target double?, prior_target double?, change_pct double?, action_date date, source_url string?",
}


def typed(rows: DataFrame, kind: str) -> DataFrame:
    """Stored rows as typed records: blanks and words for nothing are null, dates and numbers are parsed, absent optional
    columns are null. `problems` names required columns without a value."""
    out, required = [], []
    for field in RECORDS[kind].split(", "):
        name, type_ = field.split(" ")
        may_miss, type_ = type_.endswith("?"), type_.rstrip("?")
        if name not in rows.columns:
            if not may_miss:
                raise ValueError(f"missing column: {name}")
            out.append(F.lit(None).cast(type_).alias(name))
            continue
        given = T.optional(F.col(name).cast("string"))
        value = given if type_ == "string" else given.try_cast("double").cast("long") if type_ == "long" else given.try_cast(type_)
        out.append(value.alias(name))
        if not may_miss:
            required.append(name)
    done = rows.select(*out)
    return done.withColumn("problems", F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required])))


def stored(rows: DataFrame) -> DataFrame:
    """Dates as ISO text, as stored tables have them."""
    return rows.withColumns({c: F.col(c).cast("string") for c, t in rows.dtypes if t == "date"})


def recent(name: Column, prefix: str, as_of: Column, days: int) -> Column:
    """Whether a file is named <prefix>_<ISO date>.parquet with a date within so many days of as_of, on either side."""
    file = F.element_at(F.split(name, "/"), -1)
    stamp = F.try_to_date(F.regexp_extract(file, r"_(\d{4}-\d{2}-\d{2})\.parquet$", 1), "yyyy-MM-dd")
    return F.coalesce(file.startswith(f"{prefix}_") & (F.abs(F.datediff(as_of, stamp)) <= days), F.lit(False))


@dataclass(frozen=True)
class Pipeline:
    events: Callable[[DataFrame], DataFrame]
    source_type: str
    url: str | None = None


PIPELINES = {
    "thirteen_f": Pipeline(holding_events, "thirteen_f"),
    "ratings": Pipeline(rating_events, "news"),
    "targets": Pipeline(target_events, "news"),
    "fda": Pipeline(approval_events, "news"),
    "index_changes": Pipeline(U.index_changes, "index_change"),
    "short_interest": Pipeline(U.short_interest, "short_interest"),
    "short_reports": Pipeline(U.short_reports, "news"),
    "earnings": Pipeline(U.earnings, "news"),
    "news": Pipeline(U.news, "news"),
}


def run(records: DataFrame, name: str, path: str, as_of: str, ticker: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Events up to as_of and their chunks; records, events and chunks are written under path."""
    p = PIPELINES[name]
    events = p.events(records).where(F.col("event_date") <= F.lit(as_of).cast("date"))
    urls = records.select("event_id", "source_url") if {"event_id", "source_url"} <= set(records.columns) else None
    chunks = event_chunks(events, p.source_type, p.url, urls)
    stem = "_".join([*([ticker.upper()] if ticker else []), as_of])
    sinks.write_parquet(stored(records), f"{path}/records_{stem}.parquet")
    sinks.write_parquet(stored(events), f"{path}/events_{stem}.parquet")
    sinks.write_jsonl(chunks, f"{path}/chunks_{stem}.jsonl")
    return events, chunks


def prepare(steps: dict[str, Callable[[], object]]) -> list[tuple[str, str, str]]:
    """Runs every source's step; one that fails doesn't stop the others. (name, done or failed, error) of each, in order."""
    out = []
    for name, step in steps.items():
        try:
            step()
            out.append((name, "done", ""))
        except Exception as e:  # noqa: BLE001 - a source's failure is reported, the others go on
            out.append((name, "failed", f"{type(e).__name__}: {e}"))
    return out


def strategy_map() -> Column:
    """Every strategy's verdict on a row, by name; one without a verdict is neutral."""
    from eventloom.functions.signals import STRATEGIES

    return F.create_map(*[x for k, f in STRATEGIES.items() for x in (F.lit(k), F.coalesce(f(), F.lit("neutral")))])
