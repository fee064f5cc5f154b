"""Web sources: paged services as a data source, and parsers of staged pages."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from eventloom.operators.relevance import dedupe_present, first_wins


def month_slices(start: str, end: str, days: int = 30) -> list[tuple[str, str]]:
    """Inclusive slices of `days` days that cover start to end."""
    from datetime import date, timedelta

    a, b, out = date.fromisoformat(start), date.fromisoformat(end), []
    while a <= b:
        last = min(a + timedelta(days=days - 1), b)
        out.append((a.isoformat(), last.isoformat()))
        a = last + timedelta(days=1)
    return out


class Overloaded(Exception):
    """What a fetcher raises when its service asks to wait; delay: for how many seconds, if it says so."""

    def __init__(self, message: str = "", delay: float | None = None):
        super().__init__(message)
        self.delay = delay


class MorePages(Exception):
    """A service has more than max_pages pages."""


class Slice(InputPartition):
    """Pages first to end (exclusive; None: up to max_pages) of one slice of arguments."""

    def __init__(self, number: int, args: dict, first: int = 0, end: int | None = None):
        super().__init__(number)
        self.number, self.args, self.first, self.end = number, args, first, end


class _Pages:
    """Calls of a fetcher: so many seconds apart, and again after a wait where the service is overloaded."""

    def __init__(self, options: dict):
        self.fetcher, self.size, self.most = options["fetcher"], int(options.get("page_size", 5000)), int(options.get("max_pages", 50))
        self.slices = json.loads(options.get("slices", "[{}]"))
        self.interval, self.attempts, self.longest = float(options.get("interval", 0)), int(options.get("attempts", 4)), float(options.get("longest_wait", 60))
        self.keep = options.get("on_limit", "raise") == "keep"
        self.last = 0.0

    def fetch(self, args: dict, offset: int, limit: int) -> list[dict] | None:
        module, _, name = self.fetcher.partition(":")
        call = getattr(importlib.import_module(module), name)
        for k in range(self.attempts):
            time.sleep(max(0.0, self.last + self.interval - time.monotonic()))
            self.last = time.monotonic()
            try:
                return call(offset=offset, limit=limit, **args)
            except Overloaded as e:
                if k + 1 == self.attempts:
                    raise
                time.sleep(min(self.longest, e.delay if e.delay is not None else 2.0**k))
        raise AssertionError("attempts must be positive")

    def rows(self, part: Slice, fields: list[str]) -> Iterator[tuple]:
        """The slice's rows in order, each with its place."""
        page = part.first
        while part.end is None or page < part.end:
            if part.end is None and page >= self.most:
                if self.fetch(part.args, page * self.size, 1) and not self.keep:
                    raise MorePages(f"slice {part.args} has more than {self.most} pages of {self.size} rows; raise max_pages, or take what they hold with on_limit='keep'")
                return
            found = self.fetch(part.args, page * self.size, self.size)
            if found is None:  # the service has no such page
                return
            for n, row in enumerate(found):
                yield tuple([row.get(f) for f in fields[:-1]] + [(part.number << 40) + page * self.size + n])
            if len(found) < self.size:
                return
            page += 1


class PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields, self.pages = [f.name for f in schema.fields], _Pages(options)

    def partitions(self):
        return [Slice(i, a) for i, a in enumerate(self.pages.slices)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.pages.rows(partition, self.fields)


class PagedStreamReader(DataSourceStreamReader):
    """A micro-batch takes up to pages_per_batch further pages of each slice. The offset is the next page of each, so a
    run that starts again from its checkpoint goes on where it stopped, and a slice whose end is reached asks for
    one row at most. Pages that were full when they were read aren't read again, so slices should be closed (past dates)."""

    def __init__(self, schema, options):
        self.fields, self.pages, self.step = [f.name for f in schema.fields], _Pages(options), int(options.get("pages_per_batch", 10))
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {str(i): 0 for i in range(len(self.pages.slices))}

    def latestOffset(self) -> dict:
        self.at = dict(self.at or self.initialOffset())
        for i, args in enumerate(self.pages.slices):
            first = self.at[str(i)]
            while self.at[str(i)] < first + self.step and self.pages.fetch(args, self.at[str(i)] * self.pages.size, 1):
                self.at[str(i)] += 1
        return dict(self.at)

    def partitions(self, start: dict, end: dict):
        self.at = {k: max(v, (self.at or {}).get(k, 0)) for k, v in end.items()}
        return [Slice(i, a, start[str(i)], end[str(i)]) for i, a in enumerate(self.pages.slices) if start[str(i)] < end[str(i)]]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.pages.rows(partition, self.fields)


class PagedSource(DataSource):
    """Pages of a service as rows; each slice of its arguments is a task.

    Options: fetcher ("module:function", called with offset, limit and the slice's arguments; it returns a list
    of dicts, or None past the end, and raises ``Overloaded`` to be called again later), slices (JSON list of arguments),
    page_size, max_pages (of a slice that has more, reading fails with ``MorePages``; with on_limit=keep it ends there), interval
    (seconds between calls of a task), attempts, longest_wait. The last column of the schema must be a long: it gets the
    row's place, so that later steps can say which row came first. As a stream (pages_per_batch) it resumes from its checkpoint.
    """

    @classmethod
    def name(cls) -> str:
        return "eventloom_paged"

    def reader(self, schema):
        return PagedReader(schema, self.options)

    def streamReader(self, schema):
        return PagedStreamReader(schema, self.options)


def _paged_options(fetcher: str, slices: list[dict] | None, **more) -> dict[str, str]:
    return {k: str(v) for k, v in ({"fetcher": fetcher, "slices": json.dumps(slices or [{}])} | more).items()}


def read_pages(spark: SparkSession, fetcher: str, schema: str, slices: list[dict] | None = None, page_size: int = 5000, max_pages: int = 50, **more) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("eventloom_paged").schema(f"{schema}, place long").options(**_paged_options(fetcher, slices, page_size=page_size, max_pages=max_pages, **more)).load()


def stream_pages(spark: SparkSession, fetcher: str, schema: str, slices: list[dict] | None = None, page_size: int = 5000, pages_per_batch: int = 10, **more) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("eventloom_paged").schema(f"{schema}, place long").options(**_paged_options(fetcher, slices, page_size=page_size, pages_per_batch=pages_per_batch, **more)).load()


def short_interest(rows: DataFrame, as_of: Column, lag: int = 14) -> DataFrame:
    """Published rows (settled `lag` days before as_of or earlier); of revisions the last one wins."""
    known = rows.where(F.col("settlement_date") <= F.date_sub(as_of, lag))
    return first_wins(known, ["ticker", "settlement_date"], [F.desc("place")]).drop("place")


def first_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Feeds whose slices overlap: a key's first row wins; rows whose key is null or blank all stay."""
    for key in keys:
        given = F.when(F.trim(F.col(key).cast("string")) != "", F.col(key))
        rows = dedupe_present(rows.withColumn("_key", given), "_key", ["place"]).drop("_key")
    return rows.drop("place")


def table_rows(html: Column, table: int = 1, skip: int = 2) -> Column:
    """Cells of the table of that number (from 0) of a page, without its first `skip` rows; footnotes and tags go."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))
    rows = F.regexp_extract_all(F.coalesce(F.get(tables, F.lit(table)), F.lit("")), F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<sup\b.*?</sup>|\[[^\]]*\]", ""), r"(?s)<[^>]*>", ""), r"\s+", " "))
    return F.transform(F.slice(rows, skip + 1, F.lit(2**31 - 1 - skip)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>.*?</t[dh]>"), F.lit(0)), clean))


def index_changes(pages: DataFrame, as_of: Column, since: int = 2015) -> DataFrame:
    """Records of a page's change table (date, added ticker, added name, removed ticker, removed name): one row per side."""
    from eventloom.functions.text import lenient_date

    cells = pages.select(F.explode(table_rows(F.col("html"))).alias("c")).where(F.size("c") >= 5)
    dated = cells.withColumn("effective_date", lenient_date(F.get("c", F.lit(0)))).where((F.col("effective_date") <= as_of) & (F.year("effective_date") >= since))
    side = lambda action, k, other: F.struct(F.lit(action).alias("action"), F.get("c", F.lit(k)).alias("ticker"), F.get("c", F.lit(k + 1)).alias("company_name"), F.nullif(F.get("c", F.lit(other)), F.lit("")).alias("replacing_ticker"))
    both = dated.select("effective_date", F.explode(F.filter(F.array(side("add", 1, 3), side("delete", 3, 1)), lambda x: x["ticker"] != "")).alias("x"))
    return both.select("x.action", "x.ticker", "x.company_name", "x.replacing_ticker", "effective_date", F.date_sub("effective_date", 5).alias("announcement_date"))


HOLDINGS = "infoTable array<struct<nameOfIssuer:string, cusip:string, value:bigint, shrsOrPrnAmt:struct<sshPrnamt:bigint, sshPrnamtType:string>>>"


def holdings(documents: DataFrame) -> DataFrame:
    """Share positions of information tables in XML; other kinds of positions go. documents: fund_cik, filing_date, xml."""
    rows = documents.select("fund_cik", "filing_date", F.explode(F.from_xml("xml", HOLDINGS)["infoTable"]).alias("i"))
    return rows.where(F.col("i.shrsOrPrnAmt.sshPrnamtType") == "SH").select("fund_cik", "filing_date", F.col("i.nameOfIssuer").alias("issuer"), F.col("i.cusip").alias("cusip"), F.col("i.shrsOrPrnAmt.sshPrnamt").alias("shares"), F.col("i.value").alias("market_value"))


def resolve_names(rows: DataFrame, names: DataFrame, name: str = "issuer", fallback: str = "cusip") -> DataFrame:
    """Adds ticker by the normalised company name; what isn't known takes the fallback. names: company, ticker."""
    from eventloom.functions.text import company_key

    table = names.select(company_key(F.col("company")).alias("_k"), F.col("ticker")).where("_k <> ''").groupBy("_k").agg(F.min("ticker").alias("ticker"))
    return rows.withColumn("_k", company_key(F.col(name))).join(table, "_k", "left").withColumn("ticker", F.coalesce("ticker", fallback)).drop("_k")


def reports(pages: DataFrame, publisher: str) -> DataFrame:
    """Linked reports of a listing page: title of six characters or more, dated by their URL, each URL once."""
    from eventloom.functions.text import cashtag, date_in_url, slug

    links = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*href=[\"'][^\"']+[\"'][^>]*>.*?</a>"), F.lit(0))
    each = pages.select(F.posexplode(links).alias("place", "a"))
    parsed = each.select("place", F.regexp_extract("a", r"(?is)href=[\"']([^\"']+)[\"']", 1).alias("source_url"), F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", " "), r"\s+", " ")).alias("title"))
    dated = parsed.withColumn("publication_date", date_in_url(F.col("source_url"))).where((F.length("title") >= 6) & F.col("publication_date").isNotNull())
    out = first_wins(dated, ["source_url"], ["place"]).drop("place")
    return out.withColumns({"publisher": F.lit(publisher), "target_ticker": cashtag(F.col("title"), F.lit("")), "chunk_id": F.concat_ws("_", F.lit("short_report"), F.lit(publisher), slug(F.col("title")))})


# Publishers whose listings are read, and what their ids call them.
PUBLISHERS = {
    "Hindenburg Research": "hindenburg",
    "Muddy Waters Research": "muddy_waters",
    "Citron Research": "citron",
    "Kerrisdale Capital": "kerrisdale",
    "Spruce Point Capital": "spruce_point",
    "Scorpion Capital": "scorpion",
}


def all_reports(pages: DataFrame, as_of: Column, names: DataFrame | None = None, publishers: dict[str, str] = PUBLISHERS) -> DataFrame:
    """Reports of all known publishers' listing pages up to as_of, in one pass; a page that holds none gives no rows.

    pages: publisher, place (the order in which they are asked), html (null where the page couldn't be read). A title names its
    target by cash tag, or else by a company name (names: company, ticker) that it begins with, up to a colon or dash; a
    report without a date or a target goes. Of equal chunk_ids (publisher, ticker, date) the first page's first link stays.
    Unknown publishers fail the job.
    """
    from eventloom.functions.text import cashtag, company_key, date_in_url

    table = F.create_map(*[F.lit(x) for kv in publishers.items() for x in kv])
    known = pages.withColumn("_slug", F.coalesce(table[F.col("publisher")], F.raise_error(F.concat(F.lit("unknown publisher: "), F.coalesce("publisher", F.lit("null"))))))
    links = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*href=[\"'][^\"']+[\"'][^>]*>.*?</a>"), F.lit(0))
    each = known.select("publisher", "_slug", F.col("place").alias("_page"), F.posexplode(links).alias("_at", "a"))
    parsed = each.withColumns({"source_url": F.regexp_extract("a", r"(?is)href=[\"']([^\"']+)[\"']", 1), "title": F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", " "), r"\s+", " "))}).drop("a")
    dated = parsed.withColumn("publication_date", date_in_url(F.col("source_url"))).where((F.length("title") >= 6) & (F.col("publication_date") <= as_of))
    tagged = dated.withColumn("target_ticker", cashtag(F.col("title"), F.lit("")))
    if names is not None:
        companies = names.select(company_key(F.col("company")).alias("_k"), F.col("ticker").alias("_t")).where("_k <> ''").groupBy("_k").agg(F.min("_t").alias("_t"))
        tagged = tagged.withColumn("_k", company_key(F.regexp_extract("title", r"^([^:\u2013\u2014-]*)", 1))).join(companies, "_k", "left").withColumn("target_ticker", F.coalesce(F.nullif("target_ticker", F.lit("")), "_t")).drop("_k", "_t")
    whole = tagged.where(F.coalesce("target_ticker", F.lit("")) != "").withColumn("target_ticker", F.upper("target_ticker"))
    ided = whole.withColumn("chunk_id", F.concat_ws("_", F.lit("short_report"), "_slug", "target_ticker", F.col("publication_date").cast("string")))
    out = first_wins(ided, ["chunk_id"], ["_page", "_at"]).drop("_page", "_at", "_slug")
    return out.withColumns({"thesis_text": F.col("title"), "token_count": F.size(F.split("title", " "))})


def approvals(applications: DataFrame, since: Column, as_of: Column) -> DataFrame:
    """Approved submissions of drug applications dated within [since, as_of]. applications: application_number, sponsor_name, brands (array), submissions (array of struct status, date)."""
    each = applications.select("application_number", "sponsor_name", F.get("brands", F.lit(0)).alias("drug_name"), F.explode("submissions").alias("s"))
    dated = each.withColumn("event_date", F.try_to_date("s.date", "yyyyMMdd"))
    found = dated.where((F.col("s.status") == "AP") & F.col("event_date").between(since, as_of)).select("application_number", "sponsor_name", "drug_name", "event_date")
    # pages overlap: an application's approval of a day is one event
    return first_wins(found, ["application_number", "event_date"], ["sponsor_name", "drug_name"])


def document_choices(index: DataFrame, as_of: Column, forms: tuple[str, ...] = ("13F-HR",)) -> DataFrame:
    """Filings of exactly these forms up to as_of, newest first by place, from a filing index whose columns are parallel lists.

    index: fund_cik, fund_name, recent (struct of arrays form, filingDate, accessionNumber, reportDate). The second stage
    fetches each chosen accession's documents, a task a slice (``read_pages`` with one slice a choice).
    """
    zipped = F.arrays_zip(*[F.col(f"recent.{c}").alias(c) for c in ("form", "filingDate", "accessionNumber", "reportDate")])
    each = index.select("fund_cik", "fund_name", F.posexplode(zipped).alias("_i", "f"))
    rows = each.select("fund_cik", "fund_name", "_i", F.col("f.form").alias("form"), F.to_date("f.filingDate").alias("filing_date"), F.to_date("f.reportDate").alias("report_date"), F.col("f.accessionNumber").alias("accession"))
    from pyspark.sql import Window as W

    kept = rows.where(F.col("form").isin(*forms) & (F.col("filing_date") <= as_of))
    return kept.withColumn("place", F.row_number().over(W.partitionBy("fund_cik").orderBy(F.desc("filing_date"), "_i"))).drop("_i")


def information_tables(documents: DataFrame) -> DataFrame:
    """The information table of each accession: of its XML documents, primary ones aside, the first whose beginning names one.

    documents: fund_cik, filing_date, accession, path, place (order on the filing's page), xml.
    """
    table = documents.where(F.lower("path").endswith(".xml") & ~F.lower("path").contains("primary_doc") & F.substring("xml", 1, 400).contains("informationTable"))
    return first_wins(table, ["fund_cik", "accession"], ["place", "path"]).select("fund_cik", "filing_date", "accession", "xml")


def news_chunks(articles: DataFrame, ticker: Column, source_type: str = "news", prefix: str = "news", via: Column | None = None, service: str = "Finnhub") -> DataFrame:
    """Chunks of a news service's articles: headline, summary, datetime (epoch seconds), source, url, place.

    An article without text or without a time goes. The text is headline and summary with a blank line between; section_name
    is the publisher, or the service where it has none; ids count a ticker's kept articles from 0 in order of place.
    """
    from pyspark.sql import Window as W

    clean = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    rows = articles.select(F.upper(ticker).alias("ticker"), "place", F.concat_ws("\n\n", clean("headline"), clean("summary")).alias("text"), F.to_date(F.timestamp_seconds("datetime")).alias("publication_date"), F.coalesce(clean("source"), F.lit(service)).alias("_p"), clean("url").alias("source_url"), (F.lit(None).cast("string") if via is None else via).alias("_via"), (F.coalesce(F.col("datetime"), F.lit(0)) != 0).alias("_dated"))
    kept = rows.where((F.col("text") != "") & F.col("_dated"))
    seq = F.row_number().over(W.partitionBy("ticker").orderBy("place")) - 1
    section = F.when(F.col("_via").isNull(), F.col("_p")).otherwise(F.format_string("%s (via %s)", "_p", "_via"))
    chunk_id = F.format_string(f"{prefix}_%s_%s_{service.lower()}_%04d", "ticker", F.col("publication_date").cast("string"), seq)
    return kept.withColumns({"chunk_id": chunk_id, "source_type": F.lit(source_type), "section_name": section, "token_count": F.size(F.array_remove(F.split("text", r"\s+"), ""))}).drop("_p", "_via", "_dated", "place")


def macro(policy: DataFrame, shocks: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Curated macro rows (date, section, title, text) of both kinds, with idx within (date, section) by title."""
    from pyspark.sql import Window as W

    rows = policy.unionByName(shocks)
    rows = rows if as_of is None else rows.where(F.col("date") <= as_of)
    return rows.withColumn("idx", F.row_number().over(W.partitionBy("date", "section").orderBy("title")))
