"""Binding of driver tables to the engine's roles, and the registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to 6 places; -0.0 becomes 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def price_sql(c: str, places: int = 4) -> str:
    """The SQL of ``operators.panel.to_places``."""
    return f"round(({c})::decimal(28, 9), {places})::double"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (ticker, date, close, volume): a supplier's value over quantity, from whole cents."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    qty = F.sum(F.col("l_quantity").cast("long"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(cents.alias("c"), qty.alias("volume"))
    return rows.select("ticker", "date", (F.col("c").cast("double") / F.col("volume") / 100).alias("close"), "volume")


PANEL = """panel AS (
  SELECT l_suppkey AS ticker, l_shipdate::date AS date,
         sum(cast(round(l_extendedprice * 100) AS bigint))::double / sum(cast(l_quantity AS bigint))::double / 100 AS close,
         sum(cast(l_quantity AS bigint))::bigint AS volume
  FROM lineitem GROUP BY 1, 2)"""


def sector_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector): the region of the supplier's nation."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    nr = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # region: 5 rows, nation: 25
    return s.join(F.broadcast(nr), s["s_nationkey"] == nr["n_nationkey"]).select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"))


SECTOR = """sector AS (
  SELECT s_suppkey AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, amount): line items with the highest discount, in whole cents."""
    rows = table(spark, sf_dir, "lineitem").where("l_discount >= 0.1 and l_quantity >= 45")
    return rows.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg((F.max("l_quantity") / 10).alias("amount"))


DIVIDENDS = """dividends AS (
  SELECT l_suppkey AS ticker, l_shipdate::date AS date, max(l_quantity) / 10 AS amount
  FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 45 GROUP BY 1, 2)"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, split_factor): one each day on which a supplier ships at the highest tax."""
    rows = table(spark, sf_dir, "lineitem").where("l_tax >= 0.08 and l_quantity >= 50")
    ratio = F.when(F.col("l_suppkey") % 3 == 0, "1:2").otherwise("2:1")
    return rows.select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), ratio.alias("split_factor")).distinct()


SPLITS = """splits AS (
  SELECT DISTINCT l_suppkey AS ticker, l_shipdate::date AS date, CASE WHEN l_suppkey % 3 = 0 THEN '1:2' ELSE '2:1' END AS split_factor
  FROM lineitem WHERE l_tax >= 0.08 AND l_quantity >= 50)"""


def dated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ticker, event_date, session): orders, each with its least supplier."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("ticker"))
    rows = table(spark, sf_dir, "orders").join(first, "o_orderkey")
    session = F.when(F.col("o_orderkey") % 3 == 0, "AMC").otherwise("BMO")
    return rows.select(F.col("o_orderkey").alias("event_id"), "ticker", F.to_date("o_orderdate").alias("event_date"), session.alias("session"))


DATED = """dated AS (
  SELECT o_orderkey AS event_id, min(l_suppkey) AS ticker, any_value(o_orderdate)::date AS event_date, CASE WHEN o_orderkey % 3 = 0 THEN 'AMC' ELSE 'BMO' END AS session
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


# What the driver's event types stand for.
TYPE_OF = {"click": "news", "error": "short_report", "purchase": "earnings_release", "signup": "analyst_rating_change", "view": "13f_delta"}


def unified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ticker, event_date, event_type, value) from the stream table."""
    kinds = F.create_map(*[F.lit(x) for kv in TYPE_OF.items() for x in kv])
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("ticker"), F.to_date("ts").alias("event_date"), F.coalesce(kinds[F.col("event_type")], F.col("event_type")).alias("event_type"), "value")


UNIFIED = """unified AS (
  SELECT event_id, user_id AS ticker, ts::date AS event_date,
         CASE event_type WHEN 'click' THEN 'news' WHEN 'error' THEN 'short_report' WHEN 'purchase' THEN 'earnings_release'
           WHEN 'signup' THEN 'analyst_rating_change' WHEN 'view' THEN '13f_delta' ELSE event_type END AS event_type, value
  FROM events)"""


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(move_id, ticker, move_date, return_pct): large purchases of the stream table."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase' and value >= 40")
    return rows.select(F.col("event_id").alias("move_id"), F.col("user_id").alias("ticker"), F.to_date("ts").alias("move_date"), r6((F.col("value") % 40 - 20) / 100).alias("return_pct"))


MOVES = """moves AS (
  SELECT event_id AS move_id, user_id AS ticker, ts::date AS move_date, round((value % 40 - 20) / 100, 6) + 0.0 AS return_pct
  FROM events WHERE event_type = 'purchase' AND value >= 40)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
