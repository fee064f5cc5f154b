"""Articles by the tickers they name: an index that is made once and asked many times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders over which symbols are dealt; a ticker's articles lie in one, a busy one's in several files of it.
BUCKETS = 64


def bucket(symbol: Column) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(BUCKETS)).cast("int")


def write_bridge(articles: DataFrame, path: str, symbols: str = "symbols", mode: str = "overwrite") -> None:
    """(symbol, article_id, published), a row for each symbol that an article names, by folders of symbols and sorted in them.

    articles: article_id, published and an array of symbols, which are trimmed and upper-cased; blank ones go. With mode append
    new articles are added; an article that is added twice is found once.
    """
    each = articles.select("article_id", "published", F.explode(symbols).alias("symbol")).withColumn("symbol", F.upper(F.trim("symbol"))).where("symbol <> ''").distinct()
    dealt = each.withColumn("b", bucket(F.col("symbol")))
    # the time joins the key, so a symbol that a third of all articles name is written by many tasks
    dealt.repartition("b", F.trunc("published", "year")).sortWithinPartitions("b", "symbol", "published").write.mode(mode).partitionBy("b").parquet(path)


def articles_of(spark: SparkSession, path: str, tickers: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """(symbol, article_id, published) of these tickers within the dates: only their folders are read, and of those only their row groups."""
    wanted = sorted({t.strip().upper() for t in tickers if t.strip()})
    folders = [r[0] for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(bucket(F.col("t"))).distinct().collect()] if wanted else []
    rows = spark.read.parquet(path).where(F.col("b").isin(folders) & F.col("symbol").isin(wanted))
    if start:
        rows = rows.where(F.col("published") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("published") <= F.lit(end).cast("date"))
    return rows.select("symbol", "article_id", "published").distinct()


def news_of(articles: DataFrame, found: DataFrame) -> DataFrame:
    """The articles that ``articles_of`` found; an article that names several of the tickers is one row."""
    return articles.join(found.select("article_id").distinct(), "article_id", "left_semi")
