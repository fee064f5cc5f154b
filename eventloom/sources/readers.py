"""Readers: parquet, JSON, JSONL and in-code tables, with as-of filters that reach the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches the path or glob, in whatever store it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def resolve(spark: SparkSession, *paths: str) -> str:
    """The first path that exists; FileNotFoundError if none does."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths}")


def scan(spark: SparkSession, path: str, columns: Iterable[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Parquet with pushed-down filter and projection."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def scan_glob(spark: SparkSession, glob: str, schema: T.StructType | str) -> DataFrame:
    """All files of a glob; an empty frame of the schema if there are none."""
    return spark.read.schema(schema).parquet(glob) if exists(spark, glob) else empty(spark, schema)


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def load_panel(raw: DataFrame, tickers: Iterable[str] | None, as_of: str) -> DataFrame:
    """symbol, report_date (ISO text), decimals to ticker, date, doubles: rows of the tickers up to as_of, both compared as stored."""
    rows = raw.where(F.col("report_date") <= as_of)
    if tickers is not None:
        rows = rows.where(F.col("symbol").isin(sorted({t.upper() for t in tickers})))
    values = [F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in raw.dtypes if c not in ("symbol", "report_date")]
    return rows.select(F.col("symbol").alias("ticker"), F.to_date("report_date").alias("date"), *values)


def load_actions(raw: DataFrame, ticker: str, as_of: str) -> DataFrame:
    """Splits or dividends of one ticker up to as_of, by date."""
    return load_panel(raw, [ticker], as_of).orderBy("date")


def price_series(panel: DataFrame, ticker, start: str, end: str) -> DataFrame:
    return panel.where((F.col("ticker") == ticker) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, tolerant: bool = False) -> DataFrame:
    """One record a line; blank lines are skipped, bad ones fail, or are dropped if tolerant."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON documents."""
    reader = spark.read.option("multiLine", True)
    return (reader if schema is None else reader.schema(schema)).json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases by (ticker, move_date); files named as templates are left out."""
    rows = read_json(spark, path).withColumn("_file", F.input_file_name())
    return rows.where(~F.upper(F.element_at(F.split("_file", "/"), -1)).contains("TEMPLATE")).drop("_file").orderBy("ticker", "move_date")


#: A company's filings: sections are a map from name to sentences.
FILINGS = "cik string, name string, tickers array<string>, filings array<struct<form:string, filingDate:string, reportDate:string, report:map<string,array<string>>>>"


def read_filings(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """One row per filing section: ticker, form, filing_date, period_end, section, sentences. Bad lines are dropped."""
    rows = read_jsonl(spark, path, FILINGS, tolerant=True).withColumn("ticker", F.explode("tickers"))
    if ticker is not None:
        rows = rows.where(F.upper("ticker") == ticker.upper())
    each = rows.select(F.upper("ticker").alias("ticker"), F.explode("filings").alias("f"))
    return each.select("ticker", F.col("f.form").alias("form"), F.expr("try_to_date(f.filingDate)").alias("filing_date"), F.expr("try_to_date(f.reportDate)").alias("period_end"), F.explode("f.report").alias("section", "sentences"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files of a glob by their names <source>_<ticker>_<ISO date>...: path, name, source, ticker, as_of. Files are listed, not read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    parts = r"^([^_]+)_(.+?)_(\d{4}-\d{2}-\d{2})"
    named = files.select("path", name.alias("name"), *(F.nullif(F.regexp_extract(name, parts, i), F.lit("")).alias(c) for i, c in ((1, "source"), (2, "ticker"), (3, "as_of"))))
    return named.withColumn("as_of", F.try_to_date("as_of"))


def latest_snapshot(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """Rows of each source's and ticker's last file (by name, up to as_of); of equal chunk_ids the first counts, in order of file and line.

    The files are chosen from their names, so no other file is opened: a path for each ticker and source.
    """
    from pyspark.sql import Window as W

    known = manifest(spark, path)
    known = known if as_of is None else known.where(F.col("as_of") <= F.lit(as_of).cast("date"))
    chosen = known.groupBy("source", "ticker").agg(F.max(F.struct("name", "path")).alias("last")).select("last.path")
    files = sorted(r["path"] for r in chosen.collect())
    if not files:
        raise FileNotFoundError(f"no snapshot matches {path}")
    rows = spark.read.json(files)
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    first = W.partitionBy("chunk_id").orderBy("_file", "_block", "_row")
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_file", "_block", "_row")


def probe(df: DataFrame, rows: int = 3) -> tuple[list[tuple[str, str]], list]:
    """Column types, and the first rows."""
    return df.dtypes, df.limit(rows).collect()
