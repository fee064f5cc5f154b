"""Frames that a page is served from: attributions, their dimensions and the chunks they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How long a served text may be, and the places of weights.
TEXT_CAP, WEIGHT_PLACES = 600, 4


def capped(text: Column, most: int = TEXT_CAP) -> Column:
    """The text, or its first characters and an ellipsis where it is longer; a null stays null."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("…")))


def chunk_payload(chunks: DataFrame, *keep: str) -> DataFrame:
    """One struct `chunk` for each chunk, with its date as ISO text and its text capped."""
    optional = [F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in ("section_name", "source_url")]
    return chunks.select(*keep, F.struct("chunk_id", "source_type", F.col("publication_date").cast("date").cast("string").alias("publication_date"), *optional, capped(F.col("text")).alias("text")).alias("chunk"))


def dimension_payload(weight: Column, direction: Column, rationale: Column, cited: Column, ids: Column) -> Column:
    """A dimension's struct; cited: array of struct chunk_id, quote, reasoning. Missing lists are empty."""
    shaped = F.transform(cited, lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["quote"].alias("quote"), c["reasoning"].alias("reasoning")))
    nothing = F.array().cast("array<struct<chunk_id:string,quote:string,reasoning:string>>")
    return F.struct(
        F.coalesce(shaped, nothing).alias("cited_evidence"),
        F.round(weight.cast("double"), WEIGHT_PLACES).alias("weight"),
        direction.alias("direction"),
        rationale.alias("rationale"),
        F.coalesce(ids, F.array().cast("array<string>")).alias("evidence_chunk_ids"),
    )


def ticker_order(known: list[str], asked: str = "") -> tuple[list[str], list[str]]:
    """The tickers to build, in the order asked for (comma-separated; all if nothing is asked), and those that aren't known."""
    wanted = [t.strip().upper() for t in asked.split(",") if t.strip()]
    return ([t for t in wanted if t in known], [t for t in wanted if t not in known]) if wanted else (list(known), [])
