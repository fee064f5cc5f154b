"""Scores of evidence, classification rules, and hash-based random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quality of sources, of publishers (in order of look-up), and half-lives in days.
SOURCE_QUALITY = {
    "sec_10k": 1.00,
    "sec_10q": 0.95,
    "earnings_transcript": 0.95,
    "sec_8k": 0.90,
    "macro": 0.80,
    "research_13f": 0.80,
    "thirteen_f": 0.80,
    "short_interest": 0.75,
    "index_change": 0.70,
    "news": 0.70,
    "peer_news": 0.55,
    "sector_news": 0.45,
}
OTHER_QUALITY = 0.50
PUBLISHER_QUALITY = (
    ("reuters", 1.10),
    ("bloomberg", 1.10),
    ("wall street journal", 1.10),
    ("wsj", 1.10),
    ("financial times", 1.05),
    ("cnbc", 1.00),
    ("barron's", 1.00),
    ("barrons", 1.00),
    ("marketwatch", 1.00),
    ("dow jones", 1.00),
    ("associated press", 1.00),
    ("yahoo finance", 0.90),
    ("yahoo", 0.90),
    ("investopedia", 0.85),
    ("seeking alpha", 0.70),
    ("the motley fool", 0.65),
    ("motley fool", 0.65),
    ("zacks", 0.70),
    ("benzinga", 0.65),
    ("insider monkey", 0.55),
    ("simply wall st", 0.70),
)
UNKNOWN_PUBLISHER = 0.85
HALF_LIFE = {
    "news": 7.0,
    "peer_news": 5.0,
    "sector_news": 10.0,
    "earnings_transcript": 60.0,
    "sec_10k": 180.0,
    "sec_10q": 90.0,
    "sec_8k": 30.0,
    "macro": 21.0,
    "research_13f": 30.0,
    "thirteen_f": 30.0,
    "short_interest": 14.0,
    "index_change": 30.0,
}
OTHER_HALF_LIFE = 14.0
# Kinds of news; how well a source fits a move of another ticker; the words of ratings.
ALIGNMENT = {"peer_news": 0.60, "sector_news": 0.40, "macro": 0.50, "short_interest": 0.50, "thirteen_f": 0.50, "index_change": 0.50, "research_13f": 0.50}
SAME_TICKER, OTHER_ALIGNMENT = 1.0, 0.30
NEWS = ("news", "peer_news", "sector_news")
BUY = ("buy", "strong buy", "outperform", "overweight", "positive", "accumulate", "add", "conviction buy", "top pick", "sector outperform")
HOLD = ("hold", "neutral", "market perform", "equal weight", "equal-weight", "peer perform", "sector perform", "in-line", "inline", "mixed")
SELL = ("sell", "strong sell", "underperform", "underweight", "negative", "reduce", "sector underperform")


def lookup(table: dict, key: Column, other) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(other))


def source_quality(source: Column, publisher: Column) -> Column:
    """Base quality, for news times the publisher's factor; at most 1."""
    name = F.lower(F.trim(F.coalesce(publisher, F.lit(""))))
    factor = F.when(~F.coalesce(source.isin(*NEWS), F.lit(False)), 1.0).when(name == "", UNKNOWN_PUBLISHER)
    for key, f in PUBLISHER_QUALITY:
        factor = factor.when(name.contains(key), f)
    return F.least(F.lit(1.0), lookup(SOURCE_QUALITY, source, OTHER_QUALITY) * factor.otherwise(UNKNOWN_PUBLISHER))


def recency(source: Column, published: Column, move_date: Column) -> Column:
    """Halves every half-life; 0 for what is dated after the move."""
    days = F.datediff(move_date, published)
    return F.when(days < 0, 0.0).otherwise(F.exp(-math.log(2) * days / lookup(HALF_LIFE, source, OTHER_HALF_LIFE)))


def alignment(source: Column, ticker: Column, move_ticker: Column) -> Column:
    same = F.upper(F.coalesce(ticker, F.lit(""))) == F.upper(F.coalesce(move_ticker, F.lit("")))
    return F.when(same, SAME_TICKER).otherwise(lookup(ALIGNMENT, source, OTHER_ALIGNMENT))


def weight_tier(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.40, "MED").otherwise("LOW")


def tag_weight(text: Column, score: Column) -> Column:
    """The text with its weight in front; an earlier tag is replaced."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\[EVIDENCE_WEIGHT [^\]]+\]\s*", "")
    return F.rtrim(F.concat(F.lit("[EVIDENCE_WEIGHT "), weight_tier(score), F.format_string(" (%.2f)] ", score), bare))


def hash_uniform(*parts: Column) -> Column:
    """The first twelve hexadecimal digits of the sha-256 of the parts joined by '|', over 16^12."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12), 16, 10).cast("long").cast("double") / float(16**12)


def hash_normal(*parts: Column) -> Column:
    """Box-Muller over two hash numbers."""
    u, v = (F.greatest(hash_uniform(*parts, F.lit(k)), F.lit(1e-12)) for k in ("u", "v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def rating_bucket(rating: Column) -> Column:
    """Buy, Hold or Sell; an unknown rating passes trimmed, a blank one is null."""
    key = F.lower(F.trim(rating))
    return F.when(key.isin(*BUY), "Buy").when(key.isin(*HOLD), "Hold").when(key.isin(*SELL), "Sell").otherwise(F.when(rating != "", F.trim(rating)))


def rating_action(prior: Column, new: Column, hint: Column) -> Column:
    """initiate without a prior rating; up or down by bucket; else by the hint; else reiterate."""
    rank = lambda r: F.when(rating_bucket(r) == "Sell", 0).when(rating_bucket(r) == "Hold", 1).when(rating_bucket(r) == "Buy", 2)
    a, b = rank(prior), rank(new)
    hints = {"up": "upgrade", "down": "downgrade", "init": "initiate", "reit": "reiterate", "main": "reiterate"}
    return (
        F.when(F.coalesce(prior, F.lit("")) == "", "initiate")
        .when(b > a, "upgrade")
        .when(b < a, "downgrade")
        .when(b == a, "reiterate")
        .otherwise(lookup(hints, F.coalesce(hint, F.lit("")), "reiterate"))
    )


def target_direction(prior: Column, new: Column) -> Column:
    """raise, lower or maintain; initiate where there is no positive prior; 0 counts as missing."""
    a, b = F.nullif(prior, F.lit(0.0)), F.nullif(new, F.lit(0.0))
    return F.when(a.isNull(), "initiate").when(b > a, "raise").when(b < a, "lower").otherwise("maintain")


def target_change(prior: Column, new: Column) -> Column:
    return F.when(prior > 0, (new - prior) / prior)


def days_to_cover(text: Column) -> Column:
    """A number from text; null for blanks and for 999 and more."""
    v = F.trim(text).try_cast("double")
    return F.when(v < 999, v)


def entropy_share(weights: list[Column]) -> Column:
    """Entropy of weights that add up to 1, over its largest value."""
    terms = [F.when(w > 0, -w * F.log(w)).otherwise(0.0) for w in weights]
    return sum(terms[1:], terms[0]) / math.log(len(weights))


def nine_places(c: Column) -> Column:
    """Rounded to 9 places by steps that every engine does alike; a tie goes up. Values that are stored are rounded here, once."""
    return F.floor(c * 1e9 + 0.5) / 1e9
