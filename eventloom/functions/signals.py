"""Attributions as columns, and strategies over them as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.scoring import hash_uniform

# The five dimensions in order, and how lasting each one's moves are.
DIMENSIONS = ("demand", "pricing", "competitive", "management_credibility", "macro")
PERSISTENCE = {"demand": 0.85, "pricing": 0.65, "competitive": 0.45, "management_credibility": -0.15, "macro": -0.75}


def dominant(weights: list[Column] | None = None) -> Column:
    """The name of the largest weight, the earliest of equals."""
    w = weights or [F.col(f"w_{d}") for d in DIMENSIONS]
    return F.array_max(F.array(*[F.struct(c.alias("w"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (c, n) in enumerate(zip(w, DIMENSIONS, strict=True))]))["n"]


def dominant_or_none(weights: list[Column] | None = None) -> Column:
    """As ``dominant``; null if every weight is 0."""
    w = weights or [F.col(f"w_{d}") for d in DIMENSIONS]
    return F.when(F.greatest(*w) > 0, dominant(w))


def ranked_dimensions(most: int = 3) -> Column:
    """Names of positive weights, largest first."""
    rows = F.array(*[F.struct((-F.col(f"w_{d}")).alias("w"), F.lit(i).alias("i"), F.lit(d).alias("n")) for i, d in enumerate(DIMENSIONS)])
    return F.transform(F.slice(F.array_sort(F.filter(rows, lambda x: x["w"] < 0)), 1, most), lambda x: x["n"])


def strength(ret: Column, z: Column) -> Column:
    """Half from the return's size against 15 %, half from the z-score against 5."""
    return 0.5 * F.least(F.lit(1.0), F.abs(ret) / 0.15) + 0.5 * F.least(F.lit(1.0), F.abs(z) / 5)


def character(score: Column) -> Column:
    return F.when(score >= 0.65, "structural").when(score <= 0.35, "transient").otherwise("mixed")


def hashed_weights(*key: Column) -> list[Column]:
    """Five weights that add up to 1, from hash numbers of the key; the seeded stand-in of a model's answer."""
    raw = [hash_uniform(*key, F.lit(d)) + 0.01 for d in DIMENSIONS]
    total = sum(raw[1:], raw[0])
    return [r / total for r in raw]


def split_by_character(c: Column) -> Column:
    return F.when(c == "structural", "lean").when(c == "transient", "fade").otherwise("neutral")


def expected_vs_realised(pred: Column, real: Column, over: float = 1.5, under: float = 0.5) -> Column:
    ratio = F.try_divide(F.abs(real), F.abs(pred))
    return F.when(pred.isNull() | (pred == 0) | (pred * real <= 0), "neutral").when(ratio >= over, "fade").when(ratio <= under, "lean").otherwise("neutral")


def dimension_weighted(weights: list[Column], least: float = 0.2) -> Column:
    score = sum((w * PERSISTENCE[d] for w, d in zip(weights, DIMENSIONS, strict=True)), F.lit(0.0))
    return F.when(score >= least, "lean").when(score <= -least, "fade").otherwise("neutral")


def hybrid(c: Column, pred: Column, real: Column, top: Column, over: float = 1.5) -> Column:
    lasting = F.create_map(*[F.lit(x) for kv in PERSISTENCE.items() for x in kv])[top]
    overshoot = F.coalesce((pred != 0) & (pred * real > 0) & (F.abs(real) >= over * F.abs(pred)), F.lit(False))
    return F.when(c == "transient", "fade").when(c != "structural", "neutral").when(overshoot, "fade").when(F.coalesce(lasting, F.lit(0.0)) < 0, "neutral").otherwise("lean")


def fade_or_follow(c: Column, pred: Column, real: Column) -> Column:
    return (
        F.when(pred.isNull(), split_by_character(c))
        .when(c == "transient", F.when((pred != 0) & (F.abs(real) > 1.5 * F.abs(pred)), "fade").otherwise("neutral"))
        .when((c == "structural") & (pred * real > 0), "lean")
        .otherwise("neutral")
    )


def forced(verdict: Column, c: Column) -> Column:
    """lean or fade; a neutral one leans if structural or mixed."""
    return F.when(verdict != "neutral", verdict).when(c.isin("structural", "mixed"), "lean").otherwise("fade")


def outcome(verdict: Column, ret: Column, fwd: Column) -> Column:
    """right or wrong by the sign of the forward return; null for neutral or unknown."""
    ok = F.when(verdict == "lean", F.signum(ret) == F.signum(fwd)).when(verdict == "fade", F.signum(ret) != F.signum(fwd))
    return F.when(ok, "right").when(~ok, "wrong")


def alignment_state(pred: Column, real: Column) -> Column:
    ratio = F.try_divide(pred, real)
    return F.when(pred.isNull() | real.isNull(), "idle").when(F.signum(pred) != F.signum(real), "miss").when((ratio >= 0.5) & (ratio <= 2), "match").otherwise("partial")


def sentiment(u: Column, threshold: float = 0.33) -> Column:
    """A seeded reading in [-1, 1) as a verdict."""
    s = 2 * u - 1
    return F.when(s > threshold, "lean").when(s < -threshold, "fade").otherwise("neutral")


#: Registry of strategies: columns character, pred, return_pct, dominant, w_* and u to a verdict.
STRATEGIES: dict[str, Callable[[], Column]] = {
    "fundamental_split": lambda: split_by_character(F.col("character")),
    "expected_vs_realised": lambda: expected_vs_realised(F.col("pred"), F.col("return_pct")),
    "dimension_weighted": lambda: dimension_weighted([F.col(f"w_{d}") for d in DIMENSIONS]),
    "hybrid": lambda: hybrid(F.col("character"), F.col("pred"), F.col("return_pct"), F.col("dominant")),
    "fade_or_follow": lambda: fade_or_follow(F.col("character"), F.col("pred"), F.col("return_pct")),
    "always_lean": lambda: F.lit("lean"),
    "always_fade": lambda: F.when(F.abs("return_pct") >= 0.05, "fade").otherwise("neutral"),
    "random": lambda: F.when(hash_uniform(F.col("event_id").cast("string"), F.lit("42")) < 0.5, "lean").otherwise("fade"),
    "sentiment": lambda: sentiment(hash_uniform(F.col("event_id").cast("string"), F.lit("7"))),
}
