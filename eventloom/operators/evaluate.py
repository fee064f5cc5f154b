"""Scores against labelled cases, accuracy, calibration, distribution checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Weights of the assertions.
WEIGHTS = {"dim": 0.5, "dir": 0.25, "char": 0.15, "fade_lean": 0.10, "cite_source": 0.0}


def score_case(matches: dict[str, Column], veto: Column | None = None, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted share of the assertions that hold; a null match was not asserted. A veto takes the dim match back."""
    used = {k: m for k, m in matches.items() if weights[k] > 0}
    if veto is not None and "dim" in used:
        used["dim"] = F.when(used["dim"].isNotNull(), used["dim"] & ~F.coalesce(veto, F.lit(False)))
    hit = sum((F.when(m, weights[k]).otherwise(0.0) for k, m in used.items()), F.lit(0.0))
    total = sum((F.when(m.isNotNull(), weights[k]).otherwise(0.0) for k, m in used.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(hit, F.nullif(total, F.lit(0.0))), F.lit(0.0))


def accuracy(rows: DataFrame, key: str, match: str) -> DataFrame:
    """Scored rows (match not null) and the share that match, 4 places."""
    return rows.groupBy(key).agg(F.count(match).alias("n_scored"), F.round(F.avg(F.col(match).cast("int").cast("double")), 4).alias("accuracy"))


def bucket_stats(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Counts, character shares, means and sign hit rate by each key, by GROUPING SETS in one pass.

    rows: character, return_pct, pred, confidence. Result: bucket_type, bucket, ...
    """
    named = rows.withColumns({f"_{k}": c.cast("string") for k, c in keys.items()})
    names = [f"_{k}" for k in keys]
    kind = F.coalesce(*[F.when(F.grouping(n) == 0, F.lit(n[1:])) for n in names])
    value = F.coalesce(*names)
    hit = F.when(F.col("pred").isNotNull(), (F.signum("pred") == F.signum("return_pct")).cast("int").cast("double"))
    shares = [F.avg((F.col("character") == c).cast("int").cast("double")).alias(f"{c}_share") for c in ("structural", "transient", "mixed", "unclear")]
    return named.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(kind.alias("bucket_type"), value.alias("bucket"), F.count(F.lit(1)).alias("n"), *shares, F.avg("return_pct").alias("avg_return"), F.avg("pred").alias("avg_pred"), F.avg("confidence").alias("avg_confidence"), F.avg(hit).alias("hit_rate")).drop(*names)


def above_floor(summary: DataFrame, metric: str, floors: tuple[str, ...] = ("random", "sentiment"), margin: float = 0.0) -> DataFrame:
    """Each strategy's metric against the better of the floors; passes if the difference reaches the margin."""
    floor = summary.where(F.col("strategy").isin(*floors)).agg(F.max(metric).alias("floor"))
    rows = summary.where(~F.col("strategy").isin(*floors)).crossJoin(F.broadcast(floor))  # one row
    return rows.select("strategy", metric, "floor", (F.col(metric) - F.col("floor")).alias("delta"), (F.col(metric) - F.col("floor") >= margin).alias("passed"))


def sanity_flags(rows: DataFrame, collapse: float = 0.95, coverage: int = 3) -> DataFrame:
    """One row: whether one dominant dimension took over, characters collapsed, or too few rows are there.

    The rows are counted once, by both labels; the few counts are then summed up by each.
    """
    counts = rows.groupBy("dominant", "character").agg(F.count(F.lit(1)).alias("_c"))
    sums = counts.groupingSets([["dominant"], ["character"]], "dominant", "character").agg(F.grouping("dominant").alias("_g"), F.sum("_c").alias("_n"))
    of = lambda g: F.when(F.col("_g") == g, F.col("_n"))
    one = sums.agg(F.sum(of(0)).alias("n"), (F.max(of(0)) / F.sum(of(0))).alias("top_dominant_share"), (F.max(of(1)) / F.sum(of(1))).alias("top_character_share"))
    return one.select("n", "top_dominant_share", "top_character_share", (F.col("top_dominant_share") <= collapse).alias("dominant_ok"), (F.col("top_character_share") <= collapse).alias("character_ok"), (F.col("n") >= coverage).alias("coverage_ok"))


def flags(rows: DataFrame, buckets: dict[str, Column], pnl: Column | None = None, collapse: float = 0.95, coverage: int = 3, least_sharpe: float | None = None) -> DataFrame:
    """Flags of a distribution: kind, bucket_key, observed, threshold; no rows if there is nothing to tell.

    collapse: a character or dominant dimension with more than this share. coverage: a bucket with fewer rows. magnitude: more
    than half of the bets (pnl, null where there is none) win, but mean over deviation is under least_sharpe. All flags
    come from one pass by grouping sets. rows: character, dominant.
    """
    keys = {"move_character": F.col("character"), "dominant_dimension": F.col("dominant")} | buckets
    named = rows.withColumns({f"_{k}": c.cast("string") for k, c in keys.items()} | {"_pnl": F.lit(None).cast("double") if pnl is None else pnl})
    names = [f"_{k}" for k in keys]
    kind = F.coalesce(*[F.when(F.grouping(n) == 0, F.lit(n[1:])) for n in names])
    figures = [F.count("*").alias("n"), F.count("_pnl").alias("bets"), F.count_if(F.col("_pnl") > 0).alias("hits"), F.avg("_pnl").alias("mean"), F.stddev_samp("_pnl").alias("dev")]
    by = named.groupingSets([*[[F.col(n)] for n in names], []], *[F.col(n) for n in names]).agg(kind.alias("bucket"), F.coalesce(*names).alias("value"), *figures)
    # a label's share is of its own set; the other buckets, which are many, aren't summed up
    label = F.col("bucket").isin("move_character", "dominant_dimension")
    share = F.col("n") / F.sum("n").over(W.partitionBy("bucket", F.when(~label, F.col("value"))))
    flag = lambda kind, observed, threshold: F.struct(F.lit(kind).alias("kind"), observed.cast("double").alias("observed"), F.lit(float(threshold)).alias("threshold"))
    told = F.when(label & (F.col("share") > collapse), flag("collapse", F.col("share"), collapse)).when(~label & (F.col("n") < coverage), flag("coverage", F.col("n"), coverage))
    if least_sharpe is not None:
        sharpe = F.when((F.col("bets") > 1) & (F.col("dev") > 0), F.col("mean") / F.col("dev"))
        told = told.when(F.col("bucket").isNull() & (F.try_divide(F.col("hits"), F.col("bets")) > 0.5) & (sharpe < least_sharpe), flag("magnitude", sharpe, least_sharpe))
    out = by.withColumn("share", share).withColumn("_f", told).where("_f is not null")
    return out.select("_f.kind", F.when(F.col("bucket").isNotNull(), F.concat("bucket", F.lit("="), "value")).alias("bucket_key"), "_f.observed", "_f.threshold")


def ols_moments(rows: DataFrame, x: list[str], y: str) -> DataFrame:
    """One row of sums: the normal equations of y on x without intercept."""
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for i, a in enumerate(x) for b in x[i:]]
    return rows.agg(F.count(F.lit(1)).alias("n"), *cells, *[F.sum(F.col(a) * F.col(y)).alias(f"{a}__y") for a in x])


def persistence_fit(rows: DataFrame, x: list[str], y: str, prior: dict[str, float], least: int = 6) -> dict[str, float]:
    """Minimum-norm least squares, scaled to a largest coefficient of 1 and clipped; the prior where there are too few rows."""
    import numpy as np

    m = ols_moments(rows.dropna(subset=[*x, y]), x, y).first()
    if m["n"] < least:
        return dict(prior)
    a = np.array([[m[f"{p}__{q}"] if f"{p}__{q}" in m else m[f"{q}__{p}"] for q in x] for p in x], float)
    beta = np.linalg.pinv(a) @ np.array([m[f"{p}__y"] for p in x], float)
    top = np.abs(beta).max()
    return {k: float(np.clip(b / top if top else 0.0, -1, 1)) for k, b in zip(x, beta, strict=True)}
