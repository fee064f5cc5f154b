"""Exact quantiles of groups of any size by rank selection: histograms of ever narrower ranges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.sources.staging import staged

#: Buckets of a range, and values of one range that are fetched to be ordered.
BUCKETS = 4096


def exact_quantiles(rows: DataFrame, value: str, shares: tuple[float, ...], key: str | None = None) -> dict[object, list[float | None]]:
    """Interpolated quantiles of the values that aren't null or NaN, of each group; groups are few (their brackets come to the driver).

    A pass counts the values of each wanted rank's range in BUCKETS equal parts, which tasks sum up before the shuffle;
    the part that holds the rank, cut to its least and largest value, is the next range. It ends where that has
    one value or BUCKETS values at most, which are fetched. So no task ever holds a group, and a pass shrinks
    each range by the factor BUCKETS at least.
    """
    group = F.lit(0) if key is None else F.col(key)
    values = staged(rows.select(group.alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")), "values")
    sizes = {r["g"]: r for r in values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    wanted = {(g, k) for g, r in sizes.items() for q in shares for k in (math.floor(q * (r["n"] - 1)), math.ceil(q * (r["n"] - 1)))}
    open_ranks = {(g, k): (sizes[g]["lo"], sizes[g]["hi"], k, sizes[g]["n"]) for g, k in wanted}  # range, rank within it, its size
    found: dict[tuple, float] = {}
    spark, kind = rows.sparkSession, dict(values.dtypes)["g"]
    while open_ranks:
        found |= {at: lo for at, (lo, hi, _, _) in open_ranks.items() if lo == hi}
        open_ranks = {at: x for at, x in open_ranks.items() if at not in found}
        if not open_ranks:
            break
        ranges = sorted({(g, lo, hi, n) for (g, _), (lo, hi, _, n) in open_ranks.items()}, key=repr)
        small = [x for x in ranges if x[3] <= BUCKETS]
        large = [x for x in ranges if x[3] > BUCKETS]

        def within(some: list) -> DataFrame:
            # two rows a group and share
            asked = spark.createDataFrame([x[:3] for x in some], f"of {kind}, lo double, hi double")
            return values.join(F.broadcast(asked), F.col("g").eqNullSafe(F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi"))).select("g", "lo", "hi", "v")

        if small:
            held: dict[tuple, list[float]] = {}
            for r in within(small).collect():
                held.setdefault((r["g"], r["lo"], r["hi"]), []).append(r["v"])
            for (g, k), (lo, hi, place, _) in list(open_ranks.items()):
                if (g, lo, hi) in held:
                    found[g, k] = sorted(held[g, lo, hi])[place]
                    del open_ranks[g, k]
        if large:
            part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
            counted = within(large).groupBy("g", "lo", "hi", part.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
            parts: dict[tuple, list] = {}
            for r in counted.orderBy("b").collect():  # BUCKETS rows a range
                parts.setdefault((r["g"], r["lo"], r["hi"]), []).append((r["n"], r["least"], r["most"]))
            for at, (lo, hi, place, _) in list(open_ranks.items()):
                for n, least, most in parts.get((at[0], lo, hi), []):
                    if place < n:
                        open_ranks[at] = (least, most, place, n)
                        break
                    place -= n
    out = {}
    for g, r in sizes.items():
        pick = []
        for q in shares:
            at = q * (r["n"] - 1)
            a, b = found[g, math.floor(at)], found[g, math.ceil(at)]
            pick.append(a + (b - a) * (at - math.floor(at)))
        out[g] = pick
    return out
