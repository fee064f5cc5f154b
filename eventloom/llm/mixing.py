"""Mixing sources to target weights by Poisson replication.

A source of weight w has the mean repetition rate w * total / size, sizes being characters over all
documents. Each document's uniform number comes from a hash of seed, doc_id and text; the inverse of
the Poisson distribution turns it into a count, so expected sizes follow the weights and any task can
redo its part. Documents are exploded by their counts, and each copy goes to a place that a second hash
fixes: partitions by hash, and sorted by it within them.

Sources without a weight share what the named ones leave, in proportion to their sizes; with no weight
left over they go. What belongs to sources that aren't there goes to the others, in proportion to theirs. A null source counts as one source of its own, a null or empty text has size 0
and is drawn as others of its source. Repeated rows draw the same count, as the hash is the same, and
their copies have one place; rows that share only a doc_id (or have none) are spread by their texts. A
source of no characters at all has rate 0. Rates and the number of sources have no upper bound: a tiny
source beside a long text is repeated as often as its weight asks for, its copies dealt out by blocks. Columns
pass unchanged; copy and shuffle_key are added (a column of such a name is replaced).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import hash_unit

#: Up to this rate thresholds are summed from 0 on; over it, outwards from the mean (`quantiles`).
MAX_RATE = 64.0
NO_SOURCE = "(none)"
#: So many named sources are a literal map at most; more of them, or long tables of thresholds, are joined as a table.
MAX_LITERAL = 100
#: Copies of a document that are made in one place; a document with more is dealt out by blocks of so many.
BLOCK = 1024


def thresholds(rate: float) -> list[float]:
    """P(N <= k) for k from 0 until it is 1 but for 1e-15; a uniform number's count is how many it reaches."""
    if not 0 <= rate <= MAX_RATE:
        raise ValueError(f"a repetition rate of {rate} is not within 0 and {MAX_RATE}")
    p = total = math.exp(-rate)
    out, k = [total], 0
    while total < 1 - 1e-15 and (k < rate or p > 1e-18):
        k += 1
        p *= rate / k
        total += p
        out.append(min(total, 1.0))
    return out


def quantiles(rate: float) -> tuple[int, list[float]]:
    """A least count and the thresholds from it on. Counts further off than these are less likely than 1e-16 in all."""
    if rate <= MAX_RATE:
        return 0, thresholds(rate)
    mode, reach = int(rate), int(10 * math.sqrt(rate)) + 10
    low = max(0, mode - reach)
    up = np.cumprod(rate / np.arange(mode + 1, mode + reach + 1))
    down = np.cumprod(np.arange(mode, low, -1) / rate)[::-1]
    total = np.cumsum(np.concatenate([down, [1.0], up]))
    return low, (total / total[-1]).tolist()


def rates(sizes: dict[str | None, int], weights: dict[str, float], size: float = 1.0) -> dict[str | None, float]:
    """Mean repetitions of each source's documents; the mix is `size` times as large as the input."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights are not negative and add up to 1 at most")
    total = sum(sizes.values())
    rest = max(0.0, 1 - sum(weights.values()))
    others = sum(n for s, n in sizes.items() if s not in weights)
    share = {s: weights[s] if s in weights else (rest * n / others if others else 0.0) for s, n in sizes.items()}
    present = math.fsum(share[s] for s, n in sizes.items() if n)
    return {s: share[s] / present * total * size / n if n and present else 0.0 for s, n in sizes.items()}


def source_sizes(docs: DataFrame, weights: dict[str, float]) -> tuple[dict[str | None, int], DataFrame, bool]:
    """Characters of each named source and, under None, of the others, which have one rate together; the others without
    characters, as a table; and whether there are any."""
    each = docs.groupBy(F.coalesce("source", F.lit(NO_SOURCE)).alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("n"))
    named = F.col("source").isin(list(weights)) if weights else F.lit(False)
    rows = each.groupBy(F.when(named, F.col("source")).alias("source")).agg(F.sum("n").alias("n"), F.min("n").alias("least")).collect()
    bare = each.where(~named & (F.col("n") == 0)).select("source")
    return {r["source"]: r["n"] for r in rows}, bare, any(r["source"] is None and r["least"] == 0 for r in rows)


def drawn(docs: DataFrame, rate_of: dict[str | None, float], seed: int) -> DataFrame:
    """The documents, which carry their text's digest _mix_text, with their count, _mix_n."""
    u = hash_unit(F.lit(f"mix{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_mix_text"))
    source = F.coalesce("source", F.lit(NO_SOURCE))
    if len(rate_of) <= MAX_LITERAL and max(rate_of.values(), default=0.0) <= MAX_RATE:
        steps = {s: F.array(*[F.lit(c) for c in thresholds(r)]) for s, r in rate_of.items()}
        rest = steps.pop(None, F.array(F.lit(1.0)))
        own = F.create_map(*[x for s, cs in sorted(steps.items()) for x in (F.lit(s), cs)])[source] if steps else F.lit(None)
        return docs.withColumn("_mix_n", F.size(F.filter(F.coalesce(own, rest), lambda c: c <= u)))
    rows = [(s, *quantiles(r)) for s, r in rate_of.items()]
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))]
    table = docs.sparkSession.createDataFrame(pa.table(columns, names=["_mix_source", "_mix_low", "_mix_steps"]))
    # The others' row has no source; it stands for every document that no named row takes.
    named = docs.join(F.broadcast(table.where("_mix_source is not null")), source == F.col("_mix_source"), "left")
    others = table.where("_mix_source is null").select(F.col("_mix_low").alias("_mix_low0"), F.col("_mix_steps").alias("_mix_steps0"))
    both = named.join(F.broadcast(others), F.lit(True), "left")
    steps = F.coalesce("_mix_steps", "_mix_steps0", F.array(F.lit(1.0)))
    n = F.coalesce("_mix_low", "_mix_low0", F.lit(0)) + F.size(F.filter(steps, lambda c: c <= u))
    return both.withColumn("_mix_n", n).select(*docs.columns, "_mix_n")


def repeated(docs: DataFrame, most: float) -> DataFrame:
    """Each document _mix_n times with copy from 1 on; `most` is the highest rate."""
    kind = "int" if most < 2**30 else "long"
    number = lambda c: c.cast(kind)
    run = lambda low, high: F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast(f"array<{kind}>")))
    if most <= MAX_RATE:
        return docs.withColumn("copy", run(number(F.lit(1)), number(F.col("_mix_n")))).drop("_mix_n")
    few = docs.where(F.col("_mix_n") <= BLOCK).withColumn("copy", run(number(F.lit(1)), number(F.col("_mix_n"))))
    blocks = docs.where(F.col("_mix_n") > BLOCK).withColumn("_mix_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_mix_n") - 1) / BLOCK))))
    dealt = blocks.repartition("doc_id", "_mix_block")
    low = F.col("_mix_block") * BLOCK
    many = dealt.withColumn("copy", run(number(low + 1), number(F.least(F.col("_mix_n"), low + BLOCK))))
    return few.drop("_mix_n").unionByName(many.drop("_mix_n", "_mix_block"))


def mix(docs: DataFrame, weights: dict[str, float], size: float = 1.0, seed: int = 1) -> DataFrame:
    """The shuffled mix: the documents' columns, copy (from 1 on) and shuffle_key."""
    sizes, bare, any_bare = source_sizes(docs, weights)
    rate_of = rates(sizes, weights, size)
    kept = docs.drop("copy", "shuffle_key").withColumn("_mix_text", F.md5(F.coalesce("text", F.lit(""))))
    if any_bare:
        empty = F.coalesce(F.length("text"), F.lit(0)) == 0
        bare = bare.withColumnRenamed("source", "_mix_bare")
        left = kept.where(empty).join(bare, F.coalesce("source", F.lit(NO_SOURCE)) == F.col("_mix_bare"), "left_anti")
        kept = kept.where(~empty).unionByName(left)
    copies = repeated(drawn(kept, rate_of, seed), max(rate_of.values(), default=0.0))
    key = F.md5(F.concat_ws("|", F.lit(f"shuffle{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_mix_text", "copy"))
    return copies.withColumn("shuffle_key", key).drop("_mix_text").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: The production mix: the largest source is held down to a tenth, four others are raised.
WEIGHTS = {"src0": 0.10, "src1": 0.12, "src2": 0.10, "src3": 0.08, "src4": 0.06}


def mix_sql(weights: dict[str, float], size: float, seed: int) -> str:
    """The same mix in DuckDB's SQL, as a set of rows."""
    named = ", ".join(f"('{s}', {w!r}::double)" for s, w in sorted(weights.items()))
    rest = max(0.0, 1 - sum(weights.values()))
    return f"""
WITH RECURSIVE named(source, weight) AS (VALUES {named}),
sizes AS (SELECT coalesce(source, '{NO_SOURCE}') AS source, sum(coalesce(length(text), 0))::double AS n FROM documents GROUP BY 1),
whole AS (SELECT sum(n) AS total, sum(n) FILTER (source NOT IN (SELECT source FROM named)) AS others FROM sizes),
rate AS (
  SELECT source, CASE WHEN n > 0 AND present > 0 THEN share / present * total * {size!r} / n ELSE 0.0 END AS rate
  FROM (SELECT *, sum(share) FILTER (n > 0) OVER () AS present
        FROM (SELECT source, n, total, coalesce(weight, {rest!r} * n / others) AS share FROM sizes LEFT JOIN named USING (source) CROSS JOIN whole))),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS total FROM rate
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) FROM steps WHERE total < 1 - 1e-15 AND p > 1e-18),
cdf AS (SELECT source, list(total) AS cs FROM steps GROUP BY source),
drawn AS (
  SELECT d.*, md5(coalesce(text, '')) AS t, ('0x' || substr(md5(concat_ws('|', 'mix{seed}', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))), 1, 13))::bigint / pow(2, 52) AS u
  FROM documents d),
counted AS (
  SELECT drawn.* EXCLUDE (u), len(list_filter(cs, lambda c: c <= u)) AS times
  FROM drawn JOIN cdf ON cdf.source = coalesce(drawn.source, '{NO_SOURCE}')),
copies AS (SELECT * EXCLUDE (times), unnest(range(1, times + 1))::int AS copy FROM counted)
SELECT * EXCLUDE (t), md5(concat_ws('|', 'shuffle{seed}', coalesce(doc_id::varchar, ''), t, copy::varchar)) AS shuffle_key FROM copies
"""
