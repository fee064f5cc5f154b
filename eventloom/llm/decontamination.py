"""Benchmark decontamination by winnowing, in built-in functions.

Words are hashed (64 bits), and so is each gram of GRAM words. Of every sliding window of WINDOWS grams, which
spans ITEM words, the grams with the least hash are kept, on both sides by the same rule. Two texts
that share ITEM consecutive words share all grams of a window, so at least one gram of that span is kept in both: no
shared span of ITEM words is missed. Kept grams of documents and of benchmark items are joined by
hash; each meeting is extended over the words around it, as far as a span of ITEM words that
holds the gram can reach, and counts if the common run is ITEM words or more. Hashed words stand for words
throughout, so a result holds up to collisions of 64-bit hashes of ten words at once.

An item of fewer words is one window of all its words: documents give every run of that many words as well,
for the lengths that the benchmark has. Items with equal surroundings of a gram are one row of the join; copies of a
document row are one row before hits are brought together, so neither a passage in many items nor in many
documents makes pairs. The benchmark's side is broadcast if its counted size is BROADCAST_BYTES at most,
and joined by shuffle otherwise, where AQE splits a hash that many documents have.

Defined results. Null and empty texts have no words; neither have items of such texts, which occur nowhere. Repeated
rows give repeated results, and so do rows with a null doc_id. Items with a null item_id mark words but are not listed. Items that
are equal texts are all listed; an item_id that stands for several texts is listed once. No benchmark, or an empty
one, leaves every document clean. Only doc_id, text and item_id are read; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words, and the number of consecutive words that make a hit.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ITEM = 10

#: Words of a gram; WINDOWS grams in a row span ITEM words. Two in five grams are kept.
GRAM = 7
WINDOWS = ITEM - GRAM + 1
BROADCAST_BYTES = 64_000_000


def words(text: Column) -> Column:
    """The lower-cased words of a text; none of null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _shifted(name: str, by: int) -> Column:
    return F.slice(name, by + 1, F.greatest(F.size(name) - by, F.lit(0)))


def _pairwise(df: DataFrame, source: str, by: int, fn: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """out[i] = fn(source[i], source[i + by]); the last `by` elements see null."""
    return df.withColumn(out, F.zip_with(source, _shifted(source, by), fn))


def hashed_words(texts: DataFrame) -> DataFrame:
    """h: hashes of the words of `text`, in place of the text."""
    return texts.withColumn("w", words(F.col("text"))).drop("text").withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).drop("w")


def _grams(df: DataFrame, length: int, out: str) -> DataFrame:
    """Hashes of all grams of `length` words of h: of doubled grams, the last two overlapping."""
    have, name = 1, "h"
    while have < length:
        by = min(have, length - have)
        df = _pairwise(df, name, by, lambda a, b: F.xxhash64(F.lit(length), a, b), f"_g{have + by}")
        have, name = have + by, f"_g{have + by}"
    done = F.col("h") if length == 1 else F.slice(name, 1, F.greatest(F.size("h") - (length - 1), F.lit(0)))
    return df.withColumn(out, done).drop(*[c for c in df.columns if c.startswith("_g")])


def kept_grams(hashed: DataFrame, shorter: list[int]) -> DataFrame:
    """One row for each kept gram, and for each run of words of the lengths in `shorter`.

    n words of the gram, hash, at (0-based place of its first word), c (hashed words around it) and lead (how many of them stand before it);
    the other columns but h go along.
    """
    reach = WINDOWS - 1
    df = _grams(hashed, GRAM, "g")
    # least hash of the grams i to i + WINDOWS - 1, for whole windows only
    least, greatest = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    df = _pairwise(_pairwise(df, "g", 1, least, "_2"), "_2", 2, least, "_4").withColumn("m", F.slice("_4", 1, F.greatest(F.size("g") - reach, F.lit(0)))).drop("_2", "_4")
    # a gram is kept if it is the least of one of the windows that hold it, so if the largest of their least hashes is its own
    none = F.array_repeat(F.lit(None).cast("long"), reach)
    df = df.withColumn("_1", F.concat(none, "m", none)).drop("m")
    df = _pairwise(_pairwise(df, "_1", 1, greatest, "_2"), "_2", 2, greatest, "_4").withColumn("top", F.slice("_4", 1, F.size("g"))).drop("_1", "_2", "_4")
    places = F.filter(F.transform(F.arrays_zip("g", "top"), lambda x, i: F.when(x["g"] == x["top"], F.struct(F.lit(GRAM).alias("n"), x["g"].alias("hash"), i.alias("at")))), lambda x: x.isNotNull())
    df = df.withColumn("places", places).drop("g", "top")

    def place(n: int) -> Callable[[Column, Column], Column]:
        return lambda x, i: F.struct(F.lit(n).alias("n"), x.alias("hash"), i.alias("at"))

    for n in shorter:
        df = _grams(df, n, "g").withColumn("places", F.concat("places", F.transform("g", place(n)))).drop("g")

    def around(p: Column) -> Column:
        lead = F.when(p["n"] == GRAM, F.least(p["at"], F.lit(reach))).otherwise(0)
        length = F.when(p["n"] == GRAM, lead + ITEM).otherwise(p["n"])
        return F.struct(p["n"].alias("n"), p["hash"].alias("hash"), p["at"].alias("at"), lead.alias("lead"), F.slice("h", p["at"] - lead + 1, length).alias("c"))

    # the words around a gram are put beside it before rows are made, so that no row carries a whole document
    spots = df.withColumn("spots", F.transform("places", around)).drop("places", "h")
    # outer: for a plain explode the optimizer would push a test of the array's size below all of the steps above, each copied into the next
    return spots.withColumn("spot", F.explode_outer("spots")).drop("spots").where(F.col("spot").isNotNull()).select("*", "spot.*").drop("spot")


def _run(a: Column, at_a: Column, b: Column, at_b: Column, step: int, most: int) -> Column:
    """How many elements of a and b are equal, from the given places on (0-based) in steps of 1 or -1."""
    same = F.lit(0)
    for k in reversed(range(most)):
        i, j = at_a + step * k, at_b + step * k
        hit = (i >= 0) & (j >= 0) & (F.get(a, i) == F.get(b, j))
        same = F.when(F.coalesce(hit, F.lit(False)), 1 + same).otherwise(0)
    return same


def benchmark_grams(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """Kept grams of the items with the items that have them (n, hash, lead, c, need, items), and the lengths of short items."""
    hashed = hashed_words(benchmark.select(F.col("item_id").cast("string").alias("item"), "text")).where(F.size("h") > 0)
    # one row for equal texts
    texts = hashed.groupBy("h").agg(F.collect_set("item").alias("items"))
    size = F.size("h")
    shorter = sorted(r[0] for r in texts.where(size < ITEM).select(size).distinct().collect())  # at most ITEM - 1 lengths
    long_items = kept_grams(texts.where(size >= ITEM), []).withColumn("need", F.lit(ITEM))
    every = long_items
    for n in shorter:
        whole = _grams(texts.where(size == n), n, "g")
        every = every.unionByName(whole.select("items", F.lit(n).alias("n"), F.col("g")[0].alias("hash"), F.lit(0).alias("at"), F.lit(0).alias("lead"), F.col("h").alias("c"), F.lit(n).alias("need")))
    same = every.groupBy("n", "hash", "lead", "c", "need").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return same, shorter


def _row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes of a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n")), F.lit(":"), F.coalesce(text, F.lit("")))))


def hits(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Runs of words that documents share with items: row_key, start, stop (0-based, exclusive), items."""
    grams, shorter = benchmark_grams(benchmark)
    size = F.lit(64) + 8 * F.size("c") + F.aggregate("items", F.lit(0), lambda n, x: n + 16 + F.octet_length(x))
    side = grams.select("n", "hash", F.col("lead").alias("item_lead"), F.col("c").alias("item_c"), "need", "items")
    if (grams.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes:
        side = F.broadcast(side)
    keyed = docs.select(_row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    met = kept_grams(hashed_words(keyed), shorter).join(side, ["n", "hash"])
    back = _run(F.col("c"), F.col("lead") - 1, F.col("item_c"), F.col("item_lead") - 1, -1, WINDOWS - 1)
    on = _run(F.col("c"), F.col("lead"), F.col("item_c"), F.col("item_lead"), 1, ITEM)
    runs = met.select("row_key", "at", "items", "need", back.alias("back"), on.alias("on")).where(F.col("back") + F.col("on") >= F.col("need"))
    return runs.select("row_key", (F.col("at") - F.col("back")).alias("start"), (F.col("at") + F.col("on")).alias("stop"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    # copies of a row find the same runs, which go on once
    found = hits(docs, benchmark, broadcast_bytes).distinct().groupBy("row_key")
    run = F.struct("start", "stop")
    per = found.agg(F.sort_array(F.collect_set(run)).alias("runs"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    new = lambda s, r: F.greatest(r["stop"] - F.greatest(r["start"], s["end"]), F.lit(0))
    covered = F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, r: F.struct((s["n"] + new(s, r)).alias("n"), F.greatest(s["end"], r["stop"]).alias("end")))
    counted = per.select("row_key", covered["n"].cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    every = docs.select("doc_id", _row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = every.join(counted, "row_key", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"))


#: The same by whole windows of words, without hashes.
DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), met AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON bw.x = dw.x AND bw.n = dw.n),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, n, i FROM met)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
