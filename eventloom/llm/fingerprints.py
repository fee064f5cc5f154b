"""Document fingerprints: MinHash over word shingles.

A text's shingles are the rows of five words that end at each of its words (rows at the start are
shorter), words being cut at white space and lower-cased. Each shingle is hashed to 64 bits; PERMS
universal hash functions (multiply, add, shift) permute the hashes and the least value of each makes up
the signature. Equal texts have equal fingerprints; the share of equal places estimates the Jaccard
similarity. A text without a word has a fingerprint of its own.

``near_duplicates`` joins signature bands in Spark and verifies the Jaccard similarity of the shingle
sets. ``compare_edited`` compares each text with an edit of itself and with the next document: texts meet
their next ones by a shuffle on ranges of doc_id; a pair whose signatures agree in a whole band is a
candidate, and its Jaccard similarity is verified on the shingle sets.

Null texts count as empty. Equal doc_ids follow each other, ordered by their texts; a null doc_id comes
last. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import jaccard_join
from eventloom.llm.common import BATCH_ROWS, bound_batches, map_batches, staged, texts

PERMS, BANDS, WORDS, LEAST = 64, 16, 5, 0.8
#: Words whose hashes a worker keeps; a full table is emptied.
MAX_WORDS = 400_000
#: Shingles whose permutations are held at once: all of them for few, one after the other for many.
ROWS, SLICE = 128, 1 << 13

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, PERMS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, PERMS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_words: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    parts = text.lower().split()
    found = list(map(_words.get, parts))
    if None in found:
        for i, x in enumerate(found):
            if x is None:
                found[i] = h = xxhash.xxh64_intdigest(parts[i])
                if len(_words) >= MAX_WORDS:
                    _words.clear()
                if len(parts[i]) <= 48:
                    _words[parts[i]] = h
    return np.array(found, np.uint64)


def shingles(text: str, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the rows of `width` words that end at each word."""
    h = word_hashes(text)
    if not len(h):
        return h
    padded = np.concatenate([np.zeros(width - 1, np.uint64), h])
    out = np.zeros(len(h), np.uint64)
    for k in range(width):
        out = (out ^ padded[k : k + len(h)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation, uint32; all ones for no shingles."""
    least = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    if len(hashes) <= 8 * ROWS:
        for at in range(0, len(hashes), ROWS):
            values = (hashes[at : at + ROWS, None] * _A + _B) >> np.uint64(32)
            np.minimum(least, values.min(axis=0).astype(np.uint32), out=least)
        return least
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE]
        for k in range(PERMS):
            least[k] = min(least[k], ((part * _A[k] + _B[k]) >> np.uint64(32)).min())
    return least


def fingerprint(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def same_bands(a: np.ndarray, b: np.ndarray) -> int:
    """In how many of BANDS bands two signatures agree wholly."""
    return int((a == b).reshape(BANDS, -1).all(axis=1).sum())


def verified(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float | None:
    """The Jaccard similarity of two (shingles, signature), if they share a band."""
    return jaccard(a[0], b[0]) if same_bands(a[1], b[1]) else None


def described(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = shingles(text)
    return found, signature(found)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted distinct arrays; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, in one pass without a shuffle."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = texts(batch)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, every)), pa.int64()), pa.array([fingerprint(signature(shingles(t))) for t in every], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return map_batches(docs.select("doc_id", "text"), each, "doc_id long, n_chars long, fingerprint string")


def band_edges(nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """Edges (a, b) from each node to the least one of every band that it shares. nodes: node, tokens (a signature).

    Bands of four places find a pair at 0.8 with 0.9998; for a lower threshold they would lose links.
    """
    if least < LEAST:
        raise ValueError(f"bands are laid out for similarities of {LEAST} and more")
    rows = jaccard_join.TOKENS // BANDS

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bands = [hashlib.blake2b(t[4 * rows * k : 4 * rows * (k + 1)], digest_size=8, salt=bytes([k])).digest() for t in batch.column("tokens").to_pylist() for k in range(BANDS)]
        again = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
        return pa.RecordBatch.from_arrays([pa.array(bands, pa.binary()), batch.column("node").take(again)], ["band", "node"])

    shared = staged(map_batches(nodes.select("node", "tokens"), each, "band binary, node binary"), "bands")
    least = shared.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "a")
    out = shared.join(least, "band").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))
    out.staged_paths = shared.staged_paths
    return out


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per document with its class and number of links, as ``jaccard_join.join_similar`` describes them.

    Bands of MinHash signatures (of five-word rows) are joined to the least member of their bucket, so no
    pairs of a bucket are listed; what they connect is verified by Jaccard similarity on whole sets.
    """
    return jaccard_join.join_similar(docs, least, band_edges)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first characters of the next one (or all of it)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_edited(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per document, in descending doc_id order of neighbours: see the module's query contract.

    Documents are dealt to ranges of doc_id, cut at approximate quantiles. Each range's largest doc_id
    goes to the range before it too, so each task knows what follows its last row; the very first
    document also goes to the last range. Texts are shuffled once.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(x) for x in (rows.stat.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else [])}, reverse=True)
    # range 0 holds the ids over the first cut, and so on; null ids come last
    at = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        at = F.when(F.col("doc_id") > cuts[k], k).otherwise(at)
    if len(cuts) > 64:  # a deep expression is slow; the same by position in a sorted array
        ascending = F.array(*[F.lit(c) for c in reversed(cuts)])
        at = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.size(F.filter(ascending, lambda c: c >= F.col("doc_id"))))
    placed = rows.withColumn("part", at)
    # a row for each range
    heads = [(r["part"], r["head"]) for r in placed.select("part", "doc_id").groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()]
    if not heads:
        return spark.createDataFrame([], RESULT)
    before = {part: heads[i - 1][0] for i, (part, _) in enumerate(heads)}  # the first range's head follows the last range
    guest = F.lit(None).cast("int")
    for part, head in heads:
        mine = F.col("doc_id") == head if head is not None else F.col("doc_id").isNull()
        guest = F.when((F.col("part") == part) & mine, before[part]).otherwise(guest) if len(heads) <= 64 else guest
    if len(heads) > 64:
        table = F.create_map(*[F.lit(x) for part, head in heads for x in (part, before[part])])
        largest = F.create_map(*[F.lit(x) for part, head in heads for x in (part, head if head is not None else -(2**63))])
        guest = F.when(F.coalesce(F.col("doc_id"), F.lit(-(2**63))) == largest[F.col("part")], table[F.col("part")])
    copies = placed.withColumn("copy", F.explode(F.filter(F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("guest")), F.struct(guest.alias("p"), F.lit(True).alias("guest"))), lambda x: x["p"].isNotNull())))
    dealt = copies.select("doc_id", "text", "copy.p", "copy.guest").repartitionById(n, F.col("p").cast("int")).sortWithinPartitions("p", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for what follows it: (doc_id, text, its shingles and signature, part)
        out: list[tuple] = []
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(lo, BATCH_ROWS)
                for key, text, part, is_guest in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "p", "guest")], strict=True):
                    if held and held[3] != part:
                        held = None  # it was a guest's part that ended
                    if is_guest and held is None:
                        continue  # of several guests only the first follows
                    mine = described(text)
                    if held:
                        new, old = edited(held[1], text), held[2]
                        changed = described(new)
                        near = (likeness(old[1], changed[1]), likeness(old[1], mine[1]))
                        out.append((held[0], len(held[1]), hashlib.sha256(new.encode()).hexdigest(), fingerprint(old[1]), fingerprint(changed[1]), *near, same_bands(old[1], changed[1]), same_bands(old[1], mine[1]), verified(old, changed), verified(old, mine)))
                    held = None if is_guest else (key, text, mine, part)
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in out], schema=_ARROW)
                out = []

    return dealt.mapInArrow(run, RESULT)


#: bands_*: bands shared with the edited text and with the next one; jaccard_*: the verified similarity, null without a shared band.
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int, jaccard_edited double, jaccard_next double"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in RESULT.split(", ")])
