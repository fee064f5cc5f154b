"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters of a bounded, hash-chosen sample of labelled rows (about
MAX_DOCS_PER_LANG of each language; smaller languages whole), in one distributed pass. The matrix of
log probabilities (BUCKETS x languages) is broadcast; scoring gathers and sums its rows in numpy over
whole texts.

Null texts and texts without a letter are `und` with score 0; so is every text if there is nothing to
learn from. Ties go to the language that sorts first. N-grams lie within one text (with a mark at each
end), so rows are independent of each other and repeated rows get equal results. Up to MAX_LANGS
languages can be learned. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import hash_unit, held_out, map_batches, texts

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MAX_DOCS_PER_LANG = 4000
#: Odd multipliers of the n-gram hash, one for each place in it.
PLACES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Characters of the longest slice that is hashed at once, so that memory stays bounded for any text.
SLICE = 1 << 18
#: Log probabilities gathered at once: with many languages slices get shorter, down to MIN_SLICE characters.
VALUES, MIN_SLICE = 1 << 21, 1 << 12
#: The matrix takes 256 KB a language in every task; more languages than this (64 MB) are refused by `train`.
MAX_LANGS = 256


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(f"\0{text.lower()}\0".encode("utf-32-le", "surrogatepass"), np.uint32)


def bucket_ids(chars: np.ndarray, order: int) -> np.ndarray:
    """The bucket of each n-gram of `order` characters."""
    n = len(chars) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h += chars[k : k + n] * np.uint32(PLACES[k])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - 16)


def count_sample(docs: DataFrame, langs: list[str]) -> np.ndarray:
    """Counts (languages x buckets) over rows with doc_id, text, lang."""
    index = {lang: i for i, lang in enumerate(langs)}

    def run(batches):
        total = np.zeros((len(index), BUCKETS), np.int64)
        for batch in batches:
            for t, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                chars = codes(t)
                for order in ORDERS:
                    for at in range(0, len(chars), SLICE):
                        total[index[lang]] += np.bincount(bucket_ids(chars[at : at + SLICE + order - 1], order), minlength=BUCKETS)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], ["l", "b", "n"])

    rows = docs.select("text", "lang").mapInArrow(run, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(langs), BUCKETS), np.int64)
    out[rows["l"].to_numpy(), rows["b"].to_numpy()] = rows["n"].to_numpy()
    return out


def train(docs: DataFrame, max_docs_per_lang: int = MAX_DOCS_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (buckets x languages), from rows that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages to learn; the broadcast matrix is bounded to {MAX_LANGS}")
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, max_docs_per_lang / sizes[lang]))])
    sample = known.where(hash_unit(F.lit("langid"), F.col("doc_id").cast("string")) < share[F.col("lang")])
    counts = count_sample(sample, langs) + 0.5
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)


def score_texts(batch: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sums of its n-grams' log probabilities by language, and its number of n-grams.

    Short texts are hashed together, a long one by slices from its own start; n-grams that reach over a
    text's end are left out. So a text's result doesn't depend on what else is in the batch.
    """
    sums, sizes = np.zeros((len(batch), matrix.shape[1])), np.zeros(len(batch), np.int64)
    width = min(SLICE, max(MIN_SLICE, VALUES // max(1, matrix.shape[1])))
    at = 0
    while at < len(batch):
        group, size, first = [codes(batch[at])], 0, at
        size = len(group[0])
        at += 1
        while at < len(batch) and size + len(more := codes(batch[at])) <= width:
            group.append(more)
            size += len(more)
            at += 1
        chars = np.concatenate(group)
        ends = np.cumsum([len(c) for c in group])
        for order in ORDERS:
            for lo in range(0, size, width):
                ids = bucket_ids(chars[lo : lo + width + order - 1], order)
                places = np.arange(lo, lo + len(ids), dtype=np.int64)
                owner = np.searchsorted(ends, places, side="right")
                inside = places + order <= ends[np.minimum(owner, len(ends) - 1)]
                ids, owner = ids[inside], owner[inside]
                if not len(ids):
                    continue
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                sums[first + owner[starts]] += np.add.reduceat(matrix[ids], starts, axis=0, dtype=np.float64)
                sizes[first + owner[starts]] += np.diff(np.r_[starts, len(ids)])
    return sums, sizes


def predict_language(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the winner's share, softened for long texts)."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, logs = shared.value
        every = texts(batch)
        if names:
            sums, sizes = score_texts(every, logs)
            mean = sums / np.maximum(1, sizes)[:, None] * np.minimum(sizes, 64)[:, None]
            share = np.exp(mean - mean.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            best = sums.argmax(axis=1)
        lang, score = [], []
        for i, t in enumerate(every):
            sure = bool(names) and has_letter(t)
            lang.append(names[best[i]] if sure else "und")
            score.append(float(share[i, best[i]]) if sure else 0.0)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, each, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict_language(docs, *train(docs))
