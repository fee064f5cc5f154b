"""Toxicity by weak supervision.

Many voters look at each text: fixed lexicon entries, entries induced from the labelled rows that may be
learned from (words, word stems, and stems that several different words of a text have), and patterns of
style. Labels choose the voters, and so say that a vote speaks for the positive class, and give the class
balance; nothing else of the label model sees them. It is generative and treats the true class as hidden:
expectation maximisation over the votes alone, on labelled and unlabelled rows alike, estimates each
voter's firing rates by class (its accuracy) and the correlation of each pair of voters given the
class. A row's evidence is the sum of its voters' log odds, each weighted by the inverse of the correlation
matrix, so that voters which repeat each other count once between them. The model's posteriors are the
labels on which a linear classifier is trained, over words and stems; how often they agree with the
given labels is reported. Scoring is a sum of weights over a text's distinct words.

Learning takes MAX_POSITIVE + MAX_NEGATIVE labelled documents at most, and MAX_UNLABELLED that no row of
labels names, chosen by hash from those that are not held out. A doc_id counts once, however often it is labelled or present (of several texts the one
that sorts first by hash); one with differing labels is left out. Null and empty texts get the
classifier's bias. With no positive or no negative row to learn from every score is the prior (0.0 if
there are no labels). Only doc_id and text of a document are read; repeated rows give repeated scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import agreed_labels, discard, held_out, map_batches, staged, texts

MAX_POSITIVE, MAX_NEGATIVE, MAX_UNLABELLED = 1500, 3000, 4000
MAX_VOTERS, MAX_FEATURES = 160, 1500
STEMS = (4, 5, 6, 7)
#: An induced entry fires in this share of the positive rows at least, and so many times as often as in the negative ones.
MIN_SHARE, MIN_LIFT = 0.004, 8.0
#: A lexicon entry or pattern votes if it fires so many times as often in the positive rows ("die" is an article elsewhere).
POLARITY = 2.0
#: Pseudo-rows behind each firing rate, and the share of the unit matrix in that of correlations.
PSEUDO, SHRINK = 2.0, 0.1
#: Rounds of the label model over labelled and unlabelled rows together, after those over labelled ones. Many would let it
#: drift to another split of the rows than the one that the labels stand for.
OPEN_ROUNDS = 5
MAX_WORDS = 400_000
WORD = re.compile(r"[^\W\d_]+")

# Common insults of English, as a starting lexicon.
LEXICON = (
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting "
    "clown fool fools imbecile retard freak creep jerk bastard bitch crap hate hateful kill die ugly "
    "shut coward liar vermin filth filthy parasite degenerate"
).split()

PATTERNS = {
    "shouting": re.compile(r"!{3,}"),
    "caps": re.compile(r"(?:\b[A-Z]{4,}\b[ ,.!]+){3}"),
    "you are": re.compile(r"(?i)\byou(?:'re| are) (?:a |an |such )?\w+"),
    "masked": re.compile(r"\b\w[*@#$]{2,}\w*\b"),
}


def keys(word: str) -> list[str]:
    """A word's entries: itself, and its stems."""
    return [word, *(f"{word[:n]}~" for n in STEMS if len(word) > n)]


def again(key: str) -> str:
    """The entry of a stem that several different words of a text have."""
    return f"{key}+"


def entries(found: Iterable[str]) -> set[str]:
    """The entries of a text, whose different words these are: theirs, and those of stems that several of them have."""
    out: set[str] = set()
    for w in found:
        for k in keys(w):
            out.add(again(k) if k in out else k)
    return out


def words(text: str) -> set[str]:
    found: set[str] = set()
    for w in set(text.lower().split()):
        found.update(WORD.findall(w))
    return found


@dataclass(frozen=True)
class Classifier:
    weights: dict[str, float]
    bias: float
    #: Share of the sample's rows whose posterior label is the given one; None if nothing was learned.
    agreement: float | None = None
    #: Raw word -> its words with those of their entries that have a weight; filled as words come, and sent nowhere.
    table: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": {}}

    @cached_property
    def known(self) -> frozenset[str]:
        """Entries that have a weight for one word or for several."""
        return frozenset(k.removesuffix("+") for k in self.weights)

    def score(self, text: str) -> float:
        table = self.table
        weighed: dict[str, tuple[str, ...]] = {}
        for raw in set(text.lower().split()):
            found = table.get(raw)
            if found is None:
                mine = ((w, tuple(k for k in keys(w) if k in self.known)) for w in set(WORD.findall(raw)))
                found = tuple(x for x in mine if x[1])
                if len(table) >= MAX_WORDS:
                    table.clear()
                if len(raw) <= 64:
                    table[raw] = found
            weighed.update(found)
        hit: set[str] = set()
        for found in weighed.values():
            for k in found:
                hit.add(again(k) if k in hit else k)
        z = self.bias + sum(sorted(self.weights.get(k, 0.0) for k in hit))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def evidence(votes: np.ndarray, found: dict) -> np.ndarray:
    """The weighted log odds of each row's votes, those that weren't cast too."""
    hit, false, weight = found["hit"], found["false"], found["weight"]
    return votes @ (weight * np.log(hit / false)) + (1 - votes) @ (weight * np.log((1 - hit) / (1 - false)))


def label_model(votes: np.ndarray, balance: float, rounds: int = 40, start: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """Posterior of the hidden class for each row of votes, all of which speak for it; and what was estimated.

    `balance` is the share of positive rows; posteriors have that mean.
    Without a given start it is the majority's: rows with half the usual number of votes or more are likely positive. A
    voter never fires more often in the negative class than in the positive one.
    """
    n, m = votes.shape
    count = votes.sum(axis=1)
    usual = count[count > 0].mean() if count.any() else 1.0
    posterior = np.where(count >= usual / 2, 0.95, 0.02) if start is None else start
    rate = (votes.sum(axis=0) + 1) / (n + 2)
    found = {}
    for _ in range(rounds):
        pos = posterior.sum()
        hit = (posterior @ votes + PSEUDO * rate) / (pos + PSEUDO)
        false = np.minimum(((1 - posterior) @ votes + PSEUDO * rate / 4) / (n - pos + PSEUDO), hit)
        # what two voters share beyond their class's own rates, as a mean of both classes
        rho = np.zeros((m, m))
        for p, r in ((posterior, hit), (1 - posterior, false)):
            d = (votes - r) * np.sqrt(p)[:, None]
            spread = d.T @ d
            scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
            rho += spread / scale[:, None] / scale / 2
        np.fill_diagonal(rho, 1.0)
        weight = np.clip(np.linalg.solve((1 - SHRINK) * rho + SHRINK * np.eye(m), np.ones(m)), 0.05, 1.0)
        found = {"hit": hit, "false": false, "correlation": rho, "weight": weight}
        z = evidence(votes, found)
        low, high = -100.0, 100.0
        for _ in range(50):
            shift = (low + high) / 2
            posterior = 1 / (1 + np.exp(-np.clip(z + shift, -40, 40)))
            low, high = (low, shift) if posterior.mean() > balance else (shift, high)
    return posterior, found


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 3e-5, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: accelerated gradient steps, each weight's within a bound of its curvature."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    step = 1 / (0.25 * (x * x.sum(axis=1)[:, None]).mean(axis=0) + l2)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(x @ ahead, -40, 40))) - y
        new = (ahead - step * (x.T @ g / len(y) + l2 * ahead)).astype(x.dtype)
        w, ahead = new, (new + k / (k + 3) * (new - w)).astype(x.dtype)
    return w[:-1], float(w[-1])


def unseen_shift(x: np.ndarray, y: np.ndarray) -> float:
    """What to add to the bias, so that rows a fit hasn't seen score y's mean: each half is scored by a fit of the other.

    Unseen texts hold fewer of the entries that a fit relies on, so without it their scores are too low.
    """
    half, z = np.arange(len(y)) % 2, np.zeros(len(y))
    for k in (0, 1):
        w, b = fit_linear(x[half != k], y[half != k])
        z[half == k] = x[half == k] @ w + b
    low, high = -5.0, 5.0
    for _ in range(40):
        shift = (low + high) / 2
        low, high = (low, shift) if (1 / (1 + np.exp(-np.clip(z + shift, -40, 40)))).mean() > y.mean() else (shift, high)
    return low


def spread_out(fires: np.ndarray, names: list[str], wanted: list[str], most: int = MAX_VOTERS) -> list[str]:
    """Up to `most` of the wanted entries, each time the one that fires most where few of those before it do. fires: rows by names."""
    at = [names.index(k) for k in wanted]
    mine, seen, out = fires[:, at], np.zeros(len(fires), np.float32), []
    while len(out) < min(most, len(wanted)):
        gain = (1 / (1 + seen) ** 2) @ mine
        gain[out] = -1
        out.append(int(gain.argmax()))
        seen += mine[:, out[-1]]
    return [wanted[i] for i in out]


def entry_counts(sample: DataFrame) -> DataFrame:
    """entry, pos, neg: in how many positive and negative texts of the sample (text, toxic) each entry is."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, side = [], []
        for t, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
            mine = entries(words(t))
            found += mine
            side += [toxic] * len(mine)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(side, pa.bool_())], ["entry", "toxic"])

    rows = map_batches(sample.select("text", "toxic"), each, "entry string, toxic boolean")
    return rows.groupBy("entry").agg(F.count_if("toxic").alias("pos"), F.count_if(~F.col("toxic")).alias("neg"))


def choose_entries(counts: DataFrame, n_pos: int, n_neg: int) -> tuple[list[str], list[str]]:
    """MAX_FEATURES entries at most that mark positive rows, the best ones first; and the lexicon's entries that speak for them."""
    lift = (F.col("pos") / n_pos) / ((F.col("neg") + 0.5) / n_neg)
    worth = F.col("pos") * F.least(F.lit(1.0), lift / 50)
    marks = counts.where((F.col("pos") >= max(2, MIN_SHARE * n_pos)) & (lift >= MIN_LIFT)).orderBy(worth.desc(), "entry").limit(MAX_FEATURES)
    known = counts.where(F.col("entry").isin(LEXICON) & (lift >= POLARITY)).select("entry")
    return [r["entry"] for r in marks.select("entry").collect()], sorted(r["entry"] for r in known.collect())


def fired(sample: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """0/1 of the entries and of the patterns for each row of the sample in order of doc_id, and its labels (-1: none): some bytes a row."""
    at = {k: i for i, k in enumerate(names)}

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = []
        for t in texts(batch):
            row = np.zeros(len(at) + len(PATTERNS), bool)
            row[[at[k] for k in entries(words(t)) if k in at]] = True
            row[len(at) :] = [bool(p.search(t)) for p in PATTERNS.values()]
            bits.append(np.packbits(row).tobytes())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(bits, pa.binary())], ["doc_id", "toxic", "bits"])

    got = map_batches(sample.select("doc_id", "toxic", "text"), each, "doc_id long, toxic boolean, bits binary").toArrow().sort_by("doc_id")
    raw = np.frombuffer(b"".join(got["bits"].to_pylist()), np.uint8).reshape(got.num_rows, -1)
    every = np.unpackbits(raw, axis=1)[:, : len(at) + len(PATTERNS)].astype(np.float32)
    gold = np.array([-1 if x is None else int(x) for x in got["toxic"].to_pylist()], np.int8)
    return every[:, : len(at)], every[:, len(at) :], gold


def learn(sample: DataFrame, prior: float) -> Classifier:
    """sample: doc_id, text and toxic of each row to learn from; toxic is null where there is no label. prior: the share of positive rows among all."""
    sides = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg, n_open = sides.get(True, 0), sides.get(False, 0), sides.get(None, 0)
    if not n_pos or not n_neg:
        return Classifier({}, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    induced, lexicon = choose_entries(entry_counts(sample.where("toxic is not null")), n_pos, n_neg)
    features = sorted({*induced, *lexicon})
    x, style, gold = fired(sample, features)
    voters = sorted({*spread_out(x[gold == 1], features, induced), *lexicon})
    speaks = style[gold == 1].mean(axis=0) >= POLARITY * (style[gold == 0].sum(axis=0) + 0.5) / n_neg
    votes = np.concatenate([x[:, [features.index(k) for k in voters]], style[:, speaks]], axis=1)
    share = (n_pos + prior * n_open) / len(gold)
    known, own = gold >= 0, n_pos / (n_pos + n_neg)
    posterior, found = label_model(votes[known], own)
    if n_open:
        # rows without a label start from what the labelled ones' votes say, and then all are fitted together
        z = evidence(votes, found)
        start = 1 / (1 + np.exp(-np.clip(z - np.quantile(z[known], 1 - own), -40, 40)))
        start[known] = posterior
        posterior, _ = label_model(votes, share, OPEN_ROUNDS, start)
    w, b = fit_linear(x, posterior)
    b += unseen_shift(x, posterior)
    # the sample has its own share of positives; the bias goes back to that of all labelled rows
    b += np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(share / (1 - share))
    agreement = float(np.mean(((posterior >= 0.5) == (gold == 1))[gold >= 0]))
    return Classifier({k: float(c) for k, c in zip(features, w, strict=True) if abs(c) > 1e-4}, float(b), agreement)


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    known = agreed_labels(labels, "toxic").where(~held_out(F.col("doc_id"))).select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return Classifier({}, -40.0)
    order = F.md5(F.col("doc_id").cast("string"))
    others = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    chosen = others.join(labels.select("doc_id"), "doc_id", "left_anti").orderBy(order, "doc_id").limit(MAX_UNLABELLED).select("doc_id", F.lit(None).cast("boolean").alias("toxic"))
    for value, most in ((True, MAX_POSITIVE), (False, MAX_NEGATIVE)):
        chosen = chosen.unionAll(known.where(F.col("toxic") == value).orderBy(order, "doc_id").limit(most))
    # at most MAX_POSITIVE + MAX_NEGATIVE + MAX_UNLABELLED rows, so they may be sent to every task
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = joined.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit(""))).alias("h"), "text")).alias("x"))
    sample = staged(one.select("doc_id", "toxic", "x.text"), "labelled")
    found = learn(sample, sizes.get(True, 0) / total)
    discard(sample)
    return found


def score_documents(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = shared.value
        scores = [c.score(t) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), each, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train(docs, labels))
