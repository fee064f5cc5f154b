"""N-gram Jaccard join of a corpus with itself by chosen paths.

A text's set holds hashes of 40 bits of its rows of five words (a shorter text has one row); words are ``[^\\x20\\x09-\\x0D]+``. Texts with one set make up a node, so that copies are joined once.
Each set is embedded as T tokens, the least values of T hash functions: two sets share a token with the
probability of their Jaccard similarity.

The join runs so many times (`runs`) that a pair at the threshold is missed with less than 1 - TARGET,
wherever it lies. A run samples one token of each set; sets that share it meet in a bucket. A bucket of
more than SMALL sets is split again on further sampled tokens, several of them, so that a pair at the
threshold goes on with high probability, until it is small or DEPTH is reached; small buckets are
compared by brute force on all T tokens, against a threshold low enough to lose no pair. Buckets of more
than HOT_ROWS sets are split in DataFrame steps, so no task holds more; they are a table, not a list on
the driver. What still holds together after DEPTH steps is joined to its least member, which loses nothing
and leaves the decision to the check.

Candidates are made groups by connected components, and a check on the sets follows: within each group, in
blocks of sets, intersections are counted on whole sets. A block pair is one task's work and each pair
of sets is seen once, so links are counted, not listed. The check is exact but for two different rows of
words with one hash: of two texts of n rows each, one of n * n / 2^40 pairs of rows. A group of m sets
costs m * m / 2 comparisons, which counting its links needs, and m / BLOCK copies of each set. The result is one row for each document: class_id
(the least doc_id of all that links connect), rep_id (the least of its own set), n_links (other texts
with similarity of at least the threshold) and n_copies (documents of the same text, itself included).

Null texts count as empty. Texts without a word have an empty set each: they link to each other only if
equal. Rows with a null doc_id take part in no link: class_id and rep_id are null, n_links 0, n_copies 1.
Rows with one doc_id and several texts are separate documents. An empty table gives no rows. Only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import discard, map_batches, staged, texts, union

WORDS, LEAST, TOKENS = 5, 0.8, 64
#: A pair at the threshold is missed by all runs with a probability of less than 1 - TARGET wherever it lies; at 0.8 that is
#: 4.4e-4 where each split of the longest way is needed, and 1.6e-5 where buckets are small.
TARGET = 0.9995
#: Tokens on which a large bucket is split: in a task, and in a DataFrame step, where every child is a row.
SMALL, CHILDREN, STEP_CHILDREN, DEPTH = 192, 3, 2, 4
#: A bucket with more rows than this is split in DataFrame steps.
HOT_ROWS = 1024
#: Nodes whose edges a task of `contract` holds at a time.
HELD = 200_000
#: Sets of a block of the exact check.
BLOCK = 256

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_rng = np.random.default_rng(7919)
_A = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.uint64((1 << 40) - 1)


def candidate_share(least: float) -> float:
    """Share of equal tokens from which a pair is a candidate: over four standard errors below the threshold."""
    return least - 4.2 * math.sqrt(least * (1 - least) / TOKENS)


def miss(least: float, times: int, steps: int) -> float:
    """Chance that `times` runs miss a pair at the threshold whose bucket is split in so many DataFrame steps, and in a
    task if there is one step or more. Mean over how many of its tokens are equal, which all runs share."""
    out = 0.0
    for k in range(TOKENS + 1):
        p = k / TOKENS
        met = p * (1 - (1 - p) ** STEP_CHILDREN) ** steps * (1 - (1 - p) ** CHILDREN if steps else 1)
        out += math.comb(TOKENS, k) * least**k * (1 - least) ** (TOKENS - k) * (1 - met) ** times
    return out


def runs(least: float) -> int:
    """Runs that miss a pair at the threshold with less than 1 - TARGET on the longest way: DEPTH - 1 DataFrame steps and a
    task. (What the last step can't split is joined to its least member.) Each run starts from a token of its own,
    so a threshold that needs more than TOKENS runs is refused."""
    for times in range(1, TOKENS + 1):
        if miss(least, times, DEPTH - 1) < 1 - TARGET:
            return times
    raise ValueError(f"a threshold of {least} needs more than {TOKENS} runs for a recall of {TARGET}, and sets have {TOKENS} tokens")


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of 40 bits."""
    # a hash costs about as much as looking it up, so no table of words is kept
    h = np.array([xxhash.xxh64_intdigest(w, 11) for w in WORD.findall(text)], np.uint64)
    n = len(h) - WORDS + 1
    if not len(h):
        return h
    out = np.zeros(max(n, 1), np.uint64)
    for k in range(min(WORDS, len(h))):
        out = (out ^ h[k : k + max(n, 1)]) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out & _KEEP)


def embed(hashes: np.ndarray) -> np.ndarray:
    """T tokens (uint32), the place of each being part of it."""
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    step = 128
    for at in range(0, len(hashes), step):
        np.minimum(out, ((hashes[at : at + step, None] * _A + _B) >> np.uint64(32)).min(axis=0).astype(np.uint32), out=out)
    return out


def pack(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def describe(docs: DataFrame) -> DataFrame:
    """Each document's text key, node (its set's key), size of the set, tokens and set."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        text_keys, nodes, sizes, tokens, sets = [], [], [], [], []
        for t in texts(batch):
            s = shingles(t)
            raw = pack(s)
            text_keys.append(hashlib.md5(t.encode()).digest())
            # an empty set is no reason to link: such a text stands for itself
            nodes.append(hashlib.blake2b(raw or b"\0" + t.encode(), digest_size=16).digest())
            sizes.append(len(s))
            tokens.append(embed(s).tobytes())
            sets.append(raw)
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip((text_keys, nodes, sizes, tokens, sets), kinds, strict=True))], ["doc_id", "text_key", "node", "n", "tokens", "shingles"])

    return map_batches(docs.select("doc_id", "text"), each, "doc_id long, text_key binary, node binary, n long, tokens binary, shingles binary")


def _path(*parts: int) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big", signed=True)


def choices(path: int, children: int) -> list[int]:
    """The tokens on which the bucket of this path is split."""
    rng = np.random.default_rng(abs(path))
    return rng.choice(TOKENS, children, replace=False).tolist()


def first_paths(nodes: DataFrame, times: int) -> DataFrame:
    """A row for each node and run: path, node, tokens."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        places = np.random.default_rng(41).choice(TOKENS, times, replace=False)
        tokens = [np.frombuffer(x, np.uint32) for x in batch.column("tokens").to_pylist()]
        paths = [_path(run, int(places[run]), int(t[places[run]])) for t in tokens for run in range(times)]
        again = pa.array(np.repeat(np.arange(batch.num_rows), times))
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.int64()), batch.column("node").take(again), batch.column("tokens").take(again)], ["path", "node", "tokens"])

    return map_batches(nodes.select("node", "tokens"), each, "path long, node binary, tokens binary")


def next_paths(rows: DataFrame) -> DataFrame:
    """The children of rows that lie in buckets which are too large: STEP_CHILDREN rows for each."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [np.frombuffer(x, np.uint32) for x in batch.column("tokens").to_pylist()]
        paths = [_path(p, k, int(t[k])) for p, t in zip(batch.column("path").to_pylist(), tokens, strict=True) for k in choices(p, STEP_CHILDREN)]
        again = pa.array(np.repeat(np.arange(batch.num_rows), STEP_CHILDREN))
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.int64()), batch.column("node").take(again), batch.column("tokens").take(again)], ["path", "node", "tokens"])

    return map_batches(rows.select("path", "node", "tokens"), each, "path long, node binary, tokens binary")


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    root = np.arange(n)
    for a, b in pairs.tolist():
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        root[max(a, b)] = min(a, b)
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def compare(tokens: np.ndarray, share: float) -> np.ndarray:
    """Candidate pairs among few sets: those with this share of equal tokens."""
    found = []
    for i in range(0, len(tokens), 64):
        same = (tokens[i : i + 64, None, :] == tokens[None, :, :]).sum(axis=2)
        a, b = np.nonzero(same >= share * TOKENS)
        a = a + i
        found.append(np.stack([a, b], axis=1)[a < b])
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def solve(path: int, tokens: np.ndarray, depth: int, share: float = candidate_share(LEAST)) -> list[np.ndarray]:
    """Candidate pairs of a bucket: brute force if it is small, else its children's."""
    n = len(tokens)
    if n < 2:
        return []
    if n <= SMALL or depth >= DEPTH:
        out = []
        for lo in range(0, n, SMALL) if n > SMALL else (0,):
            part = tokens[lo : lo + SMALL]
            out.append(compare(part, share) + lo)
            if lo:  # neighbouring parts of a bucket that stays large hold together by its first member
                out.append(np.array([[0, lo]]))
                out.append(np.stack([np.full(len(part) - 1, lo), np.arange(lo + 1, lo + len(part))], axis=1))
        if n > SMALL:
            out.append(np.stack([np.zeros(min(n, SMALL) - 1, np.int64), np.arange(1, min(n, SMALL))], axis=1))
        return out
    out = []
    for k in choices(path, CHILDREN):
        order = np.argsort(tokens[:, k], kind="stable")
        values = tokens[order, k]
        cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist() + [n]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo > 1:
                group = order[lo:hi]
                out += [group[p] for p in solve(_path(path, k, int(values[lo])), tokens[group], depth + 1, share)]
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of two or more consecutive rows with equal keys, from sorted batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= (c[1:] != c[:-1]).astype(bool)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi == lo + 1 and 0 < lo and hi < batch.num_rows:
                continue  # alone; what is held ends at the next group
            key = tuple(c[lo] for c in columns)
            if key != now and held:
                if sum(x.num_rows for x in held) > 1:
                    yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if sum(x.num_rows for x in held) > 1:
        yield now, pa.Table.from_batches(held)


def small_buckets(rows: DataFrame, share: float) -> DataFrame:
    """Edges (a, b) of candidates within the buckets: each joined to the least of its component there. rows: depth, path, node, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for (path, depth), table in _groups(batches, ["path", "depth"]):
            nodes = table["node"].to_pylist()
            tokens = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint32).reshape(-1, TOKENS)
            if found := solve(int(path), tokens, int(depth), share):
                root = forest(len(nodes), np.concatenate(found))
                for i in np.flatnonzero(root != np.arange(len(nodes))).tolist():
                    a.append(nodes[root[i]])
                    b.append(nodes[i])
            if len(a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.repartition("path").sortWithinPartitions("path", "depth", "node").mapInArrow(run, "a binary, b binary")


def candidates(nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """Edges between nodes, from all runs."""
    rows, cold, used = first_paths(nodes, runs(least)), [], []
    for depth in range(1, DEPTH + 1):
        # a table: there may be as many large buckets as there are rows by HOT_ROWS; statistics decide how it is joined
        hot = staged(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).select("path"), "hot")
        used.append(hot)
        none = hot.isEmpty()
        cold.append((rows if none else rows.join(hot, "path", "left_anti")).select("path", F.lit(depth).alias("depth"), "node", "tokens"))
        if none:
            break
        large = rows.join(hot, "path", "left_semi")
        rows = staged(large if depth == DEPTH else next_paths(large), "paths")
        used.append(rows)
    # the small buckets of all depths in one pass
    edges = [staged(small_buckets(union(cold), candidate_share(least)), "found")]
    if not none:
        first = rows.groupBy("path").agg(F.min("node").alias("a"))
        edges.append(staged(rows.select("path", F.col("node").alias("b")).join(first, "path").where(F.col("a") != F.col("b")).select("a", "b"), "found"))
    discard(*used)
    return union(edges)


def contract(rows: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the components of rows whose columns are nodes that hang together: each node is joined to the least
    that its task's rows connect it with. A task holds HELD nodes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while x in up:
                p = up[x]
                if p in up:
                    p = up[x] = up[p]
                x = p
            return x

        def stars() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(up), pa.binary()), pa.array([root(x) for x in up], pa.binary())], ["u", "v"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = root(row[0])
                for x in row[1:]:
                    b = root(x)
                    if a != b:
                        a, b = min(a, b), max(a, b)
                        up[b] = a
            if len(up) > HELD:
                yield stars()
                up.clear()
        yield stars()

    return rows.mapInArrow(run, "u binary, v binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the least node of the component.

    A round takes each node's least neighbour (or itself) as its label. If both ends of all edges have one label, it is the root. If
    not, both ends and their labels hang together and are contracted. So a label becomes at most the label's own, as by pointer
    jumping, and of two labels that meet on an edge the greater gets the lesser one as a neighbour; some label falls in
    each round. A hub's edges are summed up in the tasks that read them, and what is joined is staged, so that statistics
    decide how, and a hub's partition can be split."""
    pairs = staged(contract(edges.select("a", "b")), "edges")
    while True:
        both = pairs.unionAll(pairs.select("v", "u"))
        labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("root")), "components")
        for end in ("u", "v"):
            ends = (pairs if end == "u" else ends).join(labels.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        if ends.where("u_root != v_root").isEmpty():
            discard(pairs)
            return labels
        after = staged(contract(ends), "edges")
        discard(pairs, labels)
        pairs = after


def links(a: list[np.ndarray], b: list[np.ndarray] | None, least: float) -> np.ndarray:
    """Pairs (i, j) with the similarity of at least `least`: within a (i < j), or of a with b."""
    left, right = a, a if b is None else b
    if b is None and len(a) <= 8:
        out = [(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if _similar(a[i], a[j], least)]
        return np.array(out, np.int64).reshape(-1, 2)
    every = np.concatenate(left if b is None else left + right)
    owner = np.repeat(np.arange(len(left) + (0 if b is None else len(right))), [len(x) for x in (left if b is None else left + right)])
    values, column, df = np.unique(every, return_inverse=True, return_counts=True)
    useful = df > 1  # what only one set holds is in no intersection
    renumber = np.cumsum(useful) - 1
    mask = useful[column]
    owner, column = owner[mask], renumber[column[mask]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows, cols, width = len(left), len(right), 2048
    both = np.zeros((rows, cols), np.float32)
    for lo in range(0, int(useful.sum()), width):
        s, e = np.searchsorted(column, [lo, lo + width])
        grid = np.zeros((rows + (0 if b is None else cols), width), np.float32)
        grid[owner[s:e], column[s:e] - lo] = 1
        both += grid[:rows] @ (grid if b is None else grid[rows:]).T
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    hit = both >= least * (sizes - both) - 1e-6
    i, j = np.nonzero(np.triu(hit, 1) if b is None else hit)
    return np.stack([i, j], axis=1)


def _similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def verify(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Rows (a, b, n): for b null, a's number of linked texts in one block pair; else an edge of the links' graph.

    groups: node, root; sets: node, weight (texts of the node), shingles.
    """
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    blocks = groups.join(sizes, "root").withColumn("count", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = blocks.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("count")).cast("int"))
    # a group of one block has one task; one of more has a task for each pair of its blocks
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    full = dealt.select("node", "root", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.binary(), pa.int64()]
        for (_, i, j), table in _groups(batches, ["root", "i", "j"]):
            nodes, weights, mine = (table[c].to_pylist() for c in ("node", "weight", "mine"))
            held = [unpack(x) for x in table["shingles"].to_pylist()]
            if i == j:
                left = right = list(range(len(nodes)))
                pairs = links(held, None, least)
            else:
                left, right = [k for k, m in enumerate(mine) if m == i], [k for k, m in enumerate(mine) if m == j]
                pairs = links([held[k] for k in left], [held[k] for k in right], least) if left and right else np.zeros((0, 2), np.int64)
            if not len(pairs):
                continue
            pairs = np.stack([np.array(left)[pairs[:, 0]], np.array(right)[pairs[:, 1]]], axis=1)
            w = np.array(weights, np.int64)
            count = np.zeros(len(nodes), np.int64)
            np.add.at(count, pairs[:, 0], w[pairs[:, 1]])
            np.add.at(count, pairs[:, 1], w[pairs[:, 0]])
            root = forest(len(nodes), pairs)
            some = np.flatnonzero(count).tolist()
            joined = np.flatnonzero(root != np.arange(len(nodes))).tolist()
            columns = ([nodes[k] for k in some] + [nodes[root[k]] for k in joined], [None] * len(some) + [nodes[k] for k in joined], count[some].tolist() + [0] * len(joined))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["a", "b", "n"])

    return full.select("node", "weight", "shingles", "mine", "root", "i", "j").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(run, "a binary, b binary, n long")


def join_similar(docs: DataFrame, least: float = LEAST, propose: Callable[[DataFrame, float], DataFrame] = candidates) -> DataFrame:
    """One row per document: doc_id, class_id, rep_id, n_links, n_copies, and the keys of its text and class (hexadecimal).

    propose gives edges (a, b) between nodes (node, tokens) that connect what may be similar at `least`. The
    result reads two staged tables; all others are removed as soon as they are read.
    """
    described = staged(describe(docs), "described")
    known = described.where(F.col("doc_id").isNotNull())
    by_text = known.groupBy("node", "text_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("tokens").alias("tokens"))
    by_text = staged(by_text, "texts")
    nodes = staged(by_text.groupBy("node").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("weight"), F.max("n").alias("n"), F.max("tokens").alias("tokens")), "nodes")
    proposed = propose(nodes.where("n > 0"), least)
    groups = components(proposed)
    discard(proposed)
    # the set of a node comes from its representative's row
    wanted = nodes.select("node", F.col("rep").alias("doc_id"), "weight").join(groups.select("node"), "node")
    sets = known.select("doc_id", "node", "shingles").join(wanted, ["node", "doc_id"]).dropDuplicates(["node"]).select("node", "weight", "shingles")
    seen = staged(verify(groups, sets, least), "links")
    counts = seen.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "node")
    classes = components(seen.where("b is not null").select("a", "b"))
    named = nodes.select("node", "rep", "weight").join(classes, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = staged(named, "named")
    discard(nodes, groups, seen, classes)
    least_id = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    decided = named.join(least_id, "root").select("node", "rep", "class_id", F.lower(F.hex("root")).alias("class_key"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    per_text = staged(by_text.select("node", "text_key", "copies").join(decided, "node"), "decided")
    discard(by_text, named)
    mine = F.col("doc_id").isNotNull()
    out = described.select("doc_id", "text_key").join(per_text, "text_key", "left")
    return out.select(
        "doc_id",
        F.when(mine, F.col("class_id")).alias("class_id"),
        F.when(mine, F.col("rep")).alias("rep_id"),
        F.when(mine, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(mine, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"),
        F.lower(F.hex("text_key")).alias("text_key"),
        F.when(mine, F.col("class_key")).alias("class_key"),
    )


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One document of each class, the one with the least doc_id (of several such texts the one with the least
    key, of repeated rows the one with the least hash of its columns). Rows with a null doc_id all stay."""
    own = join_similar(docs, least).where("doc_id = class_id").groupBy("class_key").agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
    marked = docs.where(F.col("doc_id").isNotNull()).select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    mine = marked.join(own.select("x.doc_id", "x.text_key"), ["doc_id", "text_key"], "left_semi")
    kept = mine.groupBy("doc_id", "text_key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))
