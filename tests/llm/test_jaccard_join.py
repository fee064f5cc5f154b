from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import jaccard_join as jj


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id, text -> class_id, n_links, n_copies."""
    known = [(r.doc_id, r.text or "") for r in rows if r.doc_id is not None]
    texts = sorted({t for _, t in known})
    sets = [rows_set(t) for t in texts]
    linked = {i: {i} for i in range(len(texts))}
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-12:
                linked[i].add(j)
                linked[j].add(i)
    least = {t: min(k for k, x in known if x == t) for t in texts}
    seen, group = {}, {}
    for i in range(len(texts)):
        if i not in seen:
            todo, part = [i], set()
            while todo:
                k = todo.pop()
                if k not in part:
                    part.add(k)
                    todo += linked[k]
            for k in part:
                seen[k] = True
                group[k] = min(least[texts[m]] for m in part)
    at = {t: i for i, t in enumerate(texts)}
    out = []
    for r in rows:
        t = r.text or ""
        out.append((r.doc_id, None, 0, 1) if r.doc_id is None else (r.doc_id, group[at[t]], len(linked[at[t]]) - 1, sum(x == t for _, x in known)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in df.collect()), key=str)


def test_small_and_odd(small, odd):
    for docs in (small, odd):
        assert got(jj.join_similar(docs)) == brute(docs.collect())


def test_empty(odd):
    assert jj.join_similar(odd.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [False, True])
def test_large_group(spark, monkeypatch, hot):
    """Hundreds of near copies, and a passage that many share; buckets are split in tasks or in DataFrame steps."""
    if hot:
        monkeypatch.setattr(jj, "HOT_ROWS", 40)
    r = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(420):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(100)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [" ".join([passage, *(f"q{r.randrange(10**6)}" for _ in range(30))]) for _ in range(150)]
    texts += texts[:7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(jj.join_similar(docs)) == brute(docs.collect())


def test_buckets_that_stay_large():
    t = np.tile(np.arange(jj.TOKENS, dtype=np.uint32), (jj.SMALL * 2 + 5, 1))
    root = jj.forest(len(t), np.concatenate(jj.solve(5, t, 1)))
    assert (root == 0).all()


def graphs():
    """Paths in order, against it and at random, a hub, far ends that meet, and sparse random edges."""
    r = random.Random(5)
    n = 60
    mixed = r.sample(range(n), n)
    yield "up", [(i, i + 1) for i in range(n - 1)]
    yield "mixed", list(itertools.pairwise(mixed))
    yield "hub", [(n // 2, i) for i in range(n)]
    yield "ends", [(i, n - 1) for i in range(0, n, 2)] + [(i, i + 1) for i in range(1, n - 3, 4)]
    yield "sparse", [(r.randrange(400), r.randrange(400)) for _ in range(190)]
    yield "none", []


def least_members(n, pairs):
    root = list(range(n))
    while True:
        before = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def test_forest():
    for name, pairs in graphs():
        for order in (pairs, pairs[::-1]):
            assert jj.forest(400, np.array(order, np.int64).reshape(-1, 2)).tolist() == least_members(400, pairs), name


@pytest.mark.parametrize("held", [200_000, 3])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(jj, "HELD", held)
    edges, want = [], {}
    for name, pairs in graphs():
        root = least_members(400, pairs)
        want |= {f"{name}{i:03}": f"{name}{root[i]:03}" for i in {x for a, b in pairs if a != b for x in (a, b)}}
        edges += [(f"{name}{a:03}".encode(), f"{name}{b:03}".encode()) for a, b in pairs]
    random.Random(6).shuffle(edges)
    for rows in (edges, []):
        got = jj.components(spark.createDataFrame(rows, "a binary, b binary").repartition(7)).collect()
        assert {bytes(x.node).decode(): bytes(x.root).decode() for x in got} == (want if rows else {}) and len(got) == (len(want) if rows else 0)


def test_few_shuffles(spark, monkeypatch):
    """Each costs a task for each partition, however little there is: components take one a round, small buckets one for all depths."""
    made, whole = [], jj.staged

    def staged(df, name):
        made.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return whole(df, name)

    monkeypatch.setattr(jj, "staged", staged)
    r = random.Random(4)
    edges = [(f"{r.randrange(k, k + 60):04}".encode(), f"{k:04}".encode()) for k in range(0, 600, 60) for _ in range(400)]
    assert jj.components(spark.createDataFrame(edges, "a binary, b binary").repartition(5)).count() <= 600
    assert max(n for _, n in made) == 1 and sum(n for _, n in made) <= 2
    made.clear()
    monkeypatch.setattr(jj, "HOT_ROWS", 20)
    texts = [" ".join(f"w{k}" if k % 50 != i % 50 else f"x{i}" for k in range(100)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(jj.join_similar(docs)) == brute(docs.collect())
    assert sum(name == "hot" for name, _ in made) == jj.DEPTH and sum(name == "found" for name, _ in made) == 2


def test_pack():
    h = jj.shingles("a b c d e f g h")
    assert len(h) == 4 and (jj.unpack(jj.pack(h)) == h).all()
    assert len(jj.shingles("")) == 0 and len(jj.shingles("a b")) == 1


def test_links_equal_pairs():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    assert {tuple(p) for p in jj.links(sets, None, 0.5).tolist()} == want
    cross = {tuple(p) for p in jj.links(sets[:12], sets[12:], 0.5).tolist()}
    assert cross == {(i, j - 12) for i, j in want if i < 12 <= j}


def test_keep_one(small, odd):
    for docs in (small, odd):
        kept = jj.keep_one(docs).collect()
        assert jj.keep_one(docs).columns == docs.columns
        groups = {(c, n) for d, c, n, _ in [(x[0], x[1], 0, 0) for x in brute(docs.collect())] if d is not None}
        assert {r.doc_id for r in kept if r.doc_id is not None} == {c for c, _ in groups}
        assert sum(r.doc_id is None for r in kept) == docs.where("doc_id is null").count()


def missed(least, splits, times, pairs=2000, seed=3):
    """Share of pairs at the threshold that no run brings together, by simulation: each run samples a token of its own,
    every step and the task sample theirs anew, and a pair goes on if it is equal in one of them."""
    rng = np.random.default_rng(seed)
    same = rng.random((pairs, jj.TOKENS)) < least
    met = np.zeros(pairs, bool)
    for run in range(times):
        alive = same[:, run].copy()
        for children in [jj.STEP_CHILDREN] * splits + [jj.CHILDREN]:
            places = np.argsort(rng.random((pairs, jj.TOKENS)), axis=1)[:, :children]
            alive &= np.take_along_axis(same, places, axis=1).any(axis=1)
        met |= alive
    return 1 - met.mean()


def test_every_threshold_has_its_runs():
    """On the longest way, so on any other; measured, not by the formula."""
    assert jj.runs(0.8) == 8
    for least in (0.9, 0.8, 0.7, 0.6):
        assert missed(least, jj.DEPTH - 1, jj.runs(least), 20_000) <= 2 * (1 - jj.TARGET), least
    for least in (0.3, 0.5):
        with pytest.raises(ValueError, match="runs"):
            jj.runs(least)
    assert jj.candidate_share(0.6) < 0.6 - 4 * (0.6 * 0.4 / jj.TOKENS) ** 0.5


@pytest.mark.parametrize(("least", "shared"), [(0.7, 79), (0.6, 72)])
@pytest.mark.parametrize("hot", [1024, 30])
def test_recall_at_lower_thresholds(spark, monkeypatch, hot, least, shared):
    monkeypatch.setattr(jj, "HOT_ROWS", hot)
    docs = []
    for i in range(80):
        w = [f"{'c' if i % 2 else f'a{i}x'}{k}" for k in range(94)]
        docs += [" ".join(w[:64] + [f"d{i}x{k}" for k in range(30)]), " ".join(w[:64] + [f"d{i}x{k}" for k in range(shared - 64)] + [f"e{i}x{k}" for k in range(94 - shared)])]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sets = [rows_set(t) for t in docs]
    links = [sum(len(a & b) >= least * len(a | b) for b in sets) - 1 for a in sets]
    found = {r.doc_id: r.n_links for r in jj.join_similar(rows, least).collect()}
    assert sum(links) >= 160 and sum(min(found[i], n) for i, n in enumerate(links)) >= 0.99 * sum(links)


@pytest.mark.parametrize("hot", [1024, 30])
def test_recall_at_the_threshold(spark, monkeypatch, hot):
    """Pairs at 0.8 exactly, as far apart as links may be: among strangers, and all in one crowd of look-alikes."""
    monkeypatch.setattr(jj, "HOT_ROWS", hot)
    r, docs = random.Random(8), []
    for i in range(150):
        w = [f"a{i}x{k}" for k in range(94)]
        docs += [" ".join(w), " ".join([*w[:84], *(f"b{i}x{k}" for k in range(10))])]
    crowd = [f"c{k}" for k in range(94)]
    for i in range(60):
        w = [*crowd[:60], *(f"d{i}x{k}" for k in range(34))]
        docs += [" ".join(w), " ".join([*w[:84], *(f"e{i}x{k}" for k in range(10))])]
    r.shuffle(docs)
    assert len(rows_set(docs[0]) | set()) == 90
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want, found = brute(rows.collect()), got(jj.join_similar(rows))
    links = sum(x[2] for x in want)
    assert links >= 420 and sum(min(a[2], b[2]) for a, b in zip(want, found, strict=True)) >= 0.99 * links


def test_staged_tables_are_removed(spark, small):
    from pathlib import Path

    from eventloom.llm.common import shared_dir

    folder = Path(shared_dir(spark)) / "eventloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    jj.join_similar(small).collect()
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
    assert left <= {"described", "decided"}


def test_keep_one_of_repeated_rows_is_always_the_same(spark):
    rows = [(1, "one text of five words", f"s{k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [jj.keep_one(docs.orderBy(F.rand(seed)).repartition(3)).collect() for seed in (1, 2)]
    assert len(kept[0]) == 1 and kept[0] == kept[1]
