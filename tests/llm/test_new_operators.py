"""Decontamination, row patterns and centroids: against their SQL on the given tables, and brute force on small ones."""

from __future__ import annotations

import hashlib
import random
import re
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import centroids as ce
from eventloom.llm import decontamination as dc
from eventloom.llm import queries
from eventloom.llm import row_patterns as rp

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_row_patterns", "op13_centroids"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "clicks", "embeddings"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, D).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).to_numpy().tolist())) == sorted(map(tuple, want[columns].astype(str).to_numpy().tolist()))


# ---- decontamination


def dc_words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_hits(docs, items):
    windows = {}
    for item, t in items:
        w = dc_words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, t in docs:
        w, hit, ids = dc_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    ids |= found
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def decontaminated(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, row_key string, n long")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id long")
    return sorted((tuple(r) for r in dc.decontaminate(d, b, **kw).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("broadcast_bytes", [dc.BROADCAST_BYTES, -1])
def test_decontamination_equals_brute_force(spark, seed, broadcast_bytes):
    """Few words, so that grams repeat and tie; items of every length; shared spans of every length around ten."""
    rng = random.Random(seed)
    say = lambda n, k: [rng.choice("abcdefghijkl"[:k]) for _ in range(n)]
    items = [(i, say(rng.choice([1, 2, 5, 7, 9, 10, 11, 12, 30]), 12 if i % 2 else 3)) for i in range(25)]
    docs = []
    for i in range(40):
        w = say(rng.randint(0, 60), 12)
        for _, x in rng.sample(items, 2):
            k = rng.randint(0, len(x))
            at = rng.randint(0, len(w))
            w[at:at] = x[k : k + rng.randint(5, 14)]
        docs.append((i, " ".join(w)))
    items = [(i, ", ".join(x).upper() if i % 3 else " ".join(x)) for i, x in items]
    assert decontaminated(spark, docs, items, broadcast_bytes=broadcast_bytes) == brute_hits(docs, items)


def test_decontamination_of_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    long = "filler " * 40_000 + passage + " tail" * 10
    docs = [(None, None), (None, passage), (None, passage), (1, ""), (2, "..."), (3, long), (4, f"x {passage.title()} y"), (4, f"x {passage.title()} y"), (4, "other"), (5, "É漢字 ÄB 😀"), (6, "one two three four five six seven eight nine not ten")]
    items = [(1, passage), (1, passage), (10, passage), (9, passage + " more"), (None, "É漢字 Äb"), (2, None), (3, ""), (4, "--"), (7, "word " * 5_000)]
    assert decontaminated(spark, docs, items) == brute_hits(docs, items)
    assert decontaminated(spark, docs, []) == brute_hits(docs, [])
    assert decontaminated(spark, [], items) == []


def test_decontamination_uses_no_python_in_its_plan(spark):
    plan = dc.decontaminate(spark.read.parquet(f"{D}/documents.parquet"), dc.benchmark(spark, D))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_every_shared_span_keeps_a_gram(spark):
    """The guarantee of winnowing: of any ten words in a row at least one gram is kept, whatever stands around them."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab" if i % 2 else "abcdefgh") for _ in range(rng.randint(10, 60)))) for i in range(50)]
    kept = dc.kept_grams(dc.hashed_words(spark.createDataFrame(rows, "doc_id long, text string")), []).groupBy("doc_id").agg(F.collect_list("at").alias("at")).collect()
    for r in kept:
        n, at = len(rows[r.doc_id][1].split()), set(r["at"])
        assert all(at & set(range(i, i + dc.WINDOWS)) for i in range(n - dc.ITEM + 1))


# ---- row patterns

T0 = datetime(2024, 1, 1)


def brute_matches(rows, pattern=r"AD+U+P", letters=rp.VALLEY_LETTERS):
    """Backtracking by Python's re, one start after another: at each row the letters that fit it are tried by hand."""
    by = {}
    for r in sorted(set(rows), key=lambda r: (r[3] is None, r[3] or 0, r[1] or T0, r[0] or 0)):
        if r[3] is not None and r[1] is not None:
            by.setdefault(r[3], []).append(r)
    out = []
    for client, rs in by.items():
        cents = [None if r[5] is None or not np.isfinite(r[5]) else int(np.floor(100 * r[5] + 0.5)) for r in rs]

        def fits(letter, i, first, rs=rs, cents=cents):
            x = letters[letter]
            if cents[i] is None or (x.kinds and rs[i][4] not in x.kinds) or ((x.named or x.not_kinds) and (rs[i][4] is None or rs[i][4] in x.not_kinds)):
                return False
            if x.looks_back and i == 0:
                return False
            if x.step and (cents[i - 1] is None or (cents[i] - cents[i - 1]) * x.step <= 0):
                return False
            if x.within is not None and rs[i][1] - rs[i - 1][1] > timedelta(microseconds=x.within):
                return False
            return not x.at_least or cents[i] >= first

        def match(nodes, i, first, labels):
            """The first way in order; nodes: a list of (letter, least, lazy) with + as (letter, 1, ...)."""
            if not nodes:
                return labels
            (letter, most), rest = nodes[0], nodes[1:]
            run, got = [], labels
            while i + len(run) < len(rs) and len(run) < most and fits(letter, i + len(run), cents[i] if first is None else first):
                run.append(letter)
            for k in range(len(run), 0, -1):
                found = match(rest, i + k, cents[i] if first is None else first, got + letter * k)
                if found:
                    return found
            return None

        nodes = [(x[0], 10**9 if "+" in x else 1) for x in re.findall(r"[A-Z]\+?", pattern)]
        no = 0
        for i in range(len(rs)):
            if cents[i] is not None and (labels := match(nodes, i, None, "")):
                no += 1
                last = i + len(labels) - 1
                out.append((client, no, rs[i][0], rs[last][0], len(labels), sum(cents[i : last + 1]), labels))
    return sorted(out)


SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def matched(spark, rows, n, **kw):
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("seq", F.lit("x"))
        return sorted(tuple(r) for r in rp.find_matches(df, **kw).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def series(rng, n, clients, values=6):
    rows, ts = [], T0
    for i in range(n):
        ts += timedelta(seconds=rng.choice([0, 30, 120, 300, 300.000001, 400]) if rng.random() < 0.3 else 1)
        value = rng.choice([None, float("nan"), float("inf"), 0.005]) if rng.random() < 0.04 else rng.randint(0, values) / 4
        rows.append((i, ts, ts, rng.choice(clients), rng.choice(["click", "click", "view", "error", None]) if rng.random() < 0.5 else "click", value, rng.choice(["{}", None])))
    return rows + rng.sample(rows, n // 10)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("parts", [1, 7])
def test_matches_equal_backtracking(spark, seed, parts):
    rng = random.Random(seed)
    rows = series(rng, 400, [7, 7, 7, 1, 2, None], values=[6, 3, 40][seed])
    assert matched(spark, rows, parts) == brute_matches(rows)


def test_matches_go_through_many_tasks(spark):
    """One fall and one rise over all tasks: every start but the rise's has a match, and heads cover whole tasks."""
    values = [*range(60, 0, -1), *range(2, 70)]
    rows = [(i, T0 + timedelta(seconds=i), T0, 5, "click", float(v), None) for i, v in enumerate(values)]
    got = matched(spark, rows, 9)
    assert got == brute_matches(rows) and len(got) == 59


def test_matches_of_odd_rows(spark):
    assert matched(spark, [], 3) == []
    base = [(i, T0, T0, 1, "click", v, None) for i, v in enumerate([3.0, 2.0, 3.0, 3.0])]
    rows = [*base, base[1], (None, None, None, 1, "click", 1.0, None), (9, T0, None, None, "click", 1.0, None), (None, T0, None, 2, None, None, None)]
    assert matched(spark, rows, 3) == brute_matches(rows) == [(1, 1, 0, 3, 4, 1100, "ADUP")]
    # rows of one id that differ in another column only are two rows
    assert matched(spark, [*base, (1, T0, T0, 1, "click", 2.0, "{}")], 2) == []


@pytest.mark.parametrize("pattern", ["X Y+ Z", "X (Y|Z)* Z?", "X Y*? Z", "X (Y Z|Y)+ Z", "X{2,3} Y{1,} Z", "X (Y|Y Z)(Z Y|Y) Z?"])
def test_machine_agrees_with_re(pattern):
    """Letters that exclude each other make a text of letters, on which re is the judge."""
    letters = {c: rp.Letter(kinds=(c,)) for c in "XYZ"}
    machine = rp.Machine(rp.compile_pattern(pattern), letters, "X")
    rng = random.Random(pattern)
    for _ in range(200):
        text = "".join(rng.choice("XYZ") for _ in range(rng.randint(1, 14)))
        live, done = [], []
        for i, c in enumerate(text):
            if machine.bit[c] & machine.start_bits:
                live.append(machine.start(i, i))
            live = machine.step(live, machine.bit[c], 0, i, done)
        got = sorted((s[0], "".join(x * k for x, k in rp._runs(s[5][3]))) for s in [*done, *(s for s in live if s[5])])
        want = [(i, m.group()) for i in range(len(text)) if (m := re.compile(pattern.replace(" ", "")).match(text, i))]
        assert got == want, (pattern, text)


def test_patterns_that_make_no_sense_are_refused():
    for bad in ("A?", "(A", "A)", "A*", "+A"):
        with pytest.raises(ValueError):
            rp.compile_pattern(bad)
    with pytest.raises(ValueError):
        rp.Machine(rp.compile_pattern("D A"), rp.VALLEY_LETTERS, "A")


# ---- centroids


def brute_clusters(rows, k=40, rounds=5, dim=64):
    kept = [(i, [int(np.floor(np.float64(np.float32(c)) * 256)) for c in e]) for i, e in rows if e is not None and len(e) == dim and all(c is not None and np.isfinite(c) for c in e)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    c = [x for _, x in seeds]
    if not c:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c)) for _, x in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            if mine := [x for (_, x), (_, o) in zip(kept, own, strict=True) if o == j]:
                c[j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    own = assign()
    total = sum(d for d, _ in own)
    by = {j: sum(d for d, o in own if o == j) for j in range(len(c))}
    return sorted(((i, o, d, by[o], total, hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), (d, o) in zip(kept, own, strict=True)), key=str)


def clustered(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<float>, cluster int, x string").repartition(3)
    return sorted((tuple(r) for r in ce.cluster_vectors(df, **kw).collect()), key=str)


@pytest.mark.parametrize(("dim", "k", "values"), [(2, 12, 4), (3, 9, 3), (8, 5, 2)])
def test_clusters_equal_brute_force(spark, dim, k, values):
    """Points of a small grid: most distances tie."""
    rng = random.Random(dim)
    rows = [(i, [rng.randint(-values, values) / 256 for _ in range(dim)]) for i in range(300)]
    rows += [(i + 300, [rng.gauss(0, 3) for _ in range(dim)]) for i in range(60)]
    assert clustered(spark, rows, k=k, dim=dim) == brute_clusters(rows, k=k, dim=dim)


def test_clusters_of_odd_rows(spark):
    v = [0.5, -0.25]
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, [0.0, 1.0, 2.0])]
    assert clustered(spark, odd, dim=2) == [] == clustered(spark, [], dim=2)
    some = [(8, v), (8, v), (9, v), (None, [7.0, 7.0]), (10, [-3.0, 1.001])]
    assert clustered(spark, odd + some, dim=2) == brute_clusters(odd + some, dim=2)
    assert clustered(spark, odd + some[:1], dim=2, k=1) == brute_clusters(some[:1], dim=2, k=1)
    assert clustered(spark, [*some, (11, [3e30, 0.0])], dim=2) == brute_clusters(some, dim=2)


def test_the_search_is_exact_and_looks_at_few_centroids():
    rng = np.random.default_rng(1)
    middles = rng.integers(-2000, 2000, (40, 16))
    x = middles[rng.integers(0, 40, 4000)] + rng.integers(-30, 30, (4000, 16))
    c0 = middles + rng.integers(-20, 20, middles.shape)
    c1 = c0 + rng.integers(-5, 5, c0.shape)
    a = ce.Search(c0, None).first(x)
    search = ce.Search(c1, np.sqrt(ce.squared(c1, c0).astype(float)))
    got, upper, lower = search.again(x, *a)
    every = ((x[:, None, :] - c1[None]) ** 2).sum(2)
    assert (got == every.argmin(1)).all()
    near = np.sort(np.sqrt(every), axis=1)
    assert (upper >= near[:, 0] - 1e-6).all() and (lower <= near[:, 1] + 1e-6).all()
    assert search.scanned < 0.1 * every.size
