from __future__ import annotations

import datetime as dt
import json
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.functions import dates, scoring, signals, text
from eventloom.operators import attribution, audit, backtest, evaluate, evidence, holdings, panel, reactions, relevance, unify
from eventloom.sources import readers, sinks, web

DAY = dt.date(2024, 1, 1)


def bars(spark, closes, ticker="A"):
    return spark.createDataFrame([(ticker, DAY + dt.timedelta(days=i), float(c)) for i, c in enumerate(closes)], "ticker string, date date, close double")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def walk(n, seed):
    return 100 * np.cumprod(1 + np.random.default_rng(seed).normal(0, 0.01, n))


def reference_moves(closes):
    s = pd.Series(closes).pct_change()
    vol = s.shift(1).rolling(30).std()
    out = []
    for i in range(1, len(s)):
        prior = s.iloc[max(0, i - 60) : i]
        rank = (prior.abs() < abs(s[i])).mean() if i >= 61 and prior.notna().all() and len(prior) == 60 else None
        if (vol[i] > 0 and abs(s[i]) > 2 * vol[i]) or (rank is not None and rank >= 0.95):
            out.append((i, s[i], s[i] / vol[i] if vol[i] > 0 else 0.0, rank))
    return out


def test_moves_equal_pandas(spark):
    a, b = walk(200, 1), walk(200, 2)
    a[120] *= 1.3
    rows = bars(spark, a).unionByName(bars(spark, b, "B"))
    got = {(r.ticker, (r.move_date - DAY).days): r for r in panel.significant_moves(rows.orderBy(F.rand(3))).collect()}
    want = {(t, i): (r, z, k) for t, s in (("A", a), ("B", b)) for i, r, z, k in reference_moves(s)}
    assert set(got) == set(want)
    for key, (r, z, k) in want.items():
        assert math.isclose(got[key].return_pct, r, rel_tol=1e-9) and math.isclose(got[key].vol_zscore, z, rel_tol=1e-6)
        assert (got[key].magnitude_rank is None) == (k is None)


def test_no_moves(spark):
    assert panel.significant_moves(bars(spark, [100.0] * 90)).count() == 0
    assert panel.significant_moves(bars(spark, walk(10, 1))).count() == 0
    assert panel.significant_moves(bars(spark, [1.0]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        panel.significant_moves(bars(spark, [1.0]).drop("close"))


def test_later_bars_change_nothing_before(spark):
    a = walk(150, 5)
    whole = {r.move_date: r for r in panel.significant_moves(bars(spark, a)).collect()}
    part = {r.move_date: r for r in panel.significant_moves(bars(spark, a[:120])).collect()}
    assert {k: v for k, v in whole.items() if (k - DAY).days < 120} == part


def test_splits_compound(spark):
    splits = spark.createDataFrame([("A", DAY + dt.timedelta(days=2), "2:1"), ("A", DAY + dt.timedelta(days=4), "3:1"), ("Z", DAY, "2:1")], "ticker string, date date, split_factor string")
    got = [r.close for r in panel.adjust_splits(bars(spark, [12, 12, 6, 6, 2, 2]), splits).orderBy("date").collect()]
    assert np.allclose(got, [2, 2, 2, 2, 2, 2])
    reverse = spark.createDataFrame([("A", DAY + dt.timedelta(days=1), "1:10")], "ticker string, date date, split_factor string")
    assert np.allclose([r.close for r in panel.adjust_splits(bars(spark, [1, 10]), reverse).orderBy("date").collect()], [10, 10])


def test_dividends(spark):
    paid = spark.createDataFrame([("A", DAY + dt.timedelta(days=1), 50.0), ("A", DAY + dt.timedelta(days=2), 10.0), ("A", DAY + dt.timedelta(days=9), 1.0)], "ticker string, date date, amount double")
    got = [r.adj_close for r in panel.adjust_dividends(bars(spark, [100, 100, 100]), paid).orderBy("date").collect()]
    assert got == [45.0, 90.0, 100.0]


def test_reaction_windows(spark):
    closes = [100.0] * 65 + [110.0, 121.0, 121.0]
    d = lambda i: DAY + dt.timedelta(days=i)
    events = spark.createDataFrame([(1, "A", d(65), "BMO"), (2, "A", d(65), "AMC"), (3, "A", d(67), "AMC"), (4, "A", d(0), "BMO")], "event_id int, ticker string, event_date date, session string")
    got = {r.event_id: r.reaction_return for r in reactions.reactions(events, bars(spark, closes)).collect()}
    assert set(got) == {1, 2} and math.isclose(got[1], 0.1) and math.isclose(got[2], 0.1)


def test_business_days_equal_pandas(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(28)]
    rows = spark.createDataFrame([(x,) for x in days], "d date")
    for n in range(-8, 9):
        got = {r.d: r.x for r in rows.select("d", evidence.business_day(F.col("d"), n).alias("x")).collect()}
        offset = pd.offsets.BDay(abs(n))
        for x in days:
            want = (pd.Timestamp(x) - offset) if n < 0 else (pd.Timestamp(x) + offset)
            assert got[x] == want.date(), (x, n)
    assert one(spark, a=evidence.business_day(F.lit(dt.date(2024, 2, 2)), -5), b=evidence.business_day(F.lit(dt.date(2024, 2, 2)), 1)) == (dt.date(2024, 1, 26), dt.date(2024, 2, 5))


def test_window_join_caps_and_orders(spark):
    days = evidence.calendar(spark.createDataFrame([(DAY + dt.timedelta(days=i),) for i in range(20)], "date date"))
    moves = spark.createDataFrame([(1, "a", DAY + dt.timedelta(days=10))], "move_id int, ticker string, move_date date")
    rows = [(f"e{i:02d}", "A", DAY + dt.timedelta(days=5 + i % 7), "news" if i % 2 else "short_report") for i in range(60)]
    rows += [("out1", "A", DAY + dt.timedelta(days=4), "news"), ("out2", "A", DAY + dt.timedelta(days=12), "news"), ("far", "B", DAY + dt.timedelta(days=10), "news")]
    events = spark.createDataFrame(rows, "event_id string, ticker string, event_date date, event_type string")
    got = evidence.window_join(moves, events, days).orderBy("rank").collect()
    inside = [r for r in rows if r[1] == "A" and 5 <= (r[2] - DAY).days <= 11]
    want = sorted(inside, key=lambda r: (abs((r[2] - DAY).days - 10), 1 if r[3] == "short_report" else 4, r[0]))[:30]
    assert [r.event_id for r in got] == [r[0] for r in want]
    assert len(evidence.window_join(moves, events, days, most=None).collect()) == len(inside)


def test_scores(spark):
    r = one(
        spark,
        half=scoring.recency(F.lit("news"), F.lit(DAY), F.lit(DAY + dt.timedelta(days=7))),
        future=scoring.recency(F.lit("news"), F.lit(DAY + dt.timedelta(days=1)), F.lit(DAY)),
        top=scoring.source_quality(F.lit("sec_10k"), F.lit("Reuters")),
        wire=scoring.source_quality(F.lit("news"), F.lit("Reuters Wire")),
        unknown=scoring.source_quality(F.lit("x"), F.lit(None).cast("string")),
        own=scoring.alignment(F.lit("macro"), F.lit("amd"), F.lit("AMD")),
    )
    assert np.allclose(list(r), [0.5, 0.0, 1.0, 0.77, 0.5, 1.0])


def test_tags_are_idempotent(spark):
    once = scoring.tag_weight(F.lit("text"), F.lit(0.5))
    r = one(spark, a=once, b=scoring.tag_weight(once, F.lit(0.9)))
    assert r.a == "[EVIDENCE_WEIGHT MED (0.50)] text" and r.b == "[EVIDENCE_WEIGHT HIGH (0.90)] text"


@pytest.mark.parametrize(("n", "kept"), [(3, 3), (5, 5), (6, 5), (10, 8), (100, 50)])
def test_filter_and_rank(spark, n, kept):
    rows = spark.createDataFrame([(1, f"c{i:03d}", 0.9 - i / 1000) for i in range(n)], "move_id int, chunk_id string, score double")
    assert relevance.filter_and_rank(rows).count() == kept
    low = rows.withColumn("score", F.lit(0.001))
    assert relevance.filter_and_rank(low).count() == min(n, 5)


def test_interleave(spark):
    rows = spark.createDataFrame([(1, "a", DAY, "a1"), (1, "a", DAY + dt.timedelta(days=1), "a2"), (1, "b", DAY, "b1")], "m int, s string, d date, id string")
    assert [r.id for r in relevance.interleave(rows, "m", "s", "d", "id").orderBy("place").collect()] == ["a2", "b1", "a1"]


def test_text(spark):
    words = " ".join(f"w{i}" for i in range(10))
    r = one(
        spark,
        chunks=text.word_chunks(text.word_array(F.lit(words)), 4, 1),
        none=text.word_chunks(text.word_array(F.lit("  ")), 4, 1),
        chars=text.char_chunks(F.lit("abcdefghij"), 4, 1),
        html=text.strip_html(F.lit("<p>a &amp; b</p><script>x<y</script> c")),
        key=text.company_key(F.lit("Acme Holdings, Inc.")),
        slug=text.slug(F.lit(" A--b! ")),
        url=date_text(text.date_in_url(F.lit("https://x/2024/2/30/a"))),
        url2=date_text(text.date_in_url(F.lit("https://x/2024/2/a"))),
        section=text.section_name(F.lit("Item 1A")),
        src=text.source_of_id(F.lit("13f_delta_1")),
        opt=text.optional(F.lit(" NaN ")),
    )
    assert list(r.chunks) == ["w0 w1 w2 w3", "w3 w4 w5 w6", "w6 w7 w8 w9"] and list(r.none) == [] and list(r.chars) == ["abcd", "defg", "ghij"]
    assert (r.html, r.key, r.slug, r.url, r.url2, r.section, r.src, r.opt) == ("a & b c", "ACME", "a_b", None, "2024-02-01", "risk_factors", None, None)


def date_text(c):
    return c.cast("string")


def test_quarter_ends(spark):
    r = one(spark, a=dates.last_quarter_end(F.lit(dt.date(2024, 3, 31))), b=dates.last_quarter_end(F.lit(dt.date(2024, 3, 31)), exact=False), c=dates.last_quarter_end(F.lit(dt.date(2024, 12, 31)), exact=False), d=dates.last_quarter_end(F.lit(dt.date(2024, 5, 2))))
    assert list(r) == [dt.date(2024, 3, 31), dt.date(2023, 12, 31), dt.date(2024, 12, 31), dt.date(2024, 3, 31)]


def test_strategies(spark):
    c, p, r = F.lit, lambda x: F.lit(x).cast("double"), lambda x: F.lit(x).cast("double")
    got = one(
        spark,
        a=signals.expected_vs_realised(p(0.02), r(0.03)),
        b=signals.expected_vs_realised(p(0.02), r(0.01)),
        c=signals.expected_vs_realised(p(0.02), r(-0.03)),
        d=signals.expected_vs_realised(p(None), r(0.03)),
        e=signals.fade_or_follow(c("transient"), p(0.02), r(0.03)),
        f=signals.fade_or_follow(c("transient"), p(0.02), r(0.031)),
        g=signals.hybrid(c("structural"), p(0.02), r(0.02), c("macro")),
        h=signals.hybrid(c("structural"), p(0.02), r(0.02), c("demand")),
        i=signals.fade_or_follow(c("mixed"), p(None), r(0.1)),
    )
    assert list(got) == ["fade", "lean", "neutral", "neutral", "neutral", "fade", "neutral", "lean", "neutral"]


def test_summary_equals_pandas(spark):
    x = np.random.default_rng(4).normal(0.001, 0.02, 60)
    rows = spark.createDataFrame([("s", i, 1, float(v)) for i, v in enumerate(x)] + [("s", 99, 0, 0.0), ("flat", 1, 1, 0.01)], "k string, i int, direction int, pnl double")
    got = {r.k: r for r in backtest.summarize(rows, ["k"], ["i"]).collect()}
    cum = np.cumsum(x)
    assert math.isclose(got["s"].sharpe, x.mean() / x.std(ddof=1) * math.sqrt(252 / 5)) and got["s"].n_trades == 60
    assert math.isclose(got["s"].max_drawdown, (cum - np.maximum.accumulate(cum)).min()) and got["flat"].sharpe == 0.0
    with pytest.raises(ValueError):
        backtest.profit(rows, rows, 3)


def test_basket(spark):
    rows = bars(spark, [1, 1.1, 1.21]).unionByName(bars(spark, [2, 2, 2.2], "B"))
    got = backtest.basket(rows, ["A"], ["B"]).orderBy("date").collect()
    assert np.allclose([r.ret for r in got], [0, 0.1, 0.0]) and math.isclose(got[-1].equity, 1.1)
    with pytest.raises(ValueError):
        backtest.basket(rows, [])


def test_scoring_of_cases(spark):
    t, n = F.lit(True), F.lit(None).cast("boolean")
    r = one(
        spark,
        full=evaluate.score_case({"dim": t, "dir": t, "char": F.lit(False), "fade_lean": n}),
        veto=evaluate.score_case({"dim": t, "dir": n}, F.lit(True)),
        none=evaluate.score_case({"dim": n}),
    )
    assert np.allclose(list(r), [0.75 / 0.9, 0.0, 0.0])


def test_persistence_fit(spark):
    r = np.random.default_rng(3)
    x = r.random((80, 2))
    rows = spark.createDataFrame([(float(a), float(b), float(2 * a - b)) for a, b in x], "a double, b double, y double")
    got = evaluate.persistence_fit(rows, ["a", "b"], "y", {"a": 0.0, "b": 0.0})
    assert np.allclose([got["a"], got["b"]], [1.0, -0.5])
    assert evaluate.persistence_fit(rows.limit(3), ["a", "b"], "y", {"a": 7.0, "b": 8.0}) == {"a": 7.0, "b": 8.0}


def test_holdings(spark):
    schema = "fund string, asset string, shares long, market_value long"
    now = spark.createDataFrame([("f", "a", 10, 100), ("f", "b", 5, 50), ("f", "c", 1, 1)], schema)
    then = spark.createDataFrame([("f", "a", 5, 40), ("f", "c", 1, 1), ("f", "d", 2, 9), ("g", "z", 1, 1)], schema)
    got = {r.asset: (r.action, r.shares_change) for r in holdings.deltas(now, then, "fund", "asset").collect()}
    assert got == {"a": ("INCREASED", 5), "b": ("NEW", 5), "d": ("EXITED", -2)}
    assert [r.percent for r in holdings.roll_up(now, "fund", "asset").orderBy("asset").collect()] == [66.225, 33.113, 0.662]


def test_adapters(spark):
    ix = spark.createDataFrame([("x1", "idx", "add", "amd", DAY, DAY + dt.timedelta(days=5)), ("x2", "idx", "add", " ", DAY, DAY)], "change_id string, index_name string, action string, ticker string, announcement_date date, effective_date date")
    news = spark.createDataFrame([("u1", ["amd", "amd", "nvda"], "T", "P", DAY, [(1, "one"), (2, " ")])], "uuid string, tickers array<string>, title string, publisher string, report_date date, paragraphs array<struct<n:int,text:string>>")
    got = unify.union([unify.index_changes(ix), unify.news(news)], F.lit(DAY)).collect()
    assert sorted(r.event_id for r in got) == ["news_u1_001", "news_u1_001", "x1_announcement"]
    assert got[0].ticker == "AMD"


def test_attribution_helpers(spark):
    w = [F.lit(0.2)] * 5
    pool = F.array(F.lit("a"), F.lit("b"))
    r = one(spark, ok=attribution.issues(w, F.lit(0.5), F.array(F.lit("a")), pool), bad=attribution.issues([F.lit(0.5)] * 5, F.lit(2.0), F.array(F.lit("z")), pool), kept=attribution.sanitise(F.array(F.lit("z")), pool)[0])
    assert list(r.ok) == [] and len(r.bad) == 3 and list(r.kept) == ["a"]
    rows = spark.createDataFrame([(1, ["a"])], "id int, sources array<string>").withColumn("sources", F.array(F.lit("sec_10k"), F.lit("news")))
    assert attribution.smallest_bundle(spark, rows).first().ablation == "+sec"


def test_ladders_are_cumulative_and_named_as_their_noise():
    for ladder in (attribution.LADDER, attribution.SERVED_LADDER):
        assert [n for n, _ in ladder] == list(attribution.NOISE)
        assert all(set(a) < set(b) for (_, a), (_, b) in zip(ladder, ladder[1:], strict=False))
    assert attribution.LADDER[1][1] == ("news", "sec_10k", "sec_10q", "sec_8k") and attribution.LADDER[-1][1][-1] == "research_13f"


def brute_summary(rows):
    """rows of one key in order: (direction, pnl)."""
    active = [p for d, p in rows if d != 0]
    if not active:
        return None
    cum = peak = worst = None
    for p in active:
        cum = p if cum is None else cum + p
        peak = cum if peak is None else max(peak, cum)
        worst = min(cum - peak, worst if worst is not None else 0.0)
    return len(active), sum(active) / len(active), worst, sum(p > 0 for p in active) / len(active)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scan_over_days_equals_one_pass(spark, seed):
    """Days with many rows, idle rows and idle days; keys that are null; against a loop over the whole series."""
    import random

    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), r.randint(1, 12), i, d := r.choice([-1, 0, 0, 1]), d * r.choice([0.01, -0.02, 0.05, -0.04])) for i in range(150)]
    rows += [("idle", k, 1000 + k, 0, 0.0) for k in range(5)] + [("same", k, 2000 + k, 1, 0.1) for k in range(6)]
    df = spark.createDataFrame(rows, "k string, day int, i int, direction int, pnl double").repartition(5)
    got = {x.k: x for x in backtest.summarize(df, ["k"], ["day", "i"], 5, {"n_all": F.lit(1)}, idle=True).collect()}
    for k in ("a", "b", None, "idle", "same"):
        own = [(d, p) for key, _, _, d, p in sorted(rows, key=lambda x: (x[1], x[2])) if key == k]
        want = brute_summary(own)
        assert got[k].n_all == len(own)
        if want is None:
            assert got[k].n_trades == 0 and got[k].max_drawdown is None and got[k].sharpe == 0
        else:
            assert (got[k].n_trades, got[k].avg_return, got[k].max_drawdown, got[k].hit_rate) == pytest.approx(want)
    assert got["same"].sharpe == 0 and got["same"].max_drawdown == 0
    curve = backtest.curve(df.where("k = 'a'"), ["k"], ["day", "i"], 100).orderBy("day", "i").collect()
    cum = peak = None
    for x in curve:
        cum = 100 * x.pnl + (cum or 0)
        peak = cum if peak is None else max(peak, cum)
        assert (x.cumulative, x.drawdown) == pytest.approx((cum, cum - peak), abs=1e-9)
    plan = backtest.summarize(df, ["k"], ["day", "i"])._jdf.queryExecution().executedPlan().toString()
    assert all("day#" in line.split("specifiedwindowframe")[0] or "day#" in line for line in plan.split("\n") if " Window " in line or "- Window" in line)


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles(spark, monkeypatch, seed):
    """Few buckets, so that ranges narrow many times; ties, huge spans, nulls and NaN."""
    import numpy as np

    from eventloom.operators import quantiles

    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    rng = np.random.default_rng(seed)
    values = [("a", float(x)) for x in rng.normal(0, 1, 300)] + [("b", float(x)) for x in rng.integers(0, 3, 200)] + [(None, float(x)) for x in 10.0 ** rng.uniform(-200, 200, 100)] + [("c", 7.0), ("d", None), ("d", float("nan"))]
    df = spark.createDataFrame(values, "k string, v double").repartition(6)
    got = quantiles.exact_quantiles(df, "v", (0.0, 0.25, 0.5, 0.9, 1.0), "k")
    for k in ("a", "b", None, "c"):
        own = [v for g, v in values if g == k]
        assert got[k] == pytest.approx(list(np.quantile(own, [0.0, 0.25, 0.5, 0.9, 1.0])), rel=1e-12), k
    assert set(got) == {"a", "b", None, "c"} and quantiles.exact_quantiles(df.limit(0), "v", (0.5,)) == {}


def test_paged_source(spark):
    rows = web.read_pages(spark, "tests.paged_fixture:fetch", "ticker string, id int, value int", [{"start": 0}, {"start": 9}], page_size=5)
    assert rows.count() == 15
    assert web.first_by(rows, "id").count() == 9
    with pytest.raises(Exception, match="MorePages|more than 2 pages"):
        web.read_pages(spark, "tests.paged_fixture:fetch", "id int", page_size=5, max_pages=2).count()
    assert web.read_pages(spark, "tests.paged_fixture:fetch", "id int", page_size=5, max_pages=2, on_limit="keep").count() == 10
    assert web.read_pages(spark, "tests.paged_fixture:fetch", "id int", page_size=6, max_pages=2).count() == 12
    assert web.month_slices("2024-01-01", "2024-02-05") == [("2024-01-01", "2024-01-30"), ("2024-01-31", "2024-02-05")]


def test_paged_source_waits_after_overload(monkeypatch):
    from eventloom.sources import web as w

    calls, waits = [], []
    monkeypatch.setattr(w.time, "sleep", waits.append)

    def fetch(offset, limit):
        calls.append(offset)
        if len(calls) in (1, 2, 4):
            raise w.Overloaded(delay=7 if len(calls) == 1 else None)
        return [{"id": offset}] * (limit if offset < 10 else 3)

    import tests.paged_fixture as fixture

    monkeypatch.setattr(fixture, "fetch", fetch)
    pages = w._Pages({"fetcher": "tests.paged_fixture:fetch", "page_size": "5", "attempts": "3"})
    assert len(list(pages.rows(w.Slice(0, {}), ["id", "place"]))) == 13
    assert calls == [0, 0, 0, 5, 5, 10] and [x for x in waits if x] == [7, 2.0, 1.0]
    monkeypatch.setattr(fixture, "fetch", lambda offset, limit: (_ for _ in ()).throw(w.Overloaded()))
    with pytest.raises(w.Overloaded):
        list(pages.rows(w.Slice(0, {}), ["id", "place"]))


def test_paged_stream_resumes(spark, tmp_path):
    """Two pages a batch; a second run goes on from the checkpoint and reads nothing twice."""
    got = []
    for run in (1, 2):
        df = web.stream_pages(spark, "tests.paged_fixture:fetch", "value int", [{"start": 0}, {"start": 9}], page_size=2, pages_per_batch=2)
        q = df.writeStream.foreachBatch(lambda b, i: got.append(sorted(r.value for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(**({"once": True} if run == 1 else {"processingTime": "0 seconds"})).start()
        if run == 1:
            q.awaitTermination(60)
        else:
            q.processAllAvailable()
            q.stop()
    assert got[0] == [0, 1, 2, 3, 9, 10, 11] or got[0] == [0, 1, 2, 3, 9, 10]
    assert sorted(x for b in got for x in b) == sorted([*range(12), 9, 10, 11])


def test_filing_choice_and_tables(spark):
    """From a filing index to holdings: exact forms up to as_of, newest first; of a filing's documents the information table."""
    recent = {"form": ["13F-HR", "13F-HR/A", "10-K", "13F-HR", "13F-HR"], "filingDate": ["2024-02-14", "2024-03-01", "2024-02-20", "2024-05-15", "2023-11-14"], "accessionNumber": ["a1", "a2", "a3", "a4", "a5"], "reportDate": ["2023-12-31", "2023-12-31", "2023-12-31", "2024-03-31", "2023-09-30"]}
    index = spark.createDataFrame([("7", "Fund", recent)], "fund_cik string, fund_name string, recent struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,reportDate:array<string>>")
    chosen = web.document_choices(index, F.lit("2024-04-01").cast("date")).orderBy("place").collect()
    assert [(r.accession, str(r.report_date)) for r in chosen] == [("a1", "2023-12-31"), ("a5", "2023-09-30")]
    xml = "<informationTable><infoTable><nameOfIssuer>ACME INC</nameOfIssuer><cusip>C1</cusip><value>5</value><shrsOrPrnAmt><sshPrnamt>7</sshPrnamt><sshPrnamtType>SH</sshPrnamtType></shrsOrPrnAmt></infoTable></informationTable>"
    docs = [("7", DAY, "a1", p, i, x) for i, (p, x) in enumerate([("/x/primary_doc.xml", xml), ("/x/cover.xml", "<cover/>"), ("/x/table.xml", xml), ("/x/other.xml", xml.replace("7", "8")), ("/x/t.txt", xml)])]
    tables = web.information_tables(spark.createDataFrame(docs, "fund_cik string, filing_date date, accession string, path string, place int, xml string"))
    assert [(r.cusip, r.shares) for r in web.holdings(tables).collect()] == [("C1", 7)]


def test_news_mapper(spark):
    rows = [(0, " Up ", "more ", 1704067200, "Reuters", "u1"), (1, "", " ", 1704067200, "x", "u2"), (2, "No time", "", None, "x", "u3"), (3, "Down", None, 1704153600, " ", "")]
    a = spark.createDataFrame(rows, "place long, headline string, summary string, datetime long, source string, url string")
    got = [tuple(r) for r in web.news_chunks(a, F.lit("amd")).select("chunk_id", "text", "section_name", "source_url", "token_count").orderBy("chunk_id").collect()]
    assert got == [("news_AMD_2024-01-01_finnhub_0000", "Up\n\nmore", "Reuters", "u1", 2), ("news_AMD_2024-01-02_finnhub_0001", "Down", "Finnhub", None, 1)]
    peer = web.news_chunks(a, F.lit("amd"), "peer_news", "peer", F.lit("NVDA")).orderBy("chunk_id").first()
    assert peer.section_name == "Reuters (via NVDA)" and peer.source_type == "peer_news"


def test_expectations_in_one_pass(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None), (0, -2.0)], "id long, v double")
    got = {r.check: (r.n, r.failed, r.share, r["sample"]) for r in audit.expectations(rows, {"positive": F.col("v") > 0, "small": F.col("v") < 9}, "id").collect()}
    assert got == {"positive": (3, 2, pytest.approx(2 / 3), 0), "small": (3, 0, 0.0, None)}
    assert audit.ordering(spark.createDataFrame([(1.0, 2.0, 0.5, 1.5), (1.0, 1.2, 0.5, 1.5), (1.0, 2.0, 0.0, 1.5)], "open double, high double, low double, close double")).count() == 2
    assert audit.look_ahead(spark.createDataFrame([(1, 2), (3, 2)], "used int, at int"), "used", "at").count() == 1
    assert [r.ticker for r in audit.renamed(spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x")], "ticker string, name string")).collect()] == ["A"]


def test_parsers(spark):
    table = "<table></table><table><tr><th>h</th></tr><tr><th>h</th></tr><tr><td>January 3, 2024</td><td>AAA<sup>1</sup></td><td>A Co[2]</td><td>BBB</td><td>B Co</td></tr></table>"
    got = web.index_changes(spark.createDataFrame([(table,)], "html string"), F.lit(dt.date(2024, 12, 31))).collect()
    assert {(r.action, r.ticker, r.replacing_ticker) for r in got} == {("add", "AAA", "BBB"), ("delete", "BBB", "AAA")}
    xml = "<informationTable>" + "".join(f"<infoTable><nameOfIssuer>{n}</nameOfIssuer><cusip>{n}</cusip><value>5</value><shrsOrPrnAmt><sshPrnamt>7</sshPrnamt><sshPrnamtType>{k}</sshPrnamtType></shrsOrPrnAmt></infoTable>" for n, k in (("ACME INC", "SH"), ("BOND", "PRN"))) + "</informationTable>"
    held = web.holdings(spark.createDataFrame([("1", DAY, xml)], "fund_cik string, filing_date date, xml string"))
    named = web.resolve_names(held, spark.createDataFrame([("Acme Corp", "ACM")], "company string, ticker string")).collect()
    assert [(r.ticker, r.shares) for r in named] == [("ACM", 7)]
    page = "<a href='https://x/2024/3/4/p'>Short $XYZ now</a><a href='https://x/2024/3/4/p'>Again, the same</a><a href='/about'>About us</a>"
    found = web.reports(spark.createDataFrame([(page,)], "html string"), "pub").collect()
    assert [(r.target_ticker, r.title) for r in found] == [("XYZ", "Short $XYZ now")]


def test_sinks_and_readers(spark, tmp_path):
    df = spark.createDataFrame([("a", DAY, 1.5), ("b", DAY, 2.5)], "ticker string, move_date date, v double")
    sinks.write_slim(df, str(tmp_path / "slim"))
    assert dict(spark.read.parquet(str(tmp_path / "slim")).dtypes)["v"] == "float"
    assert [json.loads(r.bundle)[0]["v"] for r in sinks.bundles(df).orderBy("ticker").collect()] == [1.5, 2.5]
    keyed = df.withColumnRenamed("ticker", "cache_key")
    path = str(tmp_path / "cache")
    sinks.append_missing(keyed.limit(1), path)
    sinks.append_missing(keyed, path)
    assert spark.read.parquet(path).count() == 2
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j"), df.schema).count() == 2
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert sinks.markdown(df).splitlines()[2] == "| a | 2024-01-01 | 1.5000 |"
    assert readers.scan_glob(spark, str(tmp_path / "none*"), df.schema).count() == 0
    assert readers.resolve(spark, str(tmp_path / "none"), path) == path
    with pytest.raises(FileNotFoundError):
        readers.resolve(spark, str(tmp_path / "none"))
    shard = tmp_path / "f.jsonl"
    shard.write_text(json.dumps({"cik": "1", "name": "n", "tickers": ["amd"], "filings": [{"form": "10-K", "filingDate": "2024-01-02", "reportDate": "x", "report": {"section_1": ["a", "b"]}}]}) + "\nnot json\n")
    got = readers.read_filings(spark, str(shard), "AMD").collect()
    assert [(r.section, list(r.sentences), r.period_end) for r in got] == [("section_1", ["a", "b"], None)]


def test_pushdown(spark):
    df = readers.scan(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_suppkey"], F.col("l_quantity") > 49)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_audits(spark):
    assert audit.duplicates(bars(spark, [1, 2]).unionByName(bars(spark, [1])), ["ticker", "date"]).count() == 1
    none = spark.createDataFrame([], "ticker string, date date")
    assert audit.unexplained_jumps(bars(spark, [1, 2, 2.1]), none).count() == 1


def stream_of(spark, path, parts, schema):
    """A stream that takes one file after another, in the parts' order."""
    import os
    import time as clock

    for i, part in enumerate(parts):
        target = path / f"part{i:03d}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(target))
        (file,) = target.glob("*.parquet")
        (path / "in").mkdir(exist_ok=True)
        moved = path / "in" / f"{i:03d}.parquet"
        file.rename(moved)
        os.utime(moved, (clock.time() - 1000 + i, clock.time() - 1000 + i))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    """Bars that come late, within the delay, give the batch's answer; a last bar far ahead makes the others final."""
    import random

    from eventloom.streaming import operators as S

    a = walk(120, 8)
    a[90] *= 1.4
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(days=i), float(c)) for i, c in enumerate(a)]
    r = random.Random(3)
    late = [x for k in range(0, 120, 5) for x in r.sample(rows[k : k + 5], 5)]  # out of order by four days at most
    parts = [late[k : k + 12] for k in range(0, 120, 12)]
    parts = [[*p, *([late[k * 12 + 13]] if k * 12 + 13 < 120 else [])] for k, p in enumerate(parts)]  # and some come twice
    parts.append([(2, start + dt.timedelta(days=200), 1.0)])
    schema = "ticker long, ts timestamp, close double"
    got = drained(S.detect_moves(stream_of(spark, tmp_path, parts, schema), delay="10 days"), "moves")
    assert sorted((x.move_date - start).days for x in got) == [i for i, *_ in reference_moves(a)]
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(S.spikes(stream.withColumnRenamed("close", "value"), delay="10 days"), "spikes")
    want = [(i, a[i - 1], a[i]) for i in range(1, 120) if a[i - 1] > 0 and a[i] / a[i - 1] - 1 > 0.2]
    assert [((x.ts - start).days, x.prior, x.value) for x in sorted(got, key=lambda x: x.ts)] == [(i, float(u), float(v)) for i, u, v in want]


def test_stream_drops_dead_keys(spark, tmp_path):
    """A key without rows for longer than `expire` starts anew: its old value is no prior."""
    from eventloom.streaming import operators as S

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    parts = [[(1, day(0), 1.0), (1, day(1), 2.0)], [(2, day(60), 1.0)], [(2, day(61), 1.0)], [(1, day(70), 9.0), (2, day(70), 1.0)], [(1, day(71), 99.0), (3, day(200), 1.0)]]
    got = drained(S.spikes(stream_of(spark, tmp_path, parts, "ticker long, ts timestamp, value double"), delay="2 days", expire_days=20), "dead")
    assert sorted(((x.ts - day(0)).days, x.prior, x.value) for x in got) == [(1, 1.0, 2.0), (71, 9.0, 99.0)]


def test_stream_dedupe_and_as_of(spark, tmp_path):
    from eventloom.streaming import operators as S

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    parts = [[(1, day(0), "u", 1.0), (1, day(1), "v", 2.0)], [(1, day(3), "u", 4.0), (2, day(3), "w", 5.0)], [(2, day(39), "x", 6.0)], [(2, day(39), "x", 7.0)], [(1, day(40), "u", 8.0)], [(2, day(41), "y", 3.0)], [(1, day(2), "late", 16.0), (1, day(80), "z", 0.0)]]
    schema = "ticker long, ts timestamp, url string, value double"
    stream = stream_of(spark, tmp_path, parts, schema)
    assert sorted((x.url, x.value) for x in drained(S.dedupe(stream, ["url"]), "deduped")) == [("u", 1.0), ("u", 8.0), ("v", 2.0), ("w", 5.0), ("x", 6.0), ("y", 3.0), ("z", 0.0)]
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(S.as_of(stream.withColumnRenamed("ts", "ts")), "as_of")
    # what came after the lag counts nowhere; the last window isn't final yet
    assert sorted(((x.window.start - day(0)).days, x.ticker, x.n, x.value) for x in got) == [(0, 1, 1, 1.0), (1, 1, 1, 2.0), (3, 1, 1, 4.0), (3, 2, 1, 5.0), (39, 2, 2, 13.0), (40, 1, 1, 8.0), (41, 2, 1, 3.0)]


def test_delta_texts_of_all_customers(spark):
    """Shares of four digits and more, which K02i_delta_events leaves out, and sales."""
    rows = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").selectExpr("'f' AS fund", "c_custkey AS ticker", "'2024-02-14' AS filing_date", "'NEW' AS action", "explode(array(c_custkey, -1000 * c_custkey)) AS shares_change")
    want = sorted((str(r.ticker), f"f NEW: {r.shares_change:+,} shares") for r in rows.collect())
    assert len(want) == 3000 and sorted((r.ticker, r.text) for r in unify.holding_deltas(rows).collect()) == want


def test_each_request_is_asked_for_once(spark, tmp_path):
    """Four calls a move, whatever reads the answers; through the cache none the second time, but for failures."""
    from eventloom.operators import provider as P
    from eventloom.plans.serving import moody, word_counter

    asked = tmp_path / "calls"

    def counted(request):
        with asked.open("a") as f:
            f.write(f"{request['event_id']} {request['variant']}\n")
        return moody(request)

    moves = spark.createDataFrame([(i, 7, 0.1) for i in (1, 3, 5, 7)], "event_id long, ticker long, return_pct double").withColumn("move_date", F.to_date(F.lit("2024-01-09")))
    chunks = [(i, f"c{i}_{k}", f"from {'news' if k % 2 else 'sec_10k'}", 1.0 - k / 10) for i in (1, 3, 5, 7) for k in range(6)]
    rows = P.evidence(moves, spark.createDataFrame(chunks, "event_id long, chunk_id string, text string, score double").withColumn("publication_date", F.to_date(F.lit("2024-01-05"))))
    doubter = lambda request: {"plausible": True}
    got = P.perturbation(rows, counted, reviewer=doubter)
    assert got.count() == 12 and got.where("passed").count() <= 9
    got.collect()
    calls = asked.read_text().split("\n")[:-1]
    assert sorted(calls) == sorted({f"{i} {v}" for i in (1, 3, 5, 7) for v in ("base", "determinism", "shuffle", "junk")})
    failed = {(r.event_id, r.check): r.reason for r in got.where("not passed").collect()}
    assert "character flipped" in failed[7, "determinism"] and all("call failed" in v for k, v in failed.items() if k[0] == 5)

    asked.unlink()
    cache = str(tmp_path / "answers")
    asked_rows = P.requests(rows)
    for n in (4, 1):  # the second time only the call that failed is made again
        out = P.answers(asked_rows, counted, cache=cache)
        assert sorted(r.event_id for r in out.collect()) == [1, 3, 5, 7] and out.where("failed is null").count() == 3
        assert len(asked.read_text().split("\n")[:-1]) == n
        asked.unlink()
    assert word_counter({"event_id": 1, "body": "CHUNKS from news", "chunk_ids": ["a"]})["demand"]["weight"] == pytest.approx(0.8)


def test_reading_through_a_cache(spark, tmp_path):
    from eventloom.sources.staging import read_through

    path, seen = str(tmp_path / "cache"), []

    def answer(rows):
        seen.append(sorted(r.cache_key for r in rows.collect()))
        return rows.select("cache_key", (F.length("cache_key") * 2).alias("a"))

    ask = lambda keys: spark.createDataFrame([(k,) for k in keys], "cache_key string")
    one = read_through(ask(["x", "x", "yy"]), answer, path)
    two = read_through(ask(["yy", "zzz"]), answer, path)
    assert sorted(map(tuple, one.collect())) == [("x", 2), ("yy", 4)] and sorted(map(tuple, two.collect())) == [("yy", 4), ("zzz", 6)]
    assert seen == [["x", "yy"], ["zzz"]]
    spark.createDataFrame([("x", 9)], "cache_key string, a int").write.mode("append").parquet(path)  # two runs at the same time
    assert [r.a for r in read_through(ask(["x"]), answer, path).collect()] == [2]


@pytest.mark.parametrize(("seed", "n"), [(1, 900), (2, 40), (3, 2500)])
def test_best_chunks_are_those_of_all(spark, seed, n):
    """What meets a move after pruning gives the same result as scoring every chunk of its ticker, and is far less."""
    import random
    from datetime import date, timedelta

    r = random.Random(seed)
    day = lambda: date(2022, 1, 1) + timedelta(days=r.randint(0, 900))
    sources = ["news", "peer_news", "sec_10k", "macro", "sec_8k", "other"]
    docs = [(r.choice([1, 1, 1, 2, 3]), f"c{i:05d}", r.choice(sources), r.choice(["Reuters", "", "x"]), day(), r.choice(["1", "2", "z"])) for i in range(n)]
    docs += [(4, f"late{i}", "news", "", date(2030, 1, 1), "4") for i in range(12)] + [(5, f"few{i}", "news", "", day(), "5") for i in range(3)]
    found = [(i, r.choice([1, 2, 3, 4, 5]), day()) for i in range(40)]
    chunks = spark.createDataFrame(docs, "ticker long, chunk_id string, src string, publisher string, published date, chunk_ticker string")
    moves = spark.createDataFrame(found, "move_id long, ticker long, move_date date")
    s = relevance.score(F.col("src"), F.col("publisher"), F.col("published"), F.col("move_date"), F.col("chunk_ticker"), F.col("ticker").cast("string"))
    every = moves.join(chunks, "ticker").withColumn("score", F.round(s, 9))
    best = relevance.best_scored(moves, chunks)
    pick = lambda df: sorted((x.move_id, x["rank"], x.chunk_id, x.score) for x in df.collect())
    assert pick(relevance.filter_and_rank(best, pool="pool")) == pick(relevance.filter_and_rank(every))
    if n > 2000:
        assert best.count() < 0.7 * every.count()


def test_a_failing_case_costs_its_own_cells(spark):
    from eventloom.operators import provider as P
    from eventloom.plans.serving import word_counter

    moves = spark.createDataFrame([(i, 7, 0.1) for i in (1, 5, 9)], "event_id long, ticker long, return_pct double").withColumn("move_date", F.to_date(F.lit("2024-01-09")))
    chunks = [(i, f"c{i}_{k}", f"from {s}", 1.0 - k / 10, s) for i in (1, 5) for k, s in enumerate(["news", "macro", "sec_10k"])] + [(9, "c9", "from macro", 0.5, "macro")]
    c = spark.createDataFrame(chunks, "event_id long, chunk_id string, text string, score double, source_type string").withColumn("publication_date", F.to_date(F.lit("2024-01-05")))
    got = P.cells(moves, c, word_counter).collect()
    n = {(r.event_id, r.ablation): 0 for r in got}
    for r in got:
        n[r.event_id, r.ablation] += 1
    names = [x for x, _ in attribution.LADDER]
    assert n == {(i, x): 5 if i == 1 or (i == 9 and x in ("+macro", "+positioning")) else 1 for i in (1, 5, 9) for x in names}
    assert {r.failed for r in got if r.event_id == 5} == {"ValueError"} and {r.failed for r in got if r.event_id == 9} == {"no chunks", None}
    weight = {(r.ablation, r.dimension): r.weight for r in got if r.event_id == 1}
    assert [round(weight[x, "demand"], 6) for x in names] == [0.8, 0.5, 0.5, 0.5, 0.5, 0.4, 0.4]


def test_token_chunks(spark):
    """Windows of tokens against the library on whole texts; words where there is no vocabulary."""
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    from eventloom.operators.chunks import token_chunks

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "   ", "short one", "Größe 漢字 😀 " * 400, "word " * 1500, "a b c d e f g h i j"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted(map(tuple, token_chunks(df, path, tokenizers.PATTERN, size=100, overlap=10).collect()))
    want = []
    for i, t in enumerate(texts):
        ids, n = (enc.encode_ordinary(t.strip()) if t and t.strip() else []), 0
        for start in range(0, max(1, len(ids) - 10), 90) if ids else ():
            if body := enc.decode(ids[start : start + 100], errors="replace").strip():
                want.append((i, n, body, len(ids[start : start + 100])))
                n += 1
    assert got == want and {x[0] for x in got} == {3, 4, 5, 6}
    words = token_chunks(df).where("id = 5").orderBy("k").collect()
    assert [(r.k, len(r.piece.split()), r.token_count) for r in words] == [(0, 600, 800), (1, 600, 800), (2, 450, 600)]


def test_bridge_of_tickers_and_articles(spark, tmp_path):
    from eventloom.operators import bridge

    rows = [(i, dt.date(2024, 1, 1 + i % 28), [" amd ", "T%d" % (i % 9), ""] if i % 3 else ["T%d" % (i % 9)]) for i in range(90)] + [(99, dt.date(2024, 2, 2), None)]
    a = spark.createDataFrame(rows, "article_id long, published date, symbols array<string>")
    path = str(tmp_path / "bridge")
    bridge.write_bridge(a, path)
    bridge.write_bridge(a.where("article_id < 5"), path, mode="append")
    found = bridge.articles_of(spark, path, ["t4", "AMD", "none"], "2024-01-05", "2024-01-20")
    want = sorted((s, i) for i, d, xs in rows[:-1] for s in {x.strip().upper() for x in xs} & {"T4", "AMD"} if dt.date(2024, 1, 5) <= d <= dt.date(2024, 1, 20))
    assert sorted((r.symbol, r.article_id) for r in found.collect()) == want
    assert sorted(r.article_id for r in bridge.news_of(a, found).collect()) == sorted({i for _, i in want})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [b" in plan.replace("isnotnull(b", "b") and "In(symbol" in plan
    assert bridge.articles_of(spark, path, []).count() == 0
