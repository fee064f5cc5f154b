from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eventloom import cli
from eventloom.operators import pipelines as P
from eventloom.operators import provider, unify
from eventloom.sources import readers, sinks, web

D = "/root/testdata/sf0.001"
DAY = dt.date(2024, 2, 14)


def test_blank_keys_all_stay(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, None, 1), (3, "u", 2), (4, "u", 3), (5, " ", 4), (6, "", 5)], "id int, url string, place long")
    assert sorted(r.id for r in web.first_by(rows, "id", "url").collect()) == [1, 2, 3, 5, 6]


def test_holding_events_number_what_shares_a_ticker(spark):
    rows = spark.createDataFrame([("f", a, t, "2023-12-31", "2024-02-14", "NEW", 1234) for a, t in (("c2", "X"), ("c1", "X"), ("c3", "Y"))], "fund string, asset string, ticker string, period_end string, filing_date string, action string, shares_change long")
    got = P.holding_events(rows).orderBy("event_id").collect()
    assert [r.event_id for r in got] == ["13f_delta_f_X_2023-12-31", "13f_delta_f_X_2023-12-31_1", "13f_delta_f_Y_2023-12-31"]
    assert got[0].event_date == DAY and got[0].text == "f NEW: +1,234 shares"


def test_analyst_frame(spark):
    rows = spark.createDataFrame(
        [("amd", "2024-02-01", "Big Firm", "Buy", "Hold", "up", "120", "100"), ("amd", "2024-02-02", "Big Firm", "Hold", "", "init", "0", None), ("amd", "2024-02-03", " ", "Buy", "", "", "1", "1"), ("amd", "2024-03-01", "Late", "Buy", "", "", "1", "1"), ("amd", None, "F", "Buy", "", "", "1", "1")],
        "ticker string, graded string, firm string, to_grade string, from_grade string, action string, new_target string, prior_target string",
    )
    ratings, targets = P.analyst_actions(rows, F.lit(DAY))
    assert [(r.rating_id, r.action) for r in ratings.orderBy("rating_id").collect()] == [("rating_AMD_big_firm_2024-02-01_upgrade", "upgrade"), ("rating_AMD_big_firm_2024-02-02_initiate", "initiate")]
    assert [(t.target_id, t.change_pct) for t in targets.collect()] == [("target_AMD_big_firm_2024-02-01", pytest.approx(0.2))]
    assert {e.event_type for e in P.rating_events(ratings).collect()} == {"analyst_upgrade", "analyst_initiate"}
    assert [e.event_type for e in P.target_events(targets).collect()] == ["analyst_price_target"]


def test_approvals_and_their_adapter(spark):
    rows = spark.createDataFrame([("e1", "approval", "2024-02-01", "PFE", "Drug", "text", "u1"), ("e2", "crl", "2024-02-02", None, "Other", "text", None)], "event_id string, event_type string, event_date string, sponsor_ticker string, drug_name string, description string, source_url string")
    assert [(e.event_id, e.ticker, e.event_type) for e in unify.approvals(rows).collect()] == [("e1", "PFE", "approval")]
    twin = {e.event_id: (e.ticker, e.event_type) for e in P.approval_events(rows).collect()}
    assert twin == {"e1": ("PFE", "fda_approval"), "e2": ("_UNMAPPED", "fda_crl")}
    chunks = {c.chunk_id: c for c in P.event_chunks(P.approval_events(rows), "news", "https://d", rows).collect()}
    assert (chunks["e1"].source_url, chunks["e2"].source_url, chunks["e1"].token_count) == ("u1", "https://d", 2)


def test_application_approvals(spark):
    rows = spark.createDataFrame([("A1", "S", ["B", "C"], [("AP", "20240201"), ("TA", "20240202"), ("AP", "20200101"), ("AP", "nonsense")]), ("A2", "S", [], None)], "application_number string, sponsor_name string, brands array<string>, submissions array<struct<status:string,date:string>>")
    got = web.approvals(rows, F.lit(dt.date(2023, 1, 1)), F.lit(DAY)).collect()
    assert [(r.application_number, r.drug_name, r.event_date) for r in got] == [("A1", "B", dt.date(2024, 2, 1))]


def test_reports_and_filings(spark):
    rows = spark.createDataFrame([("c1", "pub", "x", "2024-02-01", "Title", None, ["one", " ", *map(str, range(20))])], "chunk_id string, publisher string, target_ticker string, publication_date string, title string, source_url string, paragraphs array<string>")
    full = P.report_records(rows)
    assert unify.short_reports(full).first().event_type == "short_report"
    c = P.report_chunks(full).first()
    assert (c.chunk_id, c.ticker, c.text.count("\n\n"), c.token_count) == ("c1", "X", 10, 11)
    filed = spark.createDataFrame([("k1", "amd", "10-K", "2024-02-01", "mda", "t"), ("k2", "amd", "S-1", "2024-02-01", "x", "t"), ("k3", "amd", "8-K", None, "x", "t")], "chunk_id string, ticker string, form string, filing_date string, section string, text string")
    assert [(e.event_id, e.event_type, e.ticker) for e in unify.filings(filed).collect()] == [("k1", "sec_10k", "AMD")]


def test_transcripts(spark):
    ps = [(1, "Operator", "hello all"), (2, "CEO", "we grew"), (3, "Operator", "first question please"), (4, "", "why")]
    rows = spark.createDataFrame([("amd", "2024-02-01", ps[::-1]), ("x", None, ps), ("y", "2024-02-01", [])], "ticker string, report_date string, paragraphs array<struct<place:int,speaker:string,content:string>>")
    got = P.transcript_chunks(rows, lambda p: p["content"].contains("question")).orderBy("chunk_id").collect()
    assert [(c.chunk_id, c.text) for c in got] == [("earnings_transcript_AMD_2024-02-01_prepared_001", "[Operator]: hello all [CEO]: we grew"), ("earnings_transcript_AMD_2024-02-01_qa_001", "[Operator]: first question please why")]


def test_annual_and_current_reports(spark):
    rows = spark.createDataFrame([("amd", "2024-02-01", "2023-12-31", "Item 7", "m n o"), ("amd", "2024-02-01", "2023-12-31", "Business", "a b c d e"), ("amd", "2024-02-01", "2023-12-31", "Exhibits", "x")], "ticker string, filing_date string, period_end string, label string, text string")
    got = P.annual_chunks(rows, 3, 1).orderBy(F.substring("chunk_id", -3, 3)).collect()
    assert [(c.chunk_id, c.text) for c in got] == [("sec_10k_AMD_2024-02-01_business_000", "a b c"), ("sec_10k_AMD_2024-02-01_business_001", "c d e"), ("sec_10k_AMD_2024-02-01_mda_002", "m n o")]
    long = "Item 8.01 " + "w " * 300
    filed = spark.createDataFrame([("amd", "8-K", "2024-02-01T23:30:00Z", "Item 2.02 Results", ["exhibit text"]), ("amd", "8-K/A", "2024-02-01T10:00:00Z", "Item 2.02", []), ("amd", "8-K", "2024-02-02T10:00:00Z", "Item 9.01 only", None), ("amd", "8-K", "2024-02-03T10:00:00Z", long, ["not added"])], "ticker string, form string, accepted string, body string, exhibits array<string>")
    chunks = P.current_report_chunks(P.current_report_records(filed)).orderBy("chunk_id").collect()
    assert [c.chunk_id for c in chunks] == ["sec_8k_AMD_2024-02-01_202_001", "sec_8k_AMD_2024-02-03_801_001"]
    assert "exhibit text" in chunks[0].text and "not added" not in chunks[1].text and chunks[0].section_name == "Item 2.02"
    both = P.as_of([P.annual_chunks(rows), P.current_report_chunks(P.current_report_records(filed))], "AMD", F.lit(dt.date(2024, 2, 1)))
    assert sorted({c.source_type for c in both.collect()}) == ["sec_10k", "sec_8k"] and both.count() == 3


def test_fallback_and_assembly(spark):
    a, b = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a")], [(1, "b"), (2, "b")]))
    assert sorted(map(tuple, P.with_fallback(a, b, ["k"]).collect())) == [(1, "a", "primary"), (2, "b", "fallback")]
    chunk = lambda m, i, s, d, t: (m, i, "X", s, dt.date(2024, 1, d), None, None, None, t, 1)
    schema = "move_id int, chunk_id string, ticker string, source_type string, publication_date date, period_end date, source_url string, section_name string, text string, token_count int"
    f1, f2 = (spark.createDataFrame(r, schema) for r in ([chunk(1, "k", "sec_10k", 1, "sectioned")], [chunk(1, "k", "sec_10k", 1, "staged"), chunk(1, "j", "sec_10k", 2, "staged")]))
    news = spark.createDataFrame([chunk(1, f"n{i}", "news", i, "") for i in (1, 2, 3)], schema)
    got = P.assemble({"news": news}, (f1, f2)).orderBy("place").collect()
    assert [c.chunk_id for c in got] == ["j", "n3", "k", "n2", "n1"] and {c.chunk_id: c.text for c in got}["k"] == "sectioned"
    articles = spark.createDataFrame([("a1", "P", 2, "second"), ("a1", "P", 1, "first")], "article_id string, ticker string, k int, text string")
    peers = spark.createDataFrame([("M", "P"), ("N", "P"), ("M", "P")], "ticker string, peer string")
    assert sorted((r.ticker, r.text) for r in P.first_pieces(articles, peers).collect()) == [("M", "first"), ("N", "first")]


def test_repair(spark):
    cites = ", ".join(f"cites_{d} array<string>" for d in P.AFFINITY)
    chunks = [("n1", "news"), ("m1", "macro"), ("p1", "peer_news"), ("t1", "earnings_transcript")]
    rows = spark.createDataFrame([(1, chunks, *[["n1"]] * 5), (2, chunks, *[["n1"]] * 4, ["m1"]), (3, [], *[["n1"]] * 5)], f"id int, chunks array<struct<chunk_id:string,source_type:string>>, {cites}")
    got = {r.id: r for r in P.repair_citations(rows).collect()}
    assert [got[1][f"cites_{d}"] for d in P.AFFINITY] == [["t1"], ["t1"], ["p1"], ["t1"], ["m1"]]
    assert not got[2].repaired and got[2].cites_demand == ["n1"] and not got[3].repaired
    # known answers of the affinity table: what each dimension takes as sources go one by one
    order = ["earnings_transcript", "news", "peer_news", "sec_10k", "sec_8k", "sector_news", "macro"]
    want = {
        "demand": ["earnings_transcript", "news", "peer_news", "sector_news", "sector_news", "sector_news", "macro"],
        "pricing": ["earnings_transcript", "sec_10k", "sec_10k", "sec_10k", "sec_8k", "sector_news", "macro"],
        "competitive": ["peer_news", "peer_news", "peer_news", "sec_10k", "sector_news", "sector_news", "macro"],
        "management_credibility": ["earnings_transcript", "sec_8k", "sec_8k", "sec_8k", "sec_8k", "sector_news", "macro"],
        "macro": ["macro", "macro", "macro", "macro", "macro", "macro", "macro"],
    }
    rows = spark.createDataFrame([(i, [(s, s) for s in order[i:]], *[["x"]] * 5) for i in range(len(order))], f"id int, chunks array<struct<chunk_id:string,source_type:string>>, {cites}")
    got = {r.id: r for r in P.repair_citations(rows).collect()}
    assert {d: [got[i][f"cites_{d}"][0] for i in range(len(order))] for d in P.AFFINITY} == want


def test_typed_records(spark):
    rows = spark.createDataFrame([("amd", "2024-01-31", "100.0", "nan", "2.5"), ("x", "soon", None, "7", "")], "ticker string, settlement_date string, shares_short string, avg_daily_volume string, days_to_cover string")
    got = P.typed(rows, "short_interest").collect()
    assert (got[0].settlement_date, got[0].shares_short, got[0].avg_daily_volume, got[0].days_to_cover, got[0].float_short_percent, got[0].problems) == (dt.date(2024, 1, 31), 100, None, 2.5, None, [])
    assert got[1].problems == ["settlement_date", "shares_short"] and got[1].avg_daily_volume == 7
    with pytest.raises(ValueError):
        P.typed(rows, "rating")
    for kind in P.RECORDS:
        names = [f.split(" ")[0] for f in P.RECORDS[kind].split(", ")]
        empty = spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
        assert P.typed(empty, kind).columns == [*names, "problems"]


def test_recent_names(spark):
    names = ["d/news_AMD_2024-02-10.parquet", "d/news_AMD_2024-01-01.parquet", "d/news_NVDA_2024-02-10.parquet", "news_AMD_x.parquet", "d_2024/news_AMD_2024-02-20.parquet"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in rows.where(P.recent(F.col("name"), "news_AMD", F.lit(DAY), 7)).collect()] == [names[0], names[4]]


def test_run_writes_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "IX", "add", "amd", dt.date(2024, 2, 1), dt.date(2024, 3, 1))], "change_id string, index_name string, action string, ticker string, announcement_date date, effective_date date")
    events, chunks = P.run(rows, "index_changes", str(tmp_path), "2024-02-14", "amd")
    assert [e.event_id for e in events.collect()] == ["c1_announcement"] and chunks.first().source_type == "index_change"
    assert dict(spark.read.parquet(f"{tmp_path}/events_AMD_2024-02-14.parquet").dtypes)["event_date"] == "string"
    lines = [json.loads(x) for f in Path(f"{tmp_path}/chunks_AMD_2024-02-14.jsonl").glob("part*") for x in f.read_text().splitlines()]
    assert [x["chunk_id"] for x in lines] == ["c1_announcement"]
    assert set(P.PIPELINES) >= {"thirteen_f", "ratings", "fda", "news", "earnings", "short_interest", "short_reports"}


def test_steps_are_isolated():
    def fails():
        raise OSError("down")

    assert P.prepare({"a": lambda: 1, "b": fails, "c": lambda: 2}) == [("a", "done", ""), ("b", "failed", "OSError: down"), ("c", "done", "")]


def test_readers_without_a_query(spark, tmp_path):
    for name, rows in (("z/chunks_A_2024-01-01", ["old"]), ("a/chunks_A_2024-02-01", ["new", "new"]), ("a/chunks_B_2024-01-01", ["b"])):
        f = tmp_path / f"{name}.jsonl"
        f.parent.mkdir(exist_ok=True)
        f.write_text("\n".join(json.dumps({"ticker": name.split("_")[1], "chunk_id": r}) for r in rows))
    got = readers.latest_snapshot(spark, f"{tmp_path}/*/chunks_*.jsonl")
    assert sorted(r.chunk_id for r in got.collect()) == ["b", "new"]
    # only chosen files are opened, and of equal ids the first line counts
    assert sorted(f.rsplit("/", 1)[1] for f in got.inputFiles()) == ["chunks_A_2024-02-01.jsonl", "chunks_B_2024-01-01.jsonl"]
    assert [r.chunk_id for r in readers.latest_snapshot(spark, f"{tmp_path}/*/chunks_*.jsonl", "2024-01-15").orderBy("chunk_id").collect()] == ["b", "old"]
    (tmp_path / "a" / "twice_C_2024-01-01.jsonl").write_text("\n".join(json.dumps({"ticker": "C", "chunk_id": "same", "n": n}) for n in (5, 1, 9)))
    assert readers.latest_snapshot(spark, f"{tmp_path}/*/twice_*.jsonl").first().n == 5
    with pytest.raises(Exception):  # noqa: B017 - by Spark's version a missing path or a missing snapshot
        readers.latest_snapshot(spark, f"{tmp_path}/*/none_*.jsonl")
    (tmp_path / "c").mkdir()
    for n, t in (("AMD_2024_expected", "AMD"), ("X_TEMPLATE_expected", "X")):
        (tmp_path / "c" / f"{n}.json").write_text(json.dumps({"ticker": t, "move_date": "2024-01-01"}))
    assert [r.ticker for r in readers.read_cases(spark, f"{tmp_path}/c/*.json").collect()] == ["AMD"]
    types, first = readers.probe(spark.range(9), 2)
    assert types == [("id", "bigint")] and len(first) == 2
    sinks.write_parquet(P.stored(spark.createDataFrame([(DAY, 1)], "d date, n int")), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").first().d == "2024-02-14"
    old, new = (spark.createDataFrame(r, "ticker string, n int") for r in ([("A", 1), ("B", 1)], [("B", 2)]))
    assert sorted(map(tuple, sinks.merge_index(old, new).collect())) == [("A", 1), ("B", 2)]


def test_web_revisions_and_macro(spark):
    rows = spark.createDataFrame([("A", dt.date(2024, 1, 15), 1, 0), ("A", dt.date(2024, 1, 15), 2, 1), ("A", dt.date(2024, 2, 13), 3, 2)], "ticker string, settlement_date date, shares_short int, place long")
    assert [r.shares_short for r in web.short_interest(rows, F.lit(DAY)).collect()] == [2]
    part = lambda *r: spark.createDataFrame(r, "date date, section string, title string, text string")
    got = web.macro(part((DAY, "policy", "b", ""), (DAY, "policy", "a", "")), part((dt.date(2024, 3, 1), "shock", "c", "")), F.lit(DAY)).collect()
    assert sorted((r.title, r.idx) for r in got) == [("a", 1), ("b", 2)]


def test_command_line(spark, capsys, tmp_path):
    assert cli.main(["list"]) == 0 and "F05_significant_moves" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "--data", D], spark) == 2 and cli.main(["report", "--data", D, "--strategy", "x"], spark) == 2
    assert cli.main(["run", "E20_first_dates", "--data", D, "--out", str(tmp_path / "o")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
    capsys.readouterr()
    assert cli.main(["report", "--data", D, "--json", str(tmp_path / "r.json")], spark) == 0
    text = capsys.readouterr().out
    assert "struct_fundamental_split (" in text and " takes place " in text and "excess returns over 5 days" in text and "| position | label |" in text
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["excess"] and [r["position"] for r in report["table"]] == [1, 2, 3, 4, 5] and len(report["beats"]) + len(report["loses_to"]) == 4
    assert report["table"][report["structured_rank"] - 1]["is_structured"] and report["verdict"] in text
    assert cli.main(["report", "--data", D, "--plain"], spark) == 0
    assert capsys.readouterr().out.startswith("# fundamental_split against the baselines\n\nreturns over 5 days")


def test_calls_are_retried_and_completed():
    waits, calls = [], []

    def flaky(request):
        calls.append(request)
        if len(calls) < 3:
            raise provider.Transient(delay=None if len(calls) == 1 else 500)
        return {"move_character": "mixed"} if "nudge" not in request else {d: {} for d in provider.DIMENSIONS} | {"move_character": "mixed", "confidence": 1.0}

    got = provider.complete(flaky, {"event_id": 1}, sleep=waits.append)
    assert waits == [1.0, provider.MAX_DELAY] and not provider.missing(got) and "demand" in calls[-1]["nudge"]
    with pytest.raises(provider.Transient):
        provider.call(lambda r: (_ for _ in ()).throw(provider.Transient()), {}, attempts=2, sleep=waits.append)
    part = {"weight": 0.2, "rationale": "r", "cited": ["a"]}
    good = {d: part for d in provider.DIMENSIONS} | {"confidence": 0.5}
    request = {"ticker": "A", "move_date": DAY, "chunk_ids": ["a"]}
    assert provider.check(good, request) == []
    bad = good | {"demand": {"weight": 0.9, "rationale": " ", "cited": ["z"]}, "confidence": 2, "ticker": "B"}
    assert len(provider.check(bad, request)) == 5 and "; " in str(provider.InvalidAttribution(["a", "b"]))


def test_sentences_are_trimmed_of_spaces_only(spark):
    from eventloom.functions import text

    rows = spark.createDataFrame([([" a0 ", " ", "1b1", "  ", "4"],)], "s array<string>")
    assert rows.select(text.join_sentences(F.col("s")).alias("t")).first().t == "a0 1b1 4"


def test_reports_of_all_publishers(spark):
    a = """<a href="/2024/03/05/x/">Acme Corp: a long story</a> <a href="/2024/03/05/y/">Again on $ACM today</a> <a href="/undated/">$ACM without a date</a> <a href="/2024/05/05/z/">$ACM from the future</a>"""
    b = """<a href='/2024/02/01/q/'>Nobody knows this one</a><a href="/2024/02/02/r/">Tale of $ACM</a><a href="/2024/02/03/s/">$ACM</a>"""
    pages = spark.createDataFrame([("Citron Research", 0, a), ("Scorpion Capital", 1, b), ("Kerrisdale Capital", 2, None), ("Muddy Waters Research", 3, "<html>")], "publisher string, place int, html string")
    names = spark.createDataFrame([("ACME CORP", "ACM")], "company string, ticker string")
    as_of = F.lit("2024-04-01").cast("date")
    got = {r.chunk_id: r for r in web.all_reports(pages, as_of, names).collect()}
    assert set(got) == {"short_report_citron_ACM_2024-03-05", "short_report_scorpion_ACM_2024-02-02"}
    first = got["short_report_citron_ACM_2024-03-05"]
    assert first.title == "Acme Corp: a long story" and first.token_count == 5 and first.source_url == "/2024/03/05/x/"
    # without names the title that names no tag goes, and the next one of that day stays
    assert {r.title for r in web.all_reports(pages, as_of).collect()} == {"Again on $ACM today", "Tale of $ACM"}
    with pytest.raises(Exception, match="unknown publisher: Nobody"):
        web.all_reports(pages.withColumn("publisher", F.lit("Nobody")), as_of).collect()


def test_payloads(spark):
    from eventloom.operators import payload

    rows = spark.createDataFrame([("a", "x" * 600), ("b", "é" * 601), ("c", None), ("d", "")], "chunk_id string, text string").withColumns({"source_type": F.lit("news"), "publication_date": F.lit("2024-01-02")})
    got = {r.chunk.chunk_id: r.chunk for r in payload.chunk_payload(rows).collect()}
    assert [got[k].text for k in "abcd"] == ["x" * 600, "é" * 600 + "…", None, ""]
    assert got["a"].publication_date == "2024-01-02" and got["a"].section_name is None
    cited = F.array(F.struct(F.lit("a").alias("chunk_id"), F.lit("q").alias("quote"), F.lit("r").alias("reasoning"), F.lit(1).alias("more")))
    full = spark.range(1).select(payload.dimension_payload(F.lit(0.123456), F.lit("positive"), F.lit("why"), cited, F.array(F.lit("a"))).alias("d")).first().d
    assert full.asDict(True) == {"cited_evidence": [{"chunk_id": "a", "quote": "q", "reasoning": "r"}], "weight": 0.1235, "direction": "positive", "rationale": "why", "evidence_chunk_ids": ["a"]}
    empty = F.lit(None).cast("array<struct<chunk_id:string,quote:string,reasoning:string>>")
    bare = spark.range(1).select(payload.dimension_payload(F.lit(None), F.lit(None).cast("string"), F.lit(None).cast("string"), empty, F.lit(None).cast("array<string>")).alias("d")).first().d
    assert bare.cited_evidence == [] and bare.evidence_chunk_ids == [] and bare.weight is None
    assert payload.ticker_order(["A", "B", "C"]) == (["A", "B", "C"], [])
    assert payload.ticker_order(["A", "B", "C"], " c, x,a ,") == (["C", "A"], ["X"])


def test_evaluation_modes_and_gates(spark, capsys, tmp_path):
    assert cli.main(["evaluate", "calibration", "--data", D, "--json", str(tmp_path / "c.json")], spark) == 0
    found = json.loads((tmp_path / "c.json").read_text())
    assert found["mode"] == "calibration" and found["failed"] == sum(not r["passed"] for r in found["rows"])
    assert cli.main(["evaluate", "calibration", "--data", D, "--gate"], spark) == int(found["failed"] > 0)
    assert cli.main(["evaluate", "accuracy", "--data", D, "--gate"], spark) == 1
    capsys.readouterr()
    assert cli.main(["evaluate", "matrix", "--data", D, "--gate"], spark) == 0
    bundles = [json.loads(x)["bundle"] for x in capsys.readouterr().out.splitlines()]
    assert len(bundles) == 7
    assert cli.main(["evaluate", "matrix", "--data", D, "--bundles", bundles[2]], spark) == 0
    assert [json.loads(x)["rung"] for x in capsys.readouterr().out.splitlines()] == [2]
    assert cli.main(["evaluate", "matrix", "--data", D, "--bundles", "none_such"], spark) == 2
