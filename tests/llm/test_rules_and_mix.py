from __future__ import annotations

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom.llm import mixing, quality_rules


def statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))


REPEATS = ["a b c d e a b c d e", "x " * 12, "l1 l2\nl1 l2\n \nl1 l2", "\n\n", " \t\r\n" * 3000, "é* ü% #\n<b>|&$", "p q r s t u p q r s t u v p q r s t"]


def test_statistics(spark, small, odd):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(REPEATS)], "doc_id long, text string")
    for docs in (small, odd, more):
        got = quality_rules.with_statistics(docs.select("doc_id", "text")).select("doc_id", "s.*").collect()
        want = sorted(((r.doc_id, *statistics(r.text)) for r in docs.collect()), key=str)
        assert sorted(((r.doc_id, *(r[c] for c in quality_rules.BASE)) for r in got), key=str) == want


def test_learned_list_equals_brute_force(small, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = quality_rules.train(docs, labels)
    assert rules
    judged = {r.doc_id: r for r in quality_rules.judge(docs, rules).collect()}
    rows = {r.doc_id: r.s for r in quality_rules.with_statistics(docs).collect()}
    for i, r in judged.items():
        s = rows[i].asDict()
        failed = s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]
        first = next((k for k, rule in enumerate(rules, 1) if all(c.holds(s) for c in rule)), 0)
        assert r.base_failed == failed and r.kept == (not failed and not first)
    good = [x.doc_id for x in labels.where("quality = 1").collect() if not judged[x.doc_id].base_failed]
    assert sum(judged[i].kept for i in good) >= 0.99 * len(good)
    bad = [x.doc_id for x in labels.where("quality = 0").collect()]
    assert sum(not judged[i].kept for i in bad) >= 0.8 * len(bad)


def test_no_labels_and_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.train(odd, none) == []
    got = quality_rules.apply_rules(odd, none).collect()
    assert len(got) == odd.count()
    assert all(r.kept == (not r.base_failed) for r in got)
    kept = quality_rules.keep_good(odd, [])
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.apply_rules(odd.limit(0), none).collect() == []


def test_rules_have_only_sql(odd):
    plan = quality_rules.judge(odd, [])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_mix_equals_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = mixing.mix(spark.read.parquet(path), mixing.WEIGHTS, 1.5, 3).select("doc_id", "copy", "shuffle_key").collect()
    duckdb.sql(f"create or replace view documents as select * from '{path}'")
    want = duckdb.sql(f"select doc_id, copy, shuffle_key from ({mixing.mix_sql(mixing.WEIGHTS, 1.5, 3)})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_mix_meets_weights(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("twelve chars").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mix(docs, {"a": 0.5, "b": 0.1}, 2.0).groupBy("source").count().collect()}
    for s, share in (("a", 0.5), ("b", 0.1), (None, 0.4)):
        assert abs(got[s] / 120_000 - share) < 0.01
    mixed = mixing.mix(docs, {"a": 0.5, "b": 0.1}, 2.0)
    assert mixed.count() == mixing.mix(docs, {"a": 0.5, "b": 0.1}, 2.0).count()
    once = [r.n for r in mixed.where("source = 'b'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    drawn = [0] * (20_000 - len(once)) + once
    mean = sum(drawn) / len(drawn)
    assert abs(sum((x - mean) ** 2 for x in drawn) / len(drawn) - mean) < 0.05 * max(mean, 1)


def test_thresholds():
    assert mixing.thresholds(0.0) == [1.0]
    assert math.isclose(mixing.thresholds(2.0)[1], math.exp(-2) * 3)
    with pytest.raises(ValueError):
        mixing.thresholds(100.0)
    with pytest.raises(ValueError):
        mixing.rates({"a": 1}, {"a": 2.0})


def test_mix_odd_rows(spark, odd):
    got = mixing.mix(odd, {"src0": 0.5}, 1.0)
    assert set(odd.columns) <= set(got.columns)
    per = {}
    for r in got.collect():
        per.setdefault((r.doc_id, r.text), []).append(r.copy)
    for copies in per.values():
        assert sorted(set(copies)) == list(range(1, max(copies) + 1))
    assert mixing.mix(odd.limit(0), {"src0": 0.5}).collect() == []
    clash = odd.withColumn("copy", F.lit(7)).withColumn("shuffle_key", F.lit("x"))
    assert mixing.mix(clash, {"src0": 0.5}).count() == got.count()


def test_quantiles_of_any_rate():
    for rate in (42.0, 60.0, 64.0, 64.5, 100.0, 5000.0):
        low, cs = mixing.quantiles(rate)
        exact, at = 0.0, {}
        for k in range(low + len(cs)):
            exact += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            at[k] = exact
        assert all(math.isclose(c, at[low + i], abs_tol=1e-9) for i, c in enumerate(cs)) and cs[-1] > 1 - 1e-12
        assert low == 0 or at[low - 1] < 1e-15


def test_mix_repeats_a_tiny_source(spark):
    docs = spark.createDataFrame([(1, "abcde", "a", 5), (2, "xy", "b", 2), (3, "z" * 1_000_000, "c", 10**6), (4, "", "d", 0)], "doc_id long, text string, source string, n_chars long")
    mixed = mixing.mix(docs, {"a": 0.1, "b": 0.0001}, 1.0).select("doc_id", "copy", "shuffle_key").collect()
    copies = {i: sorted(r.copy for r in mixed if r.doc_id == i) for i in (1, 2, 3, 4)}
    for i, rate in ((1, 20_000), (2, 50)):
        assert abs(len(copies[i]) - rate) < 6 * math.sqrt(rate) and copies[i] == list(range(1, len(copies[i]) + 1))
    assert len(copies[3]) < 10 and copies[4] == [] and len({r.shuffle_key for r in mixed}) == len(mixed)


def test_mix_of_many_sources(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("twelve chars").alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    got = mixing.mix(docs, {"s7": 0.001}).groupBy("source").count().collect()
    assert abs(sum(r["count"] for r in got) - 20_000) < 1000 and 5 < {r["source"]: r["count"] for r in got}.get("s7", 0) < 50
    many = {f"s{i}": 1 / 10_000 for i in range(300)}
    table = {(r.doc_id, r.copy) for r in mixing.mix(docs, many).collect()}
    assert {(r.doc_id, r.copy) for r in mixing.mix(docs.where("doc_id < 300"), {}).collect()} and len(table) > 10_000
    kept = mixing.MAX_LITERAL
    try:
        mixing.MAX_LITERAL = 1000
        assert {(r.doc_id, r.copy) for r in mixing.mix(docs, many).collect()} == table
    finally:
        mixing.MAX_LITERAL = kept


def test_mix_of_absent_sources(spark):
    assert mixing.rates({"a": 10, "b": 30}, {"a": 0.4, "src0": 0.5}, 2.0) == {"a": pytest.approx(4.0 * 0.4 / 0.5 * 2), "b": pytest.approx(4 / 3 * 0.1 / 0.5 * 2)}
    sizes = {"a": 10, "b": 30, None: 0}
    for weights in ({"src0": 0.5, "a": 0.3, "b": 0.1}, {"a": 1e-6, "b": 1e-6}, {"a": 0.25, "b": 0.75}):
        got = mixing.rates(sizes, weights, 1.0)
        assert math.isclose(sum(got[s] * n for s, n in sizes.items()), 40)
    assert mixing.rates({"a": 0, None: 0}, {"a": 0.5}) == {"a": 0.0, None: 0.0}


def test_mix_with_absent_sources_equals_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 7} " * (i % 11), ("a", "b", None)[i % 3], 0) for i in range(400)], "doc_id long, text string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "d"))
    duckdb.sql(f"create or replace view documents as select * from '{tmp_path}/d/*.parquet'")
    for weights in ({"src0": 0.5, "a": 0.3}, {"a": 0.3, "b": 0.7}, {"zz": 1.0}):
        got = mixing.mix(docs, weights, 3.0, 5).select("doc_id", "copy", "shuffle_key").collect()
        assert sorted(map(tuple, got)) == sorted(duckdb.sql(f"select doc_id, copy, shuffle_key from ({mixing.mix_sql(weights, 3.0, 5)})").fetchall())


def test_rows_without_id_are_spread(spark):
    docs = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("a").alias("source"))
    keys = [r.shuffle_key for r in mixing.mix(docs, {}, 1.0).collect()]
    assert len(keys) > 400 and len(set(keys)) == len(keys)


def test_repeated_and_differing_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.train(docs, labels)
    assert rules == quality_rules.train(docs.unionAll(docs), labels.unionAll(labels))
    against = labels.select("doc_id", (1 - F.col("quality")).alias("quality"), "toxic")
    assert quality_rules.train(docs, labels.unionByName(against)) == []


def test_features_equal_brute_force(spark, small):
    rows = {r.doc_id: r.s.asDict() for r in quality_rules.with_statistics(small).collect()}
    for r in small.collect():
        t, s = r.text or "", rows[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, chars, symbols, dup, repeat = statistics(t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = {
            "mean_word": chars / n if n else 0.0,
            "symbol_share": symbols / chars if chars else 0.0,
            "dup_line_share": dup / len(lines) if lines else 0.0,
            "repeat_share": repeat / n if n else 0.0,
            "distinct_share": len(set(w)) / n if n else 0.0,
            "upper_share": sum(c.isupper() and c.isalpha() for c in t) / chars if chars else 0.0,
            "bang_share": t.count("!") / n if n else 0.0,
        }
        assert all(math.isclose(s[k], v, abs_tol=1e-12) for k, v in want.items()), (r.doc_id, s, want)
