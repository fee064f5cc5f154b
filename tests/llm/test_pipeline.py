from __future__ import annotations

import corpus_pipeline
from eventloom.llm import jaccard_join, mixing, quality_rules, secrets

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{D}/labels.parquet")
    good = stage[names[0]](spark, docs, D)
    judged = {r.doc_id for r in quality_rules.judge(docs, quality_rules.train(docs, labels)).where("kept").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == judged
    one = stage[names[1]](spark, good, D)
    classes = {r.class_id for r in jaccard_join.join_similar(good).collect()}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(classes)
    masked = stage[names[2]](spark, one, D)
    before = {r.doc_id: r.text for r in one.collect()}
    assert {r.doc_id: r.text for r in masked.collect()} == {k: secrets.redact(t) for k, t in before.items()}
    mixed = stage[names[3]](spark, masked, D)
    assert mixed.columns == docs.columns
    assert mixed.count() == mixing.mix(masked, mixing.WEIGHTS, 1.0, 1).count()


def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


WORDS = "the river ran past old mills where people had once made paper and cloth for towns further down beside its mouth".split()


def text_of(i, n=40):
    return " ".join(f"{WORDS[(i + k) % len(WORDS)]}{i}x{k}" for k in range(n))


def put(spark, folder, rows, schema, labels=()):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_on_odd_documents(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, near copies, secrets, and columns named as the operators name theirs."""
    good = [(i, text_of(i), "en", f"src{i % 5}", 1, "a", i, None) for i in range(20)]
    copy = (50, text_of(3) + " end", None, None, None, None, None, "z")
    secret = (51, text_of(30) + " password=Zk4Qm8Tx1Vb6Rn3W", "en", "src0", 1, "b", 1, "q")
    long = (52, " ".join(f"w{k}x{k * k}" for k in range(30_000)), "en", "src1", 1, "b", 1, "q")
    nameless = (None, text_of(40), "en", None, 1, "c", None, None)
    bad = [(60, None, None, None, None, None, None, None), (61, "", "en", "src0", 0, "", 0, ""), (62, "too short", "en", "src0", 9, "", 0, ""), (63, "same five words again and " * 50, "en", "src0", 9, "", 0, "")]
    rows = [*good, good[4], good[4], copy, secret, long, nameless, *bad]
    d = put(spark, tmp_path, rows, PLAIN + ", path string, row long, node string", [(1, None, None), (None, 1, 0), (2, 1, 0), (2, 0, 1), (999, 0, 0)])
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = docs.collect()
    ids = lambda name: sorted((r.doc_id for r in kept[name]), key=str)
    every = [r[0] for r in [*good, good[4], good[4], copy, secret, long, nameless]]
    assert ids("quality rules") == sorted(every, key=str)
    assert ids("n-gram Jaccard join") == sorted([*range(20), 51, 52, None], key=str)
    masked = {r.doc_id: r for r in kept["secret scans"]}
    assert "Zk4Qm8" not in masked[51].text and masked[51].n_chars == len(masked[51].text) and masked[7].text == text_of(7) and masked[52].text == long[1]
    mixed = kept["source mix"]
    assert {r.doc_id for r in mixed} <= set(masked) and all(r.text == masked[r.doc_id].text and r.path == masked[r.doc_id].path for r in mixed)
    out = corpus_pipeline.run(spark, d).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in mixed)
    assert all(r.n_tokens > 0 for r in out)


def test_run_on_no_documents_and_no_labels(spark, tmp_path):
    assert corpus_pipeline.run(spark, put(spark, tmp_path / "none", [], PLAIN)).count() == 0
    rows = [(i, None if i % 2 else "", None, None, None) for i in range(6)]
    assert corpus_pipeline.run(spark, put(spark, tmp_path / "empty", rows, PLAIN)).count() == 0
    assert corpus_pipeline.run(spark, put(spark, tmp_path / "one", [(1, text_of(1), "en", "src0", 1)], PLAIN)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
