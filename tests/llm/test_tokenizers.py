from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer, models, pre_tokenizers

from eventloom.llm import byte_bpe, common, sentencepiece_codec, token_counts, token_files

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", "the", "  ", " ", " ", "   ", "\n", "é", "€", "漢", "字", "😀", "▁", "ing", "er", "\x00", "<s>", "<0x41>", "ñ", ".", "!!", "\t", "ß", " ", " ", "'s", "12", "\x1c", "\r\n", "\x85"]


def mixed(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_prefix_table_equals_library():
    c, lib = sentencepiece_codec.Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in [*mixed(1, 4000), " " * 999 + "x", "abcdefghij" * 5000, ""]:
        assert c.encode(t) == lib.encode(t), t
        assert c.decode(c.encode(t)) == lib.decode(lib.encode(t))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_prefix_table_any_text(t):
    c = sentencepiece_codec.codec(PIECES)
    assert c.encode(t) == c.library.encode(t)


def test_full_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MAX_WORDS", 3)
    monkeypatch.setattr(sentencepiece_codec, "MAX_PAIRS", 3)
    monkeypatch.setattr(byte_bpe, "MAX_UNITS", 3)
    c, e = sentencepiece_codec.Codec(PIECES), byte_bpe.Encoder(BYTES)
    for t in mixed(5, 300):
        assert c.encode(t) == c.library.encode(t)
        assert e.ids(t).tolist() == e.library.encode(t, add_special_tokens=False).ids


def test_op1_odd_rows(odd):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_codec.digest_documents(odd, PIECES).collect()
    want = []
    for r in odd.collect():
        ids = lib.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    again = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(odd, PIECES), PIECES).collect()
    assert sorted(x.text for x in again) == sorted(lib.decode(lib.encode(r.text or "")) for r in odd.collect())


def test_units_equal_library():
    e, f, lib = byte_bpe.Encoder(BYTES), byte_bpe.Encoder(BYTES, offsets=True), Tokenizer.from_file(BYTES)
    for t in [*mixed(2, 4000), "<|endoftext|> a", "plain words, and more words.\nNext line here", ""]:
        want = lib.encode(t, add_special_tokens=False)
        assert e.ids(t).tolist() == want.ids, t
        ids, starts, ends = f.spans(t)
        assert ids.tolist() == want.ids
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60), st.text(alphabet="ab é²½ß·\xa1\u024f \n'st re1.,!\r\t", max_size=40))
def test_units_any_text(a, b):
    e, f = byte_bpe.encoder(BYTES), byte_bpe.encoder(BYTES, offsets=True)
    for t in (a, b):
        want = e.library.encode(t, add_special_tokens=False)
        assert e.ids(t).tolist() == want.ids
        _, starts, ends = f.spans(t)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets


def test_rules_of_crossing_tokens():
    starts, ends, bounds = np.array([0, 3, 6]), np.array([3, 7, 9]), np.array([0, 5])
    assert token_counts.attribute(starts, ends, bounds, "first").tolist() == [0, 0, 1]
    assert token_counts.attribute(starts, ends, bounds, "last").tolist() == [0, 1, 1]
    assert token_counts.attribute(starts, ends, bounds, "most").tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        token_counts.attribute(starts, ends, bounds, "none")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts(small, odd, rule):
    lib = Tokenizer.from_file(BYTES)
    for docs in (small.limit(60), odd):
        by = {}
        for r in docs.collect():
            by.setdefault(r.doc_id, []).append(r.text or "")
        for g in token_counts.count_sections(docs, BYTES, rule).collect():
            found = []
            for t in by[g.doc_id]:
                lines, counts = [0], None
                lines += [i + 1 for i, c in enumerate(t) if c == "\n"]
                counts = [0] * len(lines)
                for a, b in lib.encode(t, add_special_tokens=False).offsets:
                    held = [sum(lines[k] <= i and (k + 1 == len(lines) or i < lines[k + 1]) for i in range(a, b)) for k in range(len(lines))]
                    inside = [k for k, n in enumerate(held) if n]
                    counts[inside[0] if rule == "first" else inside[-1] if rule == "last" else held.index(max(held))] += 1
                found.append(counts)
            assert g.section_tokens in found
            assert g.n_tokens == sum(g.section_tokens) and g.n_sections == len(g.section_tokens)


def test_field_counts(odd):
    got = token_counts.count_fields(odd, "doc_id", ["source", "text"], BYTES).collect()
    assert len(got) == odd.count()
    lib = Tokenizer.from_file(BYTES)
    for g, r in zip(got, odd.collect(), strict=True):
        assert g.n_tokens == g.source_tokens + g.text_tokens == len(lib.encode(f"{r.source or ''}\n{r.text or ''}", add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**32 - 1), st.sampled_from([255, 256, 65535, 65536, 2**24 - 1, 2**24])), max_size=50))
def test_pack_round_trip(values):
    control, data = token_files.pack(np.array(values, np.uint32))
    assert len(control) == (len(values) + 3) // 4
    assert token_files.unpack(control, data, len(values)).tolist() == values


def want_files(docs):
    lib, at, out = Tokenizer.from_file(BYTES), 0, []
    rows = [(r.doc_id, lib.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect()]
    for key, ids in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=lambda x: x[1])


def test_files_round_trip(spark, small, odd):
    for docs in (small, odd, odd.limit(0)):
        got = token_files.round_trip(docs, BYTES).collect()
        assert sorted(map(tuple, got), key=lambda x: x[1]) == want_files(docs)


def test_many_blocks(spark, small, tmp_path):
    token_files.write_files(small, BYTES, str(tmp_path / "t"), block_ids=1000)
    assert spark.read.parquet(str(tmp_path / "t/blocks")).count() > 40
    got = token_files.read_files(spark, str(tmp_path / "t")).drop("ids").collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want_files(small)


def test_many_rows_without_id_spread_over_shards(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(None if i % 4 else i, f"text {i} " * 9) for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1000)
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # or so little data would be one shard
    spark.conf.set(name, False)
    try:
        token_files.write_files(docs, BYTES, str(tmp_path / "t"))
    finally:
        spark.conf.unset(name)
    blocks = spark.read.parquet(str(tmp_path / "t/blocks")).collect()
    assert len({b.shard for b in blocks if None in b.doc_ids}) > 1
    got = token_files.read_files(spark, str(tmp_path / "t")).drop("ids").collect()
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None] * 300 + list(range(0, 400, 4))
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(400)]


def test_field_names_that_clash(spark):
    rows = spark.createDataFrame([(1, "a", "b")], "`my key` int, n string, t string")
    with pytest.raises(ValueError):
        token_counts.count_fields(rows, "my key", ["n", "t"], BYTES)
    assert token_counts.count_fields(rows, "my key", ["t"], BYTES).dtypes == [("my key", "int"), ("n_tokens", "bigint"), ("t_tokens", "bigint")]


def test_words_of_any_length_and_mark():
    e, lib = byte_bpe.Encoder(BYTES), Tokenizer.from_file(BYTES)
    for n in (1, 5, 46, 47, 48, 49, 63, 64, 65, 300):
        for mark in ("", ",", "!!", ".\n", "'s"):
            t = f"a {'q' * n}{mark} {'zx' * n}{mark} b"
            assert e.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids
            assert e.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_many_texts_at_once_look_up_distinct_pieces(monkeypatch):
    asked = []
    get_all = byte_bpe.Table.get_all
    monkeypatch.setattr(byte_bpe.Table, "get_all", lambda self, keys: asked.extend(keys) or get_all(self, keys))
    e = byte_bpe.Encoder(BYTES)
    ids, counts = e.encode(pa.array(["Start of words, of many words." + " the same words again and again" * 20] * 200))
    assert len(asked) == len(set(asked)) < 20
    want = e.library.encode("Start of words, of many words." + " the same words again and again" * 20, add_special_tokens=False).ids
    assert counts.tolist() == [len(want)] * 200 and ids.tolist() == want * 200


@pytest.mark.parametrize("call", [byte_bpe.MAX_CALL, 7])
def test_texts_in_a_row_equal_library(monkeypatch, call):
    monkeypatch.setattr(byte_bpe, "MAX_CALL", call)
    lib, e = Tokenizer.from_file(BYTES), byte_bpe.Encoder(BYTES, offsets=True)
    every = ["", *mixed(7, 600), "привет, мир\nи все 漢字 漢字 too", "", "<|endoftext|> a", "漢字" * 99, " lead", "trail ", "a\n b", ""]
    ids, starts, ends, counts = e.encode_spans(pa.array(every))
    want = [lib.encode(t, add_special_tokens=False) for t in every]
    before = np.r_[0, np.cumsum([len(t) for t in every])]
    assert counts.tolist() == [len(w.ids) for w in want] and ids.tolist() == [i for w in want for i in w.ids]
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(a + b, z + b) for w, b in zip(want, before[:-1].tolist(), strict=True) for a, z in w.offsets]


def test_special_tokens_of_any_letters(tmp_path):
    lib = Tokenizer.from_file(BYTES)
    lib.add_special_tokens(["<｜end▁of_text｜>", "[a.b]"])
    for more in ([], ["two words"]):
        lib.add_special_tokens(more)
        lib.save(str(tmp_path / "t.json"))
        e = byte_bpe.Encoder(str(tmp_path / "t.json"), offsets=True)
        for t in ["a b<｜end▁of_text｜>c d", "x [a.b] y", "x [aab] y", "of two words here", "two of words two"]:
            want = lib.encode(t, add_special_tokens=False)
            assert e.ids(t).tolist() == want.ids
            assert list(zip(*(x.tolist() for x in e.spans(t)[1:]), strict=True)) == want.offsets


def test_runs_go_over_the_bounds_of_batches(spark):
    docs = spark.createDataFrame([(i, "x" * (5000 if i == 9 else i % 7)) for i in range(300)], "i long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 10)
    try:
        count = lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.column("i").to_pylist()], pa.list_(pa.int64()))], ["n", "i"])
        got = common.map_runs(docs, count, "n long, i array<long>", 2000).collect()
    finally:
        spark.conf.set(name, before)
    assert [x for r in got for x in r.i] == list(range(300))
    assert len(got) < 12 and max(r.n for r in got) > 50
    assert any(r.i == [9] for r in got)


def test_ids_of_both_widths_are_counted(spark, small):
    docs = small.limit(20)
    both = token_files.encode_ids(docs, BYTES).unionAll(token_files.encode_ids(docs, BYTES, end_id=70_000))
    lib, want = Tokenizer.from_file(BYTES), {}
    for r in docs.collect():
        for i in [*lib.encode(r.text or "", add_special_tokens=False).ids * 2, 0, 70_000]:
            want[i] = want.get(i, 0) + 1
    assert {r.id: r.n for r in token_files.count_ids(both).collect()} == want


def run_of_sections(docs, rule, monkeypatch):
    made = []
    with monkeypatch.context() as m:
        m.setattr(token_counts, "map_runs", lambda df, fn, schema, size: made.append(fn))
        token_counts.count_sections(docs, BYTES, rule)
    return lambda every: made[0](pa.RecordBatch.from_arrays([pa.array(range(len(every))), pa.array(every, pa.string())], ["doc_id", "text"])).drop_columns(["doc_id"]).to_pylist()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_of_texts_in_a_row(small, monkeypatch, rule):
    run = run_of_sections(small, rule, monkeypatch)
    every = ["a line\n", "", None, "\n", "b,\n\nc\n", "", "\n\n  \n", "é漢\n😀 x!!\n!!", None, *mixed(9, 300), ""]
    got = run(every)
    assert got == [row for t in every for row in run([t])]
    assert [r["n_sections"] for r in got] == [(t or "").count("\n") + 1 for t in every]
    assert any(r["n_crossing"] for r in got)


def test_sections_of_many_texts_look_up_distinct_pieces(small, monkeypatch):
    asked = []
    get_all = byte_bpe.Table.get_all
    monkeypatch.setattr(byte_bpe.Table, "get_all", lambda self, keys: asked.extend(keys) or get_all(self, keys))
    got = run_of_sections(small, "first", monkeypatch)(["One line of words,\nand a second line of words"] * 100)
    assert len(asked) == len(set(asked)) < 20
    assert got == [got[0]] * 100 and got[0]["n_sections"] == 2


def test_tokens_that_do_not_hold_all_bytes(tmp_path):
    few = Tokenizer(models.BPE(vocab={"Ġ": 0, "a": 1, "b": 2, "Ġa": 3}, merges=[("Ġ", "a")]))
    few.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    wide = Tokenizer.from_file(BYTES)
    wide.add_special_tokens([AddedToken("<sp>", lstrip=True)])
    for lib in (few, wide):
        lib.save(str(tmp_path / "t.json"))
        e = byte_bpe.Encoder(str(tmp_path / "t.json"), offsets=True)
        every = ["a b a", "aé 漢b ab", "xx 漢 a", "a   <sp> b", "", "b"]
        ids, starts, ends, counts = e.encode_spans(pa.array(every))
        want = [lib.encode(t, add_special_tokens=False) for t in every]
        before = np.r_[0, np.cumsum([len(t) for t in every])].tolist()
        assert counts.tolist() == [len(w.ids) for w in want] and ids.tolist() == [i for w in want for i in w.ids]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(a + b, z + b) for w, b in zip(want, before, strict=False) for a, z in w.offsets]
