from __future__ import annotations

import hashlib

import pytest

from eventloom.llm import fingerprints as fp

from .test_jaccard_join import brute, got


def brute_jaccard(a, b):
    a, b = ({tuple(w[max(0, i - 4) : i + 1]) for i in range(len(w))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b) if a | b else 1.0


def want(rows):
    ordered = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    out = []
    for i, (key, t) in enumerate(ordered):
        follows = ordered[(i + 1) % len(ordered)][1]
        e = fp.edited(t, follows)
        sig = [fp.signature(fp.shingles(x)) for x in (t, e, follows)]
        bands = [sum((sig[0][4 * k : 4 * k + 4] == s[4 * k : 4 * k + 4]).all() for k in range(16)) for s in sig[1:]]
        checked = [brute_jaccard(t, x) if n else None for x, n in zip((e, follows), bands, strict=True)]
        out.append((key, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.fingerprint(sig[0]), fp.fingerprint(sig[1]), fp.likeness(sig[0], sig[1]), fp.likeness(sig[0], sig[2]), *bands, *checked))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 7, 90])
def test_compare_edited(small, odd, parts):
    for docs in (small, odd, odd.limit(1)):
        assert sorted(map(tuple, fp.compare_edited(docs, parts).collect()), key=str) == want(docs.collect())


def test_empty(odd):
    assert fp.compare_edited(odd.limit(0)).collect() == []


def test_signature_estimates_jaccard():
    words = [f"w{i}" for i in range(600)]
    a, b = fp.shingles(" ".join(words)), fp.shingles(" ".join(words[:500] + ["x"] * 100))
    assert abs(fp.likeness(fp.signature(a), fp.signature(b)) - fp.jaccard(a, b)) < 0.2
    assert fp.likeness(fp.signature(a), fp.signature(a)) == 1.0
    assert (fp.signature(fp.shingles("")) == 0xFFFFFFFF).all()


def test_near_duplicates(small, odd):
    for docs in (small, odd):
        assert got(fp.near_duplicates(docs)) == brute(docs.collect())


def test_near_duplicates_of_nothing_and_of_lower_thresholds(odd):
    assert fp.near_duplicates(odd.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fp.near_duplicates(odd, 0.5)


def test_bands_find_pairs_at_the_threshold():
    found = 0
    for i in range(300):
        w = [f"w{i}x{k}" for k in range(90)]
        a, b = fp.described(" ".join(w)), fp.described(" ".join([*w[:80], *(f"v{i}x{k}" for k in range(10))]))
        assert abs(fp.jaccard(a[0], b[0]) - 0.8) < 1e-9
        found += fp.verified(a, b) is not None
    assert found >= 297
