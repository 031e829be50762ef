"""Scans for many patterns against plain containment."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.operators import evaluate, scan


@given(st.lists(st.text("abé", max_size=12), max_size=8), st.lists(st.text("abé", min_size=1, max_size=9), min_size=1, max_size=6), st.sampled_from([3, 7, 1 << 20]))
@settings(max_examples=200, deadline=None)
def test_windows_are_found_within_texts_only(texts, patterns, step):
    anchors = {scan._anchor(p.encode()) for p in patterns}
    bits = np.zeros(16, np.uint64)
    for probe in range(scan.PROBES):
        for word, bit in zip(*scan._place(np.array([h for _, h in anchors]).view(np.uint64), probe, 10)):
            bits[word] |= np.uint64(1) << bit
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(t) for t in raw])).astype(np.int64)
    got = scan._hits(np.frombuffer(b"".join(raw), np.uint8), offsets, sorted({n for n, _ in anchors}), bits, 10, step)
    got = set(got.itertuples(index=False, name=None))
    for i, t in enumerate(raw):
        for p in patterns:
            if p.encode() in t:
                assert (i, *scan._anchor(p.encode())) in got
    assert all(0 <= i < len(raw) and len(raw[i]) >= n for i, n, _ in got)


def brute(docs, patterns, channels):
    hold = lambda d, c, p: p[1] and d[c] is not None and p[1] in d[c]
    return sorted((d["doc_id"], c, p[0], d[c].index(p[1]) + 1, d[c][d[c].index(p[1]) :][:200]) for d in docs for c in channels for p in patterns if hold(d, c, p))


def test_scan_equals_containment(spark, monkeypatch):
    monkeypatch.setattr(scan, "ANCHOR", 16)
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcñ語 "), rng.integers(1, 40)))
    docs = [{"doc_id": i, "title": word(), "text": "".join(word() for _ in range(rng.integers(0, 30))), "k": "clash"} for i in range(60)]
    docs += [{"doc_id": 60, "title": None, "text": "", "k": None}, {"doc_id": 61, "title": "same", "text": "same", "k": None}, {"doc_id": 61, "title": "same", "text": "same", "k": None}, {"doc_id": 62, "title": "x" * 1_500_000 + "the end of a very long text", "text": None, "k": None}]
    patterns = [(j, docs[j]["text"][3 : 3 + n]) for j, n in enumerate(rng.integers(1, 90, 40))]
    patterns += [(100, "same"), (101, "same"), (102, ""), (103, None), (104, "a"), (105, "the end of a very long text"), (106, "absent words")]
    d = spark.createDataFrame(pd.DataFrame(docs), "doc_id int, title string, text string, k string").repartition(3)
    p = spark.createDataFrame(patterns, "item_id int, text string")
    got = sorted(tuple(r) for r in scan.scan(d, p, channels=["title", "text"]).collect())
    assert got == brute(docs, patterns, ["title", "text"])
    assert {r.channel for r in evaluate.leak_scan(d, p.filter("item_id = 100"), channels=["title", "text"]).collect()} == {"title", "text"}


@pytest.mark.parametrize("docs,patterns", [(0, 1), (1, 0), (0, 0)])
def test_scan_of_nothing(spark, docs, patterns):
    d, p = spark.createDataFrame([(1, "a")], "doc_id int, text string").limit(docs), spark.createDataFrame([(1, "a")], "item_id int, text string").limit(patterns)
    assert scan.scan(d, p, channels=["text"]).collect() == []


def test_few_windows_are_false_hits():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefgh "), 40)) for _ in range(500)]
    hashes = np.array([scan._anchor(t.encode())[1] for t in texts]).view(np.uint64)
    wide = (scan.BITS_EACH * len(texts) - 1).bit_length()
    bits = np.zeros(1 << (wide - 6), np.uint64)
    for probe in range(scan.PROBES):
        np.bitwise_or.at(bits, *[x if k == 0 else np.uint64(1) << x for k, x in enumerate(scan._place(hashes, probe, wide))])
    data = rng.integers(97, 123, 1_000_000).astype(np.uint8)
    assert len(scan._hits(data, np.array([0, len(data)]), [32], bits, wide)) <= 5
    assert len(scan._hits(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, 40]), [32], bits, wide)) >= 1
