"""Percentiles of all pairs by tiles equal those of the pairs' table, and no row of pairs is shuffled or written."""

import numpy as np
import pytest

from quillspan.operators import ranks, vectors


def items(spark):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((90, 5))
    m[:20], m[20], m[21:25] = m[0], 0, -m[0]
    rows = [("big" if i < 70 else "mid", i, 1000 - i, m[i].tolist()) for i in range(90)] + [("few", 200 + i, i, m[30 + i].tolist()) for i in range(4)]
    rows += [("big", 300, 1, None), ("big", 301, 2, []), ("one", 302, 3, m[50].tolist())]
    return spark.createDataFrame(rows, "corpus_id string, id int, seq int, embedding array<double>")


@pytest.mark.parametrize("width", [1 << 20, 1 << 28])
def test_tiles_give_the_definition(spark, monkeypatch, width):
    monkeypatch.setattr(ranks, "WIDTH", width)
    table = items(spark)
    want = vectors.pair_percentiles(vectors.all_pairs(table, digits=3)).collect()
    for block in (7, 2048):
        got = {(r.corpus_id, frozenset((r.a, r.b))): r for r in ranks.pair_percentiles(table, digits=3, block=block).collect()}
        assert len(got) == len(want) == 70 * 69 / 2 + 190 + 6
        for r in want:
            x = got[r.corpus_id, frozenset((r.a, r.b))]
            assert x.percentile == (None if r.percentile is None else pytest.approx(r.percentile, abs=1e-9))
            assert (x.a < x.b) == (r.corpus_id == "few")


def test_bins_of_many_values_add_up_alike(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sent = [np.unique(rng.integers(0, 1 << 12, 900), return_counts=True) for _ in range(5)]
    batch = pa.RecordBatch.from_pydict({"places": [ranks._packed(v) for v, _ in sent], "times": [ranks._packed(np.cumsum(n)) for _, n in sent], "n": [len(v) for v, _ in sent]})
    every = np.concatenate([np.repeat(v, n) for v, n in sent])
    for width in (1 << 12, 1 << 20):
        monkeypatch.setattr(ranks, "WIDTH", width)
        found, total = ranks._ranks([batch])
        assert total == len(every)
        for (v, _), got in zip(sent, found):
            assert (got == [2 * (every < x).sum() + (every == x).sum() for x in v]).all()


def test_what_is_sent_is_less_than_the_pairs(spark):
    """2,000 vectors have 1,999,000 pairs; a row of one took 30 bytes and more."""
    rng = np.random.default_rng(2)
    m = rng.standard_normal((2000, 16))
    table = spark.createDataFrame([("c", i, i, v) for i, v in enumerate(m.tolist())], "corpus_id string, id int, seq int, embedding array<double>")
    made = ranks.pair_percentiles(table, block=1000)
    text = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "Sort" not in text and made.count() == 1_999_000
    values = np.sort(rng.integers(0, 1 << 20, 7000))
    assert len(ranks._packed(values)) < 2 * len(values)


def test_nothing_gives_nothing(spark):
    assert ranks.pair_percentiles(items(spark).limit(0)).collect() == []
