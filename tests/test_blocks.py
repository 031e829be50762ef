"""Blocks of near vectors: searches and joins that skip them, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import blocks, vectors


def table(spark, m, corpus="c"):
    return spark.createDataFrame([(corpus, i, i, [float(x) for x in row]) for i, row in enumerate(m)], "corpus_id string, id int, seq int, embedding array<double>")


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def clouds(n=240, groups=6, d=8, spread=0.02, seed=4):
    rng = np.random.default_rng(seed)
    return np.eye(d)[np.arange(n) % groups] + spread * rng.standard_normal((n, d))


def hard():
    """Repeated rows, zero vectors, opposite ones, ties."""
    rng = np.random.default_rng(9)
    m = rng.standard_normal((60, 4))
    return np.concatenate([m, m[:20], -m[:10], np.zeros((5, 4)), np.tile(m[0], (30, 1))])


@pytest.mark.parametrize("size", [4, 16, 512])
def test_blocks_hold_every_row_within_reach(size):
    u = unit(hard())
    made = list(blocks._blocks(u, size))
    assert sorted(np.concatenate([rows for rows, _, _ in made])) == list(range(len(u)))
    for rows, centre, reach in made:
        assert len(rows) <= size and (reach == np.pi or (np.arccos(np.clip(u[rows] @ centre, -1, 1)) <= reach).all())


@pytest.mark.parametrize("m", [clouds(), hard()], ids=["clouds", "hard"])
@pytest.mark.parametrize("size,k", [(5, 3), (16, 20), (512, 3)])
def test_ranks_equal_brute_force(spark, m, size, k):
    asked = m[::7]
    q = table(spark, asked).select(F.col("id").alias("query_id"), "embedding")
    got = {}
    for r in vectors.rank(q, table(spark, m).repartition(3), k, block=size).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    s = np.round(unit(asked) @ unit(m).T, 9)
    for i in range(len(asked)):
        want = sorted(range(len(m)), key=lambda j: (-s[i, j], j))[:k]
        assert [got[i][x + 1] for x in range(k)] == want


def test_far_blocks_are_not_ranked(spark, monkeypatch):
    m = clouds()
    q = table(spark, m[:6]).select(F.col("id").alias("query_id"), "embedding")
    counted = []
    keep = blocks.written

    def spy(df, name):
        out = keep(df, name)
        counted.append((name, out))
        return out

    monkeypatch.setattr(blocks, "written", spy)
    vectors.rank(q, table(spark, m).coalesce(1), 3, block=8).collect()
    named = dict(counted)
    met = named["seeds"].select("x_b").distinct().count()
    total = named["queries"].count() * named["corpus"].count()
    near = blocks._summary(named["queries"], "x").crossJoin(blocks._summary(named["corpus"], "y")).filter(F.cos(blocks._gap()) >= 0.99).count()
    assert met == named["queries"].count() and near < total / 3


@pytest.mark.parametrize("m", [clouds(), hard()], ids=["clouds", "hard"])
@pytest.mark.parametrize("least", [-0.5, 0.0, 0.6, 0.95, 1.0 - 1e-9])
def test_similar_pairs_equal_all_pairs(spark, monkeypatch, m, least):
    monkeypatch.setattr(blocks, "TOGETHER", 4)
    monkeypatch.setattr(blocks, "GATHER", 50)
    items = table(spark, m).union(table(spark, m[:9], "small")).union(table(spark, m[:3], None))
    got = sorted((r.corpus_id or "", r.a, r.b, r.similarity) for r in vectors.all_pairs(items, min_similarity=least, block=8).collect())
    u = unit(m)
    s = u @ u.T
    want = [(c, i, j, s[i, j]) for c, n in (("", 3), ("c", len(m)), ("small", 9)) for i in range(n) for j in range(i + 1, n) if s[i, j] >= least]
    sure = lambda rows: {r[:3] for r in rows if abs(r[3] - least) > 1e-12}
    assert sure(got) == sure(want) and len(got) == len({r[:3] for r in got})
    assert all(x == pytest.approx(s[i, j]) for _, i, j, x in got)


def test_far_vectors_are_not_multiplied(spark):
    made = blocks._similar(table(spark, clouds()), 0.9, corpus="corpus_id", item_id="id", order="seq", vector="embedding", digits=9, size=16)
    products = made.agg(F.sum("products")).first()[0]
    assert 0 < products < 240 * 240 / 4


def test_blocks_are_sent_by_tiles_not_by_pairs(spark, monkeypatch):
    rng, sent, keep = np.random.default_rng(3), [], blocks._sent
    monkeypatch.setattr(blocks, "_sent", lambda near, made: sent.append((near, made, keep(near, made))) or sent[-1][2])
    items = table(spark, rng.normal(size=(1200, 16)))
    got = {(r.a, r.b) for r in vectors.all_pairs(items, min_similarity=0.5, block=16).collect()}
    near, made, rows = sent[0]
    n = made.count()
    assert near.count() == n * (n + 1) // 2  # nothing can be skipped
    assert rows.count() <= n * blocks.TILES < near.count() / 4
    u = unit(rng.__class__(np.random.PCG64(3)).normal(size=(1200, 16)))
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.5, 1)))}


def test_lsh_pairs_are_those_that_share_a_bucket(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    m = unit(np.random.default_rng(5).normal(size=(300, 6)))
    u = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, v array<double>").select("id", array_to_vector("v").alias("u"))
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=2 * 0.2**0.5, numHashTables=1, seed=7).fit(u)
    plain = model.approxSimilarityJoin(u, u, 0.2**0.5, "d").filter("datasetA.id < datasetB.id").select("datasetA.id", "datasetB.id")
    got = [(r.a, r.b) for r in vectors.similar_pairs_lsh(table(spark, m), min_similarity=0.9, tables=1).collect()]
    assert sorted(got) == sorted(tuple(r) for r in plain.collect()) and len(got) < int((np.triu(m @ m.T, 1) >= 0.9).sum())


def test_blocks_without_usable_vectors(spark):
    kind = "corpus_id string, id int, seq int, embedding array<double>"
    odd = spark.createDataFrame([("c", 1, 1, None), ("c", 2, 2, []), ("c", 3, 3, [1.0, None]), ("c", 4, 4, [float("nan"), 1.0]), ("c", 5, 5, [float("inf"), 1.0])], kind)
    some = odd.union(spark.createDataFrame([("c", 6, 6, [1.0, 0.0]), ("c", 7, 7, [1.0, 0.1])], kind))
    assert vectors.all_pairs(odd, min_similarity=0.1).count() == 0 and vectors.rank(odd.withColumnRenamed("id", "query_id"), some, 3).count() == 0
    assert [(r.a, r.b) for r in vectors.all_pairs(some, min_similarity=0.1).collect()] == [(6, 7)]
    got = vectors.rank(some.withColumnRenamed("id", "query_id"), some, 1).collect()
    assert sorted(tuple(r) for r in got) == [(6, 6, 1), (7, 7, 1)]
    with pytest.raises(Exception, match="unequal"):
        vectors.rank(some.withColumnRenamed("id", "query_id"), spark.createDataFrame([("c", 1, 1, [1.0])], kind), 1).collect()
