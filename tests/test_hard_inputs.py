"""Null and empty vectors, empty tables, equal vectors and tied orders, failing models, long sessions."""

import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillspan.operators import admit, cluster, embed, evaluate, project, vectors
from quillspan.plans import catalogue

EMPTY = "corpus_id int, id int, seq int, embedding array<float>"


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(3)
    rows = [(0, i, i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)] + [(0, 30, 30, None), (0, 31, 31, [])]
    return spark.createDataFrame(rows, EMPTY)


def test_vectors_that_are_not_there_take_no_part(some):
    whole = some.filter("size(embedding) > 0")
    asked = some.filter("id >= 28").withColumnRenamed("id", "query_id")
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(vectors.rank(asked, some, 3), vectors.rank(asked.filter("query_id < 30"), whole, 3))
    assert same(vectors.all_pairs(some), vectors.all_pairs(whole)) and same(vectors.outlier(some), vectors.outlier(whole))
    assert same(cluster.cluster(some), cluster.cluster(whole)) and same(cluster.cluster_rounds(some), cluster.cluster_rounds(whole))
    assert same(vectors.similar_pairs_lsh(some, min_similarity=0.5), vectors.similar_pairs_lsh(whole, min_similarity=0.5))
    assert project.fit(some) == project.fit(whole)
    assert {r.id for r in project.project_onto(some, project.fit(some)).filter("x is null").collect()} == {30, 31}


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], EMPTY)
    assert vectors.similar_pairs_lsh(none).collect() == [] and vectors.rank(none.withColumnRenamed("id", "query_id"), none, 3).collect() == []
    assert cluster.cluster(none).collect() == [] and cluster.cluster_rounds(none).collect() == []
    (r,) = project.instability(none, none).collect()
    assert (r.mean_px, r.max_px, r.n) == (None, None, 0)
    chunks = spark.createDataFrame([], "note_id int, chunk_id string, embedding array<float>, truncated boolean")
    points, basis = project.map_points(chunks, vectors.centroids(chunks))
    assert points.collect() == [] and basis.percent == 0
    flat = project.project_onto(none, project.fit(none))
    assert evaluate.order_invariance(flat, flat).first().n == 0


def test_equal_vectors_and_tied_orders(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, i // 3, [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    rows += [(0, 100 + i, 50 + i % 2, [1.0, 2.0, 2.0]) for i in range(300)] + [(0, 500 + i, 7, [0.0, 0.0, 0.0]) for i in range(4)]
    table = spark.createDataFrame(rows, EMPTY)
    found = cluster.cluster_rounds(table, threshold=0.4, most_rounds=40)
    exact = cluster.cluster_exact(table, threshold=0.4)
    assert found.count() == len(rows)
    pairs = lambda df, name: {frozenset(g) for g in df.toPandas().groupby(["corpus_id", name])["id"].agg(list)}
    copies = {frozenset(x for x in g if 100 <= x < 400) for g in pairs(exact, "cluster_id")} - {frozenset()}
    assert copies == {frozenset(range(100, 400))}
    assert found.filter("id between 100 and 399").select("cluster").distinct().count() == 1
    heights = sorted(r.height for r in cluster.cluster_rounds(table, threshold=0.4, most_rounds=40, history=True).collect())
    want = sorted(r.height for r in cluster.merge_history(table).filter("height <= 0.4").collect())
    assert heights == pytest.approx(want, abs=1e-9) and heights[298] == pytest.approx(0, abs=1e-12)


def test_a_failing_text_fails_alone(spark):
    calls = spark.sparkContext.accumulator(0)

    def encode(texts):
        calls.add(1)
        if any("bad" in t for t in texts):
            raise MemoryError("Out of memory: allocation failed")
        return [[float(len(t))] for t in texts]

    table = spark.createDataFrame([(i, "bad" if i == 70 else "x" * i) for i in range(200)], "id int, text string").coalesce(1)
    got = embed.embed_safely(table, encode).collect()
    assert [r.id for r in got if r.error] == [70] and {r.failure_kind for r in got} == {None, "memory"}
    assert all(r.embedding == [float(r.id)] for r in got if r.id != 70) and calls.value < 40


def test_long_sessions_take_linear_time():
    session = admit.Session(1 << 30, 1 << 40)
    start = time.time()
    for i in range(100_000):
        assert session.add(str(i), f"key {i}", 3) == ("added", None)
    assert session.characters == 300_000 and time.time() - start < 10
    assert session.edit("5", "key 6", 3) == ("duplicate", None) and session.edit("5", "key 5", 4) == ("edited", None)
    assert session.remove("6") == ("removed", None) and session.edit("5", "key 6", 1) == ("edited", None)
    assert session.add("new", "key 5", 2) == ("added", None) and session.characters == 300_000 - 3 - 2 + 2


def test_decimals_have_no_thousands_marks(spark):
    assert spark.range(1).select(evaluate.fixed(cluster.F.lit(1234567.0625), 3).alias("x")).first().x == "1234567.062"


def test_streams_over_empty_tables_end_without_rows(spark, sf_dir, tmp_path):
    for name in ("conversations", "events"):
        pq.write_table(pq.read_table(f"{sf_dir}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    for name in ("admission_stream", "latest_state_stream", "count_since_baseline_stream", "debounce_stream"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).collect() == [], name
