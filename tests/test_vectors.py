"""Vectors, search, pairs, percentiles, outliers, maps, clusters and checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import vec
from quillspan.operators import cluster, embed, evaluate, project, vectors


def table(spark, m, corpus="c"):
    return spark.createDataFrame([(corpus, i, i, [float(x) for x in row]) for i, row in enumerate(m)], "corpus_id string, id int, seq int, embedding array<float>")


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def blobs(seed=1, each=5, d=3, spread=0.05):
    rng = np.random.default_rng(seed)
    return np.concatenate([np.eye(d)[k] + spread * rng.standard_normal((each, d)) for k in range(3)])


def test_vector_expressions(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(vec.cosine("a", "b"), vec.cosine("a", "z"), vec.dot("a", "b"), vec.norm("b"), vec.unit("z"), vec.unit("b")).first()
    assert row[0] == pytest.approx(0.5**0.5) and row[1] == 0 and row[2] == 1 and row[3] == pytest.approx(2**0.5) and row[4] == [0, 0] and row[5] == pytest.approx([0.5**0.5] * 2)
    with pytest.raises(Exception, match="unequal"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vec.cosine("a", "b")).collect()


def test_centroid(spark):
    rows = spark.createDataFrame([("n", [1.0, 3.0]), ("n", [3.0, 5.0]), ("n", []), ("m", [7.0, 7.0]), ("e", [])], "note_id string, embedding array<float>")
    assert {r.note_id: list(r.embedding) for r in vectors.centroids(rows).collect()} == {"n": [2, 4], "m": [7, 7]}


def test_rank(spark):
    items = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 5.0])], "query_id int, embedding array<float>")
    for n in (1, 4):
        got = sorted(map(tuple, vectors.rank(q, items.repartition(n), 3).collect()), key=lambda r: (r[0], r[2]))
        assert got == [(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "c", 1), (2, "a", 2), (2, "b", 3)]
    assert vectors.rank(q, items.limit(0), 3).count() == 0 and vectors.rank(q.limit(0), items, 3).count() == 0


def test_rank_in_blocks(spark):
    m = np.random.default_rng(2).standard_normal((40, 5))
    q = table(spark, m[:7]).select(F.col("id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.id for r in vectors.rank(q, table(spark, m), 4, block=3).collect()}
    s = unit(m[:7].astype(np.float32).astype(float)) @ unit(m.astype(np.float32).astype(float)).T
    assert got == {(i, k + 1): int(x) for i in range(7) for k, x in enumerate(np.argsort(-s[i])[:4])}


@pytest.mark.parametrize("block", [512, 4])
def test_pairs_and_percentiles(spark, block):
    m = np.random.default_rng(3).standard_normal((13, 4))
    items = table(spark, m).union(table(spark, m[:3], "small"))
    pairs = vectors.all_pairs(items, block=block)
    got = {(r.a, r.b): r.similarity for r in pairs.filter("corpus_id = 'c'").collect()}
    u = unit(m.astype(np.float32).astype(float))
    assert got == {(i, j): pytest.approx(float(u[i] @ u[j])) for i in range(13) for j in range(i + 1, 13)}
    assert vectors.all_pairs(items, block=block, min_similarity=0.3).count() == sum(v >= 0.3 for v in got.values()) + sum(u[i] @ u[j] >= 0.3 for i, j in ((0, 1), (0, 2), (1, 2)))
    top = vectors.top_pairs(items, 5, block=block).filter("corpus_id = 'c'").orderBy("rank").collect()
    assert [(r.a, r.b) for r in top] == sorted(got, key=lambda p: -got[p])[:5] and top[0].remainder == 73
    ranked = {(r.corpus_id, r.a, r.b): r.percentile for r in vectors.pair_percentiles(pairs).collect()}
    v = np.array(list(got.values()))
    for (i, j), s in got.items():
        assert ranked["c", i, j] == pytest.approx(((v < s).sum() + 0.5 * (v == s).sum()) / len(v) * 100)
    assert ranked["small", 0, 1] is None  # three pairs are too few


def test_percentile_of_values(spark):
    pairs = spark.createDataFrame([("c", float(x)) for x in (0.1, 0.2, 0.2, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)] + [("d", 0.5)] * 9, "corpus_id string, similarity double")
    asked = spark.createDataFrame([("c", 0.9), ("c", 0.0), ("c", 0.2), ("c", 0.45), ("d", 0.5), ("none", 0.5)], "corpus_id string, similarity double")
    got = {(r.corpus_id, r.similarity): r.percentile for r in vectors.percentile_of(asked, pairs).collect()}
    assert got == {("c", 0.9): 100, ("c", 0.0): 0, ("c", 0.2): 25, ("c", 0.45): 60, ("d", 0.5): None, ("none", 0.5): None}
    near = {r.similarity: r.percentile for r in vectors.approximate_percentile_of(asked.filter("corpus_id = 'c'").select("similarity"), pairs.filter("corpus_id = 'c'")).collect()}
    assert near[0.9] == 100 and near[0.0] == 0


def test_outlier(spark):
    m = np.concatenate([blobs(each=4)[:8, :2], [[0.0, -1.0], [0.0, 0.0]]])
    u = unit(m.astype(np.float32).astype(float))
    s = u @ u.T
    mean = (s.sum(axis=1) - np.diag(s)) / (len(m) - 1)
    [got] = vectors.outlier(table(spark, m).union(table(spark, m[:2], "two"))).collect()
    assert got.id == int(mean.argmin()) and got.mean_similarity == pytest.approx(mean.min())
    [tie] = vectors.outlier(table(spark, [[1, 0], [1, 0], [1, 0]])).collect()
    assert tie.id == 0


def test_lsh_pairs_are_true(spark):
    m = np.repeat(np.random.default_rng(0).standard_normal((10, 8)), 2, axis=0) + 1e-3
    got = vectors.similar_pairs_lsh(table(spark, m), min_similarity=0.95).collect()
    assert {(r.a, r.b) for r in got} >= {(2 * i, 2 * i + 1) for i in range(10)} and all(r.similarity >= 0.95 - 1e-6 for r in got)


def test_projection(spark):
    m = np.concatenate([blobs(each=6, d=5, spread=0.1)[:12], [[3, 0, 0, 0, 0.5]]]).astype(np.float32).astype(float)
    basis = project.fit(table(spark, m))
    centred = m - m.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    seed = project.seed_direction(5)
    for mine, want in ((basis.pc1, axes[:, -1]), (basis.pc2, axes[:, -2])):
        assert np.array(mine) @ (want if want @ seed >= 0 else -want) == pytest.approx(1, abs=1e-6)
    assert basis.variance_explained == pytest.approx(tuple(values[[-1, -2]] / values.sum()))
    assert project.total_variance(table(spark, m)).first()[0] == pytest.approx(values.sum())
    got = {r.id: (r.x, r.y) for r in project.project_onto(table(spark, m), basis).collect()}
    assert got[3] == pytest.approx((centred[3] @ basis.pc1, centred[3] @ basis.pc2))
    again = project.fit(table(spark, m).repartition(5))
    a, b = (project.project_onto(table(spark, m), x) for x in (basis, again))
    assert evaluate.order_invariance(a, b).first().ok


def test_projection_without_spread(spark):
    assert project.fit(table(spark, [[1, 2]]).limit(0)) is None
    for m in ([[1, 2, 3]], [[1, 2, 3]] * 3):
        basis = project.fit(table(spark, m))
        assert basis.pc1 == [0, 0, 0] and basis.variance_explained == (0, 0)
        assert {(r.x, r.y) for r in project.project_onto(table(spark, m), basis).collect()} == {(0, 0)}


def test_viewport(spark):
    points = spark.createDataFrame([(1, 10.0, -2.0), (2, -5.0, 5.0)], "id int, x double, y double")
    fitted = project.viewport_fit(points)
    assert tuple(fitted.first()) == (26.0, 300.0, 300.0)
    assert [(r.px, r.py) for r in project.to_pixels(points, fitted).orderBy("id").collect()] == [(560, 352), (170, 170)]
    assert project.viewport_fit(points.limit(0)).first().scale == 1
    assert project.viewport_fit(spark.createDataFrame([(0.0, 0.0)], "x double, y double")).first().scale == 260


def test_instability_and_displacement(spark):
    m = blobs(each=5, d=4)
    got = project.instability(table(spark, m[:10]).select("id", "embedding"), table(spark, m[10:]).withColumn("id", F.col("id") + 10).select("id", "embedding")).first()
    assert got.n == 10 and 0 < got.mean_px <= got.max_px


def sequential(m, threshold):
    """Average linkage from the definition: mean distance over all pairs of members."""
    u = unit(m)
    d = 1 - u @ u.T
    groups = [[i] for i in range(len(m))]
    while len(groups) > 1:
        best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] > threshold:
            break
        _, i, j = best
        merged = groups[i] + groups[j]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [merged]
    return {frozenset(g) for g in groups}


def found(rows, column):
    groups = {}
    for r in rows:
        groups.setdefault(r[column], set()).add(r.id)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.6, 0.95, 10])
def test_clusters_follow_the_definition(spark, threshold):
    m = np.random.default_rng(5).standard_normal((24, 6)).astype(np.float32).astype(float)
    want = sequential(m, threshold)
    assert found(cluster.cluster_exact(table(spark, m), threshold=threshold).collect(), "cluster_id") == want
    assert found(cluster.cluster_rounds(table(spark, m), threshold=threshold, block=7).collect(), "cluster") == want


@pytest.mark.parametrize("keep", [1, 3])
def test_kept_neighbour_lists_give_the_same_clusters(spark, keep):
    m = np.random.default_rng(6).standard_normal((40, 5)).astype(np.float32).astype(float)
    got = cluster.cluster_rounds(table(spark, m), threshold=0.5, block=9, keep=keep, local=10 * (keep - 1))
    assert found(got.collect(), "cluster") == sequential(m, 0.5)


def test_heights_are_those_of_the_whole_dendrogram(spark):
    m = np.random.default_rng(6).standard_normal((40, 5)).astype(np.float32).astype(float)
    heights = [sorted(r.height for r in rows.collect()) for rows in (cluster.cluster_rounds(table(spark, m), threshold=2, history=True), cluster.merge_history(table(spark, m)))]
    assert heights[0] == pytest.approx(heights[1]) and len(heights[0]) == 39


def ties():
    """Vectors of equal mutual distance; three groups of them; and points on a circle, each as far from both neighbours."""
    alike = np.eye(30) + 0.5
    groups = np.zeros((30, 33))
    for i in range(30):
        groups[i, [i // 10, 3 + i]] = 3, 1
    angles = np.arange(24) * np.pi / 12
    return {"alike": (alike, 0.5), "apart": (np.eye(30), 0.5), "groups": (groups, 0.3), "circle": (np.stack([np.cos(angles), np.sin(angles)], axis=1), 0.01)}


@pytest.mark.parametrize("name", ["alike", "apart", "groups", "circle"])
def test_tied_distances_take_few_rounds(spark, name):
    m, threshold = ties()[name]
    exact = found(cluster.cluster_exact(table(spark, m), threshold=threshold).collect(), "cluster_id")
    for more in ({}, *([{"local": 4, "block": 11, "most_rounds": 20}] if name == "alike" else [])):
        assert found(cluster.cluster_rounds(table(spark, m), threshold=threshold, **more).collect(), "cluster") == exact


def test_many_ties_end(monkeypatch):
    rng = np.random.default_rng(2)
    hashes = rng.integers(-(2**63), 2**63, 1500)
    rounds = []
    monkeypatch.setattr(cluster, "_closest", lambda *a, f=cluster._closest: rounds.append(len(a[0])) or f(*a))
    merged = cluster.finish(hashes, np.eye(1500), np.ones(1500), 2.0)
    assert len(merged) == 1499 and len(rounds) < 60


def test_later_rounds_compare_what_merged_alone(spark, monkeypatch):
    m = np.random.default_rng(8).standard_normal((60, 6))
    asked = []

    def counted(state, block, keep, f=cluster._search):
        asked.append((state.filter("fresh").count(), state.count()))
        return f(state, block, keep)

    monkeypatch.setattr(cluster, "_search", counted)
    cluster.cluster_rounds(table(spark, m), threshold=2, local=30).collect()
    assert asked[0] == (60, 60) and len(asked) > 1 and all(fresh < total for fresh, total in asked[1:])


def test_cluster_floor_names_and_topics(spark):
    m = blobs()
    assert cluster.cluster_exact(table(spark, m[:14])).count() == 0
    got = cluster.cluster_exact(table(spark, m), threshold=0.3)
    assert len(found(got.collect(), "cluster_id")) == 3 and {r.cluster_id[0] for r in got.collect()} == {"m"}
    labels = spark.createDataFrame([(i, i // 5) for i in range(15)], "id int, label int")
    assert cluster.purity(got, labels, cluster="cluster_id").first().all_pure
    assert {r.cluster_id for r in cluster.cluster_exact(table(spark, m), threshold=0).collect()} == {f"n{i}" for i in range(15)}
    assert got.exceptAll(cluster.cluster_exact(table(spark, m).repartition(4), threshold=0.3)).count() == 0
    steps = cluster.merge_history(table(spark, m)).orderBy("step").collect()
    assert len(steps) == 14 and steps[-1].size == 15 and all(a.height <= b.height + 1e-9 for a, b in zip(steps, steps[1:]))
    sweep = {r.threshold: r.n_clusters for r in cluster.cut_sweep(table(spark, m), [0.0, 0.3, 10.0]).collect()}
    assert sweep == {0.0: 15, 0.3: 3, 10.0: 1}
    assert {r.threshold: r.n_clusters for r in cluster.cut_sweep(table(spark, m), [0.0, 0.3, 10.0], exact_max=5).collect()} == sweep


def test_exact_clusters_refuse_what_a_task_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(cluster, "EXACT_MAX", 10)
    with pytest.raises(Exception, match="by rounds"):
        cluster.cluster_exact(table(spark, blobs())).collect()


def test_ties_go_by_position():
    m = np.array([[1, 0], [1, 0], [0, 1], [0, 1.0]])
    assert [(a, b) for a, b, _, _ in cluster.merges(m)] == [(0, 1), (2, 3), (4, 5)]


def test_large_corpora_go_by_rounds(spark):
    m = blobs(each=6)
    got = cluster.cluster(table(spark, m).union(table(spark, m[:16], "small")), threshold=0.3, exact_max=17)
    rows = got.collect()
    assert len(found([r for r in rows if r.corpus_id == "c"], "cluster")) == 3 and len(found([r for r in rows if r.corpus_id == "small"], "cluster")) == 3


def test_embedding(spark):
    chunks = spark.createDataFrame([("n", "c0", 0, "a small text"), ("n", "c1", 1, "another"), ("m", "c2", 0, ""), ("m", "c3", 1, None)], "note_id string, chunk_id string, ord int, text string")
    got = {r.chunk_id: np.array(r.embedding) for r in embed.embed(chunks).collect()}
    assert np.linalg.norm(got["c0"]) == pytest.approx(1) and not got["c2"].any() and not got["c3"].any()
    notes = {r.note_id: np.array(r.embedding) for r in embed.note_vectors(chunks).collect()}
    assert notes["n"] == pytest.approx((got["c0"] + got["c1"]) / 2)
    cache = chunks.filter("chunk_id = 'c0'").select(embed.cache_key("text", F.lit(embed.HASHING)).alias("cache_key"))
    assert sorted(r.chunk_id for r in embed.to_embed(chunks, cache).collect()) == ["c1", "c2", "c3"]
    mixed = spark.createDataFrame([("c", "x"), ("c", "y")], "corpus_id string, model_id string")
    with pytest.raises(Exception, match="several models"):
        embed.one_model(mixed).collect()
    assert embed.one_model(mixed.filter("model_id = 'x'")).count() == 1


def test_failures_stay_rows(spark):
    def encode(texts):
        if "boom" in texts[0]:
            raise RuntimeError("WASM Out of memory")
        if "odd" in texts[0]:
            raise OverflowError("too long")
        if "bad" in texts[0]:
            raise ValueError("no")
        return np.ones((1, 2))

    rows = spark.createDataFrame([("fine",), ("boom",), ("odd",), ("bad",)], "text string")
    assert {r.text: r.failure_kind for r in embed.embed_safely(rows, encode).collect()} == {"fine": None, "boom": "memory", "odd": "memory", "bad": "other"}


def test_drift_and_sets(spark):
    m = spark.createDataFrame([(1, 0.70), (2, 0.90), (3, 0.5)], "id int, cosine double")
    p = spark.createDataFrame([(1, 0.71), (2, 0.80), (4, 0.5)], "id int, cosine double")
    assert {r.id: r.ok for r in evaluate.drift(m, p, value="cosine").collect()} == {1: True, 2: False, 3: False, 4: False}
    one = evaluate.negation_blindness(m.filter("id = 1"), p.filter("id = 1")).first()
    assert one.pinned_ok and one.high_ok and one.mean == 0.7
    pair = spark.createDataFrame([("contradiction", "it is on", "it is not on"), ("paraphrase", "it is on", "the thing runs")], "kind string, a string, b string")
    assert evaluate.contradiction_verdict(evaluate.pair_cosines(pair)).first().blind
    t = spark.createDataFrame([(0.9, 0.2), (0.5, 0.45)], "cos_positive double, cos_negative double")
    got = evaluate.triple_discriminability(t).first()
    assert (got.n, got.n_pass, got.passed) == (2, 2, True) and got.mean_gap == pytest.approx(0.375) and got.min_margin == pytest.approx(0.05)
    assert not evaluate.triple_discriminability(t.limit(0)).first().passed


def test_coverage(spark):
    claims = spark.createDataFrame([("en", "English", None, False), ("de", "German", None, False), ("fr", "French", None, False), ("tl", "Tagalog", "special", True)], "bcp47 string, name string, note string, special boolean")
    for passed, status in ((None, "unverified"), (True, "verified"), (False, "not-supported")):
        verdicts = spark.createDataFrame([] if passed is None else [("tl", passed, "20/20", "measured")], "bcp47 string, passed boolean, evidence string, note string")
        covered = evaluate.coverage(claims, verdicts)
        got = {r.bcp47: (r.status, r.note) for r in covered.collect()}
        assert got["en"][0] == "verified" and got["de"][0] == "unverified" and got["tl"] == (status, "special" if passed is None else "measured")
        listed = "English, Tagalog" if passed else "English"
        assert evaluate.coverage_sentence(covered).first()[0].startswith(f"Tuned for roughly 3 languages, tested to date in {listed}; ")
    assert "in none yet;" in evaluate.coverage_sentence(evaluate.coverage(claims.filter("bcp47 = 'de'"), verdicts)).first()[0]


def test_scans(spark):
    docs = spark.createDataFrame([(1, "x start the quick brown fox jumps over the lazy dog. end"), (2, "prethe quick brown fox jumps over the lazy dogs"), (3, "quick brown fox jumps over"), (4, None), (5, "tiny canary here")], "doc_id int, text string")
    passages = spark.createDataFrame([(10, "the quick brown fox jumps over the lazy dog"), (11, "canary"), (12, ""), (13, None), (14, "here")], "item_id int, text string")
    assert sorted((r.doc_id, r.item_id) for r in evaluate.leak_scan(docs, passages).collect()) == [(1, 10), (2, 10), (5, 11), (5, 14)]
    words = spark.createDataFrame([("QUICK",), ("absent",), ("",)], "phrase string")
    assert sorted(r.doc_id for r in evaluate.banned_words(docs, words).collect()) == [1, 2, 3]
    many = words.union(spark.range(20_000).select(F.format_string("none such %d", "id")))
    assert sorted(r.doc_id for r in evaluate.banned_words(docs, many).collect()) == [1, 2, 3]


def test_text_checks(spark):
    cases = spark.createDataFrame([("a", "One two. Three.", (1, 0, 3)), ("b", "One.", (2, 0, 1))], "id string, text string, expected struct<chunkCount:int,truncatedChunkCount:int,totalTokens:int>")
    got = {r.id: tuple(r)[1:] for r in evaluate.golden_set(cases).collect()}
    assert got == {"a": (True, True, True, True), "b": (False, True, True, True)}
    notes = spark.createDataFrame([("n", "é and \U0001f1f5\U0001f1ed.\nNext line here. More.")], "note_id string, text string")
    clusters = spark.createDataFrame([("n", "é"), ("n", "\U0001f1f5")], "note_id string, cluster string")
    assert [r.whole for r in evaluate.grapheme_integrity(notes, clusters).orderBy("cluster").collect()] == [True, False]
    assert all(r.ok for r in evaluate.encoding_invariance(notes).collect()) and evaluate.encoding_invariance(notes).count() == 3
    pairs = spark.createDataFrame([("café", "café"), ("a", "b")], "a string, b string")
    assert [r.ok for r in evaluate.nfc_equivalence(pairs).collect()] == [True, False]
    scripts = spark.createDataFrame([("Latin (en)",), ("Han",)], "script string")
    assert {r.family: r.covered for r in evaluate.scripts_covered(scripts, ["Latin", "Thai"]).collect()} == {"Latin": True, "Thai": False}
    counts = evaluate.segmentation_counts(notes).first()
    assert (counts.sentences, counts.chunks, counts.tokens) == (3, 1, 7)
    long = spark.createDataFrame([("n", "Short. " + " ".join(f"w{i}" for i in range(170)) + ". Tail here.")], "note_id string, text string")
    from quillspan.operators import chunk

    [r] = evaluate.truncation_evidence(chunk.chunk_notes(long), long.select("note_id", F.lit("w1 w2 other words").alias("text"))).collect()
    assert r.n_truncated == 1 and r.ok


def test_report(spark):
    rows = spark.createDataFrame([(True, "x"), (False, "y")], "p boolean, d string")
    got = evaluate.report([evaluate.check("a", rows, F.col("p"), F.col("d")), evaluate.check("b", rows.filter("p"), F.col("p")), evaluate.check("c", rows.limit(0), F.col("p"))])
    assert {r.id: (r.status, r.detail) for r in got.collect()} == {"a": ("fail", "1 of 2; y"), "b": ("pass", "1 of 1"), "c": ("skip", "0 of 0")}
    assert tuple(evaluate.report_totals(got).first()) == (1, 1, 1)
    assert spark.range(1).select(evaluate.percent(F.lit(2.5)), evaluate.fixed(F.lit(0.98765))).first()[:] == (3, "0.988")
