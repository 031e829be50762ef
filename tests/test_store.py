"""The store of notes: merged layers against the whole history, what is embedded, compaction, batches that run again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators.embed import hashing_vectors
from quillspan.streaming import store

KINDS = "corpus_id string, note_id int, seq int, op string, text string, extra string"
BATCHES = [
    [("a", 1, 1, "add", "one", "x"), ("a", 2, 2, "add", "two", "x"), ("b", 1, 3, None, "three", "x"), (None, 9, 1, "add", None, "x")],
    [("a", 1, 5, "edit", "one again", "x"), ("a", 1, 4, "edit", "passed over", "x"), ("a", 2, 0, "edit", "late", "x"), ("b", 1, 6, "edit", "three", "x")],
    [],
    [("b", 1, 7, "remove", None, "x"), ("a", 1, 5, "edit", "one again", "x"), (None, 9, 2, "edit", "null key", "x")],
    [("b", 1, 5, "edit", "late for removed", "x"), ("a", 3, 1, "add", "tie a", "x"), ("a", 3, 1, "add", "tie b", "x")],
    [("b", 1, 9, "add", "back", "x")],
]


def expected(upto):
    """(key -> order, text, writes) by replaying the batches."""
    state, writes = {}, {}
    for batch in BATCHES[:upto]:
        best = {}
        for c, n, s, op, text, _ in batch:
            best[c, n] = max(best.get((c, n), (-1, "", "")), (s, op or "add", text or ""))
        for key, event in best.items():
            old = state.get(key)
            if old is None or event > old:
                writes[key] = writes.get(key, 0) + (event[1] != "remove" and (old is None or old[1] == "remove" or old[2] != event[2]))
                state[key] = event
    return {k: (e[0], e[2], writes[k]) for k, e in state.items() if e[1] != "remove"}


@pytest.mark.parametrize("every", [2, 3, 100])
def test_merged_layers_equal_the_history(spark, tmp_path, every):
    keys, where = ["corpus_id", "note_id"], str(tmp_path / "store")
    with pytest.raises(ValueError):
        store.notes(spark, where, keys=keys)
    sink = store.merge(where, keys=keys, corpus="corpus_id", order="seq", every=every)
    for number, rows in enumerate(BATCHES):
        sink(spark.createDataFrame(rows, KINDS), number)
        if number in (1, 3, 5):
            sink(spark.createDataFrame(rows, KINDS), number)
        got = store.notes(spark, where, keys=keys).collect()
        assert {(r.corpus_id, r.note_id): (r.order, r.text, r.writes) for r in got} == expected(number + 1)
    assert all(np.allclose(r.embedding, hashing_vectors([r.text])[0]) for r in got)
    means = {}
    for r in got:
        means.setdefault(r.corpus_id, []).append(r.embedding)
    found = {r.corpus_id: (r.n, r.embedding) for r in store.centroids(spark, where, corpus="corpus_id").collect()}
    assert found.keys() == means.keys() and all(n == len(means[c]) and np.allclose(v, np.mean(means[c], axis=0), atol=1e-6) for c, (n, v) in found.items())
    bases, layers = store._layers(spark, f"{where}/rows")
    assert len(bases) == (0 if every == 100 else 2) and len(layers) <= 2 * every


def test_an_unfinished_layer_is_not_read_and_is_written_again(spark, tmp_path):
    keys, where = ["corpus_id", "note_id"], str(tmp_path / "store")
    sink = store.merge(where, keys=keys, corpus="corpus_id", order="seq")
    for number in (0, 1):
        sink(spark.createDataFrame(BATCHES[number], KINDS), number)
    (tmp_path / "store/rows/layer=1/_SUCCESS").unlink()
    assert {(r.corpus_id, r.note_id): (r.order, r.text, r.writes) for r in store.notes(spark, where, keys=keys).collect()} == expected(1)
    sink(spark.createDataFrame(BATCHES[1], KINDS), 1)
    assert {(r.corpus_id, r.note_id): (r.order, r.text, r.writes) for r in store.notes(spark, where, keys=keys).collect()} == expected(2)


def test_only_changed_texts_reach_the_model(spark, tmp_path):
    keys, where = ["corpus_id", "note_id"], str(tmp_path / "store")
    seen = str(tmp_path / "seen")

    def load():
        def run(texts):
            texts = [str(t) for t in np.ravel(texts)]
            with open(seen, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return hashing_vectors(texts)

        return run

    sink = store.merge(where, keys=keys, corpus="corpus_id", order="seq", load=load)
    for number in (0, 1):
        sink(spark.createDataFrame(BATCHES[number], KINDS), number)
    assert sorted(open(seen).read().split("\n")) == sorted(["one", "two", "three", "", "one again", ""])
