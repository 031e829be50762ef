"""Model switches: whole versions, pinned readers, refused writers."""

import pytest

from quillspan.sources import models


def test_switch_is_seen_whole(spark, tmp_path):
    store = str(tmp_path / "models")
    notes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "corpus_id string, note_id int")
    vectors = notes.crossJoin(spark.createDataFrame([("old",), ("new",)], "model_id string")).filter("not (corpus_id = 'b' and model_id = 'new')")
    change = lambda *rows: spark.createDataFrame(rows, models.POINTER)
    seen = lambda which: {tuple(r) for r in models.in_use(vectors, which).select("corpus_id", "note_id", "model_id").collect()}
    assert models.pointer(spark, store).count() == 0
    assert models.switch(change(("a", "old"), ("b", "old")), vectors, notes, store) == 1
    pinned = models.pointer(spark, store)
    assert models.switch(change(("a", "new")), vectors, notes, store) == 2
    assert seen(pinned) == {("a", 1, "old"), ("a", 2, "old"), ("b", 3, "old")}
    assert seen(models.pointer(spark, store)) == {("a", 1, "new"), ("a", 2, "new"), ("b", 3, "old")}
    with pytest.raises(ValueError, match="missing"):
        models.switch(change(("b", "new")), vectors, notes, store)
    with pytest.raises(ValueError, match="one model"):
        models.switch(change(("a", "new"), ("a", "old")), vectors, notes, store)
    assert models.newest(spark, store) == 2
    # a writer that died left its claim and unfinished rows: readers don't see them, others wait until it is abandoned
    (tmp_path / "models" / "claim-3").touch()
    (tmp_path / "models" / "version=3").mkdir()
    assert seen(models.pointer(spark, store)) == {("a", 1, "new"), ("a", 2, "new"), ("b", 3, "old")}
    with pytest.raises(RuntimeError, match="being written"):
        models.switch(change(("a", "old")), vectors, notes, store)
    models.abandon(spark, store)
    assert models.switch(change(("a", "old")), vectors, notes, store) == 3
    assert seen(models.pointer(spark, store)) == {("a", 1, "old"), ("a", 2, "old"), ("b", 3, "old")}
