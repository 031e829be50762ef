"""Admission, states, floors, and the streams that must equal their batches."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import admit
from quillspan.operators.admit import Session
from quillspan.streaming import notes

EVENT = "corpus_id string, seq bigint, op string, note_id string, text string"


def test_session_rules():
    s = Session(max_notes=2, max_characters=10)
    assert s.add("a", "", 0) == ("empty", None)
    assert s.add("a", "one", 3) == ("added", None)
    assert s.add("b", "one", 3) == ("duplicate", None)
    assert s.add("b", "x" * 8, 8) == ("capped", "characters")
    assert s.add("b", "x" * 7, 7) == ("added", None)  # the exact boundary, and the refused one used up nothing
    assert s.add("c", "y" * 99, 99) == ("capped", "notes")  # notes are counted first
    assert s.edit("a", "x" * 7, 7) == ("duplicate", None) and s.edit("a", "one", 3) == ("edited", None)
    assert s.edit("z", "q", 1) == ("not-found", None) and s.edit("a", "", 0) == ("empty", None)
    assert s.edit("a", "w" * 50, 50) == ("edited", None)  # edits know no budget
    assert s.remove("b") == ("removed", None) and s.remove("b") == ("not-found", None)


def random_events(n, seed=1):
    rng = random.Random(seed)
    return [(f"c{rng.randrange(3)}", i, rng.choice(["add", "add", "add", "edit", "remove"]), f"n{rng.randrange(12)}", rng.choice(["alpha", "beta ", " beta", "gamma", "", "delta " * rng.randint(1, 9), "é", "é"])) for i in range(n)]


def by_hand(events, **limits):
    import unicodedata

    sessions, out = {}, []
    for c, i, op, note, text in events:
        key = unicodedata.normalize("NFC", text).strip()
        out.append((c, i, note, *sessions.setdefault(c, Session(**limits)).apply(op, note, key, len(text.strip()))))
    return sorted(out, key=repr)


def test_admission_is_the_fold_in_any_partitioning(spark):
    events = random_events(200)
    limits = {"max_notes": 5, "max_characters": 90}
    for n in (1, 5):
        table = spark.createDataFrame(events, EVENT).repartition(n, F.rand(3))
        got = admit.admit(table, op="op", **limits).collect()
        assert sorted(map(tuple, got), key=repr) == by_hand(events, **limits)
    assert admit.admit(spark.createDataFrame([], EVENT)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", notes.ROCKSDB)
    events = random_events(60)
    limits = {"max_notes": 4, "max_characters": 60}
    for k in range(3):
        (tmp_path / f"in{k}.json").write_text("\n".join(json.dumps(dict(zip(("corpus_id", "seq", "op", "note_id", "text"), e))) for e in events[20 * k : 20 * k + 20]))
        import os

        os.utime(tmp_path / f"in{k}.json", (1000 + k, 1000 + k))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in*.json"))
    q = notes.admit_stream(stream, **limits).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("admitted").collect()), key=repr) == by_hand(events, **limits)


def test_first_of_each_and_present(spark):
    table = spark.createDataFrame([("c", "2", 2, "café"), ("c", "1", 1, "café "), ("d", "3", 3, "café"), ("c", "4", 4, "  "), ("c", "5", 5, "Café"), ("c", "6", 6, None)], "corpus_id string, note_id string, seq int, text string")
    assert sorted(r.note_id for r in admit.first_of_each(table).collect()) == ["1", "3", "5"]
    new = spark.createDataFrame([("9", "CAFÉ"), ("8", "café"), ("7", ""), ("1", "café")], "note_id string, text string")
    assert sorted(r.note_id for r in admit.not_present(new, table).collect()) == ["7", "9"]
    assert sorted(r.note_id for r in admit.not_present(new, table.filter("note_id = '1'"), other_than="note_id").collect()) == ["1", "7", "9"]
    assert sorted(r.note_id for r in admit.without(table, new).collect()) == ["2", "3", "4", "5", "6"]


def test_latest_state(spark):
    events = [("c", "a", 1, "add", "x"), ("c", "a", 3, "edit", "y"), ("c", "b", 2, "add", "z"), ("c", "b", 4, "remove", None), ("d", "a", 9, "add", "w")]
    table = spark.createDataFrame(events, "corpus_id string, note_id string, t int, op string, text string")
    got = admit.latest_state(table, keys=["corpus_id", "note_id"], order="t").collect()
    assert sorted((r.corpus_id, r.note_id, r.text, r.first_seen) for r in got) == [("c", "a", "y", 1), ("d", "a", "w", 9)]


def test_latest_state_from_batches(spark, tmp_path):
    events = [("c", "a", 1, "add", "x"), ("c", "b", 2, "add", "z"), ("c", "a", 5, "edit", "y"), ("c", "a", 3, "edit", "late"), ("c", "b", 6, "remove", None)]
    schema = "corpus_id string, note_id string, t int, op string, text string"
    sink = notes.keep_latest(str(tmp_path), keys=["corpus_id", "note_id"], order="t")
    for k in (0, 1, 1, 2):  # one batch runs twice
        sink(spark.createDataFrame(events[2 * k : 2 * k + 2], schema), k)
    got = notes.current_state(spark, str(tmp_path), keys=["corpus_id", "note_id"], order="t").collect()
    assert [(r.note_id, r.text, r.t) for r in got] == [("a", "y", 5)]


def test_floors_totals_and_preload(spark):
    table = spark.createDataFrame([("c", "x\U0001f44d"), ("c", "y"), ("d", "z")], "corpus_id string, text string")
    got = {r.corpus_id: tuple(r)[1:] for r in admit.floor_status(table).collect()}
    assert got == {"c": (2, 1, 3, 13), "d": (1, 2, 4, 14)}
    assert {r.corpus_id: (r.n_notes, r.n_characters) for r in admit.session_totals(table).collect()} == {"c": (2, 4), "d": (1, 1)}
    assert admit.at_least(table, 2).count() == 2
    sample = spark.createDataFrame([("c", "s"), ("e", "s")], "corpus_id string, text string")
    assert [r.corpus_id for r in admit.preload_once(table, sample).collect()] == ["e"]
    assert [r.seq for r in admit.numbered(table, corpus="corpus_id", by="text").orderBy("corpus_id", "seq").collect()] == [0, 1, 0]


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def test_debounce(spark):
    rows = [("u", at(0), "a"), ("u", at(100), "b"), ("u", at(299), "c"), ("u", at(700), "d"), ("v", at(50), "e")]
    table = spark.createDataFrame(rows, "k string, t timestamp, value string")
    got = notes.debounce(table, by="k", time="t", value="value").collect()
    assert sorted((r.k, r.value, r.n) for r in got) == [("u", "c", 3), ("u", "d", 1), ("v", "e", 1)]


def test_debounce_stream(spark, tmp_path):
    rows = [("u", at(0), "a"), ("u", at(200), "b"), ("u", at(900), "c"), ("z", at(60_000), "last")]
    spark.createDataFrame(rows, "k string, t timestamp, value string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp, value string").parquet(str(tmp_path / "in"))
    q = notes.debounce(stream, by="k", time="t", value="value", late="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.value) for r in spark.table("bursts").collect()) == [("u", "b"), ("u", "c")]  # the last burst is still open


def test_since_baseline(spark, tmp_path):
    rows = [("u", 1, "x"), ("u", 2, "ready"), ("u", 3, "x"), ("u", 4, "ready"), ("v", 1, "x")]
    table = spark.createDataFrame(rows, "k string, t int, kind string")
    options = {"by": "k", "time": "t", "kind": "kind", "ready": "ready"}
    assert {r.k: r.n for r in notes.since_baseline(table, **options).collect()} == {"u": 3, "v": 0}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", notes.ROCKSDB)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = notes.since_baseline_stream(stream, **options).writeStream.format("memory").queryName("since").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {r.k: r.n for r in spark.table("since").collect()} == {"u": 3, "v": 0}


@pytest.mark.parametrize("late", [None, "2 hours"])
def test_since_baseline_in_any_order(spark, tmp_path, late):
    draw = random.Random(5)
    rows = [(f"u{draw.randrange(6)}", dt.datetime(2024, 3, 1) + dt.timedelta(seconds=draw.randrange(3600)), draw.choice(["x", "x", "y", None, "ready"])) for _ in range(300)] + [("u0", None, "ready"), ("none", None, "ready")]
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, t timestamp, kind string")
    options = {"by": "k", "time": "t", "kind": "kind", "ready": "ready"}
    for n in range(5):
        spark.createDataFrame(rows[n::5], table.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", notes.ROCKSDB)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = "shuffled_" + ("bounded" if late else "whole")
    q = notes.since_baseline_stream(stream, late=late, **options).writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(240)
    got = {r.k: r.n for r in spark.table(name).groupBy("k").agg({"n": "max"}).toDF("k", "n").collect()}
    want = {r.k: r.n for r in notes.since_baseline(table, **options).collect()}
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n} and sum(want.values()) > 200


def test_refits_and_pointers(spark):
    seen = []
    run = notes.on_change(lambda dirty: seen.extend(r.corpus_id for r in dirty.collect()))
    run(spark.createDataFrame([("c", 1), ("c", 2)], "corpus_id string, x int"), 0)
    run(spark.createDataFrame([], "corpus_id string, x int"), 1)
    assert seen == ["c"]
    pointer = spark.createDataFrame([("c", "old"), ("d", "old")], "corpus_id string, model_id string")
    assert {tuple(r) for r in notes.switch_model(pointer, "c", "new").collect()} == {("c", "new"), ("d", "old")}
