"""Note events as streams: admission, latest state, debounce, counts since a baseline, refits."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspan.functions import text as T
from quillspan.operators.admit import MAX_CHARACTERS, MAX_NOTES, Session, latest_state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Admission(StatefulProcessor):
    """One corpus's session as state; the fold is that of the batch operator."""

    def __init__(self, max_notes: int, max_characters: int):
        self.limits = (max_notes, max_characters)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "keys string, sizes string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        keys, sizes = map(json.loads, self.state.get() if self.state.exists() else ("{}", "{}"))
        session = Session(*self.limits, keys, sizes)
        events = pd.concat(list(rows)).sort_values("seq")
        done = [session.apply(op, note, text, int(size)) for op, note, text, size in zip(events["op"], events["note_id"], events["key"], events["size"])]
        self.state.update((json.dumps(session.keys), json.dumps(session.sizes)))
        yield pd.DataFrame({"corpus_id": [key[0]] * len(done), "seq": events["seq"].to_numpy(), "note_id": events["note_id"].to_numpy(), "status": [s for s, _ in done], "reason": [r for _, r in done]})

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, *, max_notes: int = MAX_NOTES, max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """(corpus_id, seq, note_id, status, reason) of a stream(corpus_id, seq, op, note_id, text); serial within a corpus.

    Needs the RocksDB state store. State holds the notes that are in, so the budgets bound it.
    """
    base = events.select("corpus_id", "seq", F.coalesce("op", F.lit("add")).alias("op"), F.col("note_id").cast("string").alias("note_id"), F.coalesce(T.dedupe_key("text"), F.lit("")).alias("key"), F.coalesce(T.utf16_length(T.trimmed("text")), F.lit(0)).alias("size"))
    kind = dict(base.dtypes)["corpus_id"]
    return base.groupBy("corpus_id").transformWithStateInPandas(_Admission(max_notes, max_characters), f"corpus_id {kind}, seq bigint, note_id string, status string, reason string", "append", "none")


def keep_latest(store: str, *, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each batch's last event by note goes to ``store`` as one more version; reading takes the last.

    A late event is older than what stands and loses when read; a batch that runs twice changes nothing.
    """

    def sink(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("e"), F.min(order).alias("__first"))
        last.select(*keys, "e.*", "__first").write.mode("overwrite").parquet(f"{store}/batch={number}")

    return sink


def current_state(spark, store: str, *, keys: list[str], order: str) -> DataFrame:
    return latest_state(spark.read.parquet(store).drop("batch", "__first"), keys=keys, order=order)


def debounce(events: DataFrame, *, by: str, time: str, value: str, gap: str = "300 milliseconds", late: str | None = "10 minutes") -> DataFrame:
    """(by, value, started, settled): one row for each burst, its last value; works on streams and tables."""
    timed = events.withWatermark(time, late) if events.isStreaming and late else events
    return timed.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.max_by(value, time).alias(value), F.count("*").alias("n")).select(by, value, "n", F.col("w.start").alias("started"), F.col("w.end").alias("settled"))


def since_baseline(events: DataFrame, *, by: str, time: str, kind: str, ready: str) -> DataFrame:
    """(by, n): events from each key's first ``ready`` event on; keys without one count 0."""
    first = events.filter(F.col(kind) == ready).groupBy(by).agg(F.min(time).alias("__first"))
    return events.select(by, time).join(first, by, "left").groupBy(by).agg(F.count_if(F.coalesce(F.col(time) >= F.col("__first"), F.lit(False))).alias("n"))


class _Baseline(StatefulProcessor):
    """The first ``ready`` so far, the events counted from it on, and how many there were at each time before it."""

    def __init__(self, kind: str, bounded: bool):
        self.kind, self.bounded = kind, bounded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("count", f"first {self.kind}, n bigint")
        self.before = handle.getMapState("before", f"t {self.kind}", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, n = self.state.get() if self.state.exists() else (None, 0)
        events = pd.concat(list(rows))
        events = events[events["known"]]
        ready = events.loc[events["ready"], "t"].tolist()
        if ready and (first is None or min(ready) < first):  # the baseline moves back, over events seen before
            first = min(ready)
            for (t,), (m,) in list(self.before.iterator()):
                if t >= first:
                    n += m
                    self.before.removeKey((t,))
        for t, m in Counter(events["t"].tolist()).items():
            if first is not None and t >= first:
                n += m
                continue
            seen = self.before.getValue((t,))[0] if self.before.containsKey((t,)) else 0
            self.before.updateValue((t,), (seen + m,))
            if self.bounded:
                self.handle.registerTimer(t // 1000 + 1)
        self.state.update((first, n))
        yield pd.DataFrame({"k": [key[0]], "n": [n]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """No ``ready`` as old as these events is let in any more, so they will never count."""
        gone = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for (t,) in [k for k in self.before.keys() if k[0] < gone]:
            self.before.removeKey((t,))
        return iter([])

    def close(self) -> None:
        pass


def since_baseline_stream(events: DataFrame, *, by: str, time: str, kind: str, ready: str, late: str | None = None) -> DataFrame:
    """The running count after each micro-batch, as ``since_baseline`` has it for all events so far, in whatever order they arrive.

    An earlier ``ready`` that arrives late moves the baseline back. For that, state holds a count for each time before the
    baseline: without ``late`` of all such times; with it (``time`` is a timestamp then) events later than that are dropped, and
    times that the watermark has passed leave the state. Events without a time don't count.
    """
    timed = events.withWatermark(time, late) if late else events
    at = F.col(time)
    if dict(events.dtypes)[time].startswith("timestamp"):
        at = F.unix_micros(at.cast("timestamp"))
    elif late:
        raise ValueError("late needs a time column of type timestamp")
    known = at.isNotNull()
    base = timed.select(F.col(by).alias("k"), at.alias("t"), known.alias("known"), (known & F.coalesce(F.col(kind) == ready, F.lit(False))).alias("ready"), *([F.col(time).alias("at")] if late else []))
    kinds = dict(base.dtypes)
    # a null would make whole numbers floating in the state's frames
    whole = base.withColumn("t", F.coalesce("t", F.lit("0").cast(kinds["t"])))
    out = whole.groupBy("k").transformWithStateInPandas(_Baseline(kinds["t"], bool(late)), f"k {kinds['k']}, n bigint", "update", "eventTime" if late else "none")
    return out.withColumnRenamed("k", by)


def on_change(refit: Callable[[DataFrame], None], *, corpus: str = "corpus_id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands the batch's corpora to ``refit`` (a projection, new embeddings)."""

    def run(batch: DataFrame, number: int) -> None:
        dirty = batch.select(corpus).distinct()
        if not dirty.isEmpty():
            refit(dirty)

    return run


def switch_model(pointer: DataFrame, corpus_id: str, model_id: str) -> DataFrame:
    """The pointer table(corpus_id, model_id) after all of a corpus's vectors of the new model are there: one row changes."""
    spark = pointer.sparkSession
    return pointer.filter(F.col("corpus_id") != corpus_id).unionByName(spark.createDataFrame([(corpus_id, model_id)], pointer.schema))
