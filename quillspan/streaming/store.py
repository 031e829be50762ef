"""A store of notes with their vectors, merged batch by batch: only changed texts are embedded, and old layers are compacted.

Every batch adds a layer with the notes that it changed, under its number, and one with what that adds to and takes from each
corpus's vector sum. Every so many batches the layers up to there become one base. Readers take the newest complete base and
the complete layers after it; a base and its layers stay until the base after the next is there, for readers that began before.

Defined cases: a batch that runs again changes nothing once its layer is complete, and writes the same layer before; of events for
one note the greatest (order, op, text) wins, so late events lose and ties don't depend on arrival; a null text is empty; a null key is a key; a removed
note keeps its place without a vector, so that later its late events lose too; an empty batch is an empty layer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import vec
from quillspan.operators import embed
from quillspan.sources.shared import written

#: Layers that become one base.
EVERY = 16


def _fs(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(where).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _complete(spark: SparkSession, where: str) -> bool:
    fs, path = _fs(spark, where)
    return fs.exists(path(f"{where}/_SUCCESS"))


def _layers(spark: SparkSession, kind: str, below: int | None = None) -> tuple[list[int], list[int]]:
    """Numbers of complete bases and layers under ``kind``, those below a number only."""
    fs, path = _fs(spark, kind)
    names = [f.getPath().getName().split("=") for f in fs.listStatus(path(kind))] if fs.exists(path(kind)) else []
    known = [(n[0], int(n[1])) for n in names if len(n) == 2 and (below is None or int(n[1]) < below)]
    done = [(what, n) for what, n in known if _complete(spark, f"{kind}/{what}={n}")]
    return tuple(sorted(n for what, n in done if what == wanted) for wanted in ("base", "layer"))


def _read(spark: SparkSession, kind: str, below: int | None = None) -> DataFrame | None:
    """All rows of the newest base and the layers after it, None where there are none."""
    bases, layers = _layers(spark, kind, below)
    paths = [f"{kind}/base={n}" for n in bases[-1:]] + [f"{kind}/layer={n}" for n in layers if not bases or n > bases[-1]]
    return spark.read.parquet(*paths) if paths else None


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("e")).select(*keys, "e.*")


def _summed(rows: DataFrame, corpus: str) -> DataFrame:
    """(corpus, n, s) of rows(corpus, n, s)."""
    return rows.groupBy(corpus).agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("s")).alias("s")).select(corpus, "n", vector_to_array("s").alias("s"))


def _put(rows: DataFrame, where: str) -> None:
    if not _complete(rows.sparkSession, where):
        rows.write.mode("overwrite").parquet(where)


def merge(store: str, *, keys: list[str], corpus: str, order: str, op: str = "op", text_col: str = "text", model_id: str = embed.HASHING, load: Callable | None = None, every: int = EVERY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges events(keys, order, op, text) into the store; ``corpus`` is one of the keys.

    A note whose text and model stay keeps its vector; ``writes`` counts how often a note was embedded, ``version`` is the last batch
    that changed it.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not _complete(spark, f"{store}/rows/layer={number}"):
            add(spark, batch, number)
        if (number + 1) % every == 0:
            compact(spark, store, keys=keys, corpus=corpus, upto=number)

    def add(spark: SparkSession, batch: DataFrame, number: int) -> None:
        event = F.struct(F.col(order).alias("order"), F.coalesce(F.col(op), F.lit("add")).alias("op"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        new = batch.groupBy(*keys).agg(F.max(event).alias("new"))
        there = _read(spark, f"{store}/rows", number)
        if there is None:
            both = new.select(*keys, "new", F.lit(None).cast("struct<op: string, cache_key: string, embedding: array<float>, writes: bigint>").alias("old"))
        else:
            asked = new.select(*[F.col(k).alias(f"__{k}") for k in keys])
            same: Column = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
            old = _newest(there.join(asked, same, "left_semi"), keys).select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct("order", "op", "text").alias("stood"), F.struct("op", "cache_key", "embedding", "writes").alias("old"))
            both = new.join(old, same, "left").filter(F.col("stood").isNull() | (F.col("new") > F.col("stood"))).select(*keys, "new", "old")
        keyed = both.withColumn("cache_key", embed.cache_key("new.text", F.lit(model_id)))
        gone = F.col("new.op") == "remove"
        fresh = ~gone & (F.col("old").isNull() | (F.col("old.op") == "remove") | (F.col("old.cache_key") != F.col("cache_key")))
        # written, as the rows go to the model or past it
        changed = written(keyed.withColumn("fresh", fresh), "changed")
        vector = lambda which, value: changed.filter(which).withColumn("embedding", value)
        whole = vector(F.col("fresh"), embed.embedding("new.text", load).cast("array<float>")).unionByName(vector(~F.col("fresh"), F.when(~gone, F.col("old.embedding"))))
        rows = written(whole.withColumn("writes", F.coalesce("old.writes", F.lit(0)) + F.col("fresh").cast("bigint")), "merged")
        signed = lambda v, n: rows.filter(F.size(v) > 0).select(corpus, F.lit(n).cast("bigint").alias("n"), vec.scaled(vec.as_double(v), F.lit(float(n))).alias("s"))
        # the layer of notes comes last: with it the batch is complete
        _put(_summed(signed("embedding", 1).unionByName(signed("old.embedding", -1)), corpus), f"{store}/sums/layer={number}")
        _put(rows.select(*keys, "new.*", "cache_key", "embedding", F.col("writes").cast("bigint").alias("writes"), F.lit(number).cast("bigint").alias("version")), f"{store}/rows/layer={number}")

    return sink


def compact(spark: SparkSession, store: str, *, keys: list[str], corpus: str, upto: int) -> None:
    """One base of all layers up to a number; what the base before it had replaced goes."""
    for kind, whole in (("sums", lambda rows: _summed(rows, corpus)), ("rows", lambda rows: _newest(rows, keys))):
        there = _read(spark, f"{store}/{kind}", upto + 1)
        if there is not None:
            _put(whole(there), f"{store}/{kind}/base={upto}")
        bases, layers = _layers(spark, f"{store}/{kind}", upto)
        if bases:
            fs, path = _fs(spark, store)
            for what, n in [("base", n) for n in bases[:-1]] + [("layer", n) for n in layers if n <= bases[-1]]:
                fs.delete(path(f"{store}/{kind}/{what}={n}"), True)


def notes(spark: SparkSession, store: str, *, keys: list[str]) -> DataFrame:
    """(keys, order, op, text, cache_key, embedding, writes, version) of the notes that are in."""
    there = _read(spark, f"{store}/rows")
    if there is None:
        raise ValueError(f"no complete layer in {store}")
    return _newest(there, keys).filter("op <> 'remove'")


def centroids(spark: SparkSession, store: str, *, corpus: str) -> DataFrame:
    """(corpus, n, embedding): the mean of each corpus's vectors from the sums alone."""
    there = _read(spark, f"{store}/sums")
    if there is None:
        raise ValueError(f"no complete layer in {store}")
    return _summed(there, corpus).filter("n > 0").select(corpus, "n", F.transform("s", lambda x: x / F.col("n")).alias("embedding"))
