"""Which model's vectors each corpus is read by, as versions that become visible whole.

A version is a table(corpus_id, model_id) under the store. Its writer first claims the version's number by creating a file that
must not exist; readers take the newest version that is marked complete and stay with it, so a reader during a switch sees the
old model for all corpora or the new one for all that the switch names.

Defined cases: a store without versions has an empty pointer; a switch of no corpora is a version like the one before; a corpus
named twice with different models, or a null corpus or model, is refused; a corpus that isn't named keeps its model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "corpus_id string, model_id string"


def _files(spark: SparkSession, store: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(store).getFileSystem(spark._jsc.hadoopConfiguration()), path


def newest(spark: SparkSession, store: str) -> int:
    """The newest complete version's number, 0 where there is none."""
    fs, path = _files(spark, store)
    if not fs.exists(path(store)):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(path(store))]
    found = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
    return max((n for n in found if fs.exists(path(f"{store}/version={n}/_SUCCESS"))), default=0)


def pointer(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """(corpus_id, model_id) of one version, the newest when it is called; later switches don't change it."""
    n = newest(spark, store) if version is None else version
    return spark.read.schema(POINTER).parquet(f"{store}/version={n}") if n else spark.createDataFrame([], POINTER)


def switch(changes: DataFrame, vectors: DataFrame, notes: DataFrame, store: str, *, note_id: str = "note_id") -> int:
    """Commit changes(corpus_id, model_id) as the next version and return its number.

    Every note of a changed corpus must have its vector(corpus_id, note_id, model_id) of the new model, else nothing is
    committed. Of two writers at once one is refused; a writer that died leaves its claim, which ``abandon`` removes.
    """
    spark = changes.sparkSession
    new = changes.select(F.col("corpus_id").cast("string").alias("corpus_id"), F.col("model_id").cast("string").alias("model_id")).distinct()
    if not new.filter("corpus_id is null or model_id is null").isEmpty() or not new.groupBy("corpus_id").count().filter("count > 1").isEmpty():
        raise ValueError("each changed corpus needs one model")
    wanted = notes.select(F.col("corpus_id").cast("string").alias("corpus_id"), note_id).join(new, "corpus_id")
    have = vectors.select(F.col("corpus_id").cast("string").alias("corpus_id"), note_id, F.col("model_id").cast("string").alias("model_id"))
    if not wanted.join(have, ["corpus_id", note_id, "model_id"], "left_anti").isEmpty():
        raise ValueError("vectors of the new model are missing")
    fs, path = _files(spark, store)
    n = newest(spark, store) + 1
    if not fs.createNewFile(path(f"{store}/claim-{n}")):
        raise RuntimeError(f"version {n} is being written")
    # the claim is ours: what was newest still is, and a dead writer's unfinished rows go
    kept = pointer(spark, store, n - 1).join(new, "corpus_id", "left_anti")
    kept.unionByName(new).write.mode("overwrite").parquet(f"{store}/version={n}")
    return n


def abandon(spark: SparkSession, store: str) -> None:
    """Remove the claim of a writer that died before its version was complete."""
    fs, path = _files(spark, store)
    fs.delete(path(f"{store}/claim-{newest(spark, store) + 1}"), False)


def in_use(vectors: DataFrame, which: DataFrame) -> DataFrame:
    """The vectors(corpus_id, model_id, ...) that a pinned pointer names."""
    return vectors.join(which, ["corpus_id", "model_id"], "left_semi")
