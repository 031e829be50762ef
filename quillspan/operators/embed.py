"""Texts to unit vectors: the user's model, or a hashing embedder that needs none; only what changed is embedded again."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillspan.operators.vectors import centroids

DIMENSIONS = 64
HASHING = "hash-ngram-64"


#: CRC-32 of each byte.
_CRC = np.array([zlib.crc32(bytes([b])) ^ 0xFF000000 for b in range(256)], np.uint32)
_CRC = _CRC ^ _CRC[0]
#: Characters hashed together, about.
STEP = 1 << 18


def _gram_hashes(points: np.ndarray, *sizes: int) -> Iterator[np.ndarray]:
    """CRC-32 of the UTF-8 bytes of every run of so many code points, for each of the rising ``sizes``: a longer run's goes on from a shorter's."""
    crc = np.full(len(points), 0xFFFFFFFF, np.uint32)
    wide = bool(len(points)) and int(points.max()) >= 0x80
    for k in range(max(sizes)):
        c = points[k:]
        before, crc = crc[: len(c)], crc[: len(c)]
        crc = _CRC[(crc ^ c) & 0xFF] ^ (crc >> 8)
        at = np.flatnonzero(c >= 0x80) if wide else ()
        if len(at):
            c, now = c[at], before[at]
            size = 2 + (c >= 0x800) + (c >= 0x10000)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[size]
            for byte in range(4):
                left = np.maximum(size - 1 - byte, 0).astype(np.uint32) * 6
                b = (c >> left) & 0x3F | 0x80 if byte else c >> left | lead
                now = np.where(size > byte, _CRC[(now ^ b) & 0xFF] ^ (now >> 8), now)
            crc[at] = now
        if k + 1 in sizes:
            yield crc ^ np.uint32(0xFFFFFFFF)


def hashing_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed feature hashing of character 3- and 4-grams, L2-normalised; an empty text is the zero vector."""
    out = np.zeros((len(texts), dimensions), np.float32)
    padded = [f" {(text or '').lower()} " for text in texts]
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(padded[stop]) <= STEP):
            size += len(padded[stop])
            stop += 1
        points = np.frombuffer("".join(padded[start:stop]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(p) for p in padded[start:stop]])
        row, ends = np.repeat(np.arange(stop - start) * 2 * dimensions, lengths), np.repeat(np.cumsum(lengths), lengths)
        counts = np.zeros((stop - start) * 2 * dimensions, int)
        for n, h in zip((3, 4), _gram_hashes(points, 3, 4)):
            inside = np.arange(n, len(h) + n) <= ends[: len(h)]
            counts += np.bincount(row[: len(h)][inside] + h[inside] % (2 * dimensions), minlength=len(counts))
        # the lowest bit is the sign
        counts = counts.reshape(-1, dimensions, 2)
        counts = (counts[..., 1] - counts[..., 0]).astype(float)
        counts[[p.isspace() for p in padded[start:stop]]] = 0
        squares, rows = (counts * counts).sum(axis=1), counts.astype(np.float32)
        # up to 2^24 a sum of squares is exact in single precision too; of longer texts each norm is rounded on its own
        norms = np.sqrt(squares.astype(np.float32))
        for at in np.flatnonzero(squares >= 1 << 24):
            norms[at] = np.linalg.norm(rows[at])
        out[start:stop] = np.divide(rows, norms[:, None], out=np.zeros_like(rows), where=norms[:, None] > 0)
        start = stop
    return out


def hashing_embedder(dimensions: int = DIMENSIONS) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """In the form that a user's model takes: a function that loads it and returns one from texts to vectors."""
    return lambda: lambda texts: hashing_vectors([str(t) if t is not None else "" for t in np.ravel(texts).tolist()], dimensions)


@F.arrow_udf(ArrayType(FloatType()))
def _hashed(texts: pa.Array) -> pa.Array:
    vectors = hashing_vectors(texts.to_pylist())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * DIMENSIONS, pa.int32()), pa.array(vectors.ravel()))


def embedding(text: Column | str, load: Callable | None = None, *, batch_size: int = 256) -> Column:
    """The text's unit vector. ``load`` runs once for each Python worker; without it, texts are hashed."""
    # not deterministic to the optimizer, which would run the model again for each filter on its vectors
    if load is None:
        return _hashed.asNondeterministic()(text)
    predict = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch_size).asNondeterministic()
    return predict(text)


def embed(chunks: DataFrame, *, model_id: str = HASHING, load: Callable | None = None, text_col: str = "text") -> DataFrame:
    """``chunks`` with model_id and embedding."""
    return chunks.withColumn("model_id", F.lit(model_id)).withColumn("embedding", embedding(F.coalesce(F.col(text_col), F.lit("")), load))


def cache_key(text: Column | str, model_id: Column | str, counter: str = "words") -> Column:
    """What an embedding depends on: the text, how it was cut and the model."""
    return F.sha2(F.concat_ws("\0", text, F.lit(counter), model_id), 256)


def to_embed(chunks: DataFrame, cache: DataFrame, *, model_id: str = HASHING, counter: str = "words") -> DataFrame:
    """Chunks that the cache(cache_key) lacks."""
    keyed = chunks.withColumn("cache_key", cache_key("text", F.lit(model_id), counter))
    return keyed.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def note_vectors(chunks: DataFrame, *, model_id: str = HASHING, load: Callable | None = None) -> DataFrame:
    """(note_id, embedding): every chunk embedded, averaged by note."""
    return centroids(embed(chunks, model_id=model_id, load=load))


def one_model(vectors: DataFrame, *, corpus: str = "corpus_id") -> DataFrame:
    """``vectors``, failing if a corpus mixes models: their vectors can't be compared."""
    seen = vectors.groupBy(corpus).agg(F.count_distinct("model_id").alias("__models"))
    checked = vectors.join(seen, corpus).withColumn(corpus, F.when(F.col("__models") == 1, F.col(corpus)).otherwise(F.raise_error(F.concat(F.lit("vectors of several models in corpus "), F.col(corpus).cast("string")))))
    return checked.select(vectors.columns)


#: What messages of failed allocations hold, in lower case.
MEMORY_SIGNS = ("out of memory", "allocation failed", "memory access out of bounds", "aborted(")


def failure_kind(message: Column | str, error_class: Column | str | None = None) -> Column:
    """``memory`` for messages that tell of it (or range errors), else ``other``; null where there is none."""
    m = F.lower(F.col(message) if isinstance(message, str) else message)
    tells = F.lit(False)
    for sign in MEMORY_SIGNS:
        tells = tells | m.contains(sign)
    if error_class is not None:
        tells = tells | (F.col(error_class) if isinstance(error_class, str) else error_class).isin("RangeError")
    return F.when(m.isNull(), None).when(tells, "memory").otherwise("other")


def embed_safely(chunks: DataFrame, encode: Callable[[list[str]], np.ndarray], *, text_col: str = "text", batch_size: int = 256) -> DataFrame:
    """``chunks`` with embedding, or with the error and its kind where the model failed; no row is lost.

    Texts go to the model in batches; one that fails is halved until the texts that it fails on stand alone.
    """

    def tried(texts: list[str]) -> list[tuple]:
        try:
            return [(np.asarray(v, float).tolist(), None, None) for v in encode(texts)]
        except Exception as wrong:  # kept as a row
            if len(texts) == 1:
                return [(None, str(wrong), type(wrong).__name__)]
            half = len(texts) // 2
            return tried(texts[:half]) + tried(texts[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t or "" for t in frame[text_col]]
            done = [x for at in range(0, len(texts), batch_size) for x in tried(texts[at : at + batch_size])]
            vectors, errors, kinds = zip(*done) if done else ((), (), ())
            yield frame.assign(embedding=list(vectors), error=list(errors), error_class=list(kinds))

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    done = chunks.mapInPandas(run, f"{old}, embedding array<double>, error string, error_class string")
    return done.withColumn("failure_kind", failure_kind("error", F.when(F.col("error_class") == "OverflowError", "RangeError").otherwise(F.col("error_class"))))
