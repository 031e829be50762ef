"""Which texts hold which patterns, for any number of patterns: one pass over the texts, without comparing each with each.

A pattern's anchor is the hash of its first 2^j bytes, the greatest power of two within it (256 at most), so an anchor covers more
than half of a pattern of up to 511 bytes. Tasks hash all windows of these lengths in a text, each from two of half its length,
and look them up in a bit array of all anchors. Only texts with a hit are written; hits meet the patterns by their hash,
and a byte-wise comparison decides, so results are exact whatever the bits say.

Defined cases: null and empty patterns are in no text, null texts hold nothing; equal patterns of different ids each count, and
so does each of equal texts; a pattern that a text holds more than once is one row, at its first place; case counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.sources.shared import written

#: Longest anchor in bytes.
ANCHOR = 256
#: Bits for each pattern, how many of them it sets, and the greatest size of the array whatever their number: 2^27 bits, 16 MB.
#: One window in 30 million is a false hit for up to 2 million patterns; more patterns only cost more comparisons.
BITS_EACH, PROBES, MOST_BITS = 64, 8, 27
#: Windows hashed together, and bytes of the texts that are searched together, or one text.
STEP, SLICE = 1 << 18, 4 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _twice(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``2 n`` bytes from those of ``n``."""
    return _mixed(h[:-n] * np.uint64(0xC2B2AE3D27D4EB4F) + h[n:])


def _place(h: np.ndarray, probe: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bit within it) of a hash's probe in an array of 2^wide bits."""
    at = (h * np.uint64(2 * probe + 1 | probe << 40)) >> np.uint64(64 - wide)
    return at >> np.uint64(6), at & np.uint64(63)


def _anchor(text: bytes) -> tuple[int, int]:
    """(length, signed hash) of a pattern's anchor."""
    n = min(1 << (len(text).bit_length() - 1), ANCHOR)
    h, k = BYTE[np.frombuffer(text[:n], np.uint8)], 1
    while k < n:
        h, k = _twice(h, k), 2 * k
    return n, int(h.view(np.int64)[0])


def _hits(data: np.ndarray, offsets: np.ndarray, lengths: list[int], bits: np.ndarray, wide: int, step: int = STEP) -> pd.DataFrame:
    """Different (text, n, h) of all windows within texts whose bit is set."""
    found = [(np.empty(0, np.int64), 0, np.empty(0, np.uint64))]
    for start in range(0, len(data), step):
        h, n = BYTE[data[start : start + step + lengths[-1] - 1]], 1
        while len(h):
            if n in lengths:
                i = np.arange(len(h[:step]))
                for probe in range(PROBES):
                    word, bit = _place(h[i] if probe else h[:step], probe, wide)
                    i = i[((bits[word] >> bit) & np.uint64(1)).astype(bool)]
                text = np.searchsorted(offsets, i + start, "right") - 1
                inside = i + start + n <= offsets[text + 1]
                found.append((text[inside], n, h[i[inside]]))
            if n >= lengths[-1]:
                break
            h, n = _twice(h, n), 2 * n
    rows = pd.DataFrame({"text": np.concatenate([f[0] for f in found]), "n": np.concatenate([np.full(len(f[0]), f[1], np.int32) for f in found]), "h": np.concatenate([f[2] for f in found]).view(np.int64)})
    return rows.drop_duplicates()


def _slices(text: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of about ``SLICE`` bytes; no text is copied."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    start = 0
    while start < len(text):
        stop = max(int(np.searchsorted(offsets, offsets[start] + SLICE, "right")) - 1, start + 1)
        yield start, text.slice(start, stop - start)
        start = stop


def _anchored(patterns: DataFrame) -> DataFrame:
    def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [_anchor(t.encode()) for t in frame["pattern"]]
            yield frame.assign(n=[m[0] for m in made], h=[m[1] for m in made])

    fields = ", ".join(f"{n} {t}" for n, t in patterns.dtypes)
    return written(patterns.mapInPandas(anchors, f"{fields}, n int, h bigint").withColumn("k", F.monotonically_increasing_id()), "patterns")


def scan(documents: DataFrame, patterns: DataFrame, *, doc_id: str = "doc_id", channels: list[str], pattern_id: str = "item_id", pattern_col: str = "text") -> DataFrame:
    """(doc_id, channel, pattern_id, at, snippet): each column of ``channels`` that holds a pattern, the first place (from 1) and 200 characters from it."""
    spark = documents.sparkSession
    p = _anchored(patterns.select(F.col(pattern_id).alias("p"), F.col(pattern_col).cast("string").alias("pattern")).filter("pattern <> ''"))
    known = p.groupBy("n").count().orderBy("n").collect()
    # a row for each power of two
    lengths, total = [r["n"] for r in known], sum(r["count"] for r in known)
    wide = min(max((BITS_EACH * total - 1).bit_length(), 10), MOST_BITS)

    def spots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for probe in range(PROBES):
                word, bit = _place(frame["h"].to_numpy().view(np.uint64), probe, wide)
                yield pd.DataFrame({"w": word.view(np.int64), "bits": (np.uint64(1) << bit).view(np.int64)})

    words = p.select("h").mapInPandas(spots, "w bigint, bits bigint").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (wide - 6), np.uint64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)
    d = documents.select(F.col(doc_id).alias("d"), *[F.col(c).cast("string").alias(f"c{j}") for j, c in enumerate(channels)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, channel in enumerate(channels):
                whole = pc.fill_null(batch.column(f"c{j}"), "").cast(pa.large_string())
                for start, text in _slices(whole) if len(whole) and lengths else ():
                    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                    hits = _hits(data, offsets - offsets[0], lengths, shared.value, wide).sort_values("text", kind="stable")
                    rows, first = np.unique(hits["text"].to_numpy(), return_index=True)
                    if len(rows):
                        pairs = pa.StructArray.from_arrays([pa.array(hits["n"].to_numpy()), pa.array(hits["h"].to_numpy())], ["n", "h"])
                        take = pa.array(rows)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("d").take(pa.array(rows + start)), pa.array([channel] * len(rows), pa.string()), text.take(take).cast(pa.string()), pa.ListArray.from_arrays(pa.array(np.append(first, len(hits)), pa.int32()), pairs)],
                            ["d", "channel", "text", "hits"],
                        )

    touched = written(d.mapInArrow(find, f"d {dict(d.dtypes)['d']}, channel string, text string, hits array<struct<n: int, h: bigint>>").withColumn("r", F.monotonically_increasing_id()), "touched")
    # the texts wait until it is known which patterns they are compared with
    pairs = touched.select("r", F.inline("hits")).join(p.select("n", "h", "k"), ["n", "h"]).select("r", "k")
    met = touched.drop("hits").join(pairs, "r").join(p.select("k", "p", "pattern"), "k").filter(F.col("text").contains(F.col("pattern")))
    return met.select(F.col("d").alias(doc_id), "channel", F.col("p").alias(pattern_id), F.instr("text", F.col("pattern")).alias("at"), F.substr("text", F.instr("text", F.col("pattern")), F.lit(200)).alias("snippet"))
