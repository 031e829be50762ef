"""SimHash near-duplicates: pivot distance tables over 64-bit fingerprints, exact for up to two differing bits.

Each distinct fingerprint gets a table of its Hamming distances to many reference fingerprints (pivots).

* 33 of them, a base and the base with the j-th pair of bits turned, tell how many bits of each pair differ from the
  base: (2 - (d_j - d_0)) / 2. Two fingerprints with two differing bits or fewer have the same 16 of these coordinates in at
  least one choice of two of four groups of eight, so candidates are an equality join on six keys a fingerprint.
* 16 seeded pivots discard candidates: by the triangle inequality no coordinate of a linked pair differs by more
  than two (the maximum coordinate difference). The survivors are verified bit by bit.

A key with more than ``BUCKET`` fingerprints isn't paired up but refined: of the coordinates that it doesn't hold yet at most
two differ either, so in four smaller groups of them two must agree again. Keys thus grow with the number of fingerprints,
of 16 coordinates to 24, on which two random fingerprints agree once in 2e10 pairs. What is still dense then is a
cloud of fingerprints that are close in truth. Its members go by another exact way: each names the 65 fingerprints within
one bit of itself, and those that name the same one are linked to the least of them. Two fingerprints name one in common
just when they differ in two bits or fewer, and no more than 65 can name the same, so the work is linear however
large the cloud. Equal texts share a fingerprint and are never paired at all.

Defined cases: a text without words, null or empty, has fingerprint zero and is linked like any other; fewer than three
words are one shingle; equal rows share a class; null ids don't name a class unless it has no other; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, map_texts, written

SHINGLE, SEED, REACH = 3, 42, 2
#: Members of a key that are paired up directly, and times that a larger key is refined.
BUCKET, REFINE = 64, 1
COORDINATES = 32


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pivots(n: int, seed: int) -> list[int]:
    return [int(x) for x in np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, n)]


BASE, *FAR = _pivots(17, 20_240)
PAIRS = [_signed((BASE & (1 << 64) - 1) ^ (3 << 2 * j)) for j in range(COORDINATES)]


def fingerprint_batch(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints as uint64: a bit is set if it is set in over half of the shingles' hashes."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = text.lower().split()  # bytes: A-Z, and x20 and x09-x0D, only
        if not words:
            continue
        runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
        raw = b"".join(map(xxhash.xxh64_digest, map(b" ".join, runs), repeat(SEED)))
        hashes = np.frombuffer(raw, np.uint8).reshape(-1, 8)
        n = len(hashes)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 15):
            ones += np.unpackbits(hashes[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > n).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    work = lambda columns, texts: {"id": columns["id"], "fp": pa.array(fingerprint_batch(texts, shingle).view(np.int64))}
    return map_texts(docs, work, f"id {kind}, fp bigint", text_col=text_col, keep={"id": id_col})


def distance(a: Column | int, b: Column | int) -> Column:
    wrap = lambda x: F.lit(x).cast("bigint") if isinstance(x, int) else x
    return F.bit_count(wrap(a).bitwiseXOR(wrap(b)))


def pivot_table(distinct: DataFrame) -> DataFrame:
    """(fp, turned, far): the coordinates from the distances to the paired pivots, two bits each, and the distances to the far ones."""
    fp = F.col("fp")
    near = distinct.select("fp", distance(fp, BASE).alias("d0"), F.array(*[distance(fp, p) for p in PAIRS]).alias("d"), F.array(*[distance(fp, p).cast("tinyint") for p in FAR]).alias("far"))
    turned = [F.shiftleft(((2 - (F.col("d")[j] - F.col("d0"))) / 2).cast("bigint"), 2 * j) for j in range(COORDINATES)]
    return near.select("fp", reduce(Column.bitwiseOR, turned).alias("turned"), "far")


def refined(members: DataFrame, coordinates: int) -> DataFrame:
    """(fp, far, key, left): each of ``members(fp, far, key, left)`` with six keys more selective than its own.

    ``left`` holds the coordinates that the key doesn't, ``coordinates`` of them, in four groups; a new key adds two groups.
    """
    width = 2 * coordinates // 4
    part = [F.shiftrightunsigned("left", g * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")) for g in range(4)]
    both = lambda a, b: F.shiftleft(part[a], width).bitwiseOR(part[b])
    choices = [(k, (a, b), tuple(g for g in range(4) if g not in (a, b))) for k, (a, b) in enumerate(combinations(range(4), 2))]
    keys = F.array(*[F.struct(F.xxhash64("key", F.lit(k), both(*held)).alias("key"), both(*rest).alias("left")) for k, held, rest in choices])
    return members.select("fp", "far", F.explode(keys).alias("k")).select("fp", "far", "k.key", "k.left")


def links(distinct: DataFrame, *, bucket: int = BUCKET, refine: int = REFINE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``distinct`` fingerprints with two differing bits or fewer."""
    members = pivot_table(distinct).select("fp", "far", F.lit(0).cast("bigint").alias("key"), F.col("turned").alias("left"))
    found = []
    apart = F.array_max(F.zip_with("da", "db", lambda p, q: F.abs(p - q)))
    for level in range(refine + 1):
        keyed = written(refined(members, COORDINATES >> level), "pivots")
        sized = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
        few = sized.filter(F.col("n") <= bucket)
        x, y = few.select("key", F.col("fp").alias("a"), F.col("far").alias("da")), few.select("key", F.col("fp").alias("b"), F.col("far").alias("db"))
        found.append(x.join(y, "key").filter("a < b").filter(apart <= REACH).filter(distance(F.col("a"), F.col("b")) <= REACH).select("a", "b"))
        members = written(sized.filter(F.col("n") > bucket).select("fp", "far", "key", "left"), "dense")
        if members.isEmpty():
            break

    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("bigint")) for i in range(64)])
    named = members.select("fp").distinct().select("fp", F.explode(around).alias("mid"))
    least = named.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).filter("b < most").select("mid", "b")
    hubs = named.join(least, "mid").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return reduce(DataFrame.union, found, hubs)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component): for every row its fingerprint and the smallest id that its links reach, its own included."""
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    found = components(links(distinct, bucket=bucket))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    linked = rooted.join(found.select(F.col("component").alias("root")).distinct(), "root", "left_semi")
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    classes = rooted.join(lowest, "root", "left").select("fp", F.coalesce("lowest", "low").alias("component"))
    return prints.join(classes, "fp", "left").select(F.col("id").alias(id_col), "fp", "component")
