"""Percentiles of all pairs of each corpus, without sending a pair: tiles of pairs send counts and get ranks back.

A corpus's vectors are cut into blocks, and each pair of blocks is a tile, whose similarities a task computes as whole numbers of
10**-digits. A corpus of one block is ranked where it is. Of a larger one each tile sends its different values, sorted, by bins of
``WIDTH`` of them, as differences in compressed bytes: some 1 to 2 bytes a pair, less the more pairs there are. A bin adds up how often each
value occurs, which takes ``WIDTH`` numbers at most however many pairs there are, and answers each tile with the ranks of the values
that it sent, as differences again. The tiles are then computed once more and their pairs leave with their percentiles.

Defined cases: null and empty vectors take no part; a similarity that is no number stands above all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import vec
from quillspan.sources.shared import written

#: Vectors of a block, about, and values of a bin.
BLOCK, WIDTH = 2048, 1 << 20
#: Pairs that leave a task together, about, and tiles' partitions, at most.
OUT_ROWS, PARTS = 1 << 18, 4096
#: Rows of bins that are looked up by broadcast.
FEW = 200_000
#: The value of what is no number.
NO_NUMBER = (1 << 31) - 1


def _packed(rising: np.ndarray) -> bytes:
    """Whole numbers that don't fall, as compressed differences, byte by byte of all."""
    steps = np.diff(rising.astype(np.uint64), prepend=np.uint64(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    steps = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64).ravel()).astype(np.int64)


def _blocks(items: DataFrame, corpus: str, item_id: str, order: str, vector: str, block: int) -> DataFrame:
    """(c, b, blocks, i, o, m): each corpus's vectors in blocks, as bytes of unit rows."""
    rows = items.filter(F.size(vector) > 0).select(F.col(corpus).alias("c"), F.col(item_id).alias("i"), F.col(order).alias("o"), vec.as_double(vector).alias("v"))
    sizes = rows.groupBy("c").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = rows.join(sizes, "c").withColumn("b", F.pmod(F.xxhash64("i"), F.col("blocks")))
    kinds = dict(rows.dtypes)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("o")
        m = np.stack(frame["v"].to_numpy()).astype(float)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        u = np.divide(m, n, out=np.zeros_like(m), where=n != 0)
        first = frame.iloc[0]
        return pd.DataFrame([(first["c"], first["b"], first["blocks"], frame["i"].to_numpy(), frame["o"].to_numpy(), u.tobytes())], columns=["c", "b", "blocks", "i", "o", "m"])

    return written(placed.groupBy("c", "b").applyInPandas(pack, f"c {kinds['c']}, b bigint, blocks bigint, i array<{kinds['i']}>, o array<{kinds['o']}>, m binary"), "blocks")


def _sent(blocks: DataFrame) -> DataFrame:
    """(c, x, y, side, blocks, i, o, m): each block for each tile (x, y), x being no greater, that it is a side of."""
    whole = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return whole.select("c", F.least("b", "other").alias("x"), F.greatest("b", "other").alias("y"), (F.col("b") > F.col("other")).cast("int").alias("side"), "blocks", "i", "o", "m")


class _Tile:
    """The pairs of two blocks, or of one with itself."""

    def __init__(self, sides: dict[int, tuple], digits: int):
        (self.x_i, self.x_o, u), (self.y_i, self.y_o, w) = sides[0], sides.get(1, sides[0])
        self.same = 1 not in sides
        with np.errstate(invalid="ignore"):
            s = np.rint(u @ w.T * 10**digits)
        self.values = np.where(np.isnan(s), NO_NUMBER, s).astype(np.int32)

    def pairs(self, at: slice) -> np.ndarray:
        """Which of the rows ``at`` and all columns are pairs."""
        part = np.ones(self.values[at].shape, bool)
        return np.triu(part, 1 + at.start) if self.same else part

    def asked(self) -> np.ndarray:
        return self.values[self.pairs(slice(0, len(self.values)))] if self.same else self.values.ravel()


def _side(batch: pa.RecordBatch, r: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    i, o, m = (batch.column(c)[r] for c in ("i", "o", "m"))
    return i.values, o.values.to_numpy(zero_copy_only=False), np.frombuffer(m.as_buffer()).reshape(len(i.values), -1)


def _ranks(batches: list[pa.RecordBatch]) -> tuple[list[np.ndarray], int]:
    """For each row twice the number of a bin's pairs below each of its values, and of those equal to it once; and the number of all."""
    sent = [(_unpacked(v.as_buffer(), n), _unpacked(t.as_buffer(), n)) for batch in batches for v, t, n in zip(batch.column("places"), batch.column("times"), batch.column("n").to_pylist())]
    sent = [(at, np.diff(upto, prepend=0)) for at, upto in sent]
    if sum(len(at) for at, _ in sent) < WIDTH // 4:
        known, where = np.unique(np.concatenate([at for at, _ in sent]), return_inverse=True)
        equal = np.bincount(where, weights=np.concatenate([times for _, times in sent]), minlength=len(known)).astype(np.int64)
    else:
        known, equal = None, np.zeros(WIDTH, np.int64)
        for at, times in sent:
            equal[at] += times
    upto = np.cumsum(equal)
    middle = 2 * upto - equal
    return [middle[at if known is None else np.searchsorted(known, at)] for at, _ in sent], int(upto[-1])


def pair_percentiles(items: DataFrame, *, corpus: str = "corpus_id", item_id: str = "id", order: str = "seq", vector: str = "embedding", digits: int = 9, floor: int = 10, block: int = BLOCK) -> DataFrame:
    """(corpus, a, b, percentile) of all pairs with a before b: (below + half of the equal ones, itself included) / total * 100; null under the floor."""
    if digits > 9:
        raise ValueError("similarities are ranked to nine digits at most")
    blocks = _blocks(items, corpus, item_id, order, vector, block)
    kinds = dict(blocks.dtypes)
    item = kinds["i"][6:-1]
    tiles = blocks.groupBy("c").agg(F.first("blocks").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n + 1) div 2")), F.lit(0))).first()[0]
    parts = max(1, min(PARTS, int(tiles)))
    sent = _sent(blocks)
    names = ["c", "bin", "x", "y", "n", "places", "times"]

    def tile_of(batches: Iterator[pa.RecordBatch]) -> tuple[_Tile | None, int, list[tuple]]:
        sides, ranks, blocks = {}, [], 0
        for batch in batches:
            for r, side in enumerate(batch.column("side").to_pylist()):
                if side < 2:
                    sides[side], blocks = _side(batch, r), batch.column("blocks")[r].as_py()
                else:
                    ranks.append((*(batch.column(c)[r].as_py() for c in ("bin", "base", "total", "n")), batch.column("ranks")[r].as_buffer()))
        # a block may have got no vector
        return (_Tile(sides, digits) if 0 in sides else None), blocks, sorted(ranks, key=lambda x: x[0])

    def whole(key: tuple[pa.Scalar, ...], tile: _Tile | None) -> bool:
        return tile is not None and (tile.same == (key[1].as_py() == key[2].as_py()))

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, _, _ = tile_of(batches)
        if not whole(key, tile):
            return
        values, times = np.unique(tile.asked(), return_counts=True)
        values = values.astype(np.int64)
        for at in np.split(np.arange(len(values)), np.flatnonzero(np.diff(values // WIDTH)) + 1):
            if len(at):
                cells = [key[0].as_py(), int(values[at[0]] // WIDTH), key[1].as_py(), key[2].as_py(), len(at), _packed(values[at] % WIDTH), _packed(np.cumsum(times[at]))]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, (key[0].type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=names)

    def rank(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        ranks, inside = _ranks(held)
        rows = pa.Table.from_batches(held).select(["c", "bin", "x", "y", "n"]).combine_chunks().to_batches()[0]
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.repeat(pa.scalar(inside, pa.int64()), rows.num_rows), pa.array(map(_packed, ranks), pa.binary())], names=["c", "bin", "x", "y", "n", "inside", "ranks"])

    several = sent.filter("blocks > 1").repartition(parts, "c", "x", "y").groupBy("c", "x", "y")
    counts = several.applyInArrow(count, f"c {kinds['c']}, bin bigint, x bigint, y bigint, n bigint, places binary, times binary")
    ranked = written(counts.groupBy("c", "bin").applyInArrow(rank, f"c {kinds['c']}, bin bigint, x bigint, y bigint, n bigint, inside bigint, ranks binary"), "ranks")
    of = Window.partitionBy("c")
    bins = ranked.groupBy("c", "bin").agg(F.first("inside").alias("inside"))
    base = F.coalesce(F.sum("inside").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = written(bins.select("c", "bin", base.alias("base"), F.sum("inside").over(of).alias("total")), "bins")
    answers = ranked.drop("inside").join(F.broadcast(bins) if bins.count() <= FEW else bins, ["c", "bin"]).withColumn("side", F.lit(2))

    def leave(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, blocks, ranks = tile_of(batches)
        if not whole(key, tile):
            return
        values, place = np.unique(tile.asked(), return_inverse=True)
        if not len(place):
            return
        if blocks > 1:
            total = ranks[0][2]
            middle = np.concatenate([2 * base + _unpacked(data, n) for _, base, _, n, data in ranks])
        else:
            total, equal = len(place), np.bincount(place)
            middle = 2 * np.cumsum(equal) - equal
        if len(middle) != len(values):
            raise RuntimeError("a tile's values changed")
        percentile = middle * 0.5 / total * 100
        ids, start = pa.concat_arrays([tile.x_i, tile.y_i]), 0
        step = max(1, OUT_ROWS // len(tile.y_o))
        for at in range(0, len(tile.x_o), step):
            rows = slice(at, at + step)
            i, j = np.nonzero(tile.pairs(rows))
            i += at
            one, two, ahead = i, len(tile.x_o) + j, tile.x_o[i] < tile.y_o[j]
            found = place[start : start + len(i)]
            start += len(i)
            made = pa.array(percentile[found]) if total >= floor else pa.nulls(len(i), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(i)), ids.take(pa.array(np.where(ahead, one, two))), ids.take(pa.array(np.where(ahead, two, one))), made], names=["c", "a", "b", "percentile"])

    both = sent.unionByName(answers, allowMissingColumns=True).repartition(parts, "c", "x", "y")
    return both.groupBy("c", "x", "y").applyInArrow(leave, f"c {kinds['c']}, a {item}, b {item}, percentile double").withColumnRenamed("c", corpus)
