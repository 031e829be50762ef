"""Blocks of near vectors with a centre and a reach, and the searches and joins that skip whole blocks by them, exactly.

A block holds unit vectors, packed as bytes, and the greatest angle between its centre and a member. Angles obey the triangle
inequality, so two blocks' members are at least ``angle(centres) - reach - reach`` apart: what can't come near enough is never
multiplied. Blocks are written once; only their summaries meet in pairs.

Defined cases: null and empty vectors take no part, nor do vectors with a null, NaN or infinite value; a zero vector is
similar to nothing (0) and sits in a block that is never skipped; vectors of unequal length are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import vec
from quillspan.sources.shared import written

#: Vectors of a block.
BLOCK = 512
#: Vectors of one corpus that a task sorts into blocks together, about.
GATHER = 16_384
#: Blocks of a corpus that meet all others of it under one join key.
TOGETHER = 64
#: Bytes of vectors of a tile, two of which a task multiplies, and tiles of a corpus of so many blocks, at least.
TILE, TILES = 32 << 20, 8
#: Pairs that leave a task together, about.
OUT_ROWS = 1 << 18
#: Radians by which a bound is widened, above the rounding errors of an angle.
SLACK = 1e-6


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _blocks(u: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(rows, centre, reach) of blocks of near unit vectors: leaders are the vectors farthest from those before."""
    zero = ~(u * u).sum(axis=1).astype(bool)
    odd, rest = np.flatnonzero(zero), np.flatnonzero(~zero)
    for at in range(0, len(odd), size):
        yield odd[at : at + size], np.zeros(u.shape[1]), np.pi
    if not len(rest):
        return
    v = u[rest]
    near, of, leader = np.full(len(v), -2.0), np.zeros(len(v), int), 0
    for k in range(-(-2 * len(v) // size)):
        s = v @ v[leader]
        of[s > near] = k
        near = np.maximum(near, s)
        leader = int(near.argmin())
    order = np.lexsort((-near, of))
    bounds = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
    for start, stop in zip(bounds, bounds[1:]):
        for at in range(start, stop, size):
            part = order[at : min(at + size, stop)]
            centre = v[part].sum(axis=0)
            n = np.linalg.norm(centre)
            centre = centre / n if n > 0 else centre
            yield rest[part], centre, float(_angle(v[part] @ centre).max()) if n > 0 else np.pi


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data).reshape(n, -1)


def usable(vector: str) -> Column:
    """There is a vector and all its values are finite."""
    v = vec.as_double(vector)
    return (F.size(vector) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def _packer(size: int, columns: list[str]):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        u = _unit(frame["v"])
        made = [(*[frame[c].to_numpy()[rows] for c in columns], u[rows].tobytes(), len(rows), centre, reach) for rows, centre, reach in _blocks(u, size)]
        return pd.DataFrame(made, columns=[*columns, "m", "n", "centre", "reach"])

    return pack


def _numbered(packed: DataFrame, name: str) -> DataFrame:
    """Written, with numbers that stay: each block is one row."""
    return written(packed.withColumn("b", F.monotonically_increasing_id()), name)


def packed(items: DataFrame, *, item_id: str, vector: str = "embedding", size: int = BLOCK, name: str = "blocks") -> DataFrame:
    """(b, i, m, n, centre, reach): blocks of what each Arrow batch of a task holds, so no vector is shuffled."""
    rows = items.filter(usable(vector)).select(F.col(item_id).alias("i"), vec.as_double(vector).alias("v"))
    pack = _packer(size, ["i"])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pack(frame)

    return _numbered(rows.mapInPandas(each, f"i array<{dict(rows.dtypes)['i']}>, m binary, n int, centre array<double>, reach double"), name)


def packed_by(items: DataFrame, *, corpus: str, item_id: str, order: str, vector: str = "embedding", size: int = BLOCK) -> DataFrame:
    """(b, c, blocks, i, o, m, n, centre, reach): blocks within a corpus; a large corpus is gathered by many tasks."""
    rows = items.filter(usable(vector)).select(F.col(corpus).alias("c"), F.col(item_id).alias("i"), F.col(order).alias("o"), vec.as_double(vector).alias("v"))
    parts = rows.groupBy(F.col("c").alias("k")).agg(F.ceil(F.count("*") / GATHER).alias("parts"))
    placed = rows.join(parts, F.col("c").eqNullSafe(F.col("k"))).withColumn("part", F.pmod(F.xxhash64("i", "v"), F.col("parts")))
    kinds, pack = dict(rows.dtypes), _packer(size, ["i", "o"])
    made = placed.groupBy("c", "part").applyInPandas(lambda frame: pack(frame).assign(c=frame["c"].iloc[0]), f"c {kinds['c']}, i array<{kinds['i']}>, o array<{kinds['o']}>, m binary, n int, centre array<double>, reach double")
    return _numbered(made, "blocks")


def _summary(blocks: DataFrame, side: str, *more: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("b", "n", "centre", "reach", *more)])


def _whole(blocks: DataFrame, side: str, *columns: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("b", *columns)])


def _gap() -> Column:
    """The least angle that members of the blocks x and y can have."""
    centres = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vec.dot("x_centre", "y_centre"))))
    return F.greatest(centres - F.col("x_reach") - F.col("y_reach") - SLACK, F.lit(0.0))


def ranked(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str, item_id: str, vector: str, digits: int, size: int = BLOCK) -> DataFrame:
    """(query_id, item_id, rank) of the ``k`` most similar items; see ``vectors.rank``.

    Each query block first meets the blocks nearest to it that hold ``k`` items together. The worst k-th similarity of its queries
    is what any other block has to reach by its bound to be multiplied at all.
    """
    q, c = packed(queries, item_id=query_id, vector=vector, size=size, name="queries"), packed(corpus, item_id=item_id, vector=vector, size=size, name="corpus")
    # every query block meets every corpus block as a summary, 1 row for up to 512
    met = _summary(q, "x").crossJoin(_summary(c, "y")).select("x_b", "y_b", "y_n", _gap().alias("gap"))
    nearest = Window.partitionBy("x_b").orderBy("gap", "y_b")
    first = met.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k)
    before = F.coalesce(F.sum("y_n").over(nearest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = first.withColumn("before", before).filter(F.col("before") < k).select("x_b", "y_b")
    kinds = {n: dict(d.dtypes)["i"][6:-1] for n, d in (("q", q), ("id", c))}

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids = np.asarray(r.y_i)
                s = np.round(_matrix(r.x_m, len(r.x_i)) @ _matrix(r.y_m, len(ids)).T, digits)
                edge = np.partition(s, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(s), -np.inf)
                row, item = np.nonzero(s >= edge[:, None])  # a few more than k where similarities tie
                by_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
                order = np.lexsort((by_id[item], -s[row, item], row))
                row, item = row[order], item[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, item = row[top], item[top]
                yield pd.DataFrame({"x_b": r.x_b, "row": row, "q": np.asarray(r.x_i)[row], "id": ids[item], "s": s[row, item]})

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(_whole(q, "x", "i", "m"), "x_b").join(_whole(c, "y", "i", "m"), "y_b")
        return both.select("x_b", "x_i", "x_m", "y_i", "y_m").mapInPandas(best, f"x_b bigint, row int, q {kinds['q']}, id {kinds['id']}, s double")

    order = Window.partitionBy("x_b", "row").orderBy(F.col("s").desc(), F.col("id"))
    sown = written(scored(seeds).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k), "seeds")
    edge = sown.groupBy("x_b", "row").agg(F.min("s").alias("s"), F.count("*").alias("n")).groupBy("x_b").agg(F.min(F.when(F.col("n") >= k, F.col("s")).otherwise(-2.0)).alias("edge"))
    others = met.join(edge, "x_b").filter(F.cos("gap") >= F.col("edge") - 10.0**-digits).join(seeds, ["x_b", "y_b"], "left_anti").select("x_b", "y_b")
    found = sown.drop("r").unionByName(scored(others))
    final = Window.partitionBy("q").orderBy(F.col("s").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("id").alias(item_id), "rank")


def similar(items: DataFrame, least: float, *, corpus: str, item_id: str, order: str, vector: str, digits: int, size: int = BLOCK) -> DataFrame:
    """(corpus, a, b, similarity) of all pairs at ``least`` or above, a before b; see ``vectors.all_pairs``.

    Blocks whose bound stays below ``least`` don't meet. In a pair of blocks, a vector whose angle to the other's centre is too
    wide for any member goes before the product; ``products`` counts what was multiplied.
    """
    return _similar(items, least, corpus=corpus, item_id=item_id, order=order, vector=vector, digits=digits, size=size).filter("products is null").drop("products")


def _sent(near: DataFrame, blocks: DataFrame) -> DataFrame:
    """(p, q, b, others, ...): near blocks by pairs of tiles; a block goes once to each pair that needs it, with the blocks it meets there."""
    met = near.select("x_b", "y_b", F.least("x_tile", "y_tile").alias("p"), F.greatest("x_tile", "y_tile").alias("q"))
    ends = met.select("p", "q", F.col("x_b").alias("b"), F.col("y_b").alias("other")).unionByName(met.select("p", "q", F.col("y_b").alias("b"), F.lit(None).cast("bigint").alias("other")))
    return ends.groupBy("p", "q", "b").agg(F.collect_list("other").alias("others")).join(blocks.select("c", "b", "i", "o", "m", "centre", "reach"), "b")


def _similar(items: DataFrame, least: float, *, corpus: str, item_id: str, order: str, vector: str, digits: int, size: int = BLOCK) -> DataFrame:
    """The same rows, and for each pair of blocks one with ``products`` only."""
    blocks = packed_by(items, corpus=corpus, item_id=item_id, order=order, vector=vector, size=size)
    kinds = {n: t for n, t in dict(blocks.dtypes).items()}
    wide = float(np.arccos(np.clip(least, -1, 1))) + SLACK
    # a hot corpus's blocks are spread over keys, each of which meets all of the corpus's blocks
    tiles = F.least(F.count("*"), F.greatest(F.lit(TILES), F.ceil(F.sum(F.length("m")) / TILE)))
    keys = blocks.groupBy(F.col("c").alias("k")).agg(F.ceil(F.count("*") / TOGETHER).alias("keys"), tiles.alias("tiles"))
    tile = lambda side: F.pmod(F.xxhash64(f"{side}_b", F.lit(1)), F.col("tiles")).alias(f"{side}_tile")
    left = _summary(blocks, "x", "c").join(keys, F.col("x_c").eqNullSafe(F.col("k"))).withColumn("key", F.pmod(F.xxhash64("x_b"), F.col("keys"))).select("*", tile("x")).drop("k", "keys", "tiles")
    right = _summary(blocks, "y", "c").join(keys, F.col("y_c").eqNullSafe(F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("keys") - 1))).select("*", tile("y")).drop("k", "keys", "tiles")
    near = left.join(right, F.col("x_c").eqNullSafe(F.col("y_c")) & (F.col("key") == F.col("other")) & (F.col("x_b") <= F.col("y_b")) & (_gap() <= wide if least > 0 else F.lit(True)))
    sent = _sent(near, blocks)

    def multiply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, meet = {}, []
        for batch in batches:
            for r in range(batch.num_rows):
                b, others, i, o, m, centre, reach = (batch.column(c)[r] for c in ("b", "others", "i", "o", "m", "centre", "reach"))
                n = len(i.values)
                there[b.as_py()] = i.values, o.values.to_numpy(zero_copy_only=False), np.frombuffer(m.as_buffer()).reshape(n, -1), centre.values.to_numpy(), reach.as_py()
                meet += [(b.as_py(), other) for other in others.as_py()]
        ready, rows_ready = [], 0
        for x_b, y_b in sorted(meet):
            (x_i, x_o, u, x_centre, x_reach), (y_i, y_o, w, y_centre, y_reach) = there[x_b], there[y_b]
            rows, cols = np.arange(len(u)), np.arange(len(w))
            same = x_b == y_b
            if least > 0 and not same:
                rows, cols = (np.flatnonzero(_angle(m @ centre) - reach <= wide) for m, centre, reach in ((u, y_centre, y_reach), (w, x_centre, x_reach)))
            s = u[rows] @ w[cols].T
            ok = s >= least
            i, j = np.nonzero(np.triu(ok, 1) if same else ok)
            one, two = rows[i], len(u) + cols[j]
            ahead = x_o[one] < y_o[cols[j]]
            ids = pa.concat_arrays([x_i, y_i])
            made = [pa.repeat(key[0], len(i)), ids.take(pa.array(np.where(ahead, one, two))), ids.take(pa.array(np.where(ahead, two, one))), pa.array(np.round(s[i, j], digits)), pa.nulls(len(i), pa.int64())]
            ready += [pa.RecordBatch.from_arrays(made, names=names), pa.RecordBatch.from_arrays([pa.repeat(key[0], 1), *(pa.nulls(1, x.type) for x in made[1:4]), pa.array([s.size])], names=names)]
            rows_ready += len(i) + 1
            if rows_ready >= OUT_ROWS:
                yield pa.concat_batches(ready)
                ready, rows_ready = [], 0
        if ready:
            yield pa.concat_batches(ready)

    names = ["c", "a", "b", "similarity", "products"]
    item = kinds["i"][6:-1]
    made = sent.groupBy("c", "p", "q").applyInArrow(multiply, f"c {kinds['c']}, a {item}, b {item}, similarity double, products bigint")
    return made.withColumnRenamed("c", corpus)
