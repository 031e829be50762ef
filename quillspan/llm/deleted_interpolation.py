"""Language-model scores by deleted interpolation of n-gram estimates (Jelinek and Mercer, 1980), of words in pairs.

    P(w | v) = a2 * c(v, w) / c(v) + a1 * c(w) / N + a0 / (V + 1)

The weights a depend on the bucket of the context's frequency c(v) (its number of binary digits). They are learned by
expectation-maximisation on held-out counts: one part of the learning documents is deleted from the counts, and the weights
maximise the likelihood of its events under what remains. All learning documents then count. The last term covers unknown
words, so the probabilities of the V known tokens and "unknown" add up to one.

How it runs. Documents become blocks of a few million tokens (``blocks``); a block numbers its words and adds up its own
pairs first, so a pair is sent once a block however frequent it is. The n-grams' 64-bit hashes are dealt out by range
(``dealt``); each range adds up its counts (``totals``) and answers every block in the block's own order, so an answer is an
array of counts without keys. Blocks and answers meet by block for the weights (deleted part only) and again for the
scores. Blocks and ranges are of fixed size: more data makes more of them. A block sends a row to each range, so with more
than ``FANOUT`` ranges, where a row would hold a few n-grams only, that goes by two levels: blocks send to the square root of
so many wide ranges, in each of which teams of blocks add up theirs (``merged``), send that on to the ranges, and hand the
answers back to their blocks (``handed_back``). Results are the same either way.

Defined cases: a null or empty text is the end token alone; a null id counts as remainder 0; equal rows are scored each;
without deleted documents the weights are even; without learning documents all is unknown; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, drop, id_crc, slices, written

#: A document's part is crc32(id as text) mod 7: 2 is never learned from, 3 is the deleted part, the rest is always counted.
PARTS, HELD_OUT, DELETED = 7, 2, 3
COUNTED, DELETED_KIND, UNSEEN = 0, 1, 2
BLOCK_TOKENS = 1_500_000
RANGE_KEYS = 1_000_000
#: Ranges that a block sends rows to directly.
FANOUT = 8192
ROUNDS = 60
#: Steps of the logarithms (base 2) by which deleted events are gathered for the weights, in so many bits: down to 2 ** -63.
STEPS, STEP_BITS = 4, 8


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).tobytes())


def unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def packed_numbers(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, their bytes by significance."""
    return packed(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T)


def unpacked_numbers(x: bytes, kind: str = "<i8") -> np.ndarray:
    return np.ascontiguousarray(unpacked(x, "u1").reshape(8, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return packed_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked_numbers(x, "<u8"), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Block:
    """Words of some documents by their number in the block; number 0 is the end token and, as a context, the start."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.ids: list[pa.Array] = []
        self.sizes: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: pa.Array, texts: list[bytes]) -> None:
        split = [t.lower().split() for t in texts]  # bytes: A-Z, and x20 and x09-x0D, only
        flat = list(chain.from_iterable(split))
        new = set(flat).difference(self.place)
        self.place.update(zip(new, range(len(self.place) + 1, len(self.place) + len(new) + 1)))
        self.tokens.append(np.fromiter(map(self.place.__getitem__, flat), np.int32, len(flat)))
        self.sizes += map(len, split)
        self.ids.append(ids)
        self.n += len(flat) + len(texts)

    def row(self, block: int, kind: int) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.place), np.uint64, len(self.place))
        ids = pa.concat_arrays(self.ids)
        data = {
            "block": pa.array([block], pa.int64()),
            "kind": pa.array([kind], pa.int32()),
            "events": pa.array([self.n], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "sizes": pa.array([packed(np.array(self.sizes, "<i4"))], pa.binary()),
            "tokens": pa.array([packed(np.concatenate(self.tokens))], pa.binary()),
            "hashes": pa.array([np.append(np.uint64(0x9E3779B97F4A7C15), hashes).tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(data)


def blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block: number, kind, events, and the documents' ids, sizes and words."""
    part = F.pmod(id_crc(id_col), F.lit(PARTS))
    kind = F.when(part == HELD_OUT, UNSEEN).when(part == DELETED, DELETED_KIND).otherwise(COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        open_blocks = [_Block(), _Block(), _Block()]
        for batch in batches:
            for rows in slices(batch):
                texts, kinds = as_bytes(rows.column(2)), rows.column(1).to_numpy()
                for k in range(3):
                    mine = np.flatnonzero(kinds == k)
                    if len(mine):
                        open_blocks[k].add(rows.column(0).take(pa.array(mine)), [texts[i] for i in mine])
                    if open_blocks[k].n >= block_tokens:
                        yield open_blocks[k].row(task << 24 | made, k)
                        open_blocks[k], made = _Block(), made + 1
        for k, b in enumerate(open_blocks):
            if b.n:
                yield b.row(task << 24 | made, k)
                made += 1

    base = docs.select(F.col(id_col).alias("id"), kind.alias("kind"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"block bigint, kind int, events bigint, ids array<{dict(base.dtypes)['id']}>, sizes binary, tokens binary, hashes binary")


class Events:
    """A block's events in order of documents, and its n-grams in order of their keys."""

    def __init__(self, sizes: bytes, tokens: bytes, hashes: bytes):
        self.sizes = unpacked(sizes, "<i4").astype(np.int64)
        words, h = unpacked(tokens, "<i4"), np.frombuffer(hashes, np.uint64)
        ends = np.cumsum(self.sizes + 1) - 1
        self.word = np.zeros(len(words) + len(ends), np.int64)
        inside = np.ones(len(self.word), bool)
        inside[ends] = False
        self.word[inside] = words
        self.context = np.append(0, self.word[:-1])  # after an end token, 0, comes a start
        self.starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
        # words: the count of each number, then in order of key
        keys = mix(h)
        self.word_order = np.argsort(keys)
        self.word_keys, self.word_counts = keys[self.word_order], np.bincount(self.word, minlength=len(h))[self.word_order]
        pair, self.pair_of, counts = np.unique(self.context * len(h) + self.word, return_inverse=True, return_counts=True)
        keys = mix(h[pair // len(h)] * np.uint64(0xD1342543DE82EF95) + mix(h[pair % len(h)]))
        self.pair_order = np.argsort(keys)
        self.pair_keys, self.pair_counts = keys[self.pair_order], counts[self.pair_order]

    def by_word(self, answer: np.ndarray) -> np.ndarray:
        out = np.empty(len(answer), np.int64)
        out[self.word_order] = answer
        return out

    def by_event(self, answer: np.ndarray) -> np.ndarray:
        out = np.empty(len(answer), np.int64)
        out[self.pair_order] = answer
        return out[self.pair_of]


SENT = "range int, block bigint, kind int, grams int, keys binary, counts binary"
ANSWERS = "block bigint, kind int, range int, grams int, all binary, deleted binary, n bigint, v bigint, n_deleted bigint"


def by_range(keys: np.ndarray, counts: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted keys and their counts, cut where one of ``ranges`` equal ranges of keys ends."""
    of = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(of)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(of)]):
        if b > a:
            yield int(of[a]), packed_keys(keys[a:b]), packed_numbers(counts[a:b].astype("<i8"))


def dealt(table: DataFrame, ranges: int) -> DataFrame:
    """(range, block, kind, grams, keys, counts): each block's n-grams of one and two words, by range of their keys."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                e = Events(r["sizes"], r["tokens"], r["hashes"])
                both = ((1, e.word_keys, e.word_counts), (2, e.pair_keys, e.pair_counts))
                rows = ((k, r["block"], r["kind"], grams, x, c) for grams, keys, counts in both for k, x, c in by_range(keys, counts, ranges))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                while some := list(islice(rows, 64)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=["range", "block", "kind", "grams", "keys", "counts"])

    return table.select("block", "kind", "sizes", "tokens", "hashes").mapInArrow(run, SENT)


class Added:
    """Rows of ``dealt`` for n-grams of one order, added up: their distinct keys in order, and where those of each row are among them."""

    def __init__(self, rows: pd.DataFrame):
        keys = [unpacked_keys(x) for x in rows["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        self.counts = np.concatenate([unpacked_numbers(x) for x in rows["counts"]])
        self.kinds = np.repeat(rows["kind"].to_numpy(), np.diff(ends, prepend=0))
        self.distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        self.at = at
        self.places = list(zip(rows["block"], rows["kind"], np.split(at, ends[:-1])))

    def total(self, of: np.ndarray) -> np.ndarray:
        """The sum of those counts that ``of`` marks, for each key."""
        out = np.zeros(len(self.distinct), np.int64)
        np.add.at(out, self.at[of], self.counts[of])
        return out


def totals(sent: DataFrame) -> DataFrame:
    """(block, kind, range, grams, all, deleted, n, v, n_deleted): each block's n-grams' counts in learning documents.

    ``all`` and, for blocks of the deleted part, ``deleted`` are in the order of the block's keys. Block -1 has each range's
    number of tokens, of different ones, and of deleted tokens.
    """
    names = ["block", "kind", "range", "grams", "all", "deleted", "n", "v", "n_deleted"]

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        out, where = [], pdf["range"].iloc[0]
        for grams, part in pdf.groupby("grams"):
            found = Added(part)
            total, gone = found.total(found.kinds != UNSEEN), found.total(found.kinds == DELETED_KIND)
            for block, kind, mine in found.places:
                out.append((block, kind, where, grams, packed_numbers(total[mine]), packed_numbers(gone[mine]) if kind == DELETED_KIND else None, None, None, None))
            if grams == 1:
                out.append((-1, -1, where, grams, None, None, int(total.sum()), int((total > 0).sum()), int(gone.sum())))
        return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names[6:]})

    return sent.groupBy("range").applyInPandas(add_up, ANSWERS)


def merged(sent: DataFrame, ranges: int) -> DataFrame:
    """Rows as those of ``dealt``, by the ``ranges``, of each team of ``sent(team, ...)`` as one block."""

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        out, team, kind = [], pdf["team"].iloc[0], pdf["kind"].iloc[0]
        for grams, part in pdf.groupby("grams"):
            found = Added(part)
            out += [(k, team, kind, grams, x, c) for k, x, c in by_range(found.distinct, found.total(found.kinds == kind), ranges)]
        return pd.DataFrame(out, columns=["range", "block", "kind", "grams", "keys", "counts"])

    return sent.groupBy("team").applyInPandas(add_up, SENT)


def handed_back(sent: DataFrame, answers: DataFrame) -> DataFrame:
    """The ``answers`` to teams, as answers to their blocks."""
    names = ["block", "kind", "range", "grams", "all", "deleted"]

    def split(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for grams, part in rows.groupby("grams"):
            found, where, gone = Added(part), part["range"].iloc[0], part["kind"].iloc[0] == DELETED_KIND
            total, deleted = joined(got, grams, "all"), joined(got, grams, "deleted") if gone else None
            out += [(block, kind, where, grams, packed_numbers(total[mine]), packed_numbers(deleted[mine]) if gone else None) for block, kind, mine in found.places]
        return pd.DataFrame(out, columns=names)

    pairs = sent.groupBy("team").cogroup(answers.filter("block >= 0").withColumnRenamed("block", "team").groupBy("team"))
    back = pairs.applyInPandas(split, ANSWERS.split(", n ")[0])
    return back.unionByName(answers.filter("block < 0"), allowMissingColumns=True)


def answered(table: DataFrame, ranges: int, fanout: int) -> DataFrame:
    """The answers to all blocks of ``table``, written; at one level or at two."""
    if ranges <= fanout:
        return written(totals(dealt(table, ranges)), "answers")
    wide = math.ceil(math.sqrt(ranges))
    teams = {r.kind: math.ceil(r.n / wide) for r in table.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    team = F.coalesce(*[F.when(F.col("kind") == k, F.pmod(F.xxhash64("block"), F.lit(n))) for k, n in teams.items()])
    sent = written(dealt(table, wide).withColumn("team", (team * 3 + F.col("kind")) * wide + F.col("range")), "sent")
    found = written(totals(merged(sent, wide * math.ceil(ranges / wide))), "answers")
    back = written(handed_back(sent, found), "answers")
    drop(sent, found)
    return back


def joined(answers: pd.DataFrame, grams: int, column: str) -> np.ndarray:
    part = answers[answers["grams"] == grams].sort_values("range")
    return np.concatenate([unpacked_numbers(x) for x in part[column]])


def bucket(context_count: np.ndarray) -> np.ndarray:
    """Number of binary digits of a context's count, 0 for an unseen one."""
    return np.where(context_count > 0, np.frexp(context_count.astype(np.float64))[1], 0)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def estimates(e: Events, word: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each event: the context's bucket, and the maximum-likelihood estimates from pairs and from words."""
    context = word[e.context]
    return bucket(context), _ratio(pair, context), _ratio(word[e.word], float(n) if n else np.zeros(len(e.word)))


def gathered(table: DataFrame, answers: DataFrame, n: int) -> list[tuple[int, int]]:
    """Deleted events by bucket and steps of their two estimates: at most 64 * 256 * 256 cells, whatever the corpus; a few thousand in practice."""

    def cells(blocks_: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if blocks_.empty:
            return pd.DataFrame({"cell": [], "n": []}).astype("int64")
        r = blocks_.iloc[0]
        e = Events(r["sizes"], r["tokens"], r["hashes"])
        word = e.by_word(joined(got, 1, "all") - joined(got, 1, "deleted"))
        pair = e.by_event(joined(got, 2, "all") - joined(got, 2, "deleted"))
        b, p2, p1 = estimates(e, word, pair, n)
        step = lambda p: np.where(p > 0, 1 + np.clip(np.rint(-STEPS * np.log2(np.where(p > 0, p, 1))), 0, (1 << STEP_BITS) - 2), 0).astype(np.int64)
        cell, times = np.unique((b.astype(np.int64) << 2 * STEP_BITS) | (step(p2) << STEP_BITS) | step(p1), return_counts=True)
        return pd.DataFrame({"cell": cell, "n": times})

    mine = table.filter(F.col("kind") == DELETED_KIND).select("block", "sizes", "tokens", "hashes")
    theirs = answers.filter(F.col("kind") == DELETED_KIND).select("block", "range", "grams", "all", "deleted")
    found = mine.groupBy("block").cogroup(theirs.groupBy("block")).applyInPandas(cells, "cell bigint, n bigint")
    return [(r.cell, r.n) for r in found.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()]


def learn_weights(cells: list[tuple[int, int]], v: int, rounds: int = ROUNDS) -> np.ndarray:
    """(bucket, 3) weights of pair, word and floor; a bucket without deleted events takes those of the one below."""
    out = np.tile([1 / 3, 1 / 3, 1 / 3], (64, 1))
    out[0] = [0, 0.5, 0.5]
    code, times = (np.array(x, np.int64) for x in zip(*cells)) if cells else (np.empty(0, np.int64),) * 2
    estimate = lambda s: np.where(s > 0, 2.0 ** (-(s - 1) / STEPS), 0.0)
    low = (1 << STEP_BITS) - 1
    p = np.stack([estimate(code >> STEP_BITS & low), estimate(code & low), np.full(len(code), 1 / (v + 1))], axis=1)
    seen = False
    for b in range(64):
        mine = (code >> 2 * STEP_BITS) == b
        if mine.any():
            a, seen = out[b].copy(), seen or b > 0
            for _ in range(rounds):
                share = a * p[mine]
                share /= share.sum(axis=1, keepdims=True)
                a = (share * times[mine, None]).sum(axis=0)
                a /= a.sum()
            # no weight is quite 0, so that every event stays possible
            out[b] = (a + 1e-6 * (np.array([b > 0, True, True]))) / (1 + 1e-6 * (2 + (b > 0)))
        elif b > 1 and seen:
            out[b] = out[b - 1]
    return out


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, range_keys: int = RANGE_KEYS, fanout: int = FANOUT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    table = written(blocks(docs, id_col=id_col, text_col=text_col, block_tokens=block_tokens), "blocks")
    events = table.agg(F.sum("events")).first()[0] or 0
    answers = answered(table, max(1, math.ceil(events / range_keys)), fanout)
    n, v, n_deleted = (x or 0 for x in answers.filter("block = -1").agg(F.sum("n"), F.sum("v"), F.sum("n_deleted")).first())
    weights = learn_weights(gathered(table, answers, n - n_deleted), v)
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scores(blocks_: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if blocks_.empty:
            return pd.DataFrame({c: [] for c in names})
        r = blocks_.iloc[0]
        e = Events(r["sizes"], r["tokens"], r["hashes"])
        word, pair = e.by_word(joined(got, 1, "all")), e.by_event(joined(got, 2, "all"))
        b, p2, p1 = estimates(e, word, pair, n)
        a = weights[b]
        p = np.log10(a[:, 0] * p2 + a[:, 1] * p1 + a[:, 2] / (v + 1))
        count = word[e.word]
        base = np.log10((count + 1) / (n + 1 * (v + 1)))
        add = lambda x: np.add.reduceat(x, e.starts)
        return pd.DataFrame(dict(zip(names, (r["ids"], r["kind"] == UNSEEN, e.sizes + 1, add((count > 0).astype(np.int64)), n, add(base), add(p)))))

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    both = table.groupBy("block").cogroup(answers.filter("block >= 0").select("block", "range", "grams", "all").groupBy("block"))
    return both.applyInPandas(scores, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
