"""Sampled SentencePiece segmentations by forward filtering and backward sampling over the piece lattice.

A piece's weight is a power of its rank in the vocabulary (the model is a merge list, so ranks stand in for frequencies),
and a segmentation's probability is in proportion to the product of its pieces' weights. The forward pass sums the
weights of all segmentations of every prefix; the backward pass draws pieces from the end, each with its exact
probability given the rest. Pieces never reach over the start of a word, so the lattice of a text is that of its words, one
after the other; the forward pass runs once for each distinct word of a batch, the backward pass for every word, both
as array operations. Draws come from a hash of the row's key, the word's place and the step: a row is segmented
alike in any batch, partition or run.

Decoding is lossless: spaces become the word mark and back, a character that is no piece is spelled in byte pieces, and so
is a word mark that stands in the text itself.

Defined cases: a null or empty text has no pieces; a null key draws as key 0; equal rows are sampled alike; runs of spaces,
very long words (text without spaces, walked in windows) and any Unicode text are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from bisect import bisect_right
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MARK = "▁"
#: Weight of a piece: (rank + 2) ** -POWER. Larger powers sample closer to the likeliest segmentation.
POWER = 2.0
SEED = 77
#: Weight of a character spelled in bytes, as a rank.
BYTE_RANK = 200_000
#: Code of a word mark that stands in the text, beyond all code points.
LITERAL = 0x110000
#: Ids from here on stand for a code point to be spelled in bytes.
SPELLED = 1 << 21
#: Characters of words that share arrays.
CELLS = 1 << 18
DENSE = 192
#: Places whose smallest weights multiply without underflow.
UNSCALED = 24
#: Bytes of a word beyond which it is walked place by place, in windows of so many characters, on its own.
LONG_BYTES, WINDOW = 1024, 1 << 15


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """A trie of the pieces as arrays, with their weights."""

    def __init__(self, path: str, power: float = POWER):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.text_of = [b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for value, i in self.byte_id.items():
            self.text_of[i] = bytes([value])
        pieces = [(sp.id_to_piece(i), i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = [(p, i) for p, i in pieces if MARK not in p.lstrip(MARK)]  # none over the start of a word
        self.longest = max(len(p) for p, _ in pieces)
        counts = np.zeros(LITERAL + 1, np.int64)
        for p, _ in pieces:
            np.add.at(counts, [ord(c) for c in p], 1)
        order = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
        self.symbol = np.full(LITERAL + 1, -1, np.int32)
        self.symbol[order] = np.arange(len(order))
        edges: dict[tuple[int, int], int] = {}
        self.node_piece, nodes = {}, 1
        for p, i in pieces:
            at = 0
            for c in p:
                key = (at, int(self.symbol[ord(c)]))
                if key not in edges:
                    edges[key] = nodes
                    nodes += 1
                at = edges[key]
            self.node_piece[at] = i
        self.dense = np.zeros((nodes, DENSE), np.int32)
        rare = sorted((a << 24 | s, to) for (a, s), to in edges.items() if s >= DENSE)
        self.rare_key, self.rare_to = (np.array(x, np.int64) for x in zip(*rare)) if rare else (np.array([-1]), np.array([0]))
        for (a, s), to in edges.items():
            if s < DENSE:
                self.dense[a, s] = to
        self.piece = np.full(nodes, -1, np.int32)
        self.piece[list(self.node_piece)] = list(self.node_piece.values())
        rank = np.arange(n) - 256 - 3
        self.weight = np.exp(-power * np.log(np.maximum(rank, 0) + 2.0))
        self.byte_weight = float(np.exp(-power * np.log(BYTE_RANK)))

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next trie node, 0 where there is none."""
        out = np.zeros(len(node), np.int32)
        common = (symbol >= 0) & (symbol < DENSE)
        out[common] = self.dense[node[common], symbol[common]]
        rare = np.flatnonzero(symbol >= DENSE)
        if len(rare):
            key = node[rare].astype(np.int64) << 24 | symbol[rare]
            at = np.minimum(np.searchsorted(self.rare_key, key), len(self.rare_key) - 1)
            out[rare] = np.where(self.rare_key[at] == key, self.rare_to[at], 0)
        return out


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """Words with the spaces before them, one space being put before the text; their concatenation is that."""
    text = b" " + text
    if b"  " in text or text.endswith(b" "):
        return re.findall(rb" +[^ ]*", text)
    return [b" " + w for w in text[1:].split(b" ")]


def forward(lat: Lattice, words: list[bytes]) -> dict:
    """Forward sums of words: ``alpha`` (place, word), and for each length the weight and id of the piece at a place."""
    texts = [w.decode("utf-8") for w in words]
    sizes = np.array([len(t) for t in texts])
    width, n = int(sizes.max()), len(words)
    code = np.full((n, width), -1, np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    code[np.arange(width) < sizes[:, None]] = np.where(flat == ord(MARK), LITERAL, np.where(flat == 32, ord(MARK), flat))
    code = np.ascontiguousarray(code.T)  # place, word
    symbol = np.where(code >= 0, lat.symbol[code], -1)
    reach = min(lat.longest, width)
    weight, ids = np.zeros((reach + 1, width, n)), np.full((reach + 1, width, n), -1, np.int32)
    node = np.zeros(width * n, np.int32)
    alive = np.arange(width * n)
    for length in range(1, reach + 1):
        alive = alive[alive < (width - length + 1) * n]
        node[alive] = lat.step(node[alive], symbol.reshape(-1)[alive + (length - 1) * n])
        alive = alive[node[alive] > 0]
        if not len(alive):
            reach = length - 1
            break
        piece = lat.piece[node[alive]]
        at, piece = alive[piece >= 0], piece[piece >= 0]
        ids[length].reshape(-1)[at], weight[length].reshape(-1)[at] = piece, lat.weight[piece]
    reach = max(reach, 1)
    lone = (code >= 0) & (ids[1] < 0)
    if lone.any():
        ids[1][lone], weight[1][lone] = SPELLED + code[lone], lat.byte_weight
    # scaled at each place where words are long, so that sums stay within range
    long = width > UNSCALED
    alpha, scale = np.zeros((width + 1, n)), np.zeros((width + 1, n))
    alpha[0] = 1.0
    for k in range(1, width + 1):
        total = np.zeros(n)
        for length in range(1, min(reach, k) + 1):
            total += alpha[k - length] * np.exp(scale[k - length] - scale[k - 1]) * weight[length][k - length] if long else alpha[k - length] * weight[length][k - length]
        if long:
            some = total > 0
            alpha[k], scale[k] = some, scale[k - 1] + np.log(np.where(some, total, 1.0))
        else:
            alpha[k] = total
    return {"alpha": alpha, "scale": scale, "weight": weight[: reach + 1], "ids": ids[: reach + 1], "sizes": sizes, "long": long}


def backward(f: dict, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled pieces of each occurrence of a word, last piece first: (occurrence, id) in order of drawing."""
    at = f["sizes"][word].copy()
    active = np.arange(len(word))
    who, got = [], []
    step = 0
    reach = len(f["weight"]) - 1
    while len(active):
        place, w = at[active], word[active]
        draw = (mix(key[active] + np.uint64((step * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        share = np.zeros((reach, len(active)))
        for length in range(1, reach + 1):
            ok = place >= length
            start = np.where(ok, place - length, 0)
            p = f["alpha"][start, w] * f["weight"][length, start, w]
            if f["long"]:
                p = p * np.exp(f["scale"][start, w] - f["scale"][place, w])
            share[length - 1] = np.where(ok, p, 0.0)
        np.cumsum(share, axis=0, out=share)
        length = 1 + (share <= draw * share[-1]).sum(axis=0)
        length = np.minimum(length, place)
        start = place - length
        who.append(active)
        got.append(f["ids"][length, start, w])
        at[active] = start
        active = active[start > 0]
        step += 1
    return np.concatenate(who), np.concatenate(got)


class LongWord:
    """The lattice of one very long word (text without spaces), of which a window's pieces are held at a time.

    The forward sums, as logarithms, are carried from window to window, 8 bytes for a character; the backward pass takes the
    windows in reverse and finds their pieces again. Draws are those of ``backward``: from the word's key and the step.
    """

    def __init__(self, lat: Lattice, word: bytes):
        code = np.frombuffer(word.decode("utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
        self.lat, self.code = lat, np.where(code == ord(MARK), LITERAL, np.where(code == 32, ord(MARK), code))
        self.symbol, self.n = lat.symbol[self.code], len(code)

    def pieces(self, start: int, end: int) -> tuple[list[int], list[int], list[int], list[float]]:
        """Pieces that end at the places from ``start`` + 1 to ``end``: where each place's begin in the lists, and length, id and log weight."""
        lat, low = self.lat, max(0, start + 1 - self.lat.longest)
        at = np.arange(low, end)
        node = np.zeros(len(at), np.int32)
        ends, sizes, ids = [], [], []
        for length in range(1, lat.longest + 1):
            ok = at + length <= end
            at, node = at[ok], node[ok]
            node = lat.step(node, self.symbol[at + length - 1])
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                break
            piece = lat.piece[node]
            hit = (piece >= 0) & (at + length > start)
            ends.append(at[hit] + length)
            sizes.append(np.full(int(hit.sum()), length))
            ids.append(piece[hit])
        one = ends[0][sizes[0] == 1] if ends else np.empty(0, np.int64)
        lone = np.setdiff1d(np.arange(start + 1, end + 1), one)  # characters that are no piece are spelled in bytes
        end_, size, id_ = (np.concatenate([*x, y]) for x, y in ((ends, lone), (sizes, np.ones(len(lone), np.int64)), (ids, SPELLED + self.code[lone - 1])))
        order = np.lexsort((size, end_))
        end_, size, id_ = end_[order], size[order], id_[order]
        weight = np.log(np.where(id_ >= SPELLED, lat.byte_weight, lat.weight[np.minimum(id_, len(lat.weight) - 1)]))
        return np.searchsorted(end_, np.arange(start + 1, end + 2)).tolist(), size.tolist(), id_.tolist(), weight.tolist()

    def sample(self, key: int) -> np.ndarray:
        """Ids of one sampled segmentation, in order."""
        exp, log, alpha = math.exp, math.log, array("d", [0.0])
        for start in range(0, self.n, WINDOW):
            end = min(self.n, start + WINDOW)
            first, size, _, weight = self.pieces(start, end)
            for k in range(end - start):
                a, b, place = first[k], first[k + 1], start + k + 1
                parts = [alpha[place - size[i]] + weight[i] for i in range(a, b)]
                top = max(parts)
                alpha.append(top + log(sum([exp(x - top) for x in parts])))
        out, place, step, draws = array("q"), self.n, 0, []
        for start in reversed(range(0, self.n, WINDOW)):
            if place <= start:
                continue
            first, size, ids, weight = self.pieces(start, place)
            while place > start:
                if step % WINDOW == 0:
                    steps = np.arange(step, step + WINDOW, dtype=np.uint64)
                    draws = ((mix(np.uint64(key) + steps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
                a, b, now = first[place - start - 1], first[place - start], alpha[place]
                share = list(accumulate([exp(alpha[place - size[i]] + weight[i] - now) for i in range(a, b)]))
                i = a + min(bisect_right(share, draws[step % WINDOW] * share[-1]), b - a - 1)
                out.append(ids[i])
                place -= size[i]
                step += 1
        return np.frombuffer(out, np.int64)[::-1]


def sample_batch(lat: Lattice, texts: list[bytes], keys: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
    """Sampled piece ids of each text."""
    split = [words_of(t) if t else [] for t in texts]
    n_words = np.array([len(w) for w in split])
    total = int(n_words.sum())
    if not total:
        return [np.empty(0, np.int32)] * len(texts)
    flat = list(chain.from_iterable(split))
    distinct = list(dict.fromkeys(flat))
    place = dict(zip(distinct, range(len(distinct))))
    index = np.fromiter(map(place.__getitem__, flat), np.int64, total)
    row = np.repeat(np.arange(len(texts)), n_words)
    nth = np.arange(total) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    key = mix(mix(keys.astype(np.uint64) + np.uint64(seed))[row] + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))

    # groups of words of nearly the same length
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    by_size = np.argsort(sizes, kind="stable")
    ranked = sizes[by_size]
    group, slot = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
    groups, start = [], 0
    short = int(np.searchsorted(ranked, LONG_BYTES, "right"))
    while start < short:
        alike = min(short, int(np.searchsorted(ranked, max(4, int(ranked[start]) * 5 // 4 + 1), "right")))
        end = min(alike, start + max(1, CELLS // int(ranked[alike - 1])))
        group[by_size[start:end]], slot[by_size[start:end]] = len(groups), np.arange(end - start)
        groups.append(by_size[start:end])
        start = end
    group[by_size[short:]] = len(groups)
    of = group[index]
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(len(groups) + 1))
    who, got = [], []
    for g, members in enumerate(groups):
        mine = order[bounds[g] : bounds[g + 1]]
        a, b = backward(forward(lat, [distinct[i] for i in members]), slot[index[mine]], key[mine])
        who.append(mine[a])
        got.append(b)
    for i in order[bounds[-1] :].tolist():
        ids = LongWord(lat, flat[i]).sample(int(key[i]))
        who.append(np.full(len(ids), i))
        got.append(ids[::-1])
    occurrence, ids = np.concatenate(who), np.concatenate(got)
    # the draws of an occurrence come last piece first
    counts = np.bincount(occurrence, minlength=total)
    order = np.argsort(occurrence, kind="stable")
    first = np.cumsum(counts) - counts
    within = np.arange(len(ids)) - np.repeat(first, counts)
    out = np.empty(len(ids), np.int64)
    out[np.repeat(first + counts - 1, counts) - within] = ids[order]
    row_of = np.repeat(row, counts)
    spelled = np.flatnonzero(out >= SPELLED)
    if len(spelled):
        codes = out[spelled] - SPELLED
        names = [[lat.byte_id[b] for b in (MARK if c == LITERAL else chr(c)).encode("utf-8", "surrogatepass")] for c in codes.tolist()]
        times = np.ones(len(out), np.int64)
        times[spelled] = [len(x) for x in names]
        begin = (np.cumsum(times) - times)[spelled]
        out, row_of = np.repeat(out, times), np.repeat(row_of, times)
        out[np.repeat(begin, times[spelled]) + np.concatenate([np.arange(len(x)) for x in names])] = np.concatenate(names)
    ends = np.cumsum(np.bincount(row_of, minlength=len(texts)))[:-1]
    return np.split(out.astype(np.int32), ends)


def decode(lat: Lattice, ids: list[int]) -> bytes:
    return b"".join(map(lat.text_of.__getitem__, ids))[1:]


def _keys(column: pa.Array) -> np.ndarray:
    """A row's key as uint64: integers themselves, anything else by the hash of its text; null is 0."""
    if pa.types.is_integer(column.type):
        return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return np.array([int.from_bytes(zlib.crc32(str(x).encode()).to_bytes(4, "big") * 2, "big") if x is not None else 0 for x in column.to_pylist()], np.uint64)


#: Text that is sampled at once.
RUN_BYTES = 2 << 20


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, seed: int = SEED, with_ids: bool = True, check: bool = False) -> DataFrame:
    """(id, n_pieces, ids_crc32[, ids][, decoded_crc32, lossless]): one sampled segmentation of every whole text."""
    path = model_path or default_model()

    def work(columns, texts):
        lat, keys = lattice(path), _keys(columns["id"])
        found: list[np.ndarray] = []
        start = size = 0
        for i, t in enumerate([*texts, None]):
            if t is None or (i > start and size + len(t) > RUN_BYTES):
                found += sample_batch(lat, texts[start:i], keys[start:i], seed) if i > start else []
                start, size = i, 0
            size += len(t or b"")
        out = {"id": columns["id"], "n_pieces": pa.array([len(x) for x in found], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64())}
        if with_ids:
            out["ids"] = pa.array(found, pa.list_(pa.int32()))
        if check:
            back = [decode(lat, x.tolist()) for x in found]
            out |= {"decoded_crc32": pa.array([zlib.crc32(x) for x in back], pa.int64()), "lossless": pa.array([a == b for a, b in zip(back, texts)])}
        return out

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    schema = f"id {kind}, n_pieces bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids + ", decoded_crc32 bigint, lossless boolean" * check
    return map_texts(docs, work, schema, text_col=text_col, keep={"id": id_col}).withColumnRenamed("id", id_col)


def decode_column(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """(id, text) from piece ids; a null list is an empty text."""
    path = model_path or default_model()

    def run(batches):
        for batch in batches:
            texts = [decode(lattice(path), x or []).decode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    base = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, text string").withColumnRenamed("id", id_col)
