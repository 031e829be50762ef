"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are tokenised in Arrow batches and cut into pieces of at most one sequence. The pieces fall into groups of
a few thousand by a seeded hash; each group is packed on its own, so no task ever holds more than its groups' lengths.
With thousands of pieces a group, first-fit decreasing leaves the padding of a group's last few bins only.

Defined cases: a null or empty text is the end token alone; equal rows are packed as rows of their own; a null id stays null;
a text longer than a sequence gives several pieces; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import os
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written

CAPACITY = 2048
GROUP_PIECES = 8192
SEED = 404
#: Added after each document.
END_ID = 1
#: Words whose ids a worker remembers; it forgets them all beyond that.
MEMO_WORDS = 1_200_000
#: Bytes of text whose unknown words are encoded together.
LEARN_BYTES = 1 << 20
TAIL = b".,;:!?%$&*#\"')("


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts as little-endian uint32 bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    For a tokenizer that lower-cases, drops white space and never joins what stands on two sides of it, a text's ids are
    its words' ids in order. Words repeat, so each is encoded once. Texts that may hold a special token's string are
    encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.letters: dict[str, bool] = {}

    def _ends_in_letter(self, core: bytes) -> bool:
        """Whether the tokenizer parts ``core`` from punctuation after it: its last character, normalised, ends in a letter."""
        if core[-1] < 128:
            return 97 <= core[-1] <= 122
        at = len(core) - 1
        while core[at] & 0xC0 == 0x80:
            at -= 1
        c = core[at:].decode("utf-8")
        if c not in self.letters:
            form = self.tokenizer.normalizer
            self.letters[c] = (form.normalize_str(c) if form else c)[-1:].isalpha()
        return self.letters[c]

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        new = words.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = words
        if not new:
            return
        memo, cut, todo = self.memo, [], set()
        for w in new:
            core = w.rstrip(TAIL)
            if len(core) < len(w) and core and self._ends_in_letter(core):
                # a run of punctuation at the end of a word is a token run of its own
                tail = w[len(core) :]
                cut.append((w, core, tail))
                todo.update(x for x in (core, tail) if x not in memo)
            elif w not in memo:
                todo.add(w)
        names = [(w, w.decode("utf-8")) for w in todo]
        plain = [x for x in names if x[1].isalpha() and x[1].islower() and unicodedata.is_normalized("NFC", x[1])]
        if plain:
            # letters only: one word for the tokenizer, so many can be encoded as one text
            got = self.tokenizer.encode(" ".join(x[1] for x in plain), add_special_tokens=False)
            at = np.array(got.word_ids, np.int64)
            if len(at) and at[-1] + 1 == len(plain):
                ids = np.array(got.ids, "<u4").tobytes()
                ends = (np.flatnonzero(np.diff(at, append=-1)) + 1) * 4
                start = 0
                for (w, _), end in zip(plain, ends.tolist()):
                    memo[w] = ids[start:end]
                    start = end
            else:
                plain = []
        rest = [x for x in names if x[0] not in memo]
        memo.update(zip((w for w, _ in rest), self._encode([s for _, s in rest])))
        for w, core, tail in cut:
            memo[w] = memo[core] + memo[tail]

    def _run(self, texts: list[bytes]) -> list[bytes]:
        split = [text.lower().split() for text in texts]
        self._learn(set().union(*split))
        look = self.memo.__getitem__
        return [b"".join(map(look, words)) for words in split]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        run: list[bytes] = []
        size = 0
        for text in texts:
            special = b"<|" in text
            if run and (special or size + len(text) > LEARN_BYTES):
                out += self._run(run)
                run, size = [], 0
            if special:
                out += self._encode([text.decode("utf-8")])
            else:
                run.append(text)
                size += len(text)
        return out + self._run(run)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, which runs many tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, salt[, ids]): each document's ids, cut into runs of at most ``capacity``."""
    path = tokenizer_path or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()
    width = 4 * capacity

    def work(columns, texts):
        rows, cells = [], []
        for k, ids in enumerate(tokenizer(path).encode(texts)):
            ids += end
            for at in range(0, len(ids), width):
                run = ids[at : at + width]
                rows.append((k, at // 4, len(run) // 4, zlib.crc32(run), len(ids) // 4, len(rows)))
                if with_ids:
                    cells.append(np.frombuffer(run, "<i4"))
        k, *rest = (np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 6))
        out = {"id": columns["id"].take(pa.array(k)), **{n: pa.array(c) for n, c in zip(("start", "length", "ids_crc32", "doc_tokens", "salt"), rest)}}
        return out | ({"ids": pa.array(cells, pa.list_(pa.int32()))} if with_ids else {})

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, salt bigint" + ", ids array<int>" * with_ids
    return map_texts(docs, work, schema, text_col=text_col, keep={"id": id_col})


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order (decreasing).

    The tree's leaves are the bins' free room, each inner node the most room below it; going left where there is room
    finds the first bin that fits in logarithmic time.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    for k, size in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        where[k], offset[k] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node >>= 1
            room = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == room:
                break
            tree[node] = room
    return where, offset


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""
    cut = written(pieces(docs, id_col=id_col, text_col=text_col, tokenizer_path=tokenizer_path, capacity=capacity, with_ids=with_ids), "pieces")
    groups = max(1, math.ceil(cut.count() / group_pieces))
    dealt = cut.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string"), "start", "salt"), F.lit(groups)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "start", "salt"], ascending=[False, True, True, True], kind="stable")
        where, offset = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf["g"].to_numpy() << 24) + where, offset=offset).drop(columns=["g", "salt"])

    kept = [f for f in cut.schema.fields if f.name != "salt"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("g").applyInPandas(fit, schema).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, *, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, input_ids, n_tokens) of ``pack(..., with_ids=True)``, padded to ``capacity``."""
    run = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform("run", lambda x: x["ids"]))
    return packed.groupBy("sequence_id").agg(run.alias("run")).select("sequence_id", ids.alias("ids")).select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("ids"))).alias("input_ids"), F.size("ids").alias("n_tokens"))
