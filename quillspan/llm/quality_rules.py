"""Quality rules: plain text statistics, then bands of n-gram perplexity by language.

The model of a language is an interpolated modified Kneser-Ney model (Chen and Goodman, 1999) of 4-grams of characters:
code points in lower case, white space and digits being one symbol each, so every script is modelled. Spark counts the
n-grams and derives discounts, back-off weights and probabilities as joins and windows over tables of n-grams, by language; the
model grows with the corpus.

How it runs. The documents become blocks of some megabytes (``blocks``). A block adds up its own n-grams first and sends each
different one once (``asked``). What the model tells of an n-gram is kept in sorted hash arrays (the 64-bit code of four
symbols is its hash) beside the arrays of log probabilities, in which a document looks up each of its symbols (``scored``).
A model of up to ``MODEL_FEW`` n-grams, which that of a few alphabets never passes, is broadcast. A larger one is joined with what
the blocks asked for, and each block gets its own part (``answers``): the same values, and rows in proportion to the data.

Each symbol is judged with one occurrence of its n-gram left out. A document's perplexity must lie in its language's band: the middle half of its language's texts, in log10 per
symbol, widened on both sides by ``WIDTH`` times its own width, and by ``LEAST`` at least. Below it lie texts that repeat
themselves, above it noise. Texts with the same least hash of a five-word shingle weigh once in the model: copies always share it, and
near copies with a probability of their Jaccard similarity, so a large group of either doesn't look too predictable beside the others, or the
others too rare. Different texts share it as well, by a line that many have, so for the bands sketches of all shingles are compared: every
text shapes its band that is no near copy of another that does, and a large group of copies can't narrow it.

Defined cases: a null text has no words and fails the base rules; a null language is a language of its own; documents
that fail the base rules don't shape the bands; a language with one document keeps it; an empty table gives no rows;
columns named like the results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import near_copies
from .common import as_bytes, broadcast_if_few, drop, released, slices, written

#: Symbols of an n-gram, and bits of a symbol.
ORDER, BITS = 4, 16
MIN_WORDS, MOST_REPEATED = 50, 50
WIDTH = 2.5
#: Near copies, for the bands, have so large a part of their shingles in common.
ALIKE = 0.5
#: A band reaches so far, at least, beyond its quartiles, however little its texts differ.
LEAST = 0.025
#: Steps in one unit of log perplexity, for its quartiles.
STEPS = 10_000
#: Steps in one unit of a symbol's log probability, for sums.
FIXED = float(1 << 32)
SYMBOLS = b"#*$%&|<>"
LISTED = ["lang", "gist", "sketch", "size", "hash", "fails"]
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Text of a block, in bytes, and rows of one, the bits of a bitmap of Spark's. N-grams are made of so much text at once.
BLOCK_BYTES, BLOCK_ROWS, RUN_BYTES = 16 << 20, 1 << 15, 2 << 20
#: Rows of tables by language up to this many are looked up by broadcast; and n-grams of a model, of 20 bytes each.
FEW, MODEL_FEW = 200_000, 3_000_000


@cache
def symbol_table() -> np.ndarray:
    """Symbol of each code point, 16 bits. Code points beyond 16 bits share the 2,048 values that no character has."""
    out = 0xD800 + (np.arange(0x110000, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(2048)
    for i in range(1 << BITS):
        c = chr(i)
        out[i] = 32 if c.isspace() else 48 if c.isdecimal() else min(ord(c.lower()[0]), 0xFFFF)
    return out


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character, all texts in a row, first symbol highest, and where each text ends. Texts start after white space."""
    gap = " " * (ORDER - 1)
    words = [t.decode("utf-8", "replace") for t in texts]
    flat = symbol_table()[np.frombuffer("".join(x for t in words for x in (gap, t)).encode("utf-32-le", "replace"), "<u4")]
    code = flat.copy()
    for k in range(1, ORDER):
        code[k:] |= flat[:-k] << np.uint64(BITS * k)
    sizes = np.array([len(t) for t in words], np.int64)
    ends = np.cumsum(sizes + len(gap))
    inside = np.ones(len(flat), bool)
    for k in range(len(gap)):
        inside[ends - sizes - 1 - k] = False
    return code[inside], np.cumsum(sizes)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more, first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total = reached = 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, reached)
            reached = i + 3
    return total


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()  # bytes: at x20 and x09-x0D only
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = b"".join(words)
    points = len(letters) if letters.isascii() else len(letters.decode("utf-8", "replace"))
    return len(words), points, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def stored_as(kept: list[tuple[str, str]], text_col: str) -> list[str]:
    """Names of the ``kept`` columns inside a block: own ones, and ``text`` for the text."""
    return ["text" if (c, kind) == (text_col, "string") else f"kept_{i}" for i, (c, kind) in enumerate(kept)]


def blocks(docs: DataFrame, kept: list[tuple[str, str]], text_col: str, lang_col: str) -> DataFrame:
    """(block, docs, langs, gists, sketches, sizes, hashes, fails): runs of documents with their ``kept`` columns, texts and statistics as compressed Arrow data.

    ``langs`` are hashes of the languages, ``gists`` the least hashes of five-word shingles, ``sketches`` those of all shingles, ``sizes`` and
    ``hashes`` those of the texts, ``fails`` whether the base rules do, one for each document.
    """
    lang = F.col(f"`{lang_col}`").cast("string")
    extra = [F.col(f"`{c}`").alias(n) for (c, _), n in zip(kept, stored_as(kept, text_col)) if n != "text"]
    base = docs.select(*extra, F.xxhash64(lang, lang.isNull()).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    text_at = len(base.columns) - 1

    def packed(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        (whole,) = pa.Table.from_batches(parts).combine_chunks().to_batches()
        listed, whole = whole.select(LISTED), whole.drop_columns([c for c in LISTED if c != "lang"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(whole)
        lists = [pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), c) for c in listed.columns]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), *lists], names=["block", "docs", "langs", "gists", "sketches", "sizes", "hashes", "fails"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        parts, size, rows = [], 0, 0
        for batch in batches:
            for part in slices(batch, limit=RUN_BYTES):
                texts = as_bytes(part.column(text_at))
                stats = [np.array(x, np.int64) for x in zip(*map(statistics, texts))]
                gists, sketches = zip(*map(near_copies.gist, texts))
                fails = pa.array(base_failed(dict(zip(FEATURES, stats))))
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * near_copies.BINS, pa.int32()), pa.array(np.concatenate(sketches)))
                hashes = pa.array(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64))
                sizes = pa.array(map(len, texts), pa.int64())
                n = sum(map(len, texts))
                if parts and (size + n > BLOCK_BYTES or rows + len(texts) > BLOCK_ROWS):
                    yield packed(task << 24 | made, parts)
                    parts, size, rows, made = [], 0, 0, made + 1
                parts.append(pa.RecordBatch.from_arrays([*part.columns, pa.array(gists, pa.int64()), sketches, sizes, hashes, fails, *map(pa.array, stats)], names=[*part.schema.names, *LISTED[1:], *FEATURES]))
                size, rows = size + n, rows + len(texts)
        if parts:
            yield packed(task << 24 | made, parts)

    return base.mapInArrow(released(run), "block bigint, docs binary, langs array<bigint>, gists array<bigint>, sketches array<array<smallint>>, sizes array<bigint>, hashes array<bigint>, fails array<boolean>")


def unpacked(docs: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(docs).read_next_batch()


def by_language(docs: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[np.ndarray, list[bytes]]]]]:
    """(language, [(rows, texts)]) of a block's documents, in runs of ``RUN_BYTES`` of text or one document."""
    names = docs.schema.names
    langs, texts = docs.column(names.index("lang")).to_numpy(), docs.column(names.index("text"))
    sizes = np.array(pc.fill_null(pc.binary_length(texts), 0))
    for lang in np.unique(langs).tolist():
        at = np.flatnonzero(langs == lang)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[at]) // RUN_BYTES)) + 1
        yield lang, [(rows, as_bytes(texts.take(pa.array(rows)))) for rows in np.split(at, cuts)]


def counted(table: DataFrame) -> DataFrame:
    """(block, bits, shapes): which of a block's documents the model counts, and which shape the bands, as bitmaps.

    Of the texts with one gist the model counts the longest, of equally long ones that of the least hash, however the documents are dealt to
    blocks. For the bands its near copies form a class with it; the others are grouped again, by their gist and the least value of half their
    sketch, then of the other half, and what is left by then is no one's copy. The first of a class that passes the base rules shapes the bands.
    """
    zipped = F.posexplode(F.arrays_zip("langs", "gists", "sketches", "sizes", "hashes", "fails")).alias("i", "d")
    place = F.struct((-F.col("d.sizes")).alias("size"), F.col("d.hashes").alias("hash"), "block", "i", F.col("d.fails").alias("fails")).alias("at")
    each = table.select("block", zipped).select(F.col("d.langs").alias("lang"), F.col("d.gists").alias("gist"), F.col("d.sketches").alias("sketch"), place)
    rest = each.groupBy("lang", "gist", "at.size", "at.hash").agg(F.min("at").alias("at"), F.first("sketch").alias("sketch")).drop("size", "hash")
    half = near_copies.BINS // 2
    found, made = [], []
    for start in (None, 1, half + 1):
        key = F.lit(0) if start is None else F.coalesce(F.array_min(F.filter(F.slice("sketch", start, half), lambda x: x >= 0)), F.lit(-1))
        rest = written(rest.withColumn("key", key.cast("int")), "texts")
        first = rest.groupBy("lang", "gist", "key").agg(F.min(F.struct("at", "sketch")).alias("first"))
        met = written(rest.join(first, ["lang", "gist", "key"]).withColumn("alike", (F.col("at") == F.col("first.at")) | near_copies.alike(F.col("sketch"), F.col("first.sketch"), ALIKE)), "met")
        found.append(met.filter("alike").select("lang", "at", F.col("first.at").alias("of")))
        made += [rest, met]
        rest = met.filter("not alike").select("lang", "gist", "at", "sketch")
    found.append(rest.select("lang", "at", F.col("at").alias("of")))
    classes = reduce(DataFrame.union, found).filter("not at.fails").groupBy("lang", "of").agg(F.min("at").alias("at"))
    learned = made[0].groupBy("lang", "gist").agg(F.min("at").alias("at"))
    ends = learned.select("at.block", "at.i", F.lit(True).alias("learned")).union(classes.select("at.block", "at.i", F.lit(False)))
    bit = lambda learned: F.bitmap_construct_agg(F.when(F.col("learned") == learned, F.col("i").cast("bigint")))
    bits = written(ends.groupBy("block").agg(bit(True).alias("bits"), bit(False).alias("shapes")), "counted")
    drop(*made)
    return bits


def _flags(bits: bytes | None) -> np.ndarray:
    """A bitmap as an array."""
    return np.unpackbits(np.frombuffer(bits or bytes(BLOCK_ROWS // 8), np.uint8), bitorder="little").astype(bool)


def asked(table: DataFrame, counted: DataFrame) -> DataFrame:
    """(block, lang, grams, counts): each block's different n-grams, sorted, and how often they stand in texts that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs, bits in zip(*(c.to_pylist() for c in batch.columns)):
                first = _flags(bits)
                for lang, runs in by_language(unpacked(docs)):
                    grams, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
                    for at, texts in runs:
                        code, ends = codes(texts)
                        counts_too = np.repeat(first[at], np.diff(ends, prepend=0))
                        seen, n = np.unique(code[counts_too], return_counts=True)
                        rest = np.unique(code[~counts_too])
                        grams, place = np.unique(np.concatenate([grams, seen, rest]), return_inverse=True)
                        counts = np.bincount(place, weights=np.concatenate([counts, n, np.zeros(len(rest))]), minlength=len(grams)).astype(np.int64)
                    if len(grams):
                        cells = [pa.array([x], kind) for x, kind in ((block, pa.int64()), (lang, pa.int64()), (grams.view(np.int64), pa.list_(pa.int64())), (counts, pa.list_(pa.int64())))]
                        yield pa.RecordBatch.from_arrays(cells, names=["block", "lang", "grams", "counts"])

    return table.select("block", "docs").join(counted, "block", "left").select("block", "docs", "bits").mapInArrow(released(run), "block bigint, lang bigint, grams array<bigint>, counts array<bigint>")


def _low(gram: Column, symbols: int) -> Column:
    """The last ``symbols`` of an n-gram."""
    return gram.bitwiseAND(F.lit((1 << BITS * symbols) - 1).cast("bigint"))


def discounts(levels: dict[int, DataFrame]) -> DataFrame:
    """(lang, d1, d2, ...): of each order the three discounts, from how many n-grams occur once, twice, three and four times.

    Fixed ones where there are too few counts to estimate them from.
    """
    every = reduce(DataFrame.union, [t.select("lang", "c", F.lit(k).alias("k")) for k, t in levels.items()])
    found = every.groupBy("lang").agg(*[F.count_if((F.col("k") == k) & (F.col("c") == i)).cast("double").alias(f"n{k}{i}") for k in levels for i in (1, 2, 3, 4)])

    def of(k: int) -> Column:
        n = [F.col(f"n{k}{i}") for i in (1, 2, 3, 4)]
        y = F.try_divide(n[0], n[0] + 2 * n[1])
        d = [F.lit(i) - (i + 1) * y * F.try_divide(n[i], n[i - 1]) for i in (1, 2, 3)]
        fits = F.least(*n) > 0
        for i in (1, 2, 3):
            fits = fits & (d[i - 1] > 0) & (d[i - 1] < i)
        return F.when(fits, F.array(*d)).otherwise(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5)))

    return found.select("lang", *[of(k).alias(f"d{k}") for k in levels])


def _estimate(c: Column, total: Column, kinds: list[Column], lower: Column) -> Column:
    """Interpolated probability from a count, its context's total and numbers of n-grams seen once, twice and more, and the discounts ``d``."""
    weight = sum((F.col("d")[i] * kinds[i] for i in range(3)), F.lit(0.0))
    own = F.when(c > 0, c - F.col("d")[F.least(c, F.lit(3)).cast("int") - 1]).otherwise(0.0)
    return F.when(total > 0, (own + weight * lower) / F.nullif(total, F.lit(0))).otherwise(lower)


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(lang, g, p, q): interpolated probability of each 4-gram's last symbol after the others, from grams(lang, g, c).

    Lower orders count the different symbols that stand before. An n-gram with a count of 0 has its back-off probability. All
    symbols of 16 bits share the rest of order one, so the probabilities of a context add up to one.

    ``q`` is the probability with one occurrence of the n-gram left out of the counts, of lower orders too where it was the
    only one: texts are judged by it, for a text of rare n-grams would know itself by heart.
    """
    levels = {ORDER: written(grams, "grams")}
    for k in range(ORDER - 1, 0, -1):
        lower = levels[k + 1].groupBy("lang", _low(F.col("g"), k).alias("g")).agg(F.count_if(F.col("c") > 0).alias("c"))
        levels[k] = written(lower, "grams") if k == ORDER - 1 else lower
    d = broadcast_if_few(written(discounts(levels), "discounts"), FEW)
    below = None
    for k in range(1, ORDER + 1):
        w = Window.partitionBy("lang", "h")  # as many rows as there are symbols, at most
        kinds = [F.count_if(F.col("c") == 1).over(w), F.count_if(F.col("c") == 2).over(w), F.count_if(F.col("c") >= 3).over(w)]
        known = levels[k].withColumn("h", F.shiftrightunsigned("g", BITS)).select("lang", "g", "c", F.sum("c").over(w).alias("total"), F.array(*kinds).alias("kinds"))
        known = known.join(d.select("lang", F.col(f"d{k}").alias("d")), "lang")
        if below is None:
            known = known.withColumns({"lp": F.lit(2.0**-BITS), "lq": F.lit(2.0**-BITS)})
        else:
            known = known.withColumn("s", _low(F.col("g"), k - 1)).join(below.select("lang", F.col("g").alias("s"), F.col("p").alias("lp"), F.col("q").alias("lq")), ["lang", "s"])
        c, n = F.col("c"), [F.col("kinds")[i] for i in range(3)]
        one, two, three = ((c == i).cast("long") for i in (1, 2, 3))
        left = [n[0] - one + two, n[1] - two + three, n[2] - three]
        p = _estimate(c, F.col("total"), n, F.col("lp"))
        q = F.when(c > 0, _estimate(c - 1, F.col("total") - 1, left, F.when(c == 1, F.col("lq")).otherwise(F.col("lp")))).otherwise(p)
        below = known.select("lang", "g", p.alias("p"), q.alias("q"))
    return below


def answers(asked: DataFrame, model: DataFrame) -> DataFrame:
    """(block, model): for each block the part of the model that it asked for, one hash array for each language.

    N-grams and values are gathered side by side, which takes a third of what structs would; a block sorts its arrays.
    """
    rows = asked.select("block", "lang", F.explode("grams").alias("g")).join(model.select("lang", "g", F.log10("q").cast("float").alias("p")), ["lang", "g"])
    arrays = rows.groupBy("block", "lang").agg(F.collect_list("g").alias("g"), F.collect_list("p").alias("p"))
    return arrays.groupBy("block").agg(F.collect_list(F.struct("lang", "g", "p")).alias("model"))


def hash_arrays(model: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Language -> sorted n-grams and log10 probabilities, of a model that has been found small."""
    rows = model.select("lang", "g", F.log10("q").cast("float").alias("p")).toArrow().combine_chunks()
    lang, g, p = (rows.column(c).to_numpy() for c in ("lang", "g", "p"))
    g = g.view(np.uint64)
    order = np.lexsort((g, lang))
    cut = np.flatnonzero(np.diff(lang[order])) + 1
    return {int(lang[at[0]]): (g[at], p[at]) for at in np.split(order, cut) if len(at)}


def scored(table: DataFrame, counted: DataFrame, found: DataFrame | dict, kept: list[tuple[str, str]], text_col: str) -> DataFrame:
    """The blocks' documents: ``kept`` columns, statistics, log_perplexity (mean negative log10 probability of a symbol; 0 without any), lang, shapes.

    ``found`` is the whole model as hash arrays, or a table(block, model) of each block's part.
    """
    stored = stored_as(kept, text_col)
    names = [f"kept_{i}" for i in range(len(kept))]
    shared = table.sparkSession.sparkContext.broadcast(found) if isinstance(found, dict) else None

    def part(model: pa.ListScalar) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for m in model.values or []:
            g, p = m["g"].values.to_numpy().view(np.uint64), m["p"].values.to_numpy()
            order = np.argsort(g)
            out[m["lang"].as_py()] = g[order], p[order]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs = unpacked(batch.column(0)[i].as_py())
                model = shared.value if shared else part(batch.column(2)[i])
                out = np.zeros(docs.num_rows)
                for lang, runs in by_language(docs):
                    for at, texts in runs:
                        code, ends = codes(texts)
                        if len(code):
                            g, p = model[lang]
                            # whole numbers, so that a sum doesn't depend on what stands before
                            total = np.append(0, np.cumsum(np.rint(p[np.searchsorted(g, code)].astype(np.float64) * -FIXED).astype(np.int64)))
                            starts = np.append(0, ends[:-1])
                            out[at] = (total[ends] - total[starts]) / (FIXED * np.maximum(ends - starts, 1))
                column = lambda n: docs.column(docs.schema.names.index(n))
                yield pa.RecordBatch.from_arrays([*map(column, (*stored, *FEATURES)), pa.array(out), column("lang"), pa.array(_flags(batch.column(1)[i].as_py())[: docs.num_rows])], names=[*names, *FEATURES, "log_perplexity", "lang", "shapes"])

    kinds = ", ".join(f"{n} {kind}" for n, (_, kind) in zip(names, kept))
    schema = (f"{kinds}, " if kept else "") + ", ".join(f"{f} bigint" for f in FEATURES) + ", log_perplexity double, lang bigint, shapes boolean"
    each = table.select("block", "docs").join(counted, "block", "left")
    each = each.select("docs", "shapes") if shared else each.join(found, "block", "left").select("docs", "shapes", "model")
    return each.mapInArrow(released(run), schema)


def base_failed(row: Mapping) -> Column | np.ndarray:
    """From the columns, or arrays, of the statistics."""
    return (row["n_words"] < MIN_WORDS) | (100 * row["n_repeat_words"] > MOST_REPEATED * row["n_words"])


def bands(marked: DataFrame, width: float = WIDTH) -> DataFrame:
    """(lang, lower, upper) of log perplexity: one row for each language; near copies weigh once.

    Quartiles come from counts by steps of 1 / ``STEPS``, so they are the same in every run, and a language has some tens
    of thousands of steps at most however many documents it has.
    """
    step = F.round(F.col("log_perplexity") * STEPS).cast("bigint")
    passed = marked.filter("shapes").select("lang", step.alias("step"))
    counted = passed.groupBy("lang", "step").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    placed = counted.withColumn("below", below).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    quartile = lambda q: F.min(F.when(F.col("below") >= q * F.col("all"), F.col("step"))) / STEPS
    by = placed.groupBy("lang").agg(quartile(0.25).alias("a"), quartile(0.75).alias("b"))
    spread = F.greatest(width * (F.col("b") - F.col("a")) + 0.5 / STEPS, F.lit(LEAST))
    return by.select("lang", (F.col("a") - spread).alias("lower"), (F.col("b") + spread).alias("upper"))


def quality_rules(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, width: float = WIDTH, model_few: int = MODEL_FEW) -> DataFrame:
    """``keep`` columns (all, if None) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_perplexity, base_failed, kept."""
    made = {*FEATURES, "log_perplexity", "base_failed", "kept"}
    kept = [(c, kind) for c, kind in docs.dtypes if c not in made and (keep is None or c in keep)]
    table = written(blocks(docs, kept, text_col, lang_col), "blocks")
    once = counted(table)
    wanted = written(asked(table, once), "asked")
    counts = wanted.select("lang", F.explode(F.arrays_zip("grams", "counts")).alias("x")).groupBy("lang", F.col("x.grams").alias("g")).agg(F.sum("x.counts").alias("c"))
    model = written(kneser_ney(counts), "model")
    found = hash_arrays(model) if model.limit(model_few + 1).count() <= model_few else answers(wanted, model)
    marked = written(scored(table, once, found, kept, text_col), "rules")
    drop(table, once, wanted, model)
    limits = broadcast_if_few(written(bands(marked, width), "bands"), FEW)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    judged = marked.join(limits, "lang", "left")
    judged = judged.withColumn("base_failed", base_failed(judged))
    names = [F.col(f"kept_{i}").alias(c) for i, (c, _) in enumerate(kept)]
    return judged.select(*names, *FEATURES, "log_perplexity", "base_failed", (~F.col("base_failed") & inside).alias("kept"))
