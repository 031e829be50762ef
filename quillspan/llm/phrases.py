"""Phrases that stick together, mined after Toivonen: a sample proposes, one pass over all counts, failures are counted afterwards.

A quarter of the documents, by hash, proposes frequent words and word pairs at a lowered threshold. A full pass then counts
every word, every pair of proposed words and every longer phrase whose two parts (without its last, without its first word)
are proposed: all that is proposed and its negative border, exactly. A word or part that turns out frequent without having been proposed
is a failure of the border: it is proposed too, and a further pass counts what became countable by it alone. That goes on until
there is none, so the counts of all phrases of ``least`` occurrences or more are exact however the sample fell.

What is proposed is kept as a bit array of fixed greatest size with two hashes (``MOST_BITS``), which is all that tasks get. It may take an
item for proposed that isn't; then more is counted, nothing is missed. Each slice of texts counts its own phrases and sends
them in sorted compressed blocks, one for each of the buckets in which the counts are added up. A frequent word is one row
of a slice; buckets go by the hash of whole phrases, so none is filled by one word or language.

Defined cases: a null language is ``und``; null and empty texts have no words; equal rows count each; a table without words
gives no rows; no columns but those named are read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote_from_bytes, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, drop, slices, written

#: One document of so many is in the sample; an item is proposed from so many occurrences there.
SAMPLE, PROPOSED = 4, 2
#: The bit array has about so many bits for each word of the sample, and never more than MOST_BITS (16 MB).
BITS_A_WORD, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 27
#: A bucket adds up the phrases of about so many words.
BUCKET_WORDS = 4_000_000
#: A bucket's lines are added up whenever so many have come.
MERGE_LINES = 1_500_000
#: Best phrases of a language are first chosen within so many parts of it.
PARTS = 64

#: Upper to lower case in A-Z; all that ends a piece becomes a full stop, which no word contains.
_BYTES = bytes(ord(".") if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return _mixed(h * np.uint64(31) + word)


def _proposed(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    last = np.uint64(len(bits) * 64 - 1)
    one, two = h & last, (h >> np.uint64(27)) & last
    low = np.uint64(63)
    six = np.uint64(6)
    return ((bits[one >> six] >> (one & low)) & (bits[two >> six] >> (two & low)) & np.uint64(1)).astype(bool)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _tally(groups: list, texts: list[bytes], longest: int, filters: list, old: list | None, buckets: int) -> Iterator[tuple[int, bytes, int, bytes]]:
    """(bucket, compressed lines, their size, compressed counts) of a slice.

    ``filters`` has the bit array of what is proposed for each length below ``longest`` (None: all of it), ``old`` those of the
    pass before. A line is the group, a vertical tab and the phrase; the empty phrase counts all words of the group.
    """
    words: list[bytes] = []
    sizes = []
    for t in texts:
        before = len(words)
        words += t.translate(_BYTES).replace(b".", b" . ").split()
        words.append(b".")
        sizes.append(len(words) - before)
    if not words:
        return
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    del words
    rank = np.empty(len(coded.dictionary), np.int64)
    order = pc.sort_indices(coded.dictionary)
    rank[order.to_numpy()] = np.arange(len(rank))
    names = coded.dictionary.take(order)
    word = rank[np.asarray(coded.indices)]
    known = {g: i for i, g in enumerate(sorted(set(groups)))}
    group = np.repeat(np.array([known[g] for g in groups], np.int64), sizes)
    prefixes = pa.array([quote_from_bytes(g.encode(), safe="").encode() + b"\x0b" for g in known], pa.large_binary())
    plain = names.to_pylist()
    stop = np.array([w == b"." for w in plain])[word]
    seeds = _mixed(_word_hashes([g.encode() for g in known]))
    hashes = _word_hashes(plain)
    first_hash = _mixed(hashes[word] ^ seeds[group])
    n = len(word)

    out_lines, out_counts, out_hash = [], [], []

    def give(at: np.ndarray, counts: np.ndarray, h: np.ndarray, length: int) -> None:
        lines = prefixes.take(pa.array(group[at]))
        if length:
            lines = pc.binary_join_element_wise(lines, names.take(pa.array(word[at])), pa.scalar(b"", pa.large_binary()))
            lines = pc.binary_join_element_wise(lines, *[names.take(pa.array(word[at + k])) for k in range(1, length)], pa.scalar(b" ", pa.large_binary())) if length > 1 else lines
        out_lines.append(lines)
        out_counts.append(counts)
        out_hash.append(h)

    if old is None:
        _, at, counts = np.unique(group[~stop], return_index=True, return_counts=True)
        at = np.flatnonzero(~stop)[at]
        give(at, counts, seeds[group[at]], 0)
    key = group * len(plain) + word  # in the order of lines
    counted, counted_before = ~stop, np.zeros(n, bool) if old is None else ~stop
    h = first_hash
    for length in range(1, longest + 1):
        new = np.flatnonzero(counted & ~counted_before)
        if length > 1 and len(new):
            # numbers of phrases from those of their parts, so that lines come out sorted
            number = key[new]
            for k in range(1, length):
                _, number = np.unique(number, return_inverse=True)
                number = number * len(plain) + word[new + k]
        else:
            number = key[new]
        if len(new):
            _, at, counts = np.unique(number, return_index=True, return_counts=True)
            at = new[at]
            give(at, counts, h[at], length)
        if length == longest:
            break
        ok = counted.copy()
        if filters[length - 1] is not None:
            place = np.flatnonzero(counted)
            ok[place] = _proposed(filters[length - 1], h[place])
        ok_before = np.zeros(n, bool)
        if old is not None:
            place = np.flatnonzero(counted_before)
            ok_before[place] = _proposed(old[length - 1], h[place])
        counted = np.zeros(n, bool)
        counted_before = np.zeros(n, bool)
        counted[:-1] = ok[:-1] & ok[1:]
        counted_before[:-1] = ok_before[:-1] & ok_before[1:]
        more = np.zeros(n, np.uint64)
        more[: n - length] = first_hash[length:]
        h = _joined(h, more)
    if not sum(map(len, out_lines)):
        return
    lines, counts = pa.concat_arrays(out_lines), np.concatenate(out_counts).astype(np.uint32)
    bucket = (np.concatenate(out_hash) >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    lines, counts, bucket = lines.take(pa.array(order)), counts[order], bucket[order]
    ends = np.concatenate((np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    codec = pa.Codec("zstd")
    start = 0
    for end in ends.tolist():
        raw = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, end - start], pa.int64()), lines.slice(start, end - start)), pa.scalar(b"\n", pa.large_binary()))[0].as_py()
        yield int(bucket[start]), codec.compress(raw, asbytes=True), len(raw), codec.compress(counts[start:end].tobytes(), asbytes=True), end - start
        start = end


def _blocks(docs: DataFrame, text_col: str, group_col: str, longest: int, filters, old, buckets: int) -> DataFrame:
    """Rows (bucket, lines, size, counts, n) of all slices."""
    shared = docs.sparkSession.sparkContext.broadcast((filters, old))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = shared.value
        for batch in batches:
            for part in slices(batch):
                rows = list(_tally(part.column(0).to_pylist(), as_bytes(part.column(1)), longest, now, before, buckets))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["bucket", "lines", "size", "counts", "n"])

    inner = docs.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")).alias("g"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return inner.mapInArrow(run, "bucket int, lines binary, size bigint, counts binary, n bigint")


def _lines(raw: bytes, n: int) -> pa.Array:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10)
    # the separators are cut away: every line but the last loses its own
    offsets = np.concatenate(([0], ends + 1, [len(raw) + 1]))
    assert len(offsets) == n + 1
    padded = pa.py_buffer(raw + b"\n")
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), padded])
    return pc.binary_slice(kept.cast(pa.binary()), 0, -1)


def _sums(blocks: DataFrame, least: int, parts: int) -> DataFrame:
    """(g, phrase, words, a): phrases of ``least`` occurrences or more, and the empty phrase of each group."""

    def added(have: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        table = pa.table({"k": pa.chunked_array([x for x, _ in have]), "a": pa.array(np.concatenate([y for _, y in have]))})
        table = table.group_by("k").aggregate([("a", "sum")]).combine_chunks()
        k = table.column("k").combine_chunks()
        return (k.chunk(0) if isinstance(k, pa.ChunkedArray) else k), table.column("a_sum").to_numpy()

    def finished(have: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k, a = added(have)
        total = pc.equal(pc.binary_slice(k, -1), pa.scalar(b"\x0b", pa.binary())).to_numpy(zero_copy_only=False)
        at = np.flatnonzero((a >= least) | total)
        pairs = [x.split(b"\x0b", 1) for x in k.take(pa.array(at)).to_pylist()]
        if pairs:
            words = [p.count(b" ") + 1 if p else 0 for _, p in pairs]
            yield pa.RecordBatch.from_pydict({"g": [unquote(g.decode()) for g, _ in pairs], "phrase": [p.decode() for _, p in pairs], "words": pa.array(words, pa.int32()), "a": pa.array(a[at], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        now, have, waiting = None, [], 0
        for batch in batches:
            for bucket, lines, size, counts, n in zip(*(batch.column(i) for i in range(5)), strict=True):
                if bucket.as_py() != now:
                    if have:
                        yield from finished(have)
                    now, have, waiting = bucket.as_py(), [], 0
                k = n.as_py()
                raw = codec.decompress(lines.as_py(), size.as_py(), asbytes=True)
                have.append((_lines(raw, k), np.frombuffer(codec.decompress(counts.as_py(), 4 * k, asbytes=True), np.uint32).astype(np.int64)))
                waiting += k
                if waiting > MERGE_LINES:
                    have, waiting = [added(have)], 0
        if have:
            yield from finished(have)

    dealt = blocks.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "g string, phrase string, words int, a bigint")


def _bits(items: DataFrame, size: int, without: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Bit array of ``items`` (g, phrase) that aren't in ``without`` yet, and how many they are."""
    shared = items.sparkSession.sparkContext.broadcast(without)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, phrases = (as_bytes(batch.column(i)) for i in range(2))
            if not len(phrases):
                continue
            seed = _mixed(_word_hashes(groups))
            parts = [p.split(b" ") for p in phrases]
            h = np.zeros(len(parts), np.uint64)
            for k in range(max(map(len, parts))):
                at = np.array([i for i, p in enumerate(parts) if len(p) > k])
                word = _mixed(_word_hashes([parts[i][k] for i in at]) ^ seed[at])
                h[at] = word if k == 0 else _joined(h[at], word)
            if shared.value is not None:
                h = h[~_proposed(shared.value, h)]
            last = np.uint64(size - 1)
            places = np.concatenate((h & last, (h >> np.uint64(27)) & last))
            yield pa.RecordBatch.from_pydict({"slot": (places >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (places & np.uint64(63))).view(np.int64), "n": np.repeat([1, 0], len(h))})

    found = items.select("g", "phrase").mapInArrow(run, "slot bigint, bit bigint, n bigint").groupBy("slot").agg(F.bit_or("bit").alias("bit"), F.sum("n").alias("n")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found.column("slot").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    if without is not None:
        bits |= without
    return bits, int(pc.sum(found.column("n")).as_py() or 0)


def frequent(docs: DataFrame, *, text_col: str = "text", group_col: str = "lang", least: int = 10, longest: int = 3, sample: int = SAMPLE, proposed: int = PROPOSED) -> tuple[DataFrame, int]:
    """(g, phrase, words, a) with exact counts of all phrases of up to ``longest`` words that occur ``least`` times or more, with
    the number of all words as the empty phrase of each group; and how many full passes it took."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = docs.filter(F.pmod(F.xxhash64(F.col(f"`{text_col}`"), F.lit(1994)), F.lit(sample)) == 0)
    everything = [None] * (longest - 1)
    first = written(_sums(_blocks(drawn, text_col, group_col, longest - 1, everything, None, parts), proposed, parts), "phrases-sample")
    words = int(first.filter("words = 0").agg(F.sum("a")).first()[0] or 0)
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_WORD * words).bit_length()))
    filters = [_bits(first.filter(F.col("words") == k), size, None)[0] for k in range(1, longest)]
    drop(first)
    parts = max(parts, -(-words * sample // BUCKET_WORDS))
    passes, old = [], None
    while True:
        passes.append(written(_sums(_blocks(docs, text_col, group_col, longest, filters, old, parts), least, parts), "phrases"))
        grown = [_bits(passes[-1].filter(F.col("words") == k), size, filters[k - 1]) for k in range(1, longest)]
        if not any(n for _, n in grown):
            break
        old, filters = filters, [b for b, _ in grown]
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out, len(passes)


def collocations(docs: DataFrame, *, text_col: str = "text", group_col: str = "lang", least: int = 10, longest: int = 3, inside: int = 50, top: int = 2000, sample: int = SAMPLE, proposed: int = PROPOSED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each group whose lowest cut scores highest.

    A cut of a phrase of ``a`` occurrences into parts of ``l`` and ``r`` scores floor(1000000 * a * a / (l * r)). A phrase goes
    if a longer one that contains it occurs ``inside`` percent as often or more.
    """
    counts, _ = frequent(docs, text_col=text_col, group_col=group_col, least=least, longest=longest, sample=sample, proposed=proposed)
    phrases = counts.filter("words > 0")
    pieces = F.split("phrase", " ")
    several = phrases.filter("words > 1").withColumn("w", pieces)
    cut = several.select("g", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w", "words")
    cut = cut.select("g", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")),
        F.struct(F.lit(1).alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("part")))).alias("p")).select("g", "phrase", "a", "k", "p.*")
    of_part = phrases.select("g", F.col("phrase").alias("part"), F.col("a").alias("f"))
    both = cut.join(of_part, ["g", "part"]).groupBy("g", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    lowest = both.withColumn("score", score).groupBy("g", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("g", "phrase", "a", "best.l", "best.r", "best.score")
    shorter = several.filter("words > 2").select("g", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n"))
    shorter = shorter.select("g", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("phrase"))
    most = shorter.groupBy("g", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(most, ["g", "phrase"], "left").filter(F.col("longer").isNull() | (100 * wide("longer") < inside * wide("a")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    in_part = Window.partitionBy("g", "part").orderBy(*order)
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(in_part)).filter(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("g", F.col("a").alias("n"))
    long = [F.col(c).cast("long").alias(c) for c in ("rank", "a", "l", "r", "n", "score")]
    out = ranked.join(totals, "g").withColumns({c: x for c, x in zip(("rank", "a", "l", "r", "n", "score"), long, strict=True)})
    return out.select(F.col("g").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
