"""Notes to chunks: sentences packed under a token and a sentence budget, cut only between graphemes.

Rules: a lone sentence within the ceiling is one chunk; a lone longer one is split into runs of ``max_tokens`` and nothing is
lost. Among several sentences, one over the ceiling becomes a chunk of its own, cut at the ceiling and flagged; the
others accumulate while the combined text keeps to ``max_tokens`` and ``max_sentences`` (the first sentence of a chunk is
never weighed against ``max_tokens``). Texts are not normalised; a null or empty text gives no chunks.

Sentences are found on the JVM side; the packing itself is a streaming Arrow map, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T

MAX_TOKENS, MAX_SENTENCES, HARD_CEILING = 80, 3, 128
#: Notes of a batch that become Python objects together, and characters of chunks that are sent on together, about.
NOTES, SEND = 256, 1 << 22
Counter = Callable[[str], int]


def longest_prefix(parts: list[str], budget: int, count: Counter) -> int:
    """How many leading graphemes keep to the budget, one at least; counts must not fall as a text grows."""
    fits, beyond = 1, len(parts) + 1
    while beyond - fits > 1:
        middle = (fits + beyond) // 2
        if count("".join(parts[:middle])) <= budget:
            fits = middle
        else:
            beyond = middle
    return fits


def pack(sentences: list[str], count: Counter, max_tokens: int = MAX_TOKENS, max_sentences: int = MAX_SENTENCES, hard_ceiling: int = HARD_CEILING) -> Iterator[tuple[str, int, int, int, bool]]:
    """(text, tokens, start, end, truncated) of each chunk; spans in graphemes."""
    width = T.count_graphemes
    # words of a joined text are those of its parts, but for one that goes on from part to part
    joined = (lambda a, n, b, m: n + m - T.one_word(a, b)) if count is T.count_words else (lambda a, n, b, m: count(a + b))
    if len(sentences) == 1:
        whole = sentences[0]
        n = count(whole)
        if n <= hard_ceiling:
            yield whole, n, 0, width(whole), False
            return
        parts, at = T.split_graphemes(whole), 0
        while at < len(parts):
            # a run can't be wider than its budget in whole tokens, so only a window needs to be searched
            window = 4 * max_tokens
            k = longest_prefix(parts[at : at + window], max_tokens, count)
            while k == window and at + window < len(parts):
                window *= 4
                k = longest_prefix(parts[at : at + window], max_tokens, count)
            run = "".join(parts[at : at + k])
            yield run, count(run), at, at + k, False
            at += k
        return

    held, tokens, start, end, n = "", 0, 0, 0, 0
    for s in sentences:
        alone = count(s)
        after = end + width(s)
        if alone > hard_ceiling:
            if n:
                yield held, tokens, start, end, False
            parts = T.split_graphemes(s)
            k = longest_prefix(parts, hard_ceiling, count)
            cut = "".join(parts[:k])
            yield cut, count(cut), end, end + k, True
            held, n = "", 0
        else:
            both = joined(held, tokens, s, alone) if n else alone
            if n and (both > max_tokens or n == max_sentences):
                yield held, tokens, start, end, False
                held, n, both = "", 0, alone
            if not n:
                start = end
            held, tokens, n = held + s, both, n + 1
        end = after
    if n:
        yield held, tokens, start, end, False


def chunk_notes(notes: DataFrame, *, note_id: str = "note_id", text_col: str = "text", counter: str | Counter = "words", max_tokens: int = MAX_TOKENS, max_sentences: int = MAX_SENTENCES, hard_ceiling: int = HARD_CEILING) -> DataFrame:
    """(note_id, chunk_id, ord, text, token_count, span, truncated). ``counter`` is a registry name or a Python function."""
    count = T.COUNTERS[counter] if isinstance(counter, str) else counter

    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    names = ["note_id", "chunk_id", "ord", "text", "token_count", "span", "truncated"]

    def sent(notes: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, ids, ords, texts, tokens, starts, ends, cuts = zip(*rows)
        spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(span))
        return pa.RecordBatch.from_arrays([notes.take(pa.array(at)), pa.array(ids), pa.array(ords, pa.int32()), pa.array(texts), pa.array(tokens, pa.int32()), spans, pa.array(cuts, pa.bool_())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, NOTES):
                part = batch.slice(first, NOTES)
                notes, rows, size = part.column(0), [], 0
                for i, (note, sentences) in enumerate(zip(notes.to_pylist(), part.column(1))):
                    for k, (text, *rest) in enumerate(pack(sentences.as_py(), count, max_tokens, max_sentences, hard_ceiling) if sentences.is_valid and len(sentences) else ()):
                        rows.append((i, f"{note}-c{k}", k, text, *rest))
                        size += len(text)
                    if size > SEND:
                        yield sent(notes, rows)
                        rows, size = [], 0
                if rows:
                    yield sent(notes, rows)

    kind = dict(notes.select(F.col(note_id).alias("n")).dtypes)["n"]
    cut = notes.select(F.col(note_id).alias("note_id"), T.sentence_texts(text_col).alias("s"))
    return cut.mapInArrow(run, f"note_id {kind}, chunk_id string, ord int, text string, token_count int, span struct<start:int,end:int>, truncated boolean")


def note_of(chunk_id: Column | str) -> Column:
    """The note that a chunk_id names, as text."""
    return F.regexp_replace(chunk_id, r"-c\d+$", "")


def _words_prefix(text: Column, budget: int) -> Column:
    return F.regexp_extract(text, rf"(?s)^{T.SPACE}*(?:(?!{T.SPACE}).++{T.SPACE}*+){{0,{budget}}}".replace(".++", r"[^\s\p{Z}\x{FEFF}\x0B]++"), 0)


def chunk_notes_native(notes: DataFrame, *, note_id: str = "note_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, max_sentences: int = MAX_SENTENCES, hard_ceiling: int = HARD_CEILING) -> DataFrame:
    """(note_id, ord, text, token_count, truncated) for the word counter without Python: a fold over the sentences."""
    count = T.token_count
    step = "array<struct<text:string,n:int,tokens:int,truncated:boolean>>"
    item = lambda text, n, tokens, cut: F.struct(text.alias("text"), F.lit(n).cast("int").alias("n"), tokens.cast("int").alias("tokens"), F.lit(cut).alias("truncated"))

    def put(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        alone = count(s)
        cut = _words_prefix(s, hard_ceiling)
        joined = F.concat(last["text"], s)
        fits = (F.size(acc) > 0) & ~last["truncated"] & (last["n"] < max_sentences) & (count(joined) <= max_tokens)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(joined.alias("text"), (last["n"] + 1).cast("int").alias("n"), count(joined).cast("int").alias("tokens"), F.lit(False).alias("truncated"))))
        return F.when(alone > hard_ceiling, F.concat(acc, F.array(item(cut, 1, count(cut), True)))).when(fits, grown).otherwise(F.concat(acc, F.array(item(s, 1, alone, False))))

    parts = F.col("s")
    runs = F.regexp_extract_all(parts[0], F.lit(rf"{T.SPACE}*+(?:[^\s\p{{Z}}\x{{FEFF}}\x0B]++{T.SPACE}*+){{1,{max_tokens}}}"), F.lit(0))
    lone = F.when(count(parts[0]) <= hard_ceiling, F.array(item(parts[0], 1, count(parts[0]), False))).otherwise(F.transform(runs, lambda r: item(r, 1, count(r), False)))
    packed = F.when(F.size(parts) == 1, lone.cast(step)).otherwise(F.aggregate(parts, F.array().cast(step), put))
    cut = notes.select(F.col(note_id).alias("note_id"), T.sentence_texts(text_col).alias("s")).filter(F.size("s") > 0)
    return cut.select("note_id", F.posexplode(packed).alias("ord", "c")).select("note_id", "ord", "c.text", F.col("c.tokens").alias("token_count"), "c.truncated")


def note_summary(chunks: DataFrame) -> DataFrame:
    """(note_id, n_chunks, n_tokens, any_truncated)."""
    return chunks.groupBy("note_id").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"), F.bool_or("truncated").alias("any_truncated"))


def reconstructed(chunks: DataFrame) -> DataFrame:
    """(note_id, text): chunks put together again in order."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return chunks.groupBy("note_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def owner_of_grapheme(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk whose span holds each (note_id, i): an equality join with the interval as residual condition."""
    c = chunks.select("note_id", "chunk_id", F.col("span.start").alias("__a"), F.col("span.end").alias("__b"))
    return points.join(c, "note_id").filter("i >= __a and i < __b").drop("__a", "__b")
