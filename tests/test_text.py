"""Trimming, keys, graphemes, sentences, chunks and files."""

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import chunk
from quillspan.sources import files

FAMILY = "\U0001f468‍\U0001f469‍\U0001f467‍\U0001f466"


def values(spark, texts, *columns):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [tuple(r)[1:] for r in table.select("i", *columns).orderBy("i").collect()]


def test_trim_takes_all_unicode_space(spark):
    got = values(spark, ["﻿  a b  　", "\t\n", "", None], T.trimmed("text"), T.is_blank("text"))
    assert got == [("a b", False), ("", True), ("", True), (None, None)]


def test_dedupe_key(spark):
    a, b, c, d = (r[0] for r in values(spark, ["café ", "café", "Café", "plain"], T.dedupe_key("text")))
    assert a == b != c and d == "plain"


def test_utf16_length_and_preview(spark):
    got = values(spark, ["\U0001f44d", "x" * 70, "y" * 69 + " zz", "  short "], T.utf16_length("text"), T.preview("text"))
    assert got[0] == (2, "\U0001f44d") and got[1][1] == "x" * 70 and got[2][1] == "y" * 69 + "…" and got[3][1] == "short"


def test_graphemes(spark):
    got = values(spark, ["abc", "éx", FAMILY + "!", "\U0001f1f5\U0001f1ed", "日本", "", "a\r\nb"], T.graphemes("text"))
    assert [r[0] for r in got] == [["a", "b", "c"], ["é", "x"], [FAMILY, "!"], ["\U0001f1f5\U0001f1ed"], ["日", "本"], [], ["a", "\r\n", "b"]]
    assert [len(r[0]) for r in got] == [len(T.split_graphemes(t)) for t in ["abc", "éx", FAMILY + "!", "\U0001f1f5\U0001f1ed", "日本", "", "a\r\nb"]]


def test_offsets_and_index(spark):
    offsets = T.grapheme_offsets("text")
    [(o, *at)] = values(spark, ["a" + FAMILY + "b"], offsets, *[T.grapheme_index(offsets, F.lit(x)) for x in (0, 1, 2, 12, 13, 99)])
    assert o == [0, 1, 12, 13] and at == [0, 1, 2, 2, 3, 3]


@pytest.mark.parametrize(
    ("text", "n"),
    [("Rain. Hail! Fog. Is it snow?", 4), ("One. Two! Three?", 3), ("Pi is 3.14 today. Yes.", 2), ("今天天气好。我们走吧！好的。", 3), ("no marks at all", 1), ("", 0), ("line one\nline two", 2), ('He said "Go." Then left.', 2), ("e.g. lower goes on. Next.", 2)],
)
def test_sentences(spark, text, n):
    [(found,)] = values(spark, [text], T.sentences("text"))
    assert len(found) == n and "".join(s.text for s in found) == text
    at = 0
    for s in found:
        assert s.span.start == at
        at = s.span.end
    assert at == len(T.split_graphemes(text))


def cut(spark, text, counter="words", **options):
    table = spark.createDataFrame([("n", text)], "note_id string, text string")
    return chunk.chunk_notes(table, counter=counter, **options).orderBy("ord").collect()


TIGHT = {"max_tokens": 6, "max_sentences": 2, "hard_ceiling": 9}
NUMBERS = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn".split()


def said(n: int, mark: str = ".") -> str:
    """A sentence of n words."""
    return f"{' '.join(NUMBERS[:n]).capitalize()}{mark}"


def test_chunk_rules(spark):
    assert cut(spark, "") == [] and cut(spark, None) == []
    lone = said(4, "!")
    [only] = cut(spark, lone, **TIGHT)
    assert (only.text, only.token_count, only.truncated, only.chunk_id) == (lone, 4, False, "n-c0") and (only.span.start, only.span.end) == (0, len(lone))
    # two sentences reach the sentence budget, four and three words pass the token budget
    assert [c.token_count for c in cut(spark, " ".join([said(1), said(2), said(3)]), **TIGHT)] == [3, 3]
    assert [c.token_count for c in cut(spark, " ".join([said(4), said(3), said(2)]), **TIGHT)] == [4, 5]
    assert [c.token_count for c in cut(spark, " ".join([said(2)] * 7), max_tokens=50, max_sentences=4)] == [8, 6]
    assert [c.ord for c in cut(spark, " ".join([said(3)] * 5), max_tokens=3, max_sentences=9)] == list(range(5))


def test_long_sentence_among_others_is_cut_at_the_ceiling(spark):
    got = cut(spark, f"{said(3)} {said(13)} {said(2)}", **TIGHT)
    assert [(c.token_count, c.truncated) for c in got] == [(3, False), (9, True), (2, False)]
    assert got[2].span.start > got[1].span.end  # the tail is gone, and spans tell


def test_lone_long_run_is_split_and_kept_whole(spark):
    text = " ".join(NUMBERS)
    got = cut(spark, text, **TIGHT)
    assert "".join(c.text for c in got) == text and not any(c.truncated for c in got) and max(c.token_count for c in got) <= 6
    lao = "ກໍ" * 250
    got = cut(spark, lao, counter="graphemes", max_tokens=70, hard_ceiling=90)
    assert "".join(c.text for c in got) == lao and [c.token_count for c in got[:-1]] == [70] * (len(got) - 1)


def test_first_sentence_may_pass_the_budget(spark):
    assert [c.token_count for c in cut(spark, f"{said(8)} {said(2)}", **TIGHT)] == [8, 2]


def test_combined_count_decides_not_the_sum(spark):
    # "a.b" joins without space: two sentences of one word each are one word together
    count = lambda t: len(t.split())
    assert [c[:2] for c in chunk.pack(["甲。", "乙。"], count, max_tokens=1, max_sentences=3, hard_ceiling=8)] == [("甲。乙。", 1)]


def test_graphemes_stay_whole(spark):
    text = " ".join(NUMBERS) + f" {FAMILY} aus."
    for c in cut(spark, text, counter="graphemes", max_tokens=7, max_sentences=3, hard_ceiling=10):
        assert "\U0001f468" not in c.text or FAMILY in c.text


def test_native_fold_agrees(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("note_id"), "text")
    extra = [(9001, "Tea first. " + "leaf " * 200 + "steeps. Then milk."), (9002, "leaf " * 300), (9003, "Only."), (9004, "")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    columns = ["note_id", "ord", "text", "token_count", "truncated"]
    a, b = chunk.chunk_notes(docs).select(columns), chunk.chunk_notes_native(docs).select(columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_chunks_partition_the_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("note_id"), "text")
    for n in (2, 9):
        chunks = chunk.chunk_notes(docs.repartition(n), hard_ceiling=1 << 30)
        back = {r.note_id: hashlib.md5(r.text.encode()).digest() for r in chunk.reconstructed(chunks).collect()}
        assert back == {r.note_id: hashlib.md5(r.text.encode()).digest() for r in docs.collect()}


def test_owner_of_grapheme(spark):
    notes = spark.createDataFrame([("n", "Dry oak. Wet elm. Old fig.")], "note_id string, text string")
    points = spark.createDataFrame([("n", i) for i in (0, 17, 18, 25, 26)], "note_id string, i int")
    got = chunk.owner_of_grapheme(points, chunk.chunk_notes(notes, **TIGHT)).orderBy("i").collect()
    assert [(r.i, r.chunk_id) for r in got] == [(0, "n-c0"), (17, "n-c0"), (18, "n-c1"), (25, "n-c1")]


def test_note_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, data in {"a.txt": b"hello", "deep/B.MD": b"\xef\xbb\xbfmarked", "c.Markdown": "é".encode(), "d.pdf": b"no", "e.txt": b" \n", "big.txt": b"x" * 300_001, "edge.txt": b"y" * 300_000}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: r.text for r in files.note_files(spark, str(tmp_path)).collect()}
    assert got.keys() == {"a.txt", "B.MD", "c.Markdown", "edge.txt"} and got["B.MD"] == "marked" and got["c.Markdown"] == "é"


def test_json_sources_and_sink(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"notes": [{"id": "x", "topic": "t", "text": "one"}, {"id": "y", "topic": "u", "text": "two"}]}')
    assert [(r.note_id, r.seq, r.source) for r in files.sample_notes(spark, str(tmp_path / "s.json")).orderBy("seq").collect()] == [("x", 0, "sample"), ("y", 1, "sample")]
    assert files.sample_notes(spark, str(tmp_path / "absent.json")).count() == 0
    (tmp_path / "l.json").write_text('{"tunedLanguages": [{"bcp47": "en", "name": "English"}], "specialCases": [{"bcp47": "tl", "name": "Tagalog", "note": "n"}]}')
    assert sorted((r.bcp47, r.special) for r in files.languages(spark, str(tmp_path / "l.json")).collect()) == [("en", False), ("tl", True)]
    files.write_results(spark.createDataFrame([("c", 1), ("d", 2)], "corpus_id string, x int"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("corpus_id = 'd'").first().x == 2


def test_nfd_texts_count_alike(spark):
    text = "Résumé naïve. Zoë à côté."
    a, b = (cut(spark, t, counter="graphemes") for t in (text, unicodedata.normalize("NFD", text)))
    assert [c.token_count for c in a] == [c.token_count for c in b]
