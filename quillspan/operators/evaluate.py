"""Checks as DataFrames: drift, labelled pairs and triples, coverage, invariances, leaks, and their report."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspan.functions import text as T
from quillspan.functions import vec
from quillspan.operators import chunk as C
from quillspan.operators.embed import embedding
from quillspan.operators.scan import scan
from quillspan.operators.vectors import centroids

EPSILON = 0.02


def drift(measured: DataFrame, pinned: DataFrame, *, by: str = "id", value: str = "value", epsilon: float = EPSILON) -> DataFrame:
    """(id, measured, pinned, drift, ok): a row missing on either side is drift too."""
    m, p = measured.select(by, F.col(value).alias("measured")), pinned.select(by, F.col(value).alias("pinned"))
    apart = F.abs(F.col("measured") - F.col("pinned"))
    return m.join(p, by, "full_outer").select(by, "measured", "pinned", apart.alias("drift"), F.coalesce(apart <= epsilon, F.lit(False)).alias("ok"))


def pair_cosines(pairs: DataFrame, *, load=None) -> DataFrame:
    """``pairs(a, b, ...)`` with the cosine of the two texts' vectors."""
    return pairs.withColumn("__a", embedding("a", load)).withColumn("__b", embedding("b", load)).withColumn("cosine", vec.cosine(vec.as_double("__a"), vec.as_double("__b"))).drop("__a", "__b")


def contradiction_verdict(pairs: DataFrame) -> DataFrame:
    """One row from labelled pairs (kind contradiction or paraphrase, cosine): is the contradiction at least as close?"""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("cosine")))
    return pairs.agg(of("contradiction").alias("contradiction"), of("paraphrase").alias("paraphrase")).withColumn("blind", F.col("contradiction") >= F.col("paraphrase"))


def negation_blindness(measured: DataFrame, pinned: DataFrame, *, least: float = 0.5, epsilon: float = EPSILON) -> DataFrame:
    """One row: all pairs near their pins and at ``least`` or above, with the set's mean, minimum and maximum."""
    d = drift(measured, pinned, value="cosine", epsilon=epsilon)
    return d.agg(F.bool_and("ok").alias("pinned_ok"), F.bool_and(F.coalesce(F.col("measured") >= least, F.lit(False))).alias("high_ok"), F.avg("measured").alias("mean"), F.min("measured").alias("min"), F.max("measured").alias("max"))


def triple_discriminability(triples: DataFrame, *, least_gap: float = 0.1) -> DataFrame:
    """One row from triples(cos_positive, cos_negative): how many tell the positive, mean gap, smallest margin, verdict."""
    gap = F.col("cos_positive") - F.col("cos_negative")
    found = triples.agg(F.count("*").alias("n"), F.count_if(gap > 0).alias("n_pass"), F.avg(gap).alias("mean_gap"), F.min(gap).alias("min_margin"))
    return found.withColumn("passed", (F.col("n") > 0) & (F.col("n_pass") == F.col("n")) & (F.col("mean_gap") >= least_gap))


#: Evidence of languages that are claimed and have no verdict of their own.
CLAIMED = "claimed by the model"


def coverage(claims: DataFrame, verdicts: DataFrame, *, verified: str = "en") -> DataFrame:
    """(bcp47, name, special, status, evidence, note) of claims(bcp47, name, note, special) left-joined with verdicts(bcp47, passed, evidence, note).

    Claimed languages are unverified but the one tested; special cases follow their verdict, whose note wins.
    """
    v = verdicts.select("bcp47", "passed", "evidence", F.col("note").alias("__note"))
    status = F.when(~F.col("special"), F.when(F.col("bcp47") == verified, "verified").otherwise("unverified")).when(F.col("passed").isNull(), "unverified").when(F.col("passed"), "verified").otherwise("not-supported")
    evidence = F.coalesce("evidence", F.when(~F.col("special"), F.lit(CLAIMED)))
    return claims.join(v, "bcp47", "left").select("bcp47", "name", "special", status.alias("status"), evidence.alias("evidence"), F.coalesce("__note", "note").alias("note"))


def tested_languages(covered: DataFrame) -> DataFrame:
    """One row (claimed, tested): how many languages are claimed (special cases aside), and the verified ones' names by tag, or ``none yet``."""
    names = F.array_sort(F.collect_list(F.when(F.col("status") == "verified", F.struct("bcp47", "name"))))
    listed = F.array_join(F.transform(names, lambda x: x["name"]), ", ")
    return covered.agg(F.count_if(~F.col("special")).alias("claimed"), F.coalesce(F.nullif(listed, F.lit("")), F.lit("none yet")).alias("tested"))


#: Fixed value: the wording that claims are allowed to have.
COVERAGE_SENTENCE = "Tuned for roughly %s languages, tested to date in %s; other languages may work with reduced accuracy or may not be usable at all."


def coverage_sentence(covered: DataFrame) -> DataFrame:
    """The count and the list as one sentence."""
    return tested_languages(covered).select(F.format_string(COVERAGE_SENTENCE, F.col("claimed").cast("string"), F.col("tested")).alias("sentence"))


def data_flags(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``documents`` with flags: ASCII sentence marks, any white space, line breaks."""
    t = F.col(text_col)
    return documents.withColumn("ascii_marks", t.rlike(r"[.!?]")).withColumn("has_space", t.rlike(r"\s")).withColumn("has_newline", t.rlike(r"[\r\n]"))


def banned_words(documents: DataFrame, phrases: DataFrame, *, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, phrase) for each listed phrase in a lower-cased text; any number of phrases."""
    p = phrases.select(F.lower("phrase").alias("phrase")).distinct().select("phrase", F.col("phrase").alias("text"))
    d = documents.select(doc_id, F.lower(text_col).alias("text"))
    return scan(d, p, doc_id=doc_id, channels=["text"], pattern_id="phrase").select(doc_id, "phrase")


def leak_scan(documents: DataFrame, passages: DataFrame, *, doc_id: str = "doc_id", passage_id: str = "item_id", text_col: str = "text", channels: list[str] | None = None) -> DataFrame:
    """(doc_id, item_id, snippet): documents that hold a whole passage, verbatim, with 200 characters from where it starts.

    With ``channels`` these columns are searched, each on its own, and the result's ``channel`` names the one that holds it.
    """
    found = scan(documents, passages, doc_id=doc_id, channels=channels or [text_col], pattern_id=passage_id, pattern_col="text" if channels else text_col)
    return found.select(doc_id, passage_id, *(["channel"] if channels else []), "snippet")


def segmentation_counts(notes: DataFrame, *, note_id: str = "note_id", counter: str = "words", **options) -> DataFrame:
    """(note_id, sentences, chunks, tokens) to hold against pins."""
    chunks = C.note_summary(C.chunk_notes(notes, note_id=note_id, counter=counter, **options))
    n = notes.select(F.col(note_id).alias("note_id"), F.size(T.sentence_texts("text")).alias("sentences"))
    return n.join(chunks, "note_id", "left").select("note_id", "sentences", F.coalesce("n_chunks", F.lit(0)).alias("chunks"), F.coalesce("n_tokens", F.lit(0)).alias("tokens"))


def golden_set(cases: DataFrame, *, counter: str = "words", **options) -> DataFrame:
    """(id, chunks_ok, truncated_ok, tokens_ok, whole) of cases(id, text, expected{chunkCount, truncatedChunkCount, totalTokens})."""
    chunks = C.chunk_notes(cases, note_id="id", counter=counter, **options)
    got = chunks.groupBy(F.col("note_id").alias("id")).agg(F.count("*").alias("n"), F.count_if("truncated").alias("t"), F.sum("token_count").alias("k"))
    whole = C.reconstructed(chunks).select(F.col("note_id").alias("id"), F.col("text").alias("__whole"))
    e = F.col("expected")
    return cases.join(got, "id", "left").join(whole, "id", "left").select("id", F.coalesce(F.col("n") == e["chunkCount"], F.lit(False)).alias("chunks_ok"), F.coalesce(F.col("t") == e["truncatedChunkCount"], F.lit(False)).alias("truncated_ok"), F.coalesce(F.col("k") == e["totalTokens"], F.lit(False)).alias("tokens_ok"), F.coalesce(F.col("__whole") == F.col("text"), F.lit(False)).alias("whole"))


def grapheme_integrity(notes: DataFrame, clusters: DataFrame, *, note_id: str = "note_id") -> DataFrame:
    """(note_id, cluster, whole): required clusters(note_id, cluster) are single graphemes of their note."""
    g = notes.select(F.col(note_id).alias("note_id"), T.graphemes("text").alias("__g"))
    return clusters.join(g, "note_id").select("note_id", "cluster", F.array_contains("__g", F.col("cluster")).alias("whole"))


def scripts_covered(cases: DataFrame, families: list[str], *, column: str = "script") -> DataFrame:
    """(family, covered): is each required family among the scripts of the cases?"""
    seen = cases.agg(F.collect_set(column).alias("s"))
    return seen.select(F.explode(F.array(*map(F.lit, families))).alias("family"), "s").select("family", F.exists("s", lambda x: x.contains(F.col("family"))).alias("covered"))


def truncation_evidence(chunks: DataFrame, full_text: DataFrame, *, most: float = 0.98, load=None) -> DataFrame:
    """(note_id, n_truncated, cosine, ok): one chunk of a note was cut, and cutting changed its vector."""
    cut = chunks.filter("truncated").groupBy("note_id").agg(F.count("*").alias("n_truncated"), F.min_by("text", "ord").alias("a"))
    pairs = cut.join(full_text.select("note_id", F.col("text").alias("b")), "note_id")
    return pair_cosines(pairs, load=load).select("note_id", "n_truncated", "cosine", ((F.col("n_truncated") == 1) & (F.col("cosine") <= most)).alias("ok"))


def nfc_equivalence(pairs: DataFrame, *, least: float = 0.999, load=None) -> DataFrame:
    """(cosine, same_key, ok) of pairs(a, b) that differ in normal form only."""
    return pair_cosines(pairs.select(T.nfc("a").alias("a"), T.nfc("b").alias("b"), (T.dedupe_key("a") == T.dedupe_key("b")).alias("same_key")), load=load).select("cosine", "same_key", ((F.col("cosine") >= least) & F.col("same_key")).alias("ok"))


FORMS = ("base", "crlf", "bom", "nfd")
_LINE_END = re.compile("\r?\n")


@F.pandas_udf(StringType())
def _nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


def _forms(notes: DataFrame) -> DataFrame:
    """``notes`` with a column for each of ``FORMS``; plain ASCII is its own normal form."""
    t = F.col("text")
    plain = ~t.rlike(r"[^\x00-\x7F]")
    return notes.withColumns({"base": t, "crlf": F.regexp_replace(t, r"\r?\n", "\r\n"), "bom": F.concat(F.lit("\ufeff"), t), "nfd": F.when(plain, t).otherwise(_nfd(F.when(~plain, t)))})


def encoding_variants(notes: DataFrame, *, note_id: str = "note_id") -> DataFrame:
    """(note_id, variant, text): as it is, with CRLF line ends, with a byte-order mark, and decomposed (NFD)."""

    forms = _forms(notes)
    return reduce(DataFrame.unionByName, [forms.select(note_id, F.lit(n).alias("variant"), F.col(n).alias("text")) for n in FORMS])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(note_id, text): each note's different texts after all its ``FORMS`` were cleaned, named by the note and the variants that have it.

    Texts become Python objects a few at a time and leave by ``SEND`` characters, so what a worker holds is its batch and little more.
    """
    clean = lambda t: unicodedata.normalize("NFC", t).removeprefix("\ufeff").replace("\r\n", "\n")
    for batch in batches:
        names, texts, size = [], [], 0
        for row in range(batch.num_rows):
            note, text = (batch.column(c)[row].as_py() for c in (0, 1))
            if note is None or text is None:
                continue
            found: dict[str, list[str]] = {}
            for variant, form in zip(FORMS, (text, _LINE_END.sub("\r\n", text), "\ufeff" + text, unicodedata.normalize("NFD", text))):
                found.setdefault(clean(form), []).append(variant)
            names += [f"{note}\0{','.join(variants)}" for variants in found.values()]
            texts += found
            size += sum(map(len, found))
            if size > C.SEND:
                yield pa.RecordBatch.from_pydict({"note_id": names, "text": texts})
                names, texts, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_pydict({"note_id": names, "text": texts})


def encoding_invariance(notes: DataFrame, *, note_id: str = "note_id", least: float = 0.999, load=None, **options) -> DataFrame:
    """(note_id, variant, same_chunks, cosine, ok) against the note as it is.

    Texts are brought to one form (marks off, line ends alike, NFC) before they are cut, as imports do. Variants of a note that are one text by
    then are cut and embedded once; what is compared is the vectors, gathered by note.
    """
    texts = notes.select(F.col(note_id).cast("string").alias("note_id"), "text").mapInArrow(_cleaned, "note_id string, text string")
    chunks = C.chunk_notes(texts, **options).withColumn("embedding", embedding("text", load))
    vectors = centroids(chunks, count="n_chunks")
    parts = F.split("note_id", "\0")
    held = vectors.select(parts[0].alias("note_id"), F.explode(F.split(parts[1], ",")).alias("variant"), "embedding", "n_chunks")
    gathered = held.groupBy("note_id").agg(F.collect_list(F.struct("variant", "embedding", "n_chunks")).alias("v"))
    base, other = (F.filter("v", lambda x: x["variant"] == "base"), F.filter("v", lambda x: x["variant"] != "base"))
    met = gathered.select("note_id", F.explode(base).alias("b"), "v").select("note_id", "b", F.explode(other).alias("o"))
    found = met.select("note_id", "o.variant", (F.col("o.n_chunks") == F.col("b.n_chunks")).alias("same_chunks"), vec.cosine("o.embedding", "b.embedding").alias("cosine"))
    return found.withColumn("ok", F.col("same_chunks") & (F.col("cosine") >= least))


def order_invariance(one: DataFrame, other: DataFrame, *, by: str = "id", tolerance: float = 1e-3) -> DataFrame:
    """(n, ok): coordinates of two runs, joined by id, agree."""
    a = one.select(by, F.col("x").alias("ax"), F.col("y").alias("ay"))
    met = a.join(other.select(by, "x", "y"), by, "full_outer")
    far = F.greatest(F.abs(F.col("x") - F.col("ax")), F.abs(F.col("y") - F.col("ay")))
    return met.agg(F.count("*").alias("n"), F.bool_and(F.coalesce(far <= tolerance, F.lit(False))).alias("ok"))


def check(name: str, rows: DataFrame, passed: Column, detail: Column | None = None) -> DataFrame:
    """One report row: ``skip`` for no rows, else whether all rows pass, with how many do."""
    found = rows.select(F.coalesce(passed, F.lit(False)).alias("p"), (F.lit(None) if detail is None else detail).cast("string").alias("d"))
    counted = found.agg(F.count("*").alias("n"), F.count_if("p").alias("k"), F.min(F.when(~F.col("p"), F.col("d"))).alias("d"))
    status = F.when(F.col("n") == 0, "skip").when(F.col("n") == F.col("k"), "pass").otherwise("fail")
    return counted.select(F.lit(name).alias("id"), status.alias("status"), F.concat_ws("; ", F.format_string("%s of %s", F.col("k").cast("string"), F.col("n").cast("string")), "d").alias("detail"))


def report(checks: list[DataFrame]) -> DataFrame:
    """(id, status, detail) of all checks."""
    return reduce(DataFrame.unionByName, checks)


def report_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "skip")])


def percent(x: Column) -> Column:
    """Rounded half up."""
    return F.floor(x + 0.5)


def fixed(x: Column, digits: int = 3) -> Column:
    """With so many decimals and no marks between thousands."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def request_counts(*sources: DataFrame, by: str = "session") -> DataFrame:
    """(session, n): requests of several sources together."""
    return reduce(DataFrame.unionByName, [s.select(by) for s in sources]).groupBy(by).agg(F.count("*").alias("n"))
