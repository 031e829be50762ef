"""Text expressions on the JVM side, and the few that need Python behind an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ColumnOrName = Column | str

#: White space that trimming removes: Unicode white space, no-break spaces and the byte-order mark.
SPACE = r"[\s\p{Z}\x{FEFF}\x0B]"
#: The same set for Python.
PY_SPACE = "\t\n\x0b\x0c\r    -     　﻿"

#: Latin-1 without marks that end a sentence, each by name: one look-up a character, where a class with other marks asks for each.
_NO_MARK = "".join(rf"\x{{{c:x}}}" for c in range(256) if c not in b"\n\r\x85.!?")
#: Unicode sentence boundaries (UAX #29) as one possessive pattern: runs up to a terminator with its closers and spaces, or a line end;
#: decimals, initials, a lower-case or comma continuation don't end a sentence.
SENTENCE = (
    rf"((?s)(?:[{_NO_MARK}]++|[\x{{100}}-\x{{5FF}}]++|[\x{{3040}}-\x{{D7FF}}]++|"
    r"[^\n\r\x{85}\x{2028}\x{2029}.!?…。．！？؟۔।]++|[.](?=\p{N})|(?<=[\p{Lu}\p{Ll}])[.](?=\p{Lu})"
    r"|[.]+[\p{Pe}\p{Pf}\"']*\s*(?=[^\p{L}\n.!?]*\p{Ll})|[.!?…。．！？؟۔।]+[\p{Pe}\p{Pf}\"']*[ \t]*(?=[,:;\-，、]))*+"
    r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}]|[.!?…。．！？؟۔।]+[\p{Pe}\p{Pf}\"']*[ \t\x{A0}\x{3000}]*(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?|$))"
)


def _col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(text: ColumnOrName) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_col(text), f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: ColumnOrName) -> Column:
    return trimmed(text) == ""


def utf16_length(text: ColumnOrName) -> Column:
    """Length in UTF-16 units, as the character budget counts it."""
    return (F.octet_length(F.encode(_col(text), "UTF-16LE")) / 2).cast("bigint")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: ColumnOrName) -> Column:
    """Normal form C; plain ASCII is in it already and never leaves the JVM's hands changed."""
    t = _col(text)
    return F.when(t.rlike(r"[^\x00-\x7F]"), _nfc(F.when(t.rlike(r"[^\x00-\x7F]"), t))).otherwise(t)


def dedupe_key(text: ColumnOrName) -> Column:
    """What two texts must share to count as the same: normal form C, trimmed, case kept."""
    return trimmed(nfc(text))


def preview(text: ColumnOrName, limit: int = 70) -> Column:
    """The trimmed text, cut to ``limit`` characters with an ellipsis."""
    t = trimmed(text)
    cut = F.regexp_replace(F.substring(t, 1, limit), f"{SPACE}+$", "")
    return F.when(F.length(t) > limit, F.concat(cut, F.lit("…"))).otherwise(t)


def graphemes(text: ColumnOrName) -> Column:
    """Extended grapheme clusters as an array of strings."""
    return F.regexp_extract_all(_col(text), F.lit(r"(\X)"), F.lit(1))


def grapheme_offsets(text: ColumnOrName) -> Column:
    """UTF-16 offset of each grapheme's start, and the text's length: one more than there are graphemes."""
    sizes = F.transform(graphemes(text), lambda g: utf16_length(g).cast("int"))
    start = F.array(F.lit(0))
    return F.aggregate(sizes, start, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def grapheme_index(offsets: Column, at: Column) -> Column:
    """The smallest grapheme index whose offset is at or after ``at``; the last index if none is."""
    reached = F.array_position(F.transform(offsets, lambda o: o >= at), F.lit(True))
    return F.when(reached > 0, reached - 1).otherwise(F.size(offsets) - 1).cast("int")


def sentence_texts(text: ColumnOrName) -> Column:
    """Sentences that cover the text, each with its trailing space."""
    return F.filter(F.regexp_extract_all(_col(text), F.lit(SENTENCE), F.lit(1)), lambda s: s != "")


def sentences(text: ColumnOrName) -> Column:
    """Sentences as array<struct<text, span{start, end}>>, spans in grapheme indices, contiguous from 0."""
    sized = F.transform(sentence_texts(text), lambda s: F.struct(s.alias("text"), F.size(graphemes(s)).alias("n")))
    kind = "array<struct<text:string,span:struct<start:int,end:int>>>"

    def put(acc: Column, s: Column) -> Column:
        start = F.when(F.size(acc) > 0, F.element_at(acc, -1)["span"]["end"]).otherwise(0)
        return F.concat(acc, F.array(F.struct(s["text"].alias("text"), F.struct(start.alias("start"), (start + s["n"]).alias("end")).alias("span"))))

    return F.aggregate(sized, F.array().cast(kind), put)


# Token counters. A registry name stands for a native expression and a Python function that agree.

_RUN = re.compile(f"[^{PY_SPACE}]+")
#: Where ``str.split`` has another idea of white space.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\ufeff]")
#: Characters up to here never join another to one grapheme, but for CR and LF.
_SINGLE = re.compile("[\x00-\x0c\x0e-\u02ff]*")


def _single(text: str) -> bool:
    """Is each character a grapheme for certain? ASCII is told without a look at each."""
    return "\r" not in text if text.isascii() else bool(_SINGLE.fullmatch(text))


def split_graphemes(text: str) -> list[str]:
    return list(text) if _single(text) else regex.findall(r"\X", text)


def count_graphemes(text: str) -> int:
    return len(text) if _single(text) else len(regex.findall(r"\X", text))


def count_words(text: str) -> int:
    return len(_RUN.findall(text) if _ODD_SPACE.search(text) else text.split())


def one_word(before: str, after: str) -> bool:
    """Does a word go on from one text to the other?"""
    return bool(_RUN.match(before[-1:]) and _RUN.match(after[:1]))


COUNTERS: dict[str, Callable[[str], int]] = {"words": count_words, "graphemes": count_graphemes}


#: A word for the native counter.
WORD_RUN = rf"(?s)(?:(?!{SPACE}).)+"


def token_count(text: ColumnOrName, counter: str = "words") -> Column:
    if counter == "words":
        return F.size(F.regexp_extract_all(_col(text), F.lit(WORD_RUN), F.lit(0)))
    return F.size(graphemes(text))
