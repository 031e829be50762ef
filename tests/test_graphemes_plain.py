"""Graphemes of plain texts are counted without a pattern that walks them."""

import pytest
import regex

from quillspan.functions import text as T


class Refuses:
    def fullmatch(self, text):
        raise AssertionError("walked a plain text")


def test_plain_texts_are_not_walked(monkeypatch):
    monkeypatch.setattr(T, "_SINGLE", Refuses())
    for t in ("", "Plain words.\n", "\x00\x7f\x0b", "\r\n", "a\r\nb\r", "\n\r"):
        assert T.split_graphemes(t) == regex.findall(r"\X", t) and T.count_graphemes(t) == len(T.split_graphemes(t))


@pytest.mark.parametrize("t", ["é", "éx", "가", "a‍b", "\U0001f1e9\U0001f1ea\U0001f1eb", "\xad\x85\r\n", "नि", "ÿ\r\n"])
def test_other_texts_are_counted_as_before(t):
    assert T.split_graphemes(t) == regex.findall(r"\X", t) and T.count_graphemes(t) == len(regex.findall(r"\X", t))
