"""Ids of words that end in more than one kind of punctuation."""

import unicodedata

import numpy as np

from quillspan.llm import packing

from .test_data import tokens


def test_punctuation_after_other_characters_is_one_run():
    words = ["foo”.", "mot»,", "fin…)", "ok🎉!!", "🎉!!", "a’.", "x́.", "İ.", "café.", "日本語.", "ⅷ.", "²!", "٣,", "straße;", "Ǆ!", "ﬁ.", "—.", "€)"]
    # every 29th character, as the last before punctuation
    words += [f"ab{chr(c)}.)" for c in range(0x80, 0x30000, 29) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co") and not chr(c).isspace()]
    got = packing.WordTokenizer(packing.default_tokenizer()).encode([w.encode() for w in words])
    wrong = [w for w, g, t in zip(words, got, tokens(words)) if [*np.frombuffer(g, "<u4").tolist(), 1] != t]
    assert not wrong
