"""Bands of perplexity beside large groups of copies."""

import random

import pytest

from quillspan.llm import quality_rules

from .conftest import prose


@pytest.mark.parametrize("copies", [120, 240])
@pytest.mark.parametrize("near", [False, True])
def test_a_group_of_copies_leaves_all_in_the_band(spark, near, copies):
    """Two thirds or four fifths of a language are copies of one text, or near copies with one word changed."""
    rng = random.Random(3)
    copy = prose(500, 120).split()
    rows = [(i, prose(2000 + i, 120), "de") for i in range(60)]
    for i in range(copies):
        words = list(copy)
        if near:
            words[rng.randrange(len(words))] = rng.choice(["there", "stone", "rent", "inan"])
        rows.append((100 + i, " ".join(words), "de"))
    noise = "".join(rng.choice("qxzjkvwy0123456789#%&") + rng.choice(["", " "]) for _ in range(600))
    docs = spark.createDataFrame([*rows, (900, noise, "de")], "doc_id bigint, text string, lang string").repartition(3)
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    assert kept == {i for i, _, _ in rows}  # all are clean, the copies too
