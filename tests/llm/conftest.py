import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score string, fp string, b string, kind string, block string, slot string, shard string, kept string, features string, start string, key string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = []
    while len(out) < words:
        line = ["".join(rng.choice(["th", "er", "an", "on", "re", "é", "st", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 12))]
        out += [*line[:-1], line[-1] + "."]
    return " ".join(out[:words])


ROWS = [(i, prose(i % 37, 60 + i), ("en", "fr", None)[i % 3]) for i in range(60)] + [
    (100, None, "en"),
    (101, "", "en"),
    (102, " \n\t ", None),
    (103, prose(5, 30_000), "en"),
    (104, "one two", "xx"),
    (105, "word " * 400, "en"),
    (106, "日本語 ▁ 🎉  two  spaces\n\nend ", "ja"),
    (None, prose(3, 90), "en"),
    (None, None, None),
    (7, prose(7, 67), "en"),
    (7, prose(7, 67), "en"),
]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, g, None, None, *["x"] * 12) for i, t, g in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
