"""For SQL users: the chunker as a table function, the counters as functions, the tables as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from quillspan.functions import text as T
from quillspan.operators import chunk
from quillspan.operators.embed import DIMENSIONS, HASHING

#: Models that are known: a user adds a row for each of their own.
MODELS = [(HASHING, DIMENSIONS, "any language, by its letters")]


class ChunkNote:
    """``LATERAL chunk_note(s, max_tokens, max_sentences, hard_ceiling)`` with the word counter: the chunks of ``chunk_notes``.

    ``s`` is ``note_sentences(text)``, selected in a subquery.
    """

    def eval(self, sentences: list[str], max_tokens: int = chunk.MAX_TOKENS, max_sentences: int = chunk.MAX_SENTENCES, hard_ceiling: int = chunk.HARD_CEILING):
        for k, (run, tokens, start, end, cut) in enumerate(chunk.pack(list(sentences or []), T.count_words, max_tokens, max_sentences, hard_ceiling) if sentences else ()):
            yield k, run, tokens, start, end, cut


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, **views: DataFrame) -> None:
    """``note_sentences``, ``chunk_note`` and ``count_tokens`` for this session, ``models`` and the given tables as views."""
    made = udtf(ChunkNote, returnType="ord int, text string, token_count int, span_start int, span_end int, truncated boolean")
    spark.udtf.register("chunk_note", made)
    # SQL functions: they run on the JVM side like the expressions of functions/text.py
    word = T.WORD_RUN
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION count_tokens(t STRING) RETURNS INT RETURN size(regexp_extract_all(t, {_sql_text(word)}, 0))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION note_sentences(t STRING) RETURNS ARRAY<STRING> RETURN filter(regexp_extract_all(t, {_sql_text(T.SENTENCE)}, 1), s -> s <> '')")
    spark.createDataFrame(MODELS, "model_id string, dim int, coverage string").createOrReplaceTempView("models")
    for name, table in views.items():
        table.createOrReplaceTempView(name)
