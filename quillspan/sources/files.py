"""Reading notes, fixtures and events, and writing results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan import schemas
from quillspan.functions import text as T

MAX_FILE_BYTES = 300_000
NOTE_FILES = r"\.(txt|md|markdown)$"


def note_files(spark: SparkSession, path: str, *, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, name, text) of text and Markdown files anywhere below ``path``, not larger than ``max_bytes`` and not blank.

    Sizes and names are judged before contents are read; unreadable files are skipped; a leading byte-order mark goes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(path)
    wanted = files.filter((F.col("length") <= max_bytes) & F.lower("path").rlike(NOTE_FILES))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return wanted.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), text.alias("text")).filter(~T.is_blank("text"))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document by a declared schema; an absent file is an empty table."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def sample_notes(spark: SparkSession, path: str) -> DataFrame:
    """(note_id, topic, text, source, seq) of a sample corpus, in file order."""
    return json_document(spark, path, schemas.SAMPLE_CORPUS).select(F.posexplode("notes").alias("seq", "n")).select(F.col("n.id").alias("note_id"), "n.topic", "n.text", F.lit("sample").alias("source"), "seq")


def languages(spark: SparkSession, path: str) -> DataFrame:
    """(bcp47, name, note, special) of the tuned languages and the special cases."""
    doc = json_document(spark, path, schemas.LANGUAGES)
    tuned = doc.select(F.inline("tunedLanguages")).select("bcp47", "name", F.lit(None).cast("string").alias("note"), F.lit(False).alias("special"))
    return tuned.unionByName(doc.select(F.inline("specialCases")).select("bcp47", "name", "note", F.lit(True).alias("special")))


def note_events(spark: SparkSession, path: str, *, file_format: str = "json") -> DataFrame:
    """A stream of note events from files that arrive under ``path``."""
    return spark.readStream.schema(schemas.NOTE_EVENTS).format(file_format).load(path)


def write_results(df: DataFrame, path: str, *, by: str | None = "corpus_id", file_format: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).format(file_format)
    (writer.partitionBy(by) if by else writer).save(path)
