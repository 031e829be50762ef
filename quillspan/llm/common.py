"""What the operators share: reading texts in Arrow batches, shared storage, and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A slice of an Arrow batch that is worked on at once holds about so many bytes of text.
SLICE_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    A temporary folder only where neither is set and everything runs in this process, as in tests.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quillspan-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once no result reads them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def set_aside(docs: DataFrame, **uses: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with the columns that an operator ``uses`` under the names it knows (``text="body"``) and all others under
    names that no operator makes, and a function that gives a result the names and the order of ``docs`` back."""
    known = {c: n for n, c in uses.items()}
    names = {c: known.get(c, f"aside_{i}") for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), lambda found: found.select(*[F.col(n).alias(c) for c, n in names.items()])


def broadcast_if_few(table: DataFrame, most: int) -> DataFrame:
    """``table``, with a hint to broadcast it where it has ``most`` rows or fewer."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def id_crc(id_col: Column | str) -> Column:
    """crc32 of the id as text; 0 for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The batch in runs of ``rows`` at most, with about ``limit`` bytes of text, or one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > limit or i - start == rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its tasks, and what it holds is the next stages' loss."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which its task gives memory back."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def map_texts(docs: DataFrame, work: Callable[[dict[str, pa.Array], list[bytes]], dict], schema: str, *, text_col: str = "text", keep: dict[str, Column | str] | None = None) -> DataFrame:
    """Run ``work(columns, texts) -> {column: values}`` over slices of the documents, without a shuffle.

    ``keep`` names the columns that ``work`` gets beside the text. No other column of ``docs`` is read, so columns with
    clashing names do no harm. An empty table gives an empty result.
    """
    columns = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in (keep or {}).items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                texts = as_bytes(data.pop("text"))
                yield pa.RecordBatch.from_pydict(work(data, texts))

    return docs.select(*columns, F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, component) for each node of an edge, the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), so a node never gathers all of a component's
    edges more than once and rounds grow with the logarithm of the longest chain. Each round is written to the shared
    folder. Every step is a minimum by group and a join, so a hot node costs one pre-aggregated key.
    """
    state = written(edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = state.union(state.selectExpr("v as u", "u as v"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(lowest, "u").selectExpr("v as u", "m as v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.selectExpr("v as u", "m as v").filter("u <> v").union(low.selectExpr("u", "m as v")).distinct()
        last, state = state, written(small, "edges")
        drop(last)
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_columns(docs: DataFrame, work: Callable[[dict[str, pa.Array], list[bytes]], dict], schema: str, *, text_col: str = "text", uses: tuple[str, ...] = (), keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) and those that ``work(columns, texts)`` computes from each text and the columns ``uses``.

    No shuffle and no join. A column of ``docs`` that bears a computed column's name is replaced.
    """
    added = [f.name for f in StructType.fromDDL(schema)]
    old = [c for c in docs.columns if c not in added and (keep is None or c in keep)]
    base = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*old, *uses, text_col])])
    place = {c: base.columns.index(c) for c in (*uses, text_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                got = pa.RecordBatch.from_pydict(work({c: part.column(place[c]) for c in uses}, as_bytes(part.column(place[text_col]))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(old)], *(got.column(got.schema.get_field_index(c)) for c in added)], names=[*old, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[: len(old)])
    return base.mapInArrow(released(run), f"{kinds}, {schema}" if old else schema)
