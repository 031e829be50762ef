"""Two-pass external shuffle.

Pass one scatters rows uniformly, by a seeded hash of all their columns, into buckets small enough for memory; pass two runs
a Fisher-Yates shuffle over each bucket, whose draws are hashes of the seed, the bucket and the step. The shuffled buckets,
one after the other, are a random order of all rows, dealt out to the shards one by one, so shard sizes differ by one row at
most. The order depends on the seed, the rows and the number of buckets alone, in any partitioning. Only DataFrame functions.

Rows with equal or null keys part by their other columns. Of rows equal in all columns that occur more than ``REPEATED``
times one is kept with its count; the copies are made again, each with a number that its hash takes in. So no bucket is
filled by one key or one row.

Defined cases: a null key is a key of its own; equal rows stay separate rows; an empty table gives no rows; columns named
like the results (``shard``, ``slot``) are replaced; null or empty texts count as rows like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 16
SEED = 1971
#: A bucket holds about so many rows and bytes, whichever is reached first.
BUCKET_ROWS = 4096
BUCKET_BYTES = 16 << 20
#: Bucket counts are summed up in groups of so many buckets, then over the groups.
RUN = 1024
#: So many buckets that follow each other are shuffled, and written, by one task.
TOGETHER = 8
#: Equal rows up to this many may share a bucket; of more, copies are made by so many in a task.
REPEATED, COPIES = 64, 1024
#: Hashes of repeated rows, and starts of buckets, up to this many are looked up by broadcast.
FEW = 500_000


def scatter(rows: DataFrame, buckets: int, *, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(b, item): each row's bucket, and the row with a hash ``h`` to sort by in ``item.row``."""
    names = rows.columns
    cells = [F.col(f"`{c}`") for c in names]
    whole = F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string"), *[x for c in cells for x in (c, c.isNull())])
    repeated = written(rows.select(whole.alias("whole")).groupBy("whole").agg(F.count("*").alias("n")).filter(F.col("n") > REPEATED), "repeated")
    many = repeated.count()

    def dealt(found: DataFrame, copy: Column) -> DataFrame:
        hashed = F.xxhash64(F.lit(seed), "whole", copy)
        return found.select(F.pmod(hashed, F.lit(buckets)).alias("b"), F.struct(F.xxhash64(F.lit(seed + 1), hashed).alias("h"), "row").alias("item"))

    packed = rows.select(whole.alias("whole"), F.struct(*cells).alias("row"))
    if not many:
        return dealt(packed, F.lit(0).cast("bigint"))
    table = F.broadcast(repeated) if many <= FEW else repeated
    once = packed.join(table, "whole", "left_anti")
    first = packed.join(table.select("whole"), "whole", "left_semi").groupBy("whole").agg(F.first("row").alias("row")).join(table, "whole")
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {COPIES}")))).repartition(F.xxhash64("whole", "run"))
    copies = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * COPIES, F.least("n", (F.col("run") + 1) * COPIES) - 1)))
    return dealt(once, F.lit(0).cast("bigint")).union(dealt(copies, F.col("copy")))


def fisher_yates(items: Column, bucket: Column, seed: int) -> Column:
    """``items`` in a random order, by the inside-out form: place i takes a new index, and swaps it with that of a place up to i."""

    def step(done: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1)
        last = F.array(i)
        swapped = F.concat(F.slice(done, 1, j), last, F.slice(done, j + 2, i - j - 1), F.slice(done, j + 1, 1))
        return F.when(j == i, F.concat(done, last)).otherwise(swapped)

    steps = F.sequence(F.lit(0), F.size(items) - 1)
    return F.transform(F.aggregate(steps, F.array().cast("array<int>"), lambda done, i: step(done, i)), lambda i: items[i])


def external_shuffle(rows: DataFrame, *, key: str = "doc_id", shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    The order depends on the seed and the rows, not on how they arrive: each bucket is sorted before it is shuffled.
    Columns must be of types that can be sorted (no maps).
    """
    return _placed(rows, key, shards, seed, bucket_rows, bucket_bytes).drop(part_of(rows))


def part_of(rows: DataFrame) -> str:
    """Name of the column, and folder, of runs of buckets: ``part``, with as many underscores as none of the rows' own columns has."""
    name = "part"
    while name in rows.columns:
        name += "_"
    return name


def _placed(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """As ``external_shuffle``, with ``part_of(rows)``: the run of ``TOGETHER`` buckets, which a task holds whole."""
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    long = [c for c, kind in rows.select(*[f"`{c}`" for c in names]).dtypes if kind in ("string", "binary")]
    weight = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in long), F.lit(16 * len(names)))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(weight.cast("long")), F.lit(0))).first()
    buckets = max(1, math.ceil(n / bucket_rows), math.ceil(size / bucket_bytes))

    scattered = scatter(rows.select(*[F.col(f"`{c}`") for c in names]), buckets, key=key, seed=seed)
    shuffled = (
        scattered.withColumn("part", F.expr(f"b div {TOGETHER}"))
        .repartition("part")
        .groupBy("part", "b")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
        .select("part", "b", fisher_yates(F.col("items"), F.col("b"), seed).alias("items"))
        .select("part", "b", F.posexplode("items").alias("i", "item"))
    )

    counts = scattered.groupBy("b").agg(F.count("*").alias("c")).withColumn("run", F.floor(F.col("b") / RUN))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("c").over(before(Window.partitionBy("run").orderBy("b"))), F.lit(0))
    runs = counts.groupBy("run").agg(F.sum("c").alias("c")).select("run", F.coalesce(F.sum("c").over(before(Window.orderBy("run"))), F.lit(0)).alias("base"))
    starts = counts.withColumn("inside", inside).join(runs, "run").select("b", (F.col("inside") + F.col("base")).alias("start"))

    if buckets <= FEW:
        starts = F.broadcast(starts)
    at = F.col("start") + F.col("i")
    return shuffled.join(starts, "b").select(
        *[F.col("item.row").getField(c).alias(c) for c in names],
        F.pmod(at, F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"(start + i) div {shards}").alias("slot"),
        F.col("part").alias(part_of(rows)),
    )


def write_shards(rows: DataFrame, path: str, *, rows_per_file: int = 1_000_000, **options) -> None:
    """Shuffle ``rows`` and write them as Parquet under ``path``, a folder for each shard, in order of slot.

    A shard may be larger than a task: it is cut into folders of consecutive slots, numbered by ``part_of(rows)``, and these into
    files of at most ``rows_per_file``. The task that has shuffled a run of buckets writes it, so rows move once.
    """
    part = part_of(rows)
    done = _placed(rows, **options)
    done.sortWithinPartitions("shard", part, "slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard", part).parquet(path)
