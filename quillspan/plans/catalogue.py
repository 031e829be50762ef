"""Registered queries over the given tables, with their oracle SQL where SQL can express them.

Vectors of ``embeddings`` form a corpus for each label, documents one for each source, conversations one for each id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import vec
from quillspan.operators import admit, chunk, cluster, embed, evaluate, maps, project, ranks, scan, vectors
from quillspan.sources import models
from quillspan.sources.shared import shared_dir, written
from quillspan.streaming import notes, store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _run(stream: DataFrame, mode: str = "append", sink: Callable[[str], Callable[[DataFrame, int], None]] | None = None) -> str:
    """Run the stream over all there is and end; the folder of its rows, or that given to ``sink``."""
    spark, provider = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    root, before = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", spark.conf.get(provider)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    spark.conf.set(provider, notes.ROCKSDB)
    try:
        (writer.foreachBatch(sink(f"{root}/rows")).start() if sink else writer.start(f"{root}/rows", format="parquet")).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return f"{root}/rows"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, id, seq, embedding): a corpus for each label."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("corpus_id"), F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), "embedding")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("corpus_id"), F.col("doc_id").alias("note_id"), F.col("doc_id").alias("seq"), "text")


#: Normal form C, trimmed, as SQL.
SQL_KEY_TEXT = r"regexp_replace(nfc_normalize(text), '^[\s\p{Z}\x{FEFF}\x0B]+|[\s\p{Z}\x{FEFF}\x0B]+$', '', 'g')"

COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({COSINE}, 9) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors to every hundredth one."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.rank(asked, e, 10, item_id="vec_id")


@query()
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five chunks of all documents nearest to each benchmark passage, with their notes."""
    docs = _documents(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), embed.embedding("text").alias("embedding"))
    ranked = written(vectors.rank_few(asked, embed.embed(chunk.chunk_notes(docs)), 5, item_id="chunk_id"), "ranked")
    # the notes of what was found are cut again, so the chunks of all others are never written
    found = ranked.select(chunk.note_of("chunk_id").cast(docs.schema["note_id"].dataType).alias("note_id")).distinct()
    notes = written(docs.join(found, "note_id", "left_semi"), "notes")
    return vectors.with_context(ranked, chunk.chunk_notes(notes), notes).select("query_id", "rank", "chunk_id", "note_id", "chunk_text", F.length("note_text").alias("note_length"))


@query("""
SELECT label, i, round(avg(x), 6) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL""")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.centroids(table(spark, sf_dir, "embeddings"), by="label")
    return found.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("value"))


PAIRS = f"SELECT a.label, a.vec_id AS a, b.vec_id AS b, round({COSINE}, 9) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"


@query(f"""
WITH p AS ({PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, a, b) AS rank, count(*) OVER (PARTITION BY label) AS n FROM p)
SELECT label, a, b, round(similarity, 6) AS similarity, rank, greatest(n - 10, 0) AS remainder FROM r WHERE rank <= 10""")
def pairs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.top_pairs(_vectors(spark, sf_dir), 10)
    return found.select(F.col("corpus_id").alias("label"), "a", "b", F.round("similarity", 6).alias("similarity"), "rank", "remainder")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({COSINE}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COSINE} >= 0.3")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of all vectors at a cosine of 0.3 or more, by blocks that skip what is too far apart."""
    everything = _vectors(spark, sf_dir).withColumn("corpus_id", F.lit(0))
    return vectors.all_pairs(everything, min_similarity=0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""
WITH p AS ({PAIRS}), c AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY similarity) - 1 AS below, count(*) OVER (PARTITION BY label, similarity) AS equal, count(*) OVER (PARTITION BY label) AS total FROM p)
SELECT label, a, b, CASE WHEN total >= 10 THEN round((below + 0.5 * equal) / total * 100, 6) END AS percentile FROM c""")
def pair_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranks.pair_percentiles(_vectors(spark, sf_dir), digits=9)
    return found.select(F.col("corpus_id").alias("label"), "a", "b", F.round("percentile", 6).alias("percentile"))


@query(f"""
WITH p AS ({PAIRS}), v AS (SELECT DISTINCT label, x AS value FROM embeddings, (VALUES (-0.5::DOUBLE), (0.0), (0.1), (0.5), (2.0)) t(x))
SELECT label, value, CASE WHEN count(p.a) >= 10 THEN round((count(*) FILTER (p.similarity < value) + 0.5 * count(*) FILTER (p.similarity = value)) / count(p.a) * 100, 6) END AS percentile
FROM v LEFT JOIN p USING (label) GROUP BY ALL""")
def percentile_of_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _vectors(spark, sf_dir)
    asked = items.select("corpus_id").distinct().select("corpus_id", F.explode(F.array(*map(F.lit, (-0.5, 0.0, 0.1, 0.5, 2.0)))).alias("similarity"))
    found = vectors.percentile_of(asked, vectors.all_pairs(items, digits=9))
    return found.select(F.col("corpus_id").alias("label"), F.col("similarity").alias("value"), F.round("percentile", 6).alias("percentile"))


@query(f"""
WITH m AS (SELECT a.label, a.vec_id, avg({COSINE}) AS mean FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL HAVING count(*) >= 2)
SELECT label, vec_id, round(mean, 6) AS mean_similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(mean, 12), vec_id) AS r FROM m) WHERE r = 1""")
def outlier_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.outlier(_vectors(spark, sf_dir))
    return found.select(F.col("corpus_id").alias("label"), F.col("id").alias("vec_id"), F.round("mean_similarity", 6).alias("mean_similarity"))


@query("""
SELECT label, count(*) AS n, greatest(0, 3 - count(*)) AS outlier_needed, greatest(0, 5 - count(*)) AS percentile_needed, greatest(0, 15 - count(*)) AS cluster_needed FROM embeddings GROUP BY label""")
def floor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admit.floor_status(_vectors(spark, sf_dir)).withColumnRenamed("corpus_id", "label")


@query("""
SELECT round(sum(v * n), 4) AS total_variance FROM (SELECT i, var_pop(x) AS v, count(*) AS n FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)""")
def total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.total_variance(table(spark, sf_dir, "embeddings")).select(F.round("total_variance", 4).alias("total_variance"))


#: Squarings of a covariance matrix until its largest eigenvalue stands alone.
SQUARINGS = 14


def _axes_sql(rows: str, tag: str) -> str:
    """CTEs ``{tag}b(g, m, p, q, share)``: mean, axes and share of variance of each group of ``rows`` (g, id, v).

    The axes are columns of high powers of the covariance matrix, which is squared again and again, and of what is left without the first.
    """
    t = tag
    square = lambda x, y: f"{y} AS MATERIALIZED (SELECT a.g, a.i, b.j, sum(a.x * b.x) / any_value(a.t * b.t) AS x, sqrt(sum(sum(a.x * b.x) ^ 2) OVER (PARTITION BY a.g)) / any_value(a.t * b.t) AS t FROM {x} a JOIN {x} b ON a.g = b.g AND a.j = b.i GROUP BY a.g, a.i, b.j)"

    def axis(c: str, k: int) -> str:
        powers = [f"{t}s{k}_0 AS MATERIALIZED (SELECT g, i, j, x, sqrt(sum(x ^ 2) OVER (PARTITION BY g)) AS t FROM {c})"]
        powers += [square(f"{t}s{k}_{n}", f"{t}s{k}_{n + 1}") for n in range(SQUARINGS)]
        top = f"{t}s{k}_{SQUARINGS}"
        return ", ".join(powers) + f""",
{t}j{k} AS (SELECT g, arg_max(i, x) AS j FROM {top} WHERE i = j GROUP BY g),
{t}u{k} AS (SELECT c.g, c.i, c.x / sqrt(sum(c.x ^ 2) OVER (PARTITION BY c.g)) AS x FROM {top} c JOIN {t}j{k} b ON b.g = c.g AND b.j = c.j),
{t}w{k} AS MATERIALIZED (SELECT g, i, x * CASE WHEN sum(x * ((i * 2654435761 % 100000) / 100000.0 - 0.5)) OVER (PARTITION BY g) >= 0 THEN 1 ELSE -1 END AS x FROM {t}u{k}),
{t}l{k} AS MATERIALIZED (SELECT c.g, sum(a.x * c.x * b.x) AS l FROM {c} c JOIN {t}w{k} a ON a.g = c.g AND a.i = c.i JOIN {t}w{k} b ON b.g = c.g AND b.i = c.j GROUP BY c.g)"""

    return f"""
{t}r AS MATERIALIZED (SELECT g, id, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1)::BIGINT AS i FROM ({rows})),
{t}m AS MATERIALIZED (SELECT g, i, avg(x) AS m FROM {t}r GROUP BY g, i),
{t}d AS MATERIALIZED (SELECT r.g, r.id, r.i, r.x - m.m AS x FROM {t}r r JOIN {t}m m USING (g, i)),
{t}c1 AS MATERIALIZED (SELECT a.g, a.i, b.i AS j, sum(a.x * b.x) AS x FROM {t}d a JOIN {t}d b ON a.g = b.g AND a.id = b.id GROUP BY a.g, a.i, b.i),
{axis(f"{t}c1", 1)},
{t}c2 AS MATERIALIZED (SELECT c.g, c.i, c.j, c.x - l.l * a.x * b.x AS x FROM {t}c1 c JOIN {t}l1 l ON l.g = c.g JOIN {t}w1 a ON a.g = c.g AND a.i = c.i JOIN {t}w1 b ON b.g = c.g AND b.i = c.j),
{axis(f"{t}c2", 2)},
{t}b AS (SELECT c.g, any_value(a.l) / sum(c.x) AS share1, any_value(b.l) / sum(c.x) AS share2 FROM {t}c1 c JOIN {t}l1 a ON a.g = c.g JOIN {t}l2 b ON b.g = c.g WHERE c.i = c.j GROUP BY c.g),
{t}xy AS MATERIALIZED (SELECT d.g, d.id, sum(d.x * a.x) AS x, sum(d.x * b.x) AS y FROM {t}d d JOIN {t}w1 a ON a.g = d.g AND a.i = d.i JOIN {t}w2 b ON b.g = d.g AND b.i = d.i GROUP BY d.g, d.id),
{t}f AS (SELECT g, 260 / coalesce(nullif(max(greatest(abs(x), abs(y))), 0), 1) AS s FROM {t}xy GROUP BY g),
{t}px AS MATERIALIZED (SELECT g, id, 300 + x * s AS px, 300 - y * s AS py FROM {t}xy JOIN {t}f USING (g))"""


# centroids are projected too; they lie within their chunks' extent
@query(f"""
WITH {_axes_sql("SELECT 0 AS g, vec_id AS id, embedding AS v FROM embeddings", "o_")},
notes AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::BIGINT AS i FROM embeddings) GROUP BY label, i),
nxy AS (SELECT n.label, sum((n.x - m.m) * a.x) AS x, sum((n.x - m.m) * b.x) AS y FROM notes n JOIN o_m m ON m.i = n.i JOIN o_w1 a ON a.i = n.i JOIN o_w2 b ON b.i = n.i GROUP BY n.label),
every AS (SELECT 'chunk' AS kind, e.label AS note_id, e.vec_id::VARCHAR AS chunk_id, x, y FROM o_xy JOIN embeddings e ON e.vec_id = o_xy.id UNION ALL SELECT 'note', label, NULL, x, y FROM nxy),
s AS (SELECT 260 / max(greatest(abs(x), abs(y))) AS s FROM every)
SELECT kind, note_id, chunk_id, round(300 + x * s, 4) AS px, round(300 - y * s, 4) AS py, (SELECT floor(100 * (share1 + share2) + 0.5)::INTEGER FROM o_b) AS percent FROM every, s""")
def pca_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as chunks and their labels' centroids as notes on one pair of axes, in pixels."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("note_id"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.lit(False).alias("truncated"))
    points, basis = project.map_points(e, vectors.centroids(e))
    drawn = project.to_pixels(points, project.viewport_fit(points))
    return drawn.select("kind", "note_id", "chunk_id", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"), F.lit(basis.percent).alias("percent"))


@query(f"""
WITH {_axes_sql("SELECT label AS g, vec_id AS id, embedding AS v FROM embeddings", "o_")}
SELECT o.g AS label, o.id AS vec_id, round(o.px, 4) AS px, round(o.py, 4) AS py, round(b.share1, 6) AS share1, round(b.share2, 6) AS share2 FROM o_px o JOIN o_b b USING (g)""")
def pca_map_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for each label, all fitted in one job."""
    e = _vectors(spark, sf_dir)
    found = written(maps.bases(maps.states(e)), "bases")
    points = maps.drawn(e, found).join(F.broadcast(found.select("corpus_id", "share1", "share2")) if found.count() <= maps.FEW else found.select("corpus_id", "share1", "share2"), "corpus_id")
    return points.select(F.col("corpus_id").alias("label"), F.col("id").alias("vec_id"), *[F.round(c, k).alias(c) for c, k in (("px", 4), ("py", 4), ("share1", 6), ("share2", 6))])


@query(f"""
WITH {_axes_sql("SELECT 0 AS g, vec_id AS id, embedding AS v FROM embeddings WHERE label <> (SELECT max(label) FROM embeddings)", "o_")},
{_axes_sql("SELECT 0 AS g, vec_id AS id, embedding AS v FROM embeddings", "n_")}
SELECT round(avg(d), 4) AS mean_px, round(max(d), 4) AS max_px, count(*) AS n FROM (SELECT sqrt((o.px - n.px) ^ 2 + (o.py - n.py) ^ 2) AS d FROM o_px o JOIN n_px n USING (id))""")
def map_instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the points of all labels but the largest move when that one is added."""
    e = _vectors(spark, sf_dir)
    top = e.agg(F.max("corpus_id")).first()[0]
    found = project.instability(e.filter(F.col("corpus_id") != top).select("id", "embedding"), e.filter(F.col("corpus_id") == top).select("id", "embedding"))
    return found.select(F.round("mean_px", 4).alias("mean_px"), F.round("max_px", 4).alias("max_px"), "n")


@query(f"""
WITH {_axes_sql("SELECT label AS g, vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 5 <> 0", "o_")},
{_axes_sql("SELECT label AS g, vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 7 <> 0", "n_")}
SELECT g AS label, round(avg(d), 4) AS mean_px, round(max(d), 4) AS max_px, count(*) AS n FROM (SELECT g, sqrt((o.px - n.px) ^ 2 + (o.py - n.py) ^ 2) AS d FROM o_px o JOIN n_px n USING (g, id)) GROUP BY g""")
def map_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the points of each label move from the map without every fifth vector to that without every seventh: refitted
    from the first one's state by adding and subtracting the vectors between them."""
    e = _vectors(spark, sf_dir)
    five, seven = F.col("id") % 5 == 0, F.col("id") % 7 == 0
    before = written(maps.states(e.filter(~five)), "states")
    after = maps.changed(before, added=e.filter(five & ~seven), removed=e.filter(~five & seven))
    a = maps.drawn(e.filter(~five), maps.bases(before)).select("corpus_id", "id", F.col("px").alias("ax"), F.col("py").alias("ay"))
    b = maps.drawn(e.filter(~seven), maps.bases(after)).select("corpus_id", "id", "px", "py")
    moved = a.join(b, ["corpus_id", "id"]).select("corpus_id", F.hypot(F.col("px") - F.col("ax"), F.col("py") - F.col("ay")).alias("d"))
    found = moved.groupBy("corpus_id").agg(F.avg("d").alias("mean"), F.max("d").alias("max"), F.count("d").alias("n"))
    return found.select(F.col("corpus_id").alias("label"), F.round("mean", 4).alias("mean_px"), F.round("max", 4).alias("max_px"), "n")


@query("""
WITH p AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), f AS (SELECT label, 260 / coalesce(nullif(max(greatest(abs(x), abs(y))), 0), 1) AS s FROM p GROUP BY label)
SELECT label, vec_id, round(300 + x * s, 6) AS px, round(300 - y * s, 6) AS py FROM p JOIN f USING (label)""")
def viewport_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two dimensions as a map for each label."""
    points = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    drawn = project.to_pixels(points, project.viewport_fit(points, by="label"), by="label")
    return drawn.select("label", "vec_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


MESSAGES = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, {SQL_KEY_TEXT} AS key, CASE WHEN turn % 4 = 3 THEN 'remove' WHEN turn % 3 = 2 THEN 'edit' ELSE 'add' END AS op FROM conversations),
o AS (SELECT *, (CASE WHEN op = 'add' THEN turn ELSE turn - turn % 3 END)::VARCHAR AS note, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM k),
f AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS turn, '' AS note, '' AS status, MAP {{}}::MAP(VARCHAR, VARCHAR) AS held FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL
  SELECT conv_id, i, turn, note, status, CASE status WHEN 'removed' THEN map_from_entries(list_filter(map_entries(held), lambda e: e.key <> note))
         WHEN 'added' THEN map_concat(held, MAP {{note: key}}) WHEN 'edited' THEN map_concat(held, MAP {{note: key}}) ELSE held END
  FROM (SELECT o.conv_id, o.i, o.turn, o.note, o.key, f.held, CASE
          WHEN op = 'remove' THEN CASE WHEN map_contains(held, o.note) THEN 'removed' ELSE 'not-found' END
          WHEN o.key = '' THEN 'empty'
          WHEN op = 'edit' AND NOT map_contains(held, o.note) THEN 'not-found'
          WHEN len(list_filter(map_entries(held), lambda e: e.value = o.key AND (op = 'add' OR e.key <> o.note))) > 0 THEN 'duplicate'
          WHEN op = 'edit' THEN 'edited' ELSE 'added' END AS status
        FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1))
SELECT conv_id, turn, note, status FROM f WHERE i > 0"""


def _changes(messages: DataFrame) -> DataFrame:
    op = F.when(F.col("turn") % 4 == 3, "remove").when(F.col("turn") % 3 == 2, "edit").otherwise("add")
    note = F.when(op == "add", F.col("turn")).otherwise(F.col("turn") - F.col("turn") % 3).cast("string")
    return messages.withColumn("op", op).withColumn("note_id", note)


@query(MESSAGES)
def admission_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as additions, edits and removals of notes, one session for each conversation."""
    events = _changes(table(spark, sf_dir, "conversations"))
    found = admit.admit(events, corpus="conv_id", order="turn", op="op", max_notes=1 << 30, max_characters=1 << 40)
    return found.select("conv_id", "turn", F.col("note_id").alias("note"), "status")


@query(MESSAGES)
def admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with each conversation's session as its state."""
    events = _changes(_stream(spark, sf_dir, "conversations")).withColumn("seq", F.col("turn").cast("bigint")).withColumnRenamed("conv_id", "corpus_id")
    found = notes.admit_stream(events, max_notes=1 << 30, max_characters=1 << 40)
    back = spark.read.schema(found.schema).parquet(_run(found))
    return back.select(F.col("corpus_id").alias("conv_id"), F.col("seq").alias("turn"), F.col("note_id").alias("note"), "status")


def _linkage_sql(threshold: float, group: str = "label") -> str:
    """``steps`` (g, step, k, s, n, d): the clusters k of each group after each merge, with sums of unit vectors, and the merge's height."""
    return f"""
u AS MATERIALIZED (SELECT {group} AS g, vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
steps AS (
  SELECT g, 0 AS step, id AS k, u AS s, 1::BIGINT AS n, NULL::DOUBLE AS d FROM u
  UNION ALL
  (WITH p AS (SELECT a.g, a.k AS x, b.k AS y, 1 - list_dot_product(a.s, b.s) / (a.n * b.n) AS d FROM steps a JOIN steps b ON a.g = b.g AND a.k < b.k),
        m AS (SELECT g, arg_min(x, d) AS x, arg_min(y, d) AS y, min(d) AS d FROM p GROUP BY g HAVING min(d) <= {threshold})
   SELECT a.g, a.step + 1, a.k, CASE WHEN a.k = m.x THEN list_transform(range(1, len(a.s) + 1), lambda i: a.s[i] + b.s[i]) ELSE a.s END,
          CASE WHEN a.k = m.x THEN a.n + b.n ELSE a.n END, m.d
   FROM steps a JOIN m ON a.g = m.g JOIN steps b ON b.g = m.g AND b.k = m.y WHERE a.k <> m.y))"""


# a vector's cluster is that of the merges' last state that is nearest in the end: members follow their smallest number
@query(f"""
WITH RECURSIVE {_linkage_sql(0.85)},
merged AS (SELECT b.g, b.step, b.k AS gone, (SELECT a.k FROM steps a JOIN steps c ON c.g = a.g AND c.k = a.k AND c.step = a.step + 1 AND c.n > a.n WHERE a.g = b.g AND a.step = b.step) AS kept
           FROM steps b WHERE EXISTS (FROM steps x WHERE x.g = b.g AND x.step = b.step + 1) AND NOT EXISTS (FROM steps c WHERE c.g = b.g AND c.k = b.k AND c.step = b.step + 1)),
follow AS (SELECT g, id, id AS k FROM u UNION ALL SELECT f.g, f.id, m.kept FROM follow f JOIN merged m ON m.g = f.g AND m.gone = f.k)
SELECT g AS corpus_id, min(k) AS cluster, id FROM follow WHERE (SELECT count(*) FROM u x WHERE x.g = follow.g) >= 15 GROUP BY g, id""")
def cluster_upgma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters within each label."""
    return cluster.cluster(_vectors(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_linkage_sql(0.6, "0")},
merged AS (SELECT b.step, b.k AS gone, (SELECT a.k FROM steps a JOIN steps c ON c.k = a.k AND c.step = a.step + 1 AND c.n > a.n WHERE a.step = b.step) AS kept
           FROM steps b WHERE b.step < (SELECT max(step) FROM steps) AND NOT EXISTS (FROM steps c WHERE c.k = b.k AND c.step = b.step + 1)),
follow AS (SELECT id, id AS k FROM u UNION ALL SELECT f.id, m.kept FROM follow f JOIN merged m ON m.gone = f.k),
last AS (SELECT id, min(k) AS k FROM follow GROUP BY id),
each AS (SELECT k, count(DISTINCT label) = 1 AS pure FROM last JOIN embeddings e ON e.vec_id = last.id GROUP BY k)
SELECT count(*) AS n_clusters, count(*) FILTER (pure) AS n_pure, bool_and(pure) AS all_pure FROM each""")
def cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one corpus, clustered in rounds and held against their labels."""
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("corpus_id"), F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), "embedding", "label")
    found = cluster.cluster_rounds(e, threshold=0.6)
    return cluster.purity(found, e)


@query(f"""
WITH RECURSIVE {_linkage_sql(10)},
heights AS (SELECT DISTINCT g, step, d FROM steps WHERE step > 0)
SELECT l.label AS corpus_id, t AS threshold, l.n - (SELECT count(*) FROM heights h WHERE h.g = l.label AND h.d <= t) AS n_clusters
FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 15) l, (SELECT unnest([0.3, 0.6, 0.82, 0.85, 0.88, 0.95]::DOUBLE[]) AS t)""")
def cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cut_sweep(_vectors(spark, sf_dir), [0.3, 0.6, 0.82, 0.85, 0.88, 0.95])


SQL_KEY = SQL_KEY_TEXT


@query(f"""
WITH k AS (SELECT source, doc_id, {SQL_KEY} AS key FROM documents)
SELECT source, min(doc_id) AS doc_id FROM k WHERE key <> '' GROUP BY source, key""")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admit.first_of_each(_documents(spark, sf_dir)).select(F.col("corpus_id").alias("source"), F.col("note_id").alias("doc_id"))


@query("SELECT doc_id, length_grapheme(text) AS n FROM documents")
def grapheme_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.graphemes("text")).cast("long").alias("n"))


@query(rf"""
WITH RECURSIVE k AS (SELECT source, doc_id, {SQL_KEY} AS key FROM documents),
o AS (SELECT source, doc_id, key, length(key) + len(regexp_extract_all(key, '[\x{{10000}}-\x{{10FFFF}}]')) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM k),
f AS (
  SELECT source, 0::BIGINT AS i, 0::BIGINT AS doc_id, '' AS status, NULL::VARCHAR AS reason, []::VARCHAR[] AS keys, 0::BIGINT AS chars FROM (SELECT DISTINCT source FROM o)
  UNION ALL
  SELECT source, i, doc_id, status, CASE WHEN status = 'capped' THEN CASE WHEN len(keys) + 1 > 20 THEN 'notes' ELSE 'characters' END END,
         CASE WHEN status = 'added' THEN list_append(keys, key) ELSE keys END, CASE WHEN status = 'added' THEN chars + size ELSE chars END
  FROM (SELECT o.*, f.keys, f.chars, CASE WHEN o.key = '' THEN 'empty' WHEN list_contains(f.keys, o.key) THEN 'duplicate' WHEN len(f.keys) + 1 > 20 OR f.chars + o.size > 30000 THEN 'capped' ELSE 'added' END AS status
        FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1))
SELECT source, doc_id, status, reason FROM f WHERE i > 0""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source in order, under budgets of 20 notes and 30,000 characters."""
    found = admit.admit(_documents(spark, sf_dir), max_notes=20, max_characters=30_000)
    return found.select(F.col("corpus_id").alias("source"), F.col("seq").alias("doc_id"), "status", "reason")


#: Sentences as SQL, for texts without the characters 1, 2 and 4. A run of marks ends one with its closers, spaces and line end, and so does a line
#: end; not a single stop before a number or between a letter and a capital (1 stands for it), nor stops that a lower-case letter follows (2 stands
#: behind them and their white space) or marks that a comma, colon, semicolon or dash does. What looks ahead for a lower-case letter passes no mark, not the one in a number either.
SQL_MARKS, SQL_CLOSERS, SQL_LINE_END = ".!?…。．！？؟۔।", r"""[\p{Pe}\p{Pf}"'']*""", r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])"
SQL_ENDS = rf"[{SQL_MARKS}]+{SQL_CLOSERS}[ \t\x{{A0}}\x{{3000}}]*{SQL_LINE_END}?|{SQL_LINE_END}"


def _twice_sql(text: str, pattern: str, by: str) -> str:
    """Matches that share a character are every other one's turn."""
    return f"regexp_replace(regexp_replace({text}, {pattern}, {by}, 'g'), {pattern}, {by}, 'g')"


SQL_SENTENCES = rf"""
a AS (SELECT doc_id, {_twice_sql(_twice_sql("text", rf"'(^|[^{SQL_MARKS}])[.](\p{{N}})'", r"'\1' || chr(1) || '\2'"), r"'([\p{Lu}\p{Ll}])[.](\p{Lu})'", r"'\1' || chr(1) || '\2'")} AS t FROM documents),
b AS (SELECT doc_id, {_twice_sql("t", rf"'(^|[^{SQL_MARKS}])([.]+{SQL_CLOSERS}[\s\x0B]*)([^\p{{L}}\n.!?\x01\x02]*\p{{Ll}})'", r"'\1\2' || chr(2) || '\3'")} AS t FROM a),
c AS (SELECT doc_id, regexp_extract_all(t, '[.]+{SQL_CLOSERS}[\s\x0B]*\x02|[{SQL_MARKS}]+{SQL_CLOSERS}[ \t]*[,:;\-，、]|{SQL_ENDS}|[^\n\r\x{{85}}\x{{2028}}\x{{2029}}{SQL_MARKS}]+') AS t FROM b),
e AS (SELECT doc_id, array_to_string(list_transform(t, lambda x: CASE WHEN regexp_full_match(x, '{SQL_ENDS}') THEN x || chr(4) ELSE x END), '') AS t FROM c),
d AS (SELECT doc_id, list_filter(string_split(replace(replace(t, chr(1), '.'), chr(2), ''), chr(4)), lambda x: x <> '') AS s FROM e)"""


def _chunks_sql(count: str, max_tokens: int, ceiling: int, max_sentences: int = 3) -> str:
    """``chunks(doc_id, k, n, cut, width)`` as SQL: tokens, flag and graphemes of each chunk, by one sentence at a time; ``count`` measures ``{}``."""
    return rf"""WITH RECURSIVE {SQL_SENTENCES},
f AS (
  SELECT doc_id, 0::BIGINT AS i, '' AS held, 0 AS n, false AS fresh, false AS cut, '' AS x FROM d WHERE len(s) > 0
  UNION ALL
  SELECT doc_id, i, CASE WHEN cut THEN '' WHEN fresh THEN x ELSE held || x END, CASE WHEN cut THEN 0 WHEN fresh THEN 1 ELSE n + 1 END, fresh, cut, x
  FROM (SELECT *, cut OR n = 0 OR n = {max_sentences} OR {count.format("held || x")} > {max_tokens} AS fresh
        FROM (SELECT d.doc_id, f.i + 1 AS i, f.held, f.n, d.s[f.i + 1] AS x, {count.format("d.s[f.i + 1]")} > {ceiling} AND len(d.s) > 1 AS cut
              FROM f JOIN d ON d.doc_id = f.doc_id AND len(d.s) > f.i))),
chunks AS (
  SELECT doc_id, k, CASE WHEN bool_or(cut) THEN {ceiling} ELSE {count.format("string_agg(x, '' ORDER BY i)")} END AS n, bool_or(cut) AS cut, sum(length_grapheme(x))::BIGINT AS width
  FROM (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM f WHERE i > 0) GROUP BY doc_id, k)"""


SQL_WORDS = r"len(regexp_extract_all({}, '[^\s\p{{Z}}\x{{FEFF}}\x0B]+'))"
SQL_GRAPHEMES = "length_grapheme({})"
#: A note's only sentence over the ceiling is split into runs of whole budgets.
SQL_RUNS = "CASE WHEN count(*) = 1 AND NOT bool_or(cut) AND max(n) > {ceiling} THEN ceil(max(n) / {most})::BIGINT ELSE count(*) END"


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text <> ''")
def chunk_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a ceiling chunks are a partition of the text."""
    chunks = chunk.chunk_notes(_documents(spark, sf_dir), hard_ceiling=1 << 30)
    return chunk.reconstructed(chunks).select(F.col("note_id").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"{_chunks_sql(SQL_WORDS, 80, 128)} SELECT doc_id AS note_id, {SQL_RUNS.format(ceiling=128, most=80)} AS n_chunks, sum(n)::BIGINT AS n_tokens, bool_or(cut) AS any_truncated FROM chunks GROUP BY doc_id")
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.note_summary(chunk.chunk_notes(_documents(spark, sf_dir)))


@query(f"""{_chunks_sql(SQL_GRAPHEMES, 400, 800)}, g AS (SELECT doc_id, {SQL_RUNS.format(ceiling=800, most=400)} AS chunks, sum(n)::BIGINT AS tokens FROM chunks GROUP BY doc_id)
SELECT doc_id AS note_id, len(s)::INTEGER AS sentences, coalesce(chunks, 0) AS chunks, coalesce(tokens, 0) AS tokens FROM d LEFT JOIN g USING (doc_id)""")
def segmentation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.segmentation_counts(_documents(spark, sf_dir).select("note_id", "text"), counter="graphemes", max_tokens=400, hard_ceiling=800)


@query(f"""{_chunks_sql(SQL_WORDS, 80, 1 << 30)}, w AS (SELECT *, sum(width) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM chunks)
SELECT doc_id AS note_id, i::INTEGER AS i, doc_id || '-c' || k AS chunk_id FROM (SELECT *, unnest(range(((stop - width + 499) // 500 * 500)::BIGINT, stop::BIGINT, 500)) AS i FROM w)""")
def grapheme_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunk holds every five-hundredth grapheme of each document."""
    docs = _documents(spark, sf_dir)
    chunks = chunk.chunk_notes(docs, hard_ceiling=1 << 30)
    points = docs.select("note_id", F.explode(F.sequence(F.lit(0), F.size(T.graphemes("text")), F.lit(500))).alias("i"))
    return chunk.owner_of_grapheme(points, chunks).select("note_id", "i", "chunk_id")


SQL_TRIM = r"regexp_replace(text, '^[\s\p{Z}\x{FEFF}\x0B]+|[\s\p{Z}\x{FEFF}\x0B]+$', '', 'g')"


@query(rf"""
WITH t AS (SELECT doc_id, {SQL_TRIM} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 70 THEN regexp_replace(substr(t, 1, 70), '[\s\p{{Z}}\x{{FEFF}}\x0B]+$', '') || '…' ELSE t END AS preview FROM t""")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preview("text").alias("preview"))


@query("SELECT doc_id, item_id, substr(d.text, instr(d.text, b.text), 200) AS snippet FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leak_scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


HOST = "^[a-z]+://([^/?#]+)"


@query(f"""
WITH h AS (SELECT DISTINCT regexp_extract(url, '{HOST}', 1) AS host FROM pages)
SELECT page_id, channel, host, instr(body, host) AS at FROM (SELECT page_id, 'url' AS channel, url AS body FROM pages UNION ALL SELECT page_id, 'html', html FROM pages) JOIN h ON host <> '' AND contains(body, host)""")
def leak_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each host of the pages is named: in which pages, in their address or in their source."""
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(F.regexp_extract("url", HOST, 1).alias("host")).distinct().withColumn("text", F.col("host"))
    return scan.scan(pages, hosts, doc_id="page_id", channels=["url", "html"], pattern_id="host").select("page_id", "channel", "host", F.col("at").cast("long").alias("at"))


PHRASES = ("worthless", "idiot", "released under the mit license", "all rights reserved", "api_key")


@query(f"SELECT doc_id, phrase FROM documents, (SELECT unnest({list(PHRASES)!r}) AS phrase) WHERE contains(lower(text), phrase)")
def banned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    return evaluate.banned_words(table(spark, sf_dir, "documents"), phrases)


@query(r"SELECT doc_id, regexp_matches(text, '[.!?]') AS ascii_marks, regexp_matches(text, '\s') AS has_space, regexp_matches(text, '[\r\n]') AS has_newline FROM documents")
def data_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.data_flags(table(spark, sf_dir, "documents")).select("doc_id", "ascii_marks", "has_space", "has_newline")


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next of its label and the first of the next label."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", vec.as_double("embedding").alias("v"))
    after = F.lead("vec_id").over(vectors.Window.partitionBy("label").orderBy("vec_id"))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("n")).select((F.col("label") - 1).alias("label"), "n")
    other = e.select(F.col("vec_id").alias("after"), F.col("v").alias("p"))
    met = e.withColumn("after", after).join(other, "after").join(first, "label")
    return met.select("label", "vec_id", vec.cosine("v", "p").alias("cos_positive"), vec.cosine("v", "n").alias("cos_negative"))


SQL_TRIPLES = """
WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings),
f AS (SELECT label - 1 AS label, arg_min(v, vec_id) AS n FROM e GROUP BY label),
t AS (SELECT a.label, a.vec_id, list_cosine_similarity(a.v, p.v) AS cp, list_cosine_similarity(a.v, f.n) AS cn FROM e a JOIN e p ON p.vec_id = a.nxt JOIN f ON f.label = a.label)"""


@query(f"{SQL_TRIPLES} SELECT count(*) AS n, count(*) FILTER (cp > cn) AS n_pass, round(avg(cp - cn), 6) AS mean_gap, round(min(cp - cn), 6) AS min_margin, count(*) FILTER (cp > cn) = count(*) AND avg(cp - cn) >= 0.1 AS passed FROM t")
def triple_discriminability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.triple_discriminability(_triples(spark, sf_dir))
    return found.select("n", "n_pass", F.round("mean_gap", 6).alias("mean_gap"), F.round("min_margin", 6).alias("min_margin"), "passed")


@query(f"{SQL_TRIPLES} SELECT vec_id AS id, round(cp, 6) AS measured, round(cn, 6) AS pinned, round(abs(cp - cn), 6) AS drift, abs(cp - cn) <= 0.05 AS ok FROM t")
def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' cosines (to the label's next vector, to the next label's first) held against each other."""
    t = _triples(spark, sf_dir)
    found = evaluate.drift(t.select(F.col("vec_id").alias("id"), F.col("cos_positive").alias("value")), t.select(F.col("vec_id").alias("id"), F.col("cos_negative").alias("value")), epsilon=0.05)
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("measured", "pinned", "drift")], "ok")


SQL_COVERAGE = """
WITH claims AS (SELECT DISTINCT lang AS bcp47, upper(lang) AS name, lang IN ('es', 'fr') AS special FROM documents WHERE lang IS NOT NULL),
verdicts AS (SELECT lang AS bcp47, avg(quality) >= 0.84 AS passed, count(*)::VARCHAR || ' labels' AS evidence FROM documents JOIN labels USING (doc_id) WHERE lang <> 'es' GROUP BY lang),
c AS (SELECT bcp47, name, special, CASE WHEN NOT special THEN CASE WHEN bcp47 = 'en' THEN 'verified' ELSE 'unverified' END WHEN passed IS NULL THEN 'unverified' WHEN passed THEN 'verified' ELSE 'not-supported' END AS status, coalesce(evidence, CASE WHEN NOT special THEN 'claimed by the model' END) AS evidence FROM claims LEFT JOIN verdicts USING (bcp47))"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    claims = docs.filter("lang is not null").select(F.col("lang").alias("bcp47")).distinct().select("bcp47", F.upper("bcp47").alias("name"), F.lit(None).cast("string").alias("note"), F.col("bcp47").isin("es", "fr").alias("special"))
    measured = docs.filter("lang <> 'es'").join(labels, "doc_id").groupBy(F.col("lang").alias("bcp47"))
    verdicts = measured.agg((F.avg("quality") >= 0.84).alias("passed"), F.concat(F.count("*").cast("string"), F.lit(" labels")).alias("evidence")).withColumn("note", F.lit(None).cast("string"))
    return evaluate.coverage(claims, verdicts)


@query(f"{SQL_COVERAGE} SELECT bcp47, name, status, evidence FROM c")
def coverage_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).select("bcp47", "name", "status", "evidence")


@query(f"""{SQL_COVERAGE} SELECT 'Tuned for roughly ' || count(*) FILTER (NOT special) || ' languages, tested to date in ' || coalesce(string_agg(name, ', ' ORDER BY bcp47) FILTER (status = 'verified'), 'none yet')
  || '; other languages may work with reduced accuracy or may not be usable at all.' AS sentence FROM c""")
def coverage_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.coverage_sentence(_coverage(spark, sf_dir))


@query("""
WITH e AS (SELECT *, CASE WHEN length(text) % 5 = 0 THEN 'remove' WHEN turn = 0 THEN 'add' ELSE 'edit' END AS op FROM conversations)
SELECT conv_id, role, arg_max(text, turn) AS text, max(turn) AS turn, min(turn) AS first_seen FROM e GROUP BY conv_id, role HAVING arg_max(op, turn) <> 'remove'""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last message of each role in a conversation, where that isn't a removal (as every fifth length tells)."""
    op = F.when(F.length("text") % 5 == 0, "remove").when(F.col("turn") == 0, "add").otherwise("edit")
    events = table(spark, sf_dir, "conversations").withColumn("op", op)
    return admit.latest_state(events, keys=["conv_id", "role"], order="turn").drop("op")


@query("""
SELECT conv_id, role, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations GROUP BY conv_id, role HAVING arg_max(length(text), turn) % 5 <> 0""")
def latest_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last messages as a stream whose batches are versions of a table."""
    op = F.when(F.length("text") % 5 == 0, "remove").when(F.col("turn") == 0, "add").otherwise("edit")
    keys = ["conv_id", "role"]
    store = _run(_stream(spark, sf_dir, "conversations").withColumn("op", op), sink=lambda path: notes.keep_latest(path, keys=keys, order="turn"))
    return notes.current_state(spark, store, keys=keys, order="turn").select(*keys, "text", "turn")


@query(rf"""
WITH k AS (SELECT conv_id, turn, {SQL_KEY} AS key FROM conversations)
SELECT conv_id, turn, CASE WHEN key = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY conv_id, key ORDER BY turn) > 1 THEN 'duplicate' ELSE 'added' END AS status FROM k""")
def conversation_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each conversation by turn; budgets are out of reach here."""
    events = table(spark, sf_dir, "conversations").withColumn("note_id", F.concat_ws("-", "conv_id", "turn"))
    found = admit.admit(events, corpus="conv_id", order="turn", max_notes=1 << 30, max_characters=1 << 40)
    return found.select("conv_id", "turn", "status")


@query(f"SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE {SQL_KEY.replace('text', 'd.text')} = {SQL_KEY.replace('text', 'c.text')} AND {SQL_KEY.replace('text', 'd.text')} <> '')")
def not_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are no document's text."""
    return admit.not_present(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents")).select("conv_id", "turn")


@query("SELECT source, count(*) AS n_notes, sum(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::BIGINT AS n_characters FROM documents GROUP BY source")
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admit.session_totals(_documents(spark, sf_dir)).withColumnRenamed("corpus_id", "source")


@query("SELECT DISTINCT d.doc_id FROM documents d WHERE sha256(d.text || chr(0) || 'words' || chr(0) || 'hash-ngram-64') NOT IN (SELECT sha256(x.text || chr(0) || 'words' || chr(0) || 'hash-ngram-64') FROM documents x JOIN labels USING (doc_id))")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to embed when those with labels are in the cache."""
    docs = table(spark, sf_dir, "documents")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = known.select(embed.cache_key("text", F.lit(embed.HASHING)).alias("cache_key"))
    return embed.to_embed(docs, cache).select("doc_id")


@query("""
WITH f AS (SELECT user_id, min(ts) FILTER (event_type = 'click') AS t FROM events GROUP BY user_id)
SELECT user_id, count(*) FILTER (ts >= t) AS n FROM events JOIN f USING (user_id) GROUP BY user_id""")
def count_since_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.since_baseline(table(spark, sf_dir, "events"), by="user_id", time="ts", kind="event_type", ready="click")


@query("SELECT user_id, count(*) FILTER (ts >= t) AS n FROM events JOIN (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'click' GROUP BY user_id) USING (user_id) GROUP BY user_id")
def count_since_baseline_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of users with a baseline as a stream: a running count never falls, so the greatest is the last."""
    counts = notes.since_baseline_stream(_stream(spark, sf_dir, "events"), by="user_id", time="ts", kind="event_type", ready="click")
    store = _run(counts, "update", lambda path: lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"))
    return spark.read.schema(counts.schema).parquet(store).groupBy("user_id").agg(F.max("n").alias("n")).filter("n > 0")


BURSTS = """
WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS settled, count(*) AS n, round(arg_max(value, ts), 6) AS value FROM b GROUP BY user_id, burst"""


def _bursts(events: DataFrame) -> DataFrame:
    return notes.debounce(events.withColumn("ts", F.col("ts").cast("timestamp")), by="user_id", time="ts", value="value", gap="30 minutes")


@query(f"{BURSTS} HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bursts that have settled once the stream's watermark, ten minutes behind the last event, has passed them."""
    found = _bursts(_stream(spark, sf_dir, "events"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.schema(found.schema).parquet(_run(found)).select("user_id", at("started"), at("settled"), "n", F.round("value", 6).alias("value"))


@query(BURSTS)
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events, parted by half an hour of quiet, with the last value of each."""
    found = _bursts(table(spark, sf_dir, "events"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("user_id", at("started"), at("settled"), "n", F.round("value", 6).alias("value"))


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE event_type <> 'click') GROUP BY user_id")
def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return evaluate.request_counts(events.filter("event_type = 'click'"), events.filter("event_type <> 'click'"), by="user_id")


@query("SELECT doc_id::VARCHAR AS note_id, variant, true AS same_chunks, 1.0::DOUBLE AS cosine, true AS ok FROM documents, (VALUES ('crlf'), ('bom'), ('nfd')) v(variant) WHERE text <> ''")
def encoding_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in three other encodings against itself; the SQL states that each of them has to agree."""
    found = evaluate.encoding_invariance(_documents(spark, sf_dir).select("note_id", "text"))
    return found.withColumn("cosine", F.round("cosine", 6))


@query()
def similar_pairs_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: pairs of all vectors at a cosine of 0.5 or more."""
    return vectors.similar_pairs_lsh(_vectors(spark, sf_dir), min_similarity=0.5)


@query()
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several checks over the tables as one report."""
    docs, e = _documents(spark, sf_dir), _vectors(spark, sf_dir)
    whole = chunk.reconstructed(chunk.chunk_notes(docs, hard_ceiling=1 << 30)).join(docs.select("note_id", F.col("text").alias("want")), "note_id")
    one, other = (project.project_onto(rows, project.fit(rows)) for rows in (e, e.repartition(7, F.xxhash64("id"))))
    return evaluate.report(
        [
            evaluate.check("chunks-partition", whole, F.col("text") == F.col("want"), F.col("note_id")),
            evaluate.check("order-invariance", evaluate.order_invariance(one, other), F.col("ok")),
            evaluate.check("discriminability", evaluate.triple_discriminability(_triples(spark, sf_dir)), F.col("mean_gap") > 0, F.col("mean_gap")),
            evaluate.check("nothing-to-check", docs.limit(0), F.lit(True)),
        ]
    )


@query("""
SELECT vec_id, label, CASE WHEN label % 2 = 0 THEN 'halved' ELSE 'whole' END AS model_id, 'whole' AS model_before,
  round(embedding[1]::DOUBLE / CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END, 9) AS first_value FROM embeddings""")
def model_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in use before and after the even labels switch to a model whose vectors are half as long."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("label").cast("string").alias("corpus_id"), vec.as_double("embedding").alias("v"))
    halved = rows.withColumn("v", F.transform("v", lambda x: x / 2)).withColumn("model_id", F.lit("halved"))
    vectors_of = rows.withColumn("model_id", F.lit("whole")).unionByName(halved)
    labels, store = rows.select("corpus_id", "label").distinct(), f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    switch = lambda changed, model: models.switch(changed.select("corpus_id", F.lit(model).alias("model_id")), vectors_of, rows, store, note_id="vec_id")
    first = switch(labels, "whole")
    switch(labels.filter("label % 2 = 0"), "halved")
    before = models.in_use(vectors_of, models.pointer(spark, store, first)).select("vec_id", F.col("model_id").alias("model_before"))
    now = models.in_use(vectors_of, models.pointer(spark, store))
    return now.join(before, "vec_id").select("vec_id", "label", "model_id", "model_before", F.round(F.col("v")[0], 9).alias("first_value"))


@query("""
WITH e AS (SELECT conv_id, role, {'turn': turn, 'op': CASE WHEN turn % 5 = 4 THEN 'remove' ELSE 'add' END, 'text': coalesce(text, '')} AS e, turn * 2 % 3 AS batch FROM conversations),
s AS (SELECT DISTINCT conv_id, role, batch, max(e) OVER (PARTITION BY conv_id, role ORDER BY batch) AS s FROM e),
l AS (SELECT *, lag(s) OVER (PARTITION BY conv_id, role ORDER BY batch) AS o FROM s),
w AS (SELECT conv_id, role, max(s) AS s, count(*) FILTER (s.op <> 'remove' AND (o IS NULL OR o.op = 'remove' OR o.text <> s.text)) AS writes FROM l GROUP BY ALL)
SELECT conv_id, role, s.turn AS turn, md5(s.text) AS digest, writes FROM w WHERE s.op <> 'remove'""")
def reembedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each role said last in a conversation, merged in three batches with late turns among them, and how often it was embedded."""
    said = table(spark, sf_dir, "conversations").withColumn("op", F.when(F.col("turn") % 5 == 4, "remove").otherwise("add"))
    where, keys = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", ["conv_id", "role"]
    merge = store.merge(where, keys=keys, corpus="conv_id", order="turn", every=2)
    for number in range(3):
        merge(said.filter(F.col("turn") * 2 % 3 == number), number)
    return store.notes(spark, where, keys=keys).select("conv_id", "role", F.col("order").alias("turn"), F.md5("text").alias("digest"), "writes")
