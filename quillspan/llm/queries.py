"""The registered queries of the operators, each over the whole of its table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bradley_terry, deleted_interpolation, media, packing, periodic_runs, phrases, pii, quality_rules, sentencepiece_sampling, sharding, simhash, url_filters, warc
from .common import documents, id_crc, shared_dir


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = bradley_terry.classify(documents(spark, sf_dir), labels, keep=["doc_id"], learn=bradley_terry.learnable())
    return found.select("doc_id", (F.pmod(id_crc("doc_id"), F.lit(5)) == 0).alias("held_out"), "score", "predicted")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.mux(documents(spark, sf_dir))
    found = media.probe(stored, keep=["doc_id", "n_bytes"], read=True)
    keys = F.expr("concat(t.codec, ':', cast(t.duration_s as string), ':', t.samples, ':', size(t.keyframes), ':', t.keyframes[0].offset, '+', t.keyframes[0].size, ':', element_at(t.keyframes, -1).offset)")
    return found.withColumn("t", F.col("tracks")[0]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("media_bytes").cast("long"), "media_sha256", keys.alias("feature"))


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(docs, path)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    back = spark.read.schema(docs.select(*names).withColumns({"slot": F.lit(0).cast("bigint"), "shard": F.lit(0)}).schema).parquet(path)
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    return back.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(documents(spark, sf_dir), keep=["doc_id"])
    kinds = F.array_join(F.transform("findings", lambda x: x["kind"]), ",")
    return found.select("doc_id", "text", F.size("findings").alias("n_found"), kinds.alias("kinds"))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(documents(spark, sf_dir))


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures: the fetch hour is spread over 2024 by the page's id."""
    hours = F.expr("make_dt_interval(0, cast((page_id * 7919) % 8760 as int), 0, 0)")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", (F.lit("2024-01-01").cast("timestamp") + hours).alias("fetched_at"))


def _list_entries(captures: DataFrame) -> DataFrame:
    """Four dated entries for every host and parent domain (of two labels or more) of the pages."""
    hosts = captures.select(url_filters.host_of(F.col("url")).alias("host")).distinct().filter("host <> ''")
    domains = hosts.select(F.explode(url_filters.suffixes(F.col("host"))).alias("s")).filter("s.level > 1").select("s.domain").distinct()
    day = F.expr("(length(domain) * 37 + ascii(substr(domain, 1, 1)) * 11 + ascii(substr(domain, 3, 1)) * 5 + k * 97) % 365")
    action = F.expr("element_at(array('block', 'block', 'allow', 'remove'), cast((length(domain) + ascii(substr(domain, 2, 1)) + k) % 4 + 1 as int))")
    return domains.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("domain", action.alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("listed_at"))


def op7_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _captures(spark, sf_dir)
    found = url_filters.temporal_join(captures, _list_entries(captures))
    return found.select("page_id", "host", "action", "matched_domain", F.date_format("listed_at", "yyyy-MM-dd").alias("listed_on"), "blocked")


OP7_SQL = r"""
WITH captures AS (
  SELECT page_id, TIMESTAMP '2024-01-01' + to_hours(CAST((page_id * 7919) % 8760 AS INTEGER)) AS t,
         coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') AS host
  FROM pages),
parts AS (
  SELECT DISTINCT host, level, array_to_string(list_slice(labels, len(labels) - level + 1, len(labels)), '.') AS domain
  FROM (SELECT host, labels, unnest(range(1, len(labels) + 1)) AS level
        FROM (SELECT DISTINCT host, string_split(host, '.') AS labels FROM captures WHERE host <> ''))),
numbered AS (
  SELECT domain, k, (length(domain) * 37 + ascii(substr(domain, 1, 1)) * 11 + ascii(substr(domain, 3, 1)) * 5 + k * 97) % 365 AS day,
         (length(domain) + ascii(substr(domain, 2, 1)) + k) % 4 AS a
  FROM (SELECT DISTINCT domain FROM parts WHERE level > 1), range(4) AS r(k)),
entries AS (
  SELECT domain, DATE '2024-01-01' + CAST(day AS INTEGER) AS listed_on, max(CASE WHEN a < 2 THEN 3 WHEN a = 2 THEN 2 ELSE 1 END) AS rank
  FROM numbered GROUP BY ALL),
latest AS (
  SELECT c.page_id, c.host, p.level, p.domain, max(e.listed_on) AS listed_on, arg_max(e.rank, e.listed_on) AS rank
  FROM captures c JOIN parts p USING (host) JOIN entries e ON e.domain = p.domain AND e.listed_on <= c.t GROUP BY ALL),
best AS (
  SELECT page_id, max(level) AS level FROM latest WHERE rank > 1 GROUP BY page_id)
SELECT c.page_id, c.host, CASE l.rank WHEN 3 THEN 'block' WHEN 2 THEN 'allow' ELSE 'none' END AS action,
       l.domain AS matched_domain, strftime(l.listed_on, '%Y-%m-%d') AS listed_on, coalesce(l.rank, 0) = 3 AS blocked
FROM captures c LEFT JOIN best b USING (page_id) LEFT JOIN latest l ON l.page_id = b.page_id AND l.level = b.level
"""


def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), keep=["doc_id"])


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.encode(documents(spark, sf_dir), with_ids=False, check=True)


def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
n AS (
  SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
f AS (
  SELECT lang, phrase, k, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(string_split(phrase, ' ')[:c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS tail
  FROM f, (SELECT unnest([1, 2]) AS c) WHERE c < k),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, c, x.a AS l, y.a AS r,
         CAST((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (
  SELECT lang, part, max(a) AS a
  FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[:2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS part FROM f WHERE k = 3)
  GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, n.n, s.score
FROM lowest s JOIN n ON n.lang = s.lang LEFT JOIN longer o ON o.lang = s.lang AND o.part = s.phrase
WHERE o.a IS NULL OR 100 * o.a < 50 * s.a
QUALIFY rank <= 2000
"""


def op12_block_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = documents(spark, sf_dir).select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"))
    a, p = "((h div 10) % size(w))", "(1 + (size(w) - (h div 10) % size(w)) div (3 + (h div 10) % 8))"
    tail = F.expr(f"array_join(transform(sequence(0, size(w) - 1), i -> w[cast(if(i < {a}, i, {a} + (i - {a}) % {p}) as int)]), ' ')")
    found = periodic_runs.periodic_runs(planted.select("doc_id", F.when(F.size("w") > 0, tail).otherwise(F.col("text")).alias("text")))
    best = F.expr("element_at(array_sort(runs, (x, y) -> case when x.length <> y.length then if(x.length > y.length, -1, 1) when x.start <> y.start then if(x.start < y.start, -1, 1) else cast(x.period - y.period as int) end), 1)")
    listed = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div greatest(best.period, 1)").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(pages, path, key="page_id", url="url", payload="html")
    back = warc.read(spark, path)
    return back.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP13_SQL = r"""
WITH digests AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((list_reduce(list_transform(range(5), lambda d: (strpos('0123456789abcdef', substr(hex, (i // 4) * 5 + d + 1, 1)) - 1)), lambda x, y: x * 16 + y)
               >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM digests
"""


QUERIES = {
    "op1_bradley_terry": op1_bradley_terry,
    "op2_media_columns": op2_media_columns,
    "op3_external_shuffle": op3_external_shuffle,
    "op4_ffd_packing": op4_ffd_packing,
    "op5_feistel_pseudonyms": op5_feistel_pseudonyms,
    "op6_deleted_interpolation": op6_deleted_interpolation,
    "op7_temporal_lists": op7_temporal_lists,
    "op8_simhash_pivots": op8_simhash_pivots,
    "op9_perplexity_rules": op9_perplexity_rules,
    "op10_sampled_pieces": op10_sampled_pieces,
    "op11_toivonen_phrases": op11_toivonen_phrases,
    "op12_block_convolution": op12_block_convolution,
    "op13_warc_shards": op13_warc_shards,
}

ORACLES: dict[str, str] = {"op7_temporal_lists": OP7_SQL, "op11_toivonen_phrases": OP11_SQL, "op13_warc_shards": OP13_SQL}
