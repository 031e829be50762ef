"""Whole documents through the external shuffle, with keys and rows that repeat."""

import zlib
from collections import Counter

from quillspan.llm import queries, sharding


def test_no_key_or_row_fills_a_bucket(spark):
    same = [(None, "one row")] * 3000  # equal rows with a null key
    rows = [(None, f"text {i}") for i in range(1500)] + [(5, f"other {i}") for i in range(1500)] + same
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    sizes = [r["count"] for r in sharding.scatter(table, 60).groupBy("b").count().collect()]
    assert len(sizes) == 60 and max(sizes) < 200 and sum(sizes) == len(rows)  # a hundred expected
    got = sharding.external_shuffle(table, bucket_rows=100).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert sorted(r.slot * 16 + r.shard for r in got) == list(range(len(rows)))
    again = sharding.external_shuffle(table.repartition(7), bucket_rows=100).collect()
    place = lambda found: Counter(map(tuple, found))
    assert place(got) == place(again)  # however the rows arrive


def test_query_moves_whole_documents(spark, sf_dir, monkeypatch):
    written = []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda rows, path, **options: (written.append(path), write(rows, path, **options)))
    got = queries.op3_external_shuffle(spark, sf_dir)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in docs.items()}
    assert {"text", "shard", "slot"} <= set(spark.read.parquet(written[0]).columns)
    assert sorted(r.slot * 16 + r.shard for r in rows) == list(range(len(rows)))


def test_files_hold_consecutive_slots(spark, tmp_path):
    rows = spark.range(9000).selectExpr("id as doc_id", "cast(id as string) as text").repartition(5)
    sharding.write_shards(rows, str(tmp_path / "out"), bucket_rows=100)
    slots: dict = {}
    for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("shard", "part", "slot", "_metadata.file_path as f").collect():
        slots.setdefault((r.shard, r.part, r.f), []).append(r.slot)
    assert len(slots) > 16 and len({k[:2] for k in slots}) == len(slots)
    assert all(max(x) - min(x) == len(x) - 1 for x in slots.values())
