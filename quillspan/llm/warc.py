"""Deterministic sharded WARC writer, and a reader for what it wrote.

Rows are sorted by key over ranges that hold about equally many rows, one task each. A task appends records, one gzip member
each, and begins another file when the compressed size would pass ``file_bytes``. Headers, digests and record ids are made anew from
the rows, and nothing depends on clocks, attempts or the number of executors: the same rows give the same files. A file is written
under a temporary name, which carries the attempt, and renamed when complete; a second attempt renames the same bytes over it.
The list of files is written last and committed by one rename; readers open only what it lists.

Of records with equal payloads (SHA-1 and length) of ``least`` bytes or more the one with the largest key is a response, others
revisit it. That is decided on keys and digests alone; payloads are compressed first, so they pass one shuffle, compressed.

Defined cases: a null payload is empty; a null key is the smallest; rows with equal keys and payloads count as one response (that
with the largest URL) and revisits of it; equal rows below ``least`` are responses with one record id; a null URL is ``about:blank``, control characters and spaces in
a URL are percent-encoded; an empty table gives an empty list of files; no columns but the three named are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, slices

#: A range holds about so many bytes of payload; a small table has LEAST_RANGES (of a megabyte or more), none has over MOST_RANGES.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 256 << 20, 32, 20_000
#: Ranges are cut by so many keys for each of them, those of least hash.
SAMPLE = 50
FILE_BYTES = 256 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20
MANIFEST = "name string, part int, seq int, records bigint, bytes bigint, sha1 string"
RECORDS = "key string, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to string, valid boolean"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(key: int | None, digest: bytes, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr((key, digest.hex(), nth)).encode()).digest(), version=4)}>"


def _uri(url: bytes | None) -> str:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url).decode() if url else "about:blank"


def _member(headers: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def _http(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


def _response(key: int | None, url: bytes | None, payload: bytes, digest: bytes, level: int) -> bytes:
    block = _http(len(payload)) + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", _record_id(key, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("X-Row-Key", key), ("Content-Type", "application/http;msgtype=response")]
    return _member(headers, block, level)


def _revisit(key: int | None, url: bytes | None, n_bytes: int, digest: bytes, nth: int, to: int | None, to_url: bytes | None, level: int) -> bytes:
    block = _http(n_bytes)
    headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", _record_id(key, digest, nth)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(to, digest)), ("WARC-Refers-To-Target-URI", _uri(to_url)), ("WARC-Refers-To-Date", DATE), ("X-Row-Key", key), ("X-Refers-To-Key", to), ("Content-Type", "application/http;msgtype=response")]
    return _member(headers, block, level)


def _range_of(bounds: np.ndarray, keys: list[int | None], digests: list[bytes]) -> list[int]:
    """The range of each key; a key that fills several ranges is dealt to them by digest."""
    low, high = (np.searchsorted(bounds, [-(2**63) if k is None else k for k in keys], side=s) for s in ("left", "right"))
    return [int(a) if a == b else int(a) + int.from_bytes(d[:4]) % (b - a + 1) for a, b, d in zip(low.tolist(), high.tolist(), digests, strict=True)]


class _Shard:
    """Files of one range: written under temporary names, renamed when complete."""

    def __init__(self, path: str, part: int, attempt: int, file_bytes: int):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(path)
        self.part, self.attempt, self.most, self.seq, self.out = part, attempt, file_bytes, 0, None

    def append(self, member: bytes, level: int) -> Iterator[dict]:
        if self.out is not None and self.size + len(member) > self.most:
            yield self.close()
        if self.out is None:
            self.name = f"part-{self.part:05d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.base}/_temporary/{self.name}.{self.attempt}"
            self.out, self.size, self.records, self.sha1 = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha1()
            block = f"software: quillspan\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
            self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, self.name.encode())), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], block, level))
        self._put(member)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temporary, f"{self.base}/{self.name}")
        done = {"name": self.name, "part": self.part, "seq": self.seq, "records": self.records, "bytes": self.size, "sha1": self.sha1.hexdigest()}
        self.out, self.seq = None, self.seq + 1
        return done


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def write(docs: DataFrame, path: str, *, key: str, url: str, payload: str, least: int = 0, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write an archive of ``docs`` below ``path``; the list of its files (name, part, seq, records, bytes, sha1).

    ``key`` is an integer column. ``path`` is seen by all executors under the same URI.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("text"))
    narrow = rows.select("k", "url", F.unhex(F.sha1(F.col("text").cast("binary"))).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"))

    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(-(-total // range_bytes), min(LEAST_RANGES, total >> 20), 1))
    bounds = np.zeros(0, np.int64)
    if ranges > 1:
        # a sample that depends on the rows alone
        drawn = narrow.select("k", F.xxhash64("k", "url", "digest").alias("h")).orderBy("h", "k").limit(SAMPLE * ranges).select(F.coalesce("k", F.lit(-(2**63))).alias("k"))
        keys = np.sort(drawn.toArrow().column(0).to_numpy())
        bounds = keys[[len(keys) * i // ranges for i in range(1, ranges)]]

    kind = "part int, k bigint, digest binary, kind int, url string, n_bytes bigint, to bigint, to_url string, member binary"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                keys, urls, texts = some.column(0).to_pylist(), some.column(1).to_pylist(), as_bytes(some.column(2))
                digests = [hashlib.sha1(t).digest() for t in texts]
                members = [_response(k, u and u.encode(), t, d, level) for k, u, t, d in zip(keys, urls, texts, digests, strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_range_of(bounds, keys, digests), pa.int32()), pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array([1] * n, pa.int32()), pa.array(urls, pa.string()), pa.array(map(len, texts), pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(members, pa.binary())],
                    names=["part", "k", "digest", "kind", "url", "n_bytes", "to", "to_url", "member"],
                )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, d = batch.column(0), batch.column(1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(_range_of(bounds, k.to_pylist(), d.to_pylist()), pa.int32()), k, d, pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), batch.column(2), batch.column(3), pa.nulls(n, pa.binary())],
                names=["part", "k", "digest", "kind", "url", "n_bytes", "to", "to_url", "member"],
            )

    # who revisits whom, on keys and digests alone
    best = narrow.filter(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(F.max(F.struct("k", "url")).alias("top"), F.count("*").alias("copies")).filter("copies > 1")
    revisits = narrow.select("k", "digest", "n_bytes").join(best, ["digest", "n_bytes"]).filter(~F.col("k").eqNullSafe(F.col("top.k")))
    revisits = revisits.select("k", "digest", F.col("top.k").alias("to"), F.col("top.url").alias("to_url"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        shard, now, to, to_url, nth, first_url = None, None, None, None, 0, None
        for batch in batches:
            done = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part, k, digest, is_record, link, n_bytes, goes_to, goes_to_url, member = r
                if shard is None or shard.part != part:
                    if shard is not None and shard.out is not None:
                        done.append(shard.close())
                    shard, now = _Shard(path, part, attempt, file_bytes), None
                if (k, digest) != now:
                    now, nth, revisiting = (k, digest), 0, not is_record
                if not is_record:
                    to, to_url = goes_to, goes_to_url
                    continue
                if revisiting or nth and n_bytes >= least:
                    target = (to, to_url) if revisiting else (k, first_url)
                    member = _revisit(k, link and link.encode(), n_bytes, digest, nth + 1, target[0], target[1] and target[1].encode(), level)
                elif not nth:
                    first_url = link
                nth += 1
                done += shard.append(member, level)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=listed)
        if shard is not None and shard.out is not None:
            yield pa.RecordBatch.from_pylist([shard.close()], schema=listed)

    listed = pa.schema([("name", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
    fs, where = _hadoop(spark, path)
    fs.mkdirs(_hadoop(spark, f"{path}/_temporary")[1])
    everything = rows.mapInArrow(records, kind).unionByName(revisits.mapInArrow(placed, kind))
    dealt = everything.repartitionById(int(ranges), F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("k"), "digest", "kind", F.desc_nulls_last("url"))
    dealt.mapInArrow(files, MANIFEST).write.parquet(f"{path}/_manifest")
    fs.rename(_hadoop(spark, f"{path}/_manifest")[1], _hadoop(spark, f"{path}/manifest")[1])
    fs.delete(_hadoop(spark, f"{path}/_temporary")[1], True)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    data = stream.read(READ_BYTES)
    while data:
        unpacker, out = zlib.decompressobj(31), []
        while True:
            out.append(unpacker.decompress(data))
            if unpacker.eof:
                data = unpacker.unused_data or stream.read(READ_BYTES)
                break
            data = stream.read(READ_BYTES)
            if not data:
                raise ValueError("a gzip member ends early")
        yield b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and the block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(headers["content-length"])
    if not lines[0].startswith("WARC/") or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, rest[:size]


def read(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """The records of an archive: key, record_type, url, payload_bytes, payload_digest, refers_to (a key), valid and, if
    asked for, payload. Digests and lengths of responses are those of the bytes read; ``valid`` says that the headers agree."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    schema = RECORDS + (", payload binary" if payloads else "")
    names = ["key", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "valid", *(["payload"] if payloads else [])]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        store, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        h, block = parse(record)
                        if h["warc-type"] == "warcinfo":
                            continue
                        seen += 1
                        http, _, body = block.partition(b"\r\n\r\n")
                        n_bytes = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        valid = h["warc-block-digest"] == f"sha1:{_digest(block)}"
                        if h["warc-type"] == "response":
                            valid &= n_bytes == len(body) and digest == _digest(body)
                            n_bytes, digest = len(body), _digest(body)
                        rows.append((h.get("x-row-key"), h["warc-type"], h["warc-target-uri"], n_bytes, digest, h.get("x-refers-to-key"), valid, body)[: len(names)])
                        size += len(body) if payloads else 100
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{name} holds {seen} records instead of {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    files = manifest.count()
    return manifest.select("name", "records", "part", "seq").repartitionByRange(max(1, min(files, MOST_RANGES)), "part", "seq").mapInArrow(run, schema)
