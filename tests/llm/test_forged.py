import struct
from collections import Counter

import pytest

from quillspan.llm import media, sharding


def patched(kind: bytes, skip: int, value: int, form: str = ">I") -> bytes:
    m = bytearray(media.mux_bytes(b"x" * 192 * 27))
    struct.pack_into(form, m, m.index(kind) + 4 + skip, value)
    return bytes(m)


@pytest.mark.parametrize(
    "forged",
    [
        patched(b"stts", 8, 1),  # fewer samples than there are
        patched(b"stts", 12, 100),  # other durations than the header's
        patched(b"stss", 8, 0),
        patched(b"stss", 12, 28),  # beyond the last sample
        patched(b"stss", 8, 27),  # not ascending
        patched(b"mdhd", 16, 7),
    ],
)
def test_tables_that_disagree_are_errors(forged):
    assert media.tracks(media.mux_bytes(b"x" * 192 * 27))[0]["keys"].tolist() == [0, 25]
    with pytest.raises(ValueError, match="disagree"):
        media.tracks(forged)


@pytest.mark.parametrize("offset", [2**63 - 1, 2**63, 2**64 - 1, 1 << 40])
def test_wide_offsets_do_not_wrap(offset):
    m = media.mux_bytes(b"x" * 192 * 3)
    at = m.index(b"stco")
    body = struct.pack(">IIQ", 0, 1, offset)
    wide = m[: at - 4] + struct.pack(">I4s", len(body) + 8, b"co64") + body
    data = memoryview(wide + b"x" * 576)
    found = {}
    for path, a, b in media.boxes(memoryview(m), 0, len(m)):
        if path[:2] == (b"moov", b"trak") and len(path) > 2 and path[-1] != b"stco":
            found.setdefault(path[-1], (a, b))
    found[b"co64"] = (at + 4, at + 4 + len(body))
    with pytest.raises(ValueError, match="beyond the end"):
        media._track(data, found)


def test_columns_named_part(spark, tmp_path):
    rows = [(i, f"text {i}", i % 3, "x", -i) for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, part int, part_ string, slot int")
    got = sharding.external_shuffle(table, bucket_rows=50)
    assert set(got.columns) == {"doc_id", "text", "part", "part_", "shard", "slot"}
    assert Counter((r.doc_id, r.text, r.part, r.part_) for r in got.collect()) == Counter(r[:4] for r in rows)
    sharding.write_shards(table, str(tmp_path / "out"), bucket_rows=50)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.part, r.part_) for r in back.collect()) == Counter(r[:4] for r in rows)
    assert sorted(r.slot * 16 + r.shard for r in back.collect()) == list(range(500))
