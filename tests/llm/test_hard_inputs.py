"""Inputs that are rare in the tables: several tracks, other digits, text without spaces, clashing columns, dense fingerprints."""

import random
import struct
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import bradley_terry, common, media, pii, sentencepiece_sampling, sharding, simhash, url_filters

from .conftest import prose


def one_track(number, handler, codec, sizes, at, keys=None):
    """A track whose samples lie one after another from ``at``, one in a chunk."""
    n = len(sizes)
    starts = [at + sum(sizes[:k]) for k in range(n)]
    table = lambda kind, *numbers: media.full(kind, struct.pack(f">{len(numbers)}I", *numbers))
    stbl = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(codec, bytes(28))),
        table(b"stts", 1, n, 10),
        table(b"stsc", 1, 1, 1, 1),
        table(b"stsz", 0, n, *sizes),
        table(b"stco", n, *starts),
        *([table(b"stss", len(keys), *keys)] if keys else []),
    )
    mdhd = media.full(b"mdhd", bytes(8), struct.pack(">II", 10, 10 * n), bytes(4))
    hdlr = media.full(b"hdlr", bytes(4), handler, bytes(12))
    tkhd = media.full(b"tkhd", bytes(8), struct.pack(">I", number), bytes(68))
    return media.box(b"trak", tkhd, media.box(b"mdia", mdhd, hdlr, media.box(b"minf", stbl)))


def test_tracks_keep_their_own_tables(spark):
    """Audio first, video second, as in most files; only the video has sync samples."""

    def build(at):
        return media.box(b"ftyp", b"isom", bytes(4)) + media.box(b"moov", one_track(1, b"soun", b"mp4a", [3, 3, 3], at), one_track(2, b"vide", b"avc1", [5, 2, 2, 5], at + 9, keys=[1, 4]))

    whole = build(len(build(0)) + 8) + media.box(b"mdat", b"aaabbbccc" + b"KKKKKppqqLLLLL")
    (r,) = media.probe(spark.createDataFrame([(1, whole)], "i int, media binary"), keep=["i"], read=True).collect()
    audio, video = r.tracks
    assert (audio.number, audio.handler, audio.codec, audio.samples, len(audio.keyframes)) == (1, "soun", "mp4a", 3, 3)
    assert (video.number, video.handler, video.codec, video.duration_s) == (2, "vide", "avc1", 4.0)
    assert [whole[k.offset : k.offset + k.size] for k in video.keyframes] == [b"KKKKK", b"LLLLL"] and r.payload_bytes == 9
    assert [media.sample_bytes(whole, t) for t in media.tracks(whole)] == [b"aaabbbccc", b"KKKKKppqqLLLLL"]


def test_forged_counts_are_refused_before_memory_is_taken(spark):
    m = media.mux_bytes(b"x" * 192 * 40)
    places = {k: m.index(k) for k in (b"stsz", b"stsc", b"stco", b"stss", b"stts", b"mdhd", b"stsd")}
    forged = []
    for kind, skip in ((b"stsz", 12), (b"stsc", 8), (b"stsc", 12), (b"stsc", 16), (b"stco", 8), (b"stco", 12), (b"stss", 8), (b"stts", 8)):
        at = places[kind] + skip
        forged.append(m[:at] + b"\xff\xff\xff\xf0" + m[at + 4 :])
    forged += [m.replace(k, b"free") for k in places if k != b"stss"]
    start = time.time()
    got = media.probe(spark.createDataFrame(list(enumerate(forged)), "i int, media binary"), keep=["i"]).collect()
    assert all(r.error and r.tracks is None for r in got) and len(got) == len(forged) and time.time() - start < 60


def test_dates_link_whichever_part_comes_first():
    new = lambda t: pii.pseudonymise_text(t)[0]
    for day, month, year in ((31, 12, 1999), (13, 1, 2004), (28, 2, 1970), (20, 10, 2021)):
        y, m, d = new(f"{year}-{month:02d}-{day:02d}").split("-")
        assert new(f"{day:02d}/{month:02d}/{year}") == f"{d}/{m}/{y}"
        assert new(f"{month:02d}/{day:02d}/{year}") == f"{m}/{d}/{y}" and int(d) > 12


def test_addresses_of_six_bytes_keep_their_form():
    new, found = pii.pseudonymise_text("from 2001:db8::8a2e:370:7334 to")
    assert [f["kind"] for f in found] == ["ip"] and new.startswith("from 2001:") and len(new) == 31 and pii.pseudonymise_text(new)[1] == found
    full = pii.pseudonymise_text("2001:0DB8:0000:0000:0000:8A2E:0370:7334")[0].lower()
    assert [g.lstrip("0") for g in full.split(":") if g.strip("0")] == [g for g in new[5:-3].split(":") if g]
    for text in ("::1", "fe80::1", "at 12:30:45", "std::move a::b", "1:2:3:4:5:6:7:8:9", "ff02::1"):
        assert pii.pseudonymise_text(text) == (text, [])


def test_secrets_without_digits():
    new, found = pii.pseudonymise_text("token: correctHorseBatteryStaple, secret: internationalisation")
    assert [f["kind"] for f in found] == ["secret"] and new.endswith("secret: internationalisation") and "Horse" not in new


def test_digits_of_other_scripts_do_no_harm(spark):
    rng = random.Random(6)
    digits = ["0123456789", "٠١٢٣٤٥٦٧٨٩", "०१२३४५६७८९", "０１２３４５６７８９", "²³¹⁴⁵⁶⁷⁸⁹⁰"]
    shapes = ["+966 55 123 4567", "123-45-6789", "1234567890123", "2021-03-04", "8.8.4.4", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "token=abcdef1234567890", "2001:db8::1", "a1@b.com"]
    texts = []
    for shape in shapes:
        for script in digits:
            texts.append("".join(script[int(c)] if c in "0123456789" else c for c in shape))
            texts.append("".join(rng.choice(digits)[int(c)] if c in "0123456789" and rng.random() < 0.5 else c for c in shape))
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert all(len(r.text) == len(texts[r.doc_id]) for r in got) and len(got) == len(texts)
    whole = {r.doc_id: r.text for r in got}
    assert all(whole[i] == t for i, t in enumerate(texts) if not any(c.isascii() and (c.isdigit() or c == "@") for c in t))


def test_long_words_are_sampled_like_short_ones(monkeypatch):
    lat = sentencepiece_sampling.lattice(sentencepiece_sampling.default_model())
    rng = random.Random(1)
    base = "".join(rng.choice(["th", "er", "日本", "語の", "é", "🎉", "st", "▁", "ing"]) for _ in range(200))
    words = [(base * 2)[:k].encode() for k in (5, 40, 200)]
    keys = np.arange(5, 8, dtype=np.uint64)
    short = sentencepiece_sampling.sample_batch(lat, words, keys)
    monkeypatch.setattr(sentencepiece_sampling, "LONG_BYTES", 8)
    monkeypatch.setattr(sentencepiece_sampling, "WINDOW", 32)
    long = sentencepiece_sampling.sample_batch(lat, words, keys)
    assert [x.tolist() for x in short] == [x.tolist() for x in long]


def test_a_million_characters_without_spaces():
    lat = sentencepiece_sampling.lattice(sentencepiece_sampling.default_model())
    rng = random.Random(2)
    text = "".join(rng.choices("的一是不了人我在有他这为之大来以个中上们日本語の", k=1_000_000)).encode()
    start = time.time()
    (ids,) = sentencepiece_sampling.sample_batch(lat, [text], np.array([3], np.uint64))
    assert sentencepiece_sampling.decode(lat, ids.tolist()) == text and time.time() - start < 60


def test_shuffle_matches_a_plain_one(spark):
    rows = spark.createDataFrame([(i % 7, f"text {i}") for i in range(600)], "doc_id bigint, text string").repartition(3)
    buckets = 6
    by: dict = defaultdict(list)
    for r in sharding.scatter(rows, buckets).collect():
        by[r.b].append((r["item"].h, r["item"].row.doc_id, r["item"].row.text))
    want, at = {}, 0
    for b in sorted(by):
        done: list = []
        for i, row in enumerate(sorted(by[b])):
            h = 42
            for x, form in ((sharding.SEED, "<i"), (b, "<q"), (i, "<i")):
                h = xxhash.xxh64_intdigest(struct.pack(form, x), h)
            j = (h - (1 << 64) if h >> 63 else h) % (i + 1)
            done.append(row)
            done[i], done[j] = done[j], done[i]
        for row in done:
            want[row[2]] = (at % 16, at // 16)
            at += 1
    for partitions in (2, 9):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = {r.text: (r.shard, r.slot) for r in sharding.external_shuffle(rows, bucket_rows=100).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == want


def test_dense_fingerprints_are_linked_in_linear_work(spark):
    """Twenty thousand fingerprints in sixteen bits, each with tens of partners, and some far from all."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    cloud = sorted({centre ^ sum(1 << 3 * k for k in range(16) if m >> k & 1) for m in rng.sample(range(1 << 16), 20_000)})
    far = [rng.getrandbits(64) for _ in range(50)]
    edges = common.written(simhash.links(spark.createDataFrame([(simhash._signed(x),) for x in cloud + far], "fp bigint")), "edges")
    assert edges.count() < (65 + 36 * simhash.BUCKET // 2) * len(cloud)
    found = {r.node: r.component for r in common.components(edges).collect()}
    mine = {found.get(simhash._signed(x), simhash._signed(x)) for x in cloud}
    assert len(mine) == 1 and not any(simhash._signed(x) in found for x in far)


def test_a_listed_top_level_domain(spark):
    """Every host is below one listed domain of one label; a more specific entry still wins."""
    captures = spark.createDataFrame([(i, f"http://h{i}.example{i % 50}.com/") for i in range(500)], "page_id int, url string").withColumn("fetched_at", F.lit("2024-06-01").cast("timestamp"))
    entries = spark.createDataFrame([("com", "block", "2024-01-01"), ("example3.com", "allow", "2024-02-01")], "domain string, action string, listed_at string")
    got = url_filters.temporal_join(captures, entries).collect()
    assert Counter(r.action for r in got) == {"block": 490, "allow": 10} and all(r.matched_domain == ("example3.com" if r.page_id % 50 == 3 else "com") for r in got)


CLASHING = "doc_id bigint, text string, lang string, slot string, features string, __nth string, kept string, n_words string, score string, findings string, predicted string, node string, at string, n string, keys string, base_failed string, aside_0 string, block string"


def test_stages_carry_any_columns(spark):
    texts = [prose(i, 70 + i) for i in range(40)]
    rows = [(i, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(texts)] + [(1, prose(900, 80), "en"), (None, prose(901, 90), "en"), (None, None, None), (50, "", "en"), (51, texts[3], "en"), (None, texts[3], "en"), (52, "call (212) 555-0199 " + prose(902, 60), "en")]
    table = spark.createDataFrame([(*r, *[f"c{k}" for k in range(15)]) for r in rows], CLASHING)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        # labels are read from the tables; ids that aren't there do no harm
        got = stage(spark, table, "/root/testdata/sf0.001")
        assert got.schema == table.schema, name
        found = got.collect()
        assert all(tuple(r)[3:] == tuple(f"c{k}" for k in range(15)) for r in found) and found, name
        if name == "near_duplicates":
            kept = Counter(r.text or "" for r in found)
            assert set(kept) == {t or "" for _, t, _ in rows} and set(kept.values()) == {1}
            assert {r.doc_id for r in found if r.text == texts[3]} == {3} and sum(r.doc_id == 1 for r in found) == 2
        if name == "pseudonyms":
            assert len(found) == len(rows) and sum(r.text is None for r in found) == 1
        assert stage(spark, table.limit(0), "/root/testdata/sf0.001").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, table, "")
    assert packed.select("doc_id", "start").count() >= len(rows) and corpus_pipeline.STAGES[-1][1](spark, table.limit(0), "").count() == 0


def test_a_column_called_features_is_kept(spark):
    docs = spark.createDataFrame([(1, "a b", "mine")], "doc_id bigint, text string, features string")
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert bradley_terry.classify(docs, labels).first().features == "mine"


def test_the_shared_folder_needs_no_setting_of_ours(monkeypatch):
    class Context:
        master, folder = "local[2]", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path

    class Session:
        sparkContext = Context()
        conf = {}

    assert common.shared_dir(Session()) == Session.sparkContext.folder == common.shared_dir(Session())
    Session.sparkContext = Context()
    Context.master = "spark://host:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "file:///shared/"}
    assert common.shared_dir(Session()) == "file:///shared"
