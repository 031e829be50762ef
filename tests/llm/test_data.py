"""Media columns, sharding, packing, pseudonyms, near-duplicates, sampled pieces and the pipeline."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import media, packing, pii, sentencepiece_sampling, sharding, simhash
from quillspan.llm.common import components


def test_media_round_trip(docs, no_docs, rows):
    stored = media.mux(docs)
    got = media.probe(stored, keep=["doc_id", "n_bytes"], read=True).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _ in rows:
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        want[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    for r in got:
        (t,) = r.tracks
        assert r.error is None and (t.number, t.handler, t.codec) == (1, "soun", "raw") and t.duration_s == r.payload_bytes / 19_200 and t.samples == r.payload_bytes // 192
        assert len(t.keyframes) == -(-t.samples // 25)
    assert media.probe(media.mux(no_docs), keep=["doc_id"]).count() == 0


def test_media_keyframe_ranges_point_at_samples():
    payload = bytes(random.Random(1).randbytes(192 * 61))
    m = media.mux_bytes(payload)
    (t,) = media.tracks(m)
    for k in t["keys"].tolist():
        assert m[t["offsets"][k] : t["offsets"][k] + t["sizes"][k]] == payload[192 * k : 192 * (k + 1)]
    assert t["keys"].tolist() == [0, 25, 50] and t["table_ticks"] == len(payload)


def test_media_other_layouts_and_damage(spark):
    payload = b"x" * 192 * 40
    m = media.mux_bytes(payload)
    # samples of different sizes in chunks out of file order, 64-bit offsets and box sizes, an unknown box
    def table(kind, *numbers, wide=False):
        return media.full(kind, struct.pack(">I", len(numbers[0]) if kind == b"co64" else numbers[0]), *(struct.pack(">Q" if wide else ">I", x) for x in (numbers[0] if kind == b"co64" else numbers[1:])))

    entry = media.box(b"avc1", bytes(78))
    head = media.box(b"ftyp", b"isom", bytes(4)) + struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"

    def build(at):
        stbl = media.box(b"stbl", table(b"stsd", 1), media.full(b"stts", struct.pack(">III", 1, 3, 10)), media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), media.full(b"stsz", struct.pack(">IIIII", 0, 3, 4, 2, 3)), table(b"co64", [at + 3, at], wide=True))
        stsd = media.full(b"stsd", struct.pack(">I", 1), entry)
        stbl = stbl.replace(table(b"stsd", 1), stsd)
        stbl = struct.pack(">I", len(stbl)) + stbl[4:]
        mdhd = media.full(b"mdhd", bytes(16), struct.pack(">IQ", 10, 30), bytes(4), version=1)
        return head + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))

    whole = build(len(build(0)) + 8) + struct.pack(">I4s", 0, b"mdat") + b"CCCAAAABB"
    (t,) = media.tracks(whole)
    assert media.sample_bytes(whole, t) == b"AAAABBCCC" and t["codec"] == "avc1" and t["keys"].tolist() == [0, 1, 2] and t["ticks"] == 30
    damaged = [None, b"", b"hello", m[:100], m[:-500], media.box(b"moof"), struct.pack(">I4s", 4, b"moov")]
    got = media.probe(spark.createDataFrame([(i, x) for i, x in enumerate(damaged)], "i int, media binary"), keep=["i"]).collect()
    assert all(r.error and r.tracks is None for r in got) and len(got) == len(damaged)


def test_sharding_is_a_shuffle(docs, no_docs, rows):
    for options in ({}, {"bucket_rows": 5}, {"bucket_bytes": 1000, "shards": 3}):
        got = sharding.external_shuffle(docs, **options).collect()
        shards = options.get("shards", 16)
        assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        sizes = [len(slots[k]) for k in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.external_shuffle(no_docs).count() == 0
    place = lambda seed: {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(docs.filter("doc_id < 60 and doc_id <> 7"), seed=seed, bucket_rows=9).collect()}
    assert place(1) == place(1) != place(2)


def test_sharding_is_uniform(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    got = sharding.external_shuffle(rows, bucket_rows=200).toPandas()
    half = got[got["doc_id"] < 2000].groupby("shard").size()
    assert half.between(80, 170).all()  # 125 expected
    order = got.sort_values(["slot", "shard"])["doc_id"].to_numpy()
    assert abs(np.corrcoef(order, np.arange(4000))[0, 1]) < 0.08


def test_shards_on_disk(spark, docs, tmp_path, rows):
    sharding.write_shards(docs, str(tmp_path / "out"), rows_per_file=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 16


def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_packing_holds_every_token_once(docs, no_docs, rows):
    got = packing.pack(docs.filter("doc_id <> 7"), group_pieces=20, with_ids=True)
    pieces = got.collect()
    of = {i: ids for (i, t, _), ids in zip(rows, tokens(t for _, t, _ in rows))}
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert set(by_doc) == {i for i, _, _ in rows if i not in (7, None)}
    for i, runs in by_doc.items():
        assert sum((r.ids for r in sorted(runs, key=lambda r: r.start)), []) == of[i] and {r.doc_tokens for r in runs} == {len(of[i])}
    for runs in by_sequence.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 2048
    whole = packing.sequences(got).collect()
    assert {len(r.input_ids) for r in whole} == {2048} and sum(r.n_tokens for r in whole) == sum(len(of[i]) for i in by_doc)
    assert packing.pack(docs).select("doc_id").filter("doc_id is null").count() == 2
    assert packing.pack(no_docs).count() == 0


def test_first_fit_decreasing_matches_a_scan():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 200):
        lengths = np.sort(rng.integers(1, 101, n))[::-1]
        where, offset = packing.first_fit_decreasing(lengths, 100)
        bins: list[int] = []
        for k, size in enumerate(lengths.tolist()):
            b = next((i for i, used in enumerate(bins) if used + size <= 100), len(bins))
            bins += [0] * (b == len(bins))
            assert (where[k], offset[k]) == (b, bins[b])
            bins[b] += size


def test_padding_is_small(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert got[0] / (2048 * got[1]) > 0.99


def test_tokens_equal_the_tokenizers(small):
    texts = [r.text for r in small.collect()] + ["don't it's 'S a's", "<|endoftext|> x <|STARTOFTEXT|>", "İstanbul ǅ ﬁ", "a1b2,.;x..y!!", "́ x ́", "x\x1cy\x85z", "ß ẞ Σς", "a" * 5000]
    got = packing.WordTokenizer(packing.default_tokenizer()).encode([t.encode() for t in texts])
    assert [[*np.frombuffer(g, "<u4").tolist(), 1] for g in got] == tokens(texts)


SAMPLES = {
    "email": ["hein.19@mail5.example.com", "a_b+c@x.org", "éa.1@mail2.example.com"],
    "ip": ["8.8.4.4", "192.168.0.17", "233.171.25.2"],
    "ymd": ["2021-03-04", "1999/12/31"],
    "dmy": ["31/12/1999", "12/31/1999", "05.06.2001"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (743) 555-3824", "(212) 555-0199", "310-555-4510"],
    "card": ["4465758382889437", "4111 1111 1111 1111", "378282246310005"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "secret": ['api_key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff'],
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_pseudonyms_keep_format(kind):
    for value in SAMPLES[kind]:
        new, found = pii.pseudonymise_text(f"x {value} y")
        new = new[2:-2]
        assert [f["kind"] for f in found] == [kind], value
        assert new != value and len(new) == len(value)
        again, found = pii.pseudonymise_text(f"z {new}.")
        assert [f["kind"] for f in found] == [kind], new  # still valid
        assert pii.pseudonymise_text(f"{value}, and")[0].startswith(new)  # linked
        assert pii.pseudonymise_text(value, b"another key")[0] != new


def test_invalid_numbers_stay():
    for text in ("9870157079875996", "4111111111111112", "999.1.1.1", "1.2.3.4.5", "2021-13-45", "000-12-3456", "DE00 3704 0044 0532 0130 00", "Version 2.0.", "5" * 16, "12345"):
        assert pii.pseudonymise_text(f"a {text} b") == (f"a {text} b", [])


def test_equal_cards_link_whatever_their_spacing():
    new = pii.pseudonymise_text("4111 1111 1111 1111 or 4111111111111111 or 4111-1111-1111-1111")[0].split(" or ")
    assert len({x.replace(" ", "").replace("-", "") for x in new}) == 1


def test_permutations_are_bijections():
    p = pii.Permuter(b"k")
    for n in (2, 3, 10, 999, 1000, 2500):
        assert sorted(p.integer("t", n, x) for x in range(n)) == list(range(n))
    even = lambda v: v % 2 == 0
    assert sorted(p.integer("t", 3000, x, even) for x in range(0, 3000, 2)) == list(range(0, 3000, 2))
    assert all(p.integer("s", 26, x) != x for x in range(26))


def test_pseudonyms_of_a_table(spark, docs, no_docs, rows):
    got = pii.pseudonymise(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows) and all(r.findings == [] for r in got)
    assert pii.pseudonymise(no_docs).count() == 0
    table = spark.createDataFrame([(1, "call +1 (743) 555-3824"), (2, "or +1 (743) 555-3824!"), (3, None)], "doc_id bigint, text string")
    a, b, c = pii.pseudonymise(table).orderBy("doc_id").collect()
    assert a.text[5:] == b.text[3:-1] != "+1 (743) 555-3824" and c.text is None
    assert [tuple(f) for f in a.findings] == [("phone", 5, 17)]


def brute_components(prints: dict) -> dict:
    names = sorted(set(prints.values()))
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(names, np.uint64)
    for i, x in enumerate(names):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 2):
            root[find(names[i + 1 + j])] = find(x)
    low: dict = {}
    for i, x in prints.items():
        low[find(x)] = min(low.get(find(x), i), i)
    return {i: low[find(x)] for i, x in prints.items()}


@pytest.mark.parametrize("bucket,refine", [(64, 1), (3, 1), (3, 3), (2, 0)])
def test_links_are_exact(spark, bucket, refine):
    rng = random.Random(9)
    prints: dict[int, int] = {}
    for c in range(12):  # chains and clouds around a few centres, zero among them
        x = rng.getrandbits(64) if c else 0
        for k in range(25):
            if c % 2:
                x ^= 1 << rng.randrange(64)
                prints[len(prints)] = x
            else:
                prints[len(prints)] = x ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))})
    want = brute_components(prints)
    distinct = spark.createDataFrame([(simhash._signed(x),) for x in set(prints.values())], "fp bigint")
    edges = simhash.links(distinct, bucket=bucket, refine=refine)
    found = {r.node: r.component for r in components(edges).collect()}
    mine = {i: found.get(simhash._signed(x), simhash._signed(x)) for i, x in prints.items()}
    groups = lambda m: {frozenset(i for i in m if m[i] == v) for v in m.values()}
    assert groups(mine) == groups(want)


def test_components_of_a_long_chain(spark):
    chain = list(range(1, 400))
    random.Random(2).shuffle(chain)
    edges = [(a, b) for a, b in zip(chain, chain[1:])] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[x] for x in chain} == {1} and got[1001] == got[1000] == 1000 and 5000 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_of_texts(docs, no_docs, small, rows):
    import re

    import xxhash

    got = simhash.near_duplicates(small).collect()
    texts = {r.doc_id: r.text for r in small.collect()}
    prints = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == prints
    assert {r.doc_id: r.component for r in got} == brute_components(prints)
    edge = simhash.near_duplicates(docs).collect()
    assert len(edge) == len(rows)
    assert {r.component for r in edge if r.fp == 0} == {100}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_hot_groups_make_few_links(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    cloud = {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}  # two thousand fingerprints within two bits of one
    edges = simhash.links(spark.createDataFrame([(simhash._signed(x),) for x in cloud], "fp bigint"))
    assert edges.count() < (65 + 6 * 7 * simhash.BUCKET // 2) * len(cloud)  # linear: names, and pairs of six small keys and their refinements
    assert components(edges).select("component").distinct().count() == 1


def test_sampled_pieces_are_lossless(docs, no_docs, rows):
    got = sentencepiece_sampling.encode(docs, check=True)
    back = sentencepiece_sampling.decode_column(got).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t, _ in rows)
    found = got.collect()
    assert all(r.lossless for r in found)
    same = defaultdict(set)
    for r in found:
        same[r.doc_id, r.doc_id is None and r.n_pieces].add(r.ids_crc32)
    assert {len(x) for x in same.values()} == {1}
    other = {r.doc_id: r.ids_crc32 for r in sentencepiece_sampling.encode(docs.repartition(7)).collect()}
    assert all(other[r.doc_id] == r.ids_crc32 for r in found if r.doc_id is not None)  # in any partitioning
    assert any(other[r.doc_id] != r.ids_crc32 for r in sentencepiece_sampling.encode(docs, seed=5).collect() if r.doc_id is not None)
    assert sentencepiece_sampling.encode(no_docs).count() == 0


def test_samples_follow_the_lattice():
    import sentencepiece

    lat = sentencepiece_sampling.lattice(sentencepiece_sampling.default_model())
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sampling.default_model())
    ids = {sp.id_to_piece(i): i for i in range(259, sp.get_piece_size())}

    def paths(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in ids:
                yield from ((ids[s[:k]], *rest) for rest in paths(s[k:]))

    for word in ("there", "reste"):
        weight = {p: float(np.prod([lat.weight[i] for i in p])) for p in paths(sentencepiece_sampling.MARK + word)}
        n = 8000
        got = Counter(tuple(x.tolist()) for x in sentencepiece_sampling.sample_batch(lat, [word.encode()] * n, np.arange(n, dtype=np.uint64)))
        assert set(got) <= set(weight)
        for p, w in weight.items():
            assert got[p] / n == pytest.approx(w / sum(weight.values()), abs=0.025)


def test_pipeline_stages_take_effect(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        docs = docs.persist()
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0.6 * sizes[0]
    # brute force over what is left
    from .test_filters import brute_statistics

    left = docs.collect()
    assert len({r.text for r in left}) == len(left)
    assert all(brute_statistics(r.text)[0] >= 50 for r in left)
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in left:
        new, found = pii.pseudonymise_text(before[r.doc_id])
        assert r.text == new and len(r.text) == r.n_chars
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    by = defaultdict(int)
    for r in last:
        by[r.doc_id] += r.length
    assert by == {r.doc_id: len(t) for r, t in zip(left, tokens(r.text for r in left))}
