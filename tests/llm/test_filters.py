"""Quality classifier, quality rules, language-model scores and URL lists."""

import datetime as dt
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspan.llm import bradley_terry, deleted_interpolation, quality_rules, queries, url_filters

from .conftest import prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_classifier_ranks_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_bradley_terry(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    for i, h in zip(got["doc_id"], got["held_out"]):
        assert h == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = got[got["held_out"]]
    good, bad = (held.loc[held["quality"] == q, "score"].to_numpy() for q in (1, 0))
    assert np.mean([(good > x).mean() for x in bad]) > 0.97
    assert (got["predicted"] == (got["score"] >= 0.3)).all() and got["score"].between(0, 1).all()


def test_classifier_edge_cases(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)] + [(104, 0), (105, 0), (None, 1), (1, None), (999, 1)], "doc_id bigint, quality int")
    got = bradley_terry.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    texts = {}
    for r in got:
        assert texts.setdefault(r.text or "", r.score) == r.score
    assert bradley_terry.classify(no_docs, labels).count() == 0
    even = bradley_terry.classify(docs, labels.filter("quality = 1"), keep=["doc_id"]).collect()
    assert {r.score for r in even} == {0.5} and even[0].asDict().keys() == {"doc_id", "score", "predicted"}


def brute_statistics(text):
    words = WORDS.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    doubled = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), doubled, len(covered)


def test_rules_match_brute_force(docs, no_docs, rows):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, doubled, repeated = brute_statistics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, doubled, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_rules_keep_clean_documents_of_the_corpus(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op9_perplexity_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    share = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.97 and share[0] < 0.6


def symbols(text):
    return [ord(" ") if c.isspace() else ord("0") if c.isdecimal() else ord(c.lower()[0]) for c in text]  # none beyond 16 bits here


def gist(text):
    words = lower(text).split()
    runs = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    return min((signed(xxhash.xxh64_intdigest(x.encode(), 43)) for x in runs), default=0)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_kneser_ney(texts):
    """A function from a 4-gram to its probability, learned from ``texts``."""
    grams = lambda t: list(zip(*([*[32] * 3, *symbols(t)][k:] for k in range(4))))
    counts = {4: Counter(g for t in texts for g in grams(t))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        cut[k] = [0.5, 1.0, 1.5]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
            cut[k] = d if all(0 < d[i - 1] < i for i in (1, 2, 3)) else cut[k]
    after = {k: {} for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            after[k].setdefault(g[:-1], {})[g] = v

    def plain(g):
        if not g:
            return 2.0**-16
        k, own = len(g), after[len(g)].get(g[:-1])
        if not own:
            return plain(g[1:])
        v = own.get(g, 0)
        held = sum(cut[k][min(x, 3) - 1] for x in own.values())
        return ((v - cut[k][min(v, 3) - 1] if v else 0) + held * plain(g[1:])) / sum(own.values())

    def p(g):
        """With one occurrence taken out of all counts."""
        gone = []
        for k in (4, 3, 2, 1):
            own = after[k].get(g[4 - k : 3], {})
            if g[4 - k :] not in own:
                break
            gone.append((own, g[4 - k :]))
            own[g[4 - k :]] -= 1
            if own[g[4 - k :]]:
                break
            del own[g[4 - k :]]
        found = plain(g)
        for own, x in gone:
            own[x] = own.get(x, 0) + 1
        return found

    return p, grams


def test_perplexities_and_bands_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, prose(i, 55 + i), ("en", "fr", None)[i % 3]) for i in range(36)] + [(40 + i, prose(9, 64), "en") for i in range(30)]
    rows += [(80, "Ein Wort 12 " * 40, "de"), (81, None, "en"), (82, "", "fr"), (83, "Слово и дело " * 3 + prose(7, 60), "ru"), (84, "zq#x " * 60 + prose(3, 50), "en"), (85, "".join(rng.choice("qxzvkyw#") + " " * (rng.random() < 0.3) for _ in range(400)), "fr")]
    table = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(table).collect()}
    joined = {r.doc_id: r for r in quality_rules.quality_rules(table, model_few=0).collect()}
    assert all((r.kept, r.log_perplexity) == (joined[i].kept, pytest.approx(joined[i].log_perplexity, abs=1e-6)) for i, r in got.items())
    perplexity = {}
    for lang in {r[2] for r in rows}:
        mine = [(i, t or "") for i, t, g in rows if g == lang]
        first: dict = {}
        for _, t in sorted(mine, key=lambda x: (-len(x[1].encode()), signed(xxhash.xxh64_intdigest(x[1].encode())))):
            first.setdefault(gist(t), t)
        p, grams = brute_kneser_ney(first.values())
        seen: dict = {}
        for i, t in mine:
            perplexity[i] = -sum(math.log10(p(g)) for g in grams(t)) / len(t) if t else 0.0
            assert got[i].log_perplexity == pytest.approx(perplexity[i], abs=2e-6)
            if not got[i].base_failed:
                seen.setdefault(gist(t), set()).add(round(got[i].log_perplexity * 10_000))
        hashed = lambda s: signed(xxhash.xxh64_intdigest(struct.pack("<q", s), 42))
        steps = sorted(min(s, key=hashed) for s in seen.values())
        if steps:
            a, b = (steps[math.ceil(q * len(steps)) - 1] / 10_000 for q in (0.25, 0.75))
            spread = max(2.5 * (b - a) + 0.00005, 0.025)
        for i, t in mine:
            assert got[i].kept == (not got[i].base_failed and a - spread <= got[i].log_perplexity <= b + spread), i
    assert got[83].kept  # a lone language stays
    assert sum(r.kept for r in got.values()) > 50


def test_verdicts_do_not_depend_on_partitions(spark):
    near = [prose(9, 80).split() for _ in range(12)]
    for k, words in enumerate(near):
        words[k + 20] = f"other{k}"
    rows = [(i, prose(i % 29, 55 + i), ("en", None)[i % 2]) for i in range(80)] + [(100 + k, " ".join(w), "en") for k, w in enumerate(near)]
    table = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    found = [{tuple(r) for r in quality_rules.quality_rules(table.repartition(n, "text")).collect()} for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


def test_probabilities_of_a_context_add_up(spark):
    text = [symbols(prose(1, 400))]
    grams = Counter(zip(*(text[0][k:] for k in range(4))))
    code = lambda g: sum(s << 16 * (3 - k) for k, s in enumerate(g))
    alphabet = sorted({s for g in grams for s in g})
    contexts = list({g[:3] for g in grams})[:5] + [(1, 2, 3)]
    asked = {(*h, s) for h in contexts for s in (*alphabet, 60_000)}
    table = spark.createDataFrame([(1, code(g), grams[g]) for g in {*grams, *asked}], "lang bigint, g bigint, c bigint")
    p = {r.g: r.p for r in quality_rules.kneser_ney(table).collect()}
    for h in contexts:  # all symbols that never occur have one probability
        assert sum(p[code((*h, s))] for s in alphabet) + (2**16 - len(alphabet)) * p[code((*h, 60_000))] == pytest.approx(1, abs=1e-9)


def test_language_model_matches_brute_force(docs, rows):
    got = sorted(deleted_interpolation.score(docs, block_tokens=5000, range_keys=3000).collect(), key=repr)
    part = lambda i: zlib.crc32(str(i).encode()) % 7 if i is not None else 0
    texts = [(i, [*WORDS.findall(lower(t)), None]) for i, t, _ in rows]
    count = Counter(w for i, t in texts if part(i) != 2 for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((i, part(i) == 2, len(t), sum(w in count for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in texts if i is not None)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got if r.doc_id is not None) == want
    assert len(got) == len(rows) and all(r.score < 0 for r in got)
    score = brute_mixture([(part(i), t) for i, t in texts])
    want = sorted((i, score(t)) for i, t in texts if i is not None)
    found = sorted((r.doc_id, r.score) for r in got if r.doc_id is not None)
    assert [i for i, _ in found] == [i for i, _ in want] and [s for _, s in found] == pytest.approx([s for _, s in want], rel=1e-9)


def brute_mixture(texts):
    """A function from tokens to their log10 probability: pairs, words and a floor, mixed by the digits of the context's count."""
    START = object()  # a context of its own, as frequent as the end
    events = lambda t: list(zip([START, *t[:-1]], t))

    def counted(parts):
        word, pair = Counter(), Counter()
        for k, t in texts:
            if k in parts:
                word.update(t)
                pair.update(events(t))
        return word, pair, sum(word.values())

    def estimates(word, pair, n, v, w):
        c = word[None] if v is START else word[v]
        return c.bit_length(), pair[v, w] / c if c else 0.0, word[w] / n if n else 0.0

    full, rest = counted({0, 1, 3, 4, 5, 6}), counted({0, 1, 4, 5, 6})
    floor = 1 / (len(full[0]) + 1)
    rounded = lambda x: 2.0 ** (-round(-4 * math.log2(x)) / 4) if x else 0.0
    seen: dict = {}
    for k, t in texts:
        if k == 3:
            for v, w in events(t):
                b, p2, p1 = estimates(*rest, v, w)
                seen.setdefault(b, []).append((rounded(p2), rounded(p1), floor))
    weights, last = {0: [0, 0.5, 0.5]}, None
    for b in range(64):
        if b in seen:
            a = weights.get(b, [1 / 3] * 3)
            for _ in range(deleted_interpolation.ROUNDS):
                total = [0.0] * 3
                for p in seen[b]:
                    whole = sum(x * y for x, y in zip(a, p))
                    total = [s + x * y / whole for s, x, y in zip(total, a, p)]
                a = [x / sum(total) for x in total]
            least = [1e-6 * (b > 0), 1e-6, 1e-6]
            weights[b] = [(x + y) / (1 + sum(least)) for x, y in zip(a, least)]
            last = weights[b] if b else last
        elif b:
            weights[b] = last or [1 / 3] * 3

    def score(t):
        out = 0.0
        for v, w in events(t):
            b, p2, p1 = estimates(*full, v, w)
            out += math.log10(sum(x * y for x, y in zip(weights[b], (p2, p1, floor))))
        return out

    return score


def test_pairwise_fit_matches_brute_force(spark):
    """Weights by Newton's method on the same pairs, threshold by trying all levels, against the operator's."""
    rng = random.Random(12)
    rows = [(i, prose(i, rng.randint(20, 120)) + " !! 12" * rng.randint(0, 9)) for i in range(80)]
    quality = {i: int(len(t.split("!!")) < 4 + i % 4) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(sorted(quality.items()), "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in bradley_terry.classify(docs, labels, keep=["doc_id"], learn=bradley_terry.learnable()).collect()}
    x = {i: np.array(bradley_terry.features(t.encode())) for i, t in rows}
    used = sorted((i for i in x if zlib.crc32(str(i).encode()) % 5), key=lambda i: signed(xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))
    good, bad = ([i for i in used if quality[i] == q] for q in (1, 0))
    d = np.array([x[w] - x[bad[(k * 8 + m) % len(bad)]] for k, w in enumerate(good) for m in range(8)])
    sign = np.array([2 * ((k + m) % 2) - 1 for k in range(len(good)) for m in range(8)])
    spread = (d * sign[:, None]).std(axis=0, ddof=1)
    w = np.zeros(d.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-d @ w))
        slope = d.T @ (p - 1) / len(d) + 1e-4 * spread**2 * w
        w -= np.linalg.pinv((d * (p * (1 - p))[:, None]).T @ d / len(d) + np.diag(1e-4 * spread**2)) @ slope
    strength = {i: float(v @ w) for i, v in x.items()}
    levels = np.quantile([strength[i] for i in used], np.linspace(0.005, 0.6, 120))
    balance = [np.mean([strength[i] >= t for i in good]) + np.mean([strength[i] < t for i in bad]) for t in levels]
    threshold = levels[int(np.argmax(balance))]
    want = {i: 1 / (1 + math.exp(-(s - threshold + math.log(0.3 / 0.7)))) for i, s in strength.items()}
    order = lambda m: np.argsort(np.argsort([m[i] for i in sorted(m)]))
    assert np.corrcoef(order(got), order(want))[0, 1] > 0.999
    assert np.mean([abs(got[i] - want[i]) for i in want]) < 0.02


def test_language_model_weights_and_probabilities():
    assert deleted_interpolation.learn_weights([], 10)[5] == pytest.approx([1 / 3] * 3)
    # 90 events that pairs explain well and 10 that only the floor explains
    cells = [((4 << 16) | (2 << 8) | 40, 90), (4 << 16, 10)]
    a = deleted_interpolation.learn_weights(cells, 1000)
    assert a[4].sum() == pytest.approx(1) and a[4][0] > 0.85 and 0.05 < a[4][2] < 0.15 and (a[9] == a[4]).all()
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (deleted_interpolation.unpacked_keys(deleted_interpolation.packed_keys(keys)) == keys).all()


def test_language_model_beats_its_base_and_adds_up(spark, small, no_docs):
    got = deleted_interpolation.score(small, block_tokens=20_000, range_keys=9_000).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b
    again = {r.doc_id: r.score for r in deleted_interpolation.score(small.repartition(5)).collect()}
    once = {r.doc_id: r.score for r in deleted_interpolation.score(small, block_tokens=20_000, range_keys=9_000).collect()}
    assert once == pytest.approx(again)
    # ranges by two levels, of teams of several blocks
    twice = {r.doc_id: r.score for r in deleted_interpolation.score(small, block_tokens=2_000, range_keys=5_000, fanout=3).collect()}
    assert twice == pytest.approx(once)
    assert deleted_interpolation.score(no_docs).count() == 0


DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
ENTRIES = [("example.com", "block", DAY(10)), ("example.com", "remove", DAY(40)), ("good.example.com", "allow", DAY(5)), ("Bad.org", "block", DAY(0)), ("bad.org", "allow", DAY(0)), ("x.bad.org", "remove", DAY(3)), (None, "block", DAY(1)), ("nul.com", "block", None), ("odd.com", "shrug", DAY(1))]


def judged(url, at):
    m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", (url or "").lower())
    labels = m[1].rstrip(".").split(".") if m else []
    for i in range(len(labels)):
        seen = [(t, ("remove", "allow", "block").index(a), a) for d, a, t in ENTRIES if d and t and at and d.lower() == ".".join(labels[i:]) and t <= at and a in ("remove", "allow", "block")]
        if seen and max(seen)[2] != "remove":
            return max(seen)[2]
    return "none"


def test_url_lists_match_brute_force(spark):
    urls = ["http://example.com/a", "https://good.example.com:80/", "http://u@a.b.bad.org/x?y", "http://x.bad.org", "ftp://EXAMPLE.COM./", "not a url", "", None, "http://odd.com", "http://nul.com"]
    captures = [(k, u, DAY(n), "x") for k, (u, n) in enumerate((u, n) for u in urls for n in (0, 4, 7, 10, 25, 40, 41, 300))] + [(900, urls[0], None, "x"), (901, urls[0], DAY(25), "x"), (901, urls[0], DAY(25), "x")]
    table = spark.createDataFrame(captures, "page_id int, url string, fetched_at timestamp, action string")
    entries = spark.createDataFrame(ENTRIES, "domain string, action string, listed_at timestamp")
    got = url_filters.temporal_join(table, entries).collect()
    assert len(got) == len(captures)
    for r in got:
        assert r.action == judged(r.url, r.fetched_at), r
        assert r.blocked == (r.action == "block")
    assert url_filters.temporal_join(table.limit(0), entries).count() == 0
    assert {r.action for r in url_filters.temporal_join(table, entries.limit(0)).collect()} == {"none"}
    spans = url_filters.validity_intervals(entries).filter("domain = 'example.com'").orderBy("valid_from").collect()
    assert [(r.action, r.valid_to) for r in spans] == [("block", DAY(40)), ("remove", None)]


def test_url_lists_match_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = con.sql(queries.OP7_SQL)
    got = queries.op7_temporal_lists(spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_intervals_are_cut_for_hot_hosts_only(spark, monkeypatch):
    start = 1_600_000_000
    captures = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("https://hot.example.com/")).otherwise(F.concat(F.lit("https://h"), F.col("id") % 2000, F.lit(".example.com/"))).alias("url"), F.timestamp_seconds(F.lit(start) + F.col("id")).alias("fetched_at"), "id")
    entries = spark.createDataFrame([("example.com", "block", dt.datetime(2020, 1, 1)), ("hot.example.com", "allow", dt.datetime(2020, 9, 13, 20))], "domain string, action string, listed_at timestamp")
    made = []
    whole = url_filters.bucketed
    monkeypatch.setattr(url_filters, "bucketed", lambda lines, hot: made.append((hot.count(), whole(lines, hot).count())) or whole(lines, hot))
    for rows in (captures, captures.withColumn("x", F.explode(F.array(*map(F.lit, range(4)))))):
        got = {(r.hot, r.action) for r in url_filters.temporal_join(rows, entries).select((F.col("host") == "hot.example.com").alias("hot"), "action").distinct().collect()}
        assert got == {(False, "block"), (True, "block"), (True, "allow")}
    (few, rows), (few4, rows4) = made
    assert few == few4 == 1
    assert 2001 <= rows <= 2001 + 6 and rows4 <= 2001 + 22
    monkeypatch.setattr(url_filters, "LEAST", 1)
    assert url_filters.hot_hosts(spark.range(1000).selectExpr("concat('h', id) host", "1000000 n", "0L first", "10L last")).count() < url_filters.HOT
