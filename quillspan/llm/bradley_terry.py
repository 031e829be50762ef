"""Quality classifier: Bradley-Terry strengths learned from preference pairs.

A labelled row of quality 1 is preferred to one of quality 0. Each preferred row meets ``PARTNERS`` others, dealt out in
turn, and the weights minimise the logistic loss of the pairs' feature differences (a logistic regression without
intercept). A document's strength is the weighted sum of its features, and the quantile of the labelled rows' strengths
that parts the labels best is the threshold; the score is a logistic curve through it, so 0.3 or more means accepted.

Features are statistics of the whole text alone. The fit uses every labelled row: they are numbered in the order of a hash of
their id, within ranges of it. The quantiles are exact: the driver gets counts of ``BINS`` steps of strength and the values at their ranks.

Defined cases: a null text is an empty one and gets a score; labels without a document, with a null quality or id are
left out; with labels of one kind only (or none) all weights are 0 and every score is 0.5; equal rows are scored each; columns
named like the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, with_columns, written
from .quality_rules import statistics

PARTNERS = 8
#: Labelled rows that are numbered together, about, and steps of strength in which they are counted.
RANGE, BINS = 8_192, 4_096
#: Quantiles that may be the threshold.
SHARES = np.linspace(0.005, 0.6, 120)
CUT = 0.3
#: Holds a row's features until it is scored.
FEATURES = "__features"
NAMES = ("log_words", "word_length", "long_words", "upper", "digits", "symbols", "bars", "shouts", "stops", "commas", "lines", "duplicate_lines", "repeated", "distinct", "non_ascii", "no_stop", "short", "brief")
UPPER, DIGITS, SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&<>@_~^=+\\/{}[]"


def _count(text: bytes, what: bytes) -> int:
    return len(text) - len(text.translate(None, what))


def features(text: bytes) -> list[float]:
    """Values of ``NAMES``: rates are square roots, so that rare marks weigh too, and all lie in about 0 to 3."""
    n, letters, _, doubled, repeated = statistics(text)
    w = max(n, 1)
    distinct = len(set(text.split())) / w
    size = max(len(text), 1)
    rate = lambda x, of: math.sqrt(min(x / of, 1.0))
    stops = _count(text, b".?")
    return [
        math.log10(1 + n),
        min(letters / w, 20) / 10,
        rate(max(letters / w - 8, 0), 12),
        rate(_count(text, UPPER), size),
        rate(_count(text, DIGITS), size),
        rate(_count(text, SYMBOLS), size),
        rate(text.count(b"|"), w),
        rate(text.count(b"!"), w),
        rate(stops, w),
        rate(text.count(b","), w),
        rate(text.count(b"\n"), w),
        rate(doubled, text.count(b"\n") + 1),
        rate(repeated, w),
        distinct,
        rate(sum(text.count(b) for b in (b"\xc3", b"\xc2")) if not text.isascii() else 0, size),
        float(stops == 0),
        float(n < 10),
        float(n < 50),
    ]


def with_features(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    work = lambda columns, texts: {FEATURES: pa.array([features(t) for t in texts], pa.list_(pa.float64()))}
    return with_columns(docs, work, f"{FEATURES} array<double>", text_col=text_col, keep=keep)


@dataclass(frozen=True)
class Model:
    weights: list[float]
    threshold: float

    def score(self, column: str = FEATURES) -> Column:
        strength = F.aggregate(F.zip_with(F.col(column), F.array(*map(F.lit, self.weights)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
        return 1 / (1 + F.exp(-(strength - self.threshold + math.log(CUT / (1 - CUT)))))


def _numbered(rows: DataFrame, n: int) -> DataFrame:
    """``rows(id, features, o)``, some ``n`` of them, with ``i``, gapless from 0 in the order of (o, id): numbers within ranges of ``o``, and the ranges' sums."""
    wide = max((-(-n // RANGE) - 1).bit_length(), 0)
    # 2^wide ranges of the hash; one row for each of them meets the others
    ranged = rows.withColumn("range", F.shiftright("o", 64 - wide) if wide else F.lit(0).cast("bigint"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count("*").alias("c")).select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("o", "id")) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(starts), "range").select((F.col("start") + F.col("inside")).alias("i"), "features")


def _quantiles(hist: DataFrame) -> np.ndarray:
    """The quantiles ``SHARES`` of ``hist(s, n)``, values and how many rows have each: ranks within bins of the value, and the bins' sums."""
    low, high = hist.agg(F.min("s"), F.max("s")).first()
    if not high > low:
        return np.full(len(SHARES), low)
    binned = hist.withColumn("bin", F.least(F.floor((F.col("s") - low) / ((high - low) / BINS)), F.lit(BINS - 1)))
    counts = np.zeros(BINS, np.int64)
    for r in binned.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows at most
        counts[r["bin"]] = r["n"]
    ends = np.cumsum(counts)
    at = SHARES * (ends[-1] - 1)
    ranks = np.unique(np.concatenate((np.floor(at), np.ceil(at)))).astype(int)
    asked: dict[int, list[int]] = {}
    for rank in ranks.tolist():
        asked.setdefault(int(np.searchsorted(ends, rank, "right")), []).append(rank)
    wanted = hist.sparkSession.createDataFrame([(b, int(ends[b] - counts[b]), r) for b, r in asked.items()], "bin bigint, start bigint, ranks array<bigint>")
    end = F.col("start") + F.sum("n").over(Window.partitionBy("bin").orderBy("s"))
    placed = binned.join(F.broadcast(wanted), "bin").withColumn("end", end)
    found = dict(placed.select(F.explode(F.filter("ranks", lambda r: (r >= F.col("end") - F.col("n")) & (r < F.col("end")))).alias("r"), "s").collect())
    value = np.array([found[r] for r in ranks.tolist()])
    return np.interp(at, ranks, value)


def _threshold(rows: DataFrame, weights: list[float]) -> float:
    """The quantile of strength that parts all ``rows(quality, features)`` best."""
    strength = F.aggregate(F.zip_with("features", F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    each = rows.groupBy(strength.alias("s")).agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"), F.count("*").alias("n"))
    hist = written(each, "strengths")
    levels = _quantiles(hist)
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in levels]), lambda t: t <= F.col("s")))
    counts = np.zeros((2, len(levels) + 1))
    for r in hist.groupBy(reached.alias("k")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect():
        counts[:, r["k"]] = r["bad"], r["good"]
    bad, good = np.cumsum(counts, axis=1)[:, :-1] / counts.sum(axis=1, keepdims=True)  # shares under each level
    return float(levels[int(np.argmax(1 - good + bad))])


def fit(rows: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", partners: int = PARTNERS, learn: Column | None = None) -> Model:
    """Weights and threshold from ``rows(id, FEATURES)`` and ``labels(id, quality)``; ``learn`` tells which ids may be used."""
    usable = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality")).filter(F.col("id").isNotNull() & F.col("quality").isin(0, 1) & (F.lit(True) if learn is None else learn))
    known = rows.select(F.col(id_col).alias("id"), F.col(FEATURES).alias("features")).join(usable, "id")
    labelled = written(known.select("quality", "features", F.xxhash64("id").alias("o"), "id"), "labelled")
    sizes = {r["quality"]: r["count"] for r in labelled.groupBy("quality").count().collect()}
    if len(sizes) < 2:
        return Model([0.0] * len(NAMES), math.log(CUT / (1 - CUT)))
    winners, losers = (_numbered(labelled.filter(F.col("quality") == q), sizes[q]).withColumnRenamed("features", f) for q, f in ((1, "w"), (0, "l")))
    met = winners.select("i", "w", F.explode(F.sequence(F.lit(0), F.lit(partners - 1))).alias("k"))
    pairs = met.withColumn("j", F.pmod(F.col("i") * partners + F.col("k"), F.lit(sizes[0]))).join(losers.withColumnRenamed("i", "j"), "j")
    won = F.pmod(F.col("i") + F.col("k"), F.lit(2))
    difference = F.zip_with("w", "l", lambda a, b: (a - b) * (2 * won - 1))
    data = pairs.select(won.cast("double").alias("label"), array_to_vector(difference).alias("features")).cache()
    try:
        weights = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=60).fit(data).coefficients.toArray().tolist()
    finally:
        data.unpersist()
    return Model(weights, _threshold(labelled, weights))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, learn: Column | None = None) -> DataFrame:
    """``keep`` columns of every document (all, if None) with ``score`` (0 to 1) and ``predicted`` (score >= 0.3)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted", FEATURES)]
    rows = written(with_features(docs, text_col=text_col, keep=list(dict.fromkeys([*kept, id_col]))), "features")
    model = fit(rows, labels, id_col=id_col, learn=learn)
    scored = rows.withColumn("score", model.score())
    return scored.select(*[f"`{c}`" for c in kept], "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def learnable(id_col: str = "id") -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, modulo 5, isn't 0."""
    return F.pmod(id_crc(id_col), F.lit(5)) != 0
