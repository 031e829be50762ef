"""The classifier learns from every labelled row, numbered in ranges."""

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm import bradley_terry


def test_numbers_are_gapless_in_hash_order(spark, monkeypatch):
    rows = spark.range(1000).select("id", F.array(F.col("id").cast("double")).alias("features"), F.xxhash64("id").alias("o")).repartition(5)
    want = [r.id for r in rows.orderBy("o", "id").collect()]
    for size in (10, 300, 5000):
        monkeypatch.setattr(bradley_terry, "RANGE", size)
        got = bradley_terry._numbered(rows, 1000).orderBy("i").collect()
        assert [r.i for r in got] == list(range(1000)) and sorted(int(r.features[0]) for r in got) == sorted(want)
        assert size != 5000 or [int(r.features[0]) for r in got] == want


def test_threshold_counts_all_rows(spark):
    n = 40_000
    # the first feature is the strength; 1 in 4 is bad and lies below 0.25
    rows = spark.range(n).select((F.col("id") % 4 != 0).cast("int").alias("quality"), F.array(F.when(F.col("id") % 4 == 0, F.col("id") / n / 4).otherwise(0.25 + F.col("id") / n)).alias("features"))
    assert abs(bradley_terry._threshold(rows, [1.0]) - 0.25) < 0.01
    hist = rows.select(F.round(F.col("features")[0], 3).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    values = [r.s for r in hist.collect() for _ in range(r.n)]
    np.testing.assert_allclose(bradley_terry._quantiles(hist), np.quantile(values, bradley_terry.SHARES), atol=1e-12)
    assert bradley_terry._threshold(rows, [0.0]) == 0.0


def test_every_label_weighs(spark):
    """Rows beyond any fixed number of them change the weights: 20,000 labels, of which the last by hash order say the opposite."""
    width = len(bradley_terry.NAMES)
    rank = F.percent_rank().over(bradley_terry.Window.orderBy(F.xxhash64("id")))
    rows = spark.range(20_000).withColumn("late", rank > 0.82).withColumn("quality", (F.col("id") % 2).cast("int")).cache()
    sign = F.when(F.col("late"), -20.0).otherwise(1.0) * (F.col("quality") - 0.5)
    features = rows.select(F.col("id").alias("doc_id"), F.concat(F.array(sign), F.array_repeat(F.lit(0.0), width - 1)).alias(bradley_terry.FEATURES))
    model = bradley_terry.fit(features, rows.select(F.col("id").alias("doc_id"), "quality"))
    few = bradley_terry.fit(features.join(rows.filter("not late").select(F.col("id").alias("doc_id")), "doc_id"), rows.select(F.col("id").alias("doc_id"), "quality"))
    assert few.weights[0] > 0 > model.weights[0]
