"""Maps of many corpora in one job.

A corpus's state is (n, total, outer): how many vectors it has, their sum and the upper triangle of the sum of their outer products. States add
up, so tasks make them of their own rows first and a large corpus is no hot key; and they subtract, so a map is refitted
to edits from the vectors that came and went, without reading those that stayed. Each corpus's axes come from its own small
eigenproblem, one row of states at a time in any task; nothing is collected.

Defined cases: null and empty vectors don't count; a corpus without vectors has no state, no basis and null coordinates; a null corpus is a
corpus of its own; one vector, or equal ones, give zero axes, so all points lie at the origin; vectors of unequal length in
a corpus are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import vec
from quillspan.operators import project

#: Bases of up to so many corpora are broadcast to the points.
FEW = 1000
#: Spread below which a corpus has no axes, and share below which an axis is none: fixed values.
NO_SPREAD, NO_SHARE = 1e-18, 1e-12


def _state(m: np.ndarray) -> tuple[list[float], list[float]]:
    return m.sum(axis=0).tolist(), (m.T @ m)[np.triu_indices(m.shape[1])].tolist()


def _added(partial: DataFrame) -> DataFrame:
    """Sums of states (c, n, total, outer), with partial sums in each task."""
    total, outer = (Summarizer.sum(array_to_vector(x)) for x in ("total", "outer"))
    found = partial.groupBy("c").agg(F.sum("n").alias("n"), total.alias("t"), outer.alias("o"))
    return found.select("c", "n", vector_to_array("t").alias("total"), vector_to_array("o").alias("outer"))


def states(items: DataFrame, *, corpus: str = "corpus_id", vector: str = "embedding") -> DataFrame:
    """(corpus, n, total, outer) of each corpus."""
    # as text: pandas makes whole numbers floats beside a null
    rows = items.filter(F.size(vector) > 0).select(F.col(corpus).cast("string").alias("c"), vec.as_double(vector).alias("v"))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for c, some in frame.groupby("c", dropna=False):
                total, outer = _state(np.stack(some["v"].to_numpy()))
                yield pd.DataFrame({"c": pd.Series([None if pd.isna(c) else c], dtype=object), "n": [len(some)], "total": [total], "outer": [outer]})

    made = rows.mapInPandas(partial, "c string, n bigint, total array<double>, outer array<double>")
    return _added(made).withColumn("c", F.col("c").cast(items.schema[corpus].dataType)).withColumnRenamed("c", corpus)


def changed(before: DataFrame, *, added: DataFrame | None = None, removed: DataFrame | None = None, corpus: str = "corpus_id", vector: str = "embedding") -> DataFrame:
    """``before`` with the vectors of ``added`` and without those of ``removed``; corpora that are left with none go.

    Reads the states and what changed, not what stayed.
    """
    parts = before.select(F.col(corpus).alias("c"), "n", "total", "outer")
    for rows, sign in ((added, 1), (removed, -1)):
        if rows is not None:
            s = states(rows, corpus=corpus, vector=vector)
            scaled = lambda x, k=sign: vec.scaled(x, F.lit(float(k)))
            parts = parts.unionByName(s.select(F.col(corpus).alias("c"), (sign * F.col("n")).alias("n"), scaled("total").alias("total"), scaled("outer").alias("outer")))
    return _added(parts).filter("n > 0").withColumnRenamed("c", corpus)


def axes(n: int, total: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Mean, two axes with settled signs and their shares of the variance."""
    d = len(total)
    mean, zero = total / n, np.zeros(d)
    scatter = np.zeros((d, d))
    scatter[np.triu_indices(d)] = outer
    scatter = scatter + np.triu(scatter, 1).T - n * np.outer(mean, mean)
    spread = float(np.trace(scatter))
    # what is left of cancelled sums isn't spread
    if n == 1 or spread <= max(NO_SPREAD, 1e-13 * float(np.abs(np.diag(scatter + n * np.outer(mean, mean))).sum())):
        return mean, zero, zero, 0.0, 0.0
    values, columns = np.linalg.eigh(scatter)
    found = [(zero, 0.0), (zero, 0.0)]
    seed = project.seed_direction(d)
    for i in range(min(2, d)):
        share, axis = max(float(values[-1 - i]), 0.0) / spread, columns[:, -1 - i]
        found[i] = ((axis if axis @ seed >= 0 else -axis) if share > NO_SHARE else zero, share)
    return mean, found[0][0], found[1][0], found[0][1], found[1][1]


def bases(fitted: DataFrame, *, corpus: str = "corpus_id") -> DataFrame:
    """(corpus, n, mean, pc1, pc2, share1, share2) from states."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [axes(int(n), np.asarray(t), np.asarray(o)) for n, t, o in zip(frame["n"], frame["total"], frame["outer"], strict=True)]
            made = {k: [x[i] for x in found] for i, k in enumerate(("mean", "pc1", "pc2", "share1", "share2"))}
            yield pd.DataFrame({"c": frame["c"], "n": frame["n"], **made})

    rows = fitted.select(F.col(corpus).cast("string").alias("c"), "n", "total", "outer")
    made = rows.mapInPandas(solve, "c string, n bigint, mean array<double>, pc1 array<double>, pc2 array<double>, share1 double, share2 double")
    return made.withColumn("c", F.col("c").cast(fitted.schema[corpus].dataType)).withColumnRenamed("c", corpus)


def project_onto(items: DataFrame, found: DataFrame, *, corpus: str = "corpus_id", vector: str = "embedding") -> DataFrame:
    """``items`` with x and y on their corpus's axes; null where there are none."""
    few = found.limit(FEW + 1).count() <= FEW
    side = found.select(F.col(corpus).alias("__c"), F.col("mean").alias("__m"), F.col("pc1").alias("__p"), F.col("pc2").alias("__q"))
    met = items.join(F.broadcast(side) if few else side, F.col(corpus).eqNullSafe(F.col("__c")), "left")
    v = F.when((F.size(vector) > 0) & F.col("__m").isNotNull(), F.zip_with(vec.as_double(vector), F.col("__m"), lambda a, m: a - m))
    return met.withColumn("__v", v).withColumn("x", vec.dot("__v", "__p")).withColumn("y", vec.dot("__v", "__q")).drop("__c", "__m", "__p", "__q", "__v")


def drawn(items: DataFrame, found: DataFrame, *, corpus: str = "corpus_id", vector: str = "embedding", size: int = 600, padding: int = 40) -> DataFrame:
    """``items`` with x, y and pixels px, py, each corpus in a viewport of its own."""
    points = project_onto(items, found, corpus=corpus, vector=vector)
    fits = project.viewport_fit(points, by=corpus, size=size, padding=padding)
    fits = fits.select(F.col(corpus).alias("__c"), "scale", "cx", "cy")
    fits = F.broadcast(fits) if fits.limit(FEW + 1).count() <= FEW else fits
    met = points.join(fits, F.col(corpus).eqNullSafe(F.col("__c")))
    return met.withColumn("px", F.col("cx") + F.col("x") * F.col("scale")).withColumn("py", F.col("cy") - F.col("y") * F.col("scale")).drop("__c", "scale", "cx", "cy")


def instability(old: DataFrame, new: DataFrame, *, corpus: str = "corpus_id", item_id: str = "id", vector: str = "embedding") -> DataFrame:
    """(corpus, mean_px, max_px, n): how far each corpus's old points move when its map is refitted with the new ones."""
    before = states(old, corpus=corpus, vector=vector)
    after = changed(before, added=new, corpus=corpus, vector=vector)
    both = old.select(corpus, item_id, vector, F.lit(True).alias("old")).unionByName(new.select(corpus, item_id, vector, F.lit(False).alias("old")))
    a = drawn(old.select(corpus, item_id, vector), bases(before, corpus=corpus), corpus=corpus, vector=vector).select(corpus, item_id, F.col("px").alias("ax"), F.col("py").alias("ay"))
    b = drawn(both, bases(after, corpus=corpus), corpus=corpus, vector=vector).filter("old").select(F.col(corpus).alias("__c"), F.col(item_id).alias("__i"), "px", "py")
    met = a.join(b, F.col(corpus).eqNullSafe(F.col("__c")) & (F.col(item_id) == F.col("__i")))
    moved = met.select(corpus, F.hypot(F.col("px") - F.col("ax"), F.col("py") - F.col("ay")).alias("moved"))
    return moved.groupBy(corpus).agg(F.avg("moved").alias("mean_px"), F.max("moved").alias("max_px"), F.count("moved").alias("n"))
