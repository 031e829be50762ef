"""Two-axis maps: principal components with settled signs, projection, viewport and stability."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import vec


@dataclass(frozen=True)
class Basis:
    """Mean, two components and their shares of the variance; zeros where there is no spread."""

    mean: list[float] = field(default_factory=list)
    pc1: list[float] = field(default_factory=list)
    pc2: list[float] = field(default_factory=list)
    variance_explained: tuple[float, float] = (0.0, 0.0)

    @property
    def percent(self) -> int:
        """The map's share of the variance, rounded half up."""
        return int(np.floor(100 * sum(self.variance_explained) + 0.5))


def seed_direction(d: int) -> np.ndarray:
    """The direction whose side settles a component's sign."""
    i = np.arange(1, d + 1, dtype=np.int64)
    v = (i * 2654435761 % 100_000) / 100_000 - 0.5
    return v / np.linalg.norm(v)


def fit(vectors: DataFrame, *, vector: str = "embedding") -> Basis | None:
    """The basis of all vectors: covariance summed up over the executors, a small eigenproblem on the driver. None without any; null and empty vectors don't count."""
    rows = vectors.filter(F.size(vector) > 0).select(array_to_vector(vec.as_double(vector)).alias("v"))
    if rows.isEmpty():
        return None
    found = rows.agg(F.count("*").alias("n"), Summarizer.mean(F.col("v")).alias("m"), Summarizer.variance(F.col("v")).alias("s")).first()
    mean = found.m.toArray()
    d = len(mean)
    if found.n == 1 or found.s.toArray().sum() <= 1e-18:
        return Basis(mean.tolist(), [0.0] * d, [0.0] * d)
    model = PCA(k=min(2, d), inputCol="v", outputCol="p").fit(rows)
    parts, share = model.pc.toArray().T, model.explainedVariance.toArray().tolist()
    seed = seed_direction(d)
    axes = [(p if p @ seed >= 0 else -p) * (s > 1e-12) for p, s in zip(parts, share)]
    axes += [np.zeros(d)] * (2 - len(axes))
    return Basis(mean.tolist(), axes[0].tolist(), axes[1].tolist(), (share[0], share[1] if len(share) > 1 else 0.0))


def _array(values: list[float]) -> Column:
    return F.array(*map(F.lit, values))


def project_onto(items: DataFrame, basis: Basis | None, *, vector: str = "embedding") -> DataFrame:
    """``items`` with x and y: centred, then along the two components. A narrow map; nothing is fitted.

    Null and empty vectors, and all of them without a basis, have null coordinates.
    """
    if basis is None:
        return items.withColumn("x", F.lit(None).cast("double")).withColumn("y", F.lit(None).cast("double"))
    items = items.withColumn(vector, F.when(F.size(vector) > 0, F.col(vector)))
    centred = F.zip_with(vec.as_double(vector), _array(basis.mean), lambda a, m: a - m)
    return items.withColumn("x", vec.dot(centred, _array(basis.pc1))).withColumn("y", vec.dot(centred, _array(basis.pc2)))


def total_variance(items: DataFrame, *, vector: str = "embedding") -> DataFrame:
    """One row: the sum of squared distances from the mean."""
    at = items.select(F.posexplode(vec.as_double(vector)).alias("i", "x"))
    return at.groupBy("i").agg(F.var_pop("x").alias("v"), F.count("*").alias("n")).agg(F.sum(F.col("v") * F.col("n")).alias("total_variance"))


def map_points(chunks: DataFrame, centroids: DataFrame, *, vector: str = "embedding") -> tuple[DataFrame, Basis]:
    """Chunks and note centroids on the axes fitted to all chunks; an empty basis without chunks."""
    basis = fit(chunks, vector=vector)
    c = project_onto(chunks, basis, vector=vector).select(F.lit("chunk").alias("kind"), "note_id", "chunk_id", "x", "y", "truncated")
    n = project_onto(centroids, basis, vector=vector).select(F.lit("note").alias("kind"), "note_id", F.lit(None).cast("string").alias("chunk_id"), "x", "y", F.lit(None).cast("boolean").alias("truncated"))
    return c.unionByName(n), basis or Basis()


def viewport_fit(points: DataFrame, *, by: str | None = None, size: int = 600, padding: int = 40) -> DataFrame:
    """(by, scale, cx, cy): the scale at which all points of a map fit."""
    extent = F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")
    found = points.groupBy(by).agg(extent) if by else points.agg(extent)
    usable = float(size / 2 - padding)
    whole = F.when(F.col("m").isNull(), F.lit(1.0)).otherwise(F.lit(usable) / F.coalesce(F.nullif(F.col("m"), F.lit(0.0)), F.lit(1.0)))
    return found.select(*([by] if by else []), whole.alias("scale"), F.lit(size / 2).alias("cx"), F.lit(size / 2).alias("cy"))


def to_pixels(points: DataFrame, fitted: DataFrame, *, by: str | None = None) -> DataFrame:
    """Points with px and py, y pointing up. The fit is one row (for each map)."""
    met = points.join(fitted, by) if by else points.crossJoin(F.broadcast(fitted))
    return met.withColumn("px", F.col("cx") + F.col("x") * F.col("scale")).withColumn("py", F.col("cy") - F.col("y") * F.col("scale"))


def displacement(before: DataFrame, after: DataFrame, *, by: str = "id") -> DataFrame:
    """(id, moved): distance between a point's two places, joined by id."""
    a = before.select(by, F.col("px").alias("ax"), F.col("py").alias("ay"))
    return a.join(after.select(by, "px", "py"), by).select(by, F.hypot(F.col("px") - F.col("ax"), F.col("py") - F.col("ay")).alias("moved"))


def instability(old: DataFrame, new: DataFrame, *, by: str = "id", vector: str = "embedding", size: int = 600, padding: int = 40) -> DataFrame:
    """One row (mean_px, max_px, n): how far old points move when the map is fitted with the new ones."""

    def drawn(rows: DataFrame) -> DataFrame:
        basis = fit(rows, vector=vector)
        points = project_onto(rows, basis, vector=vector)
        return to_pixels(points, viewport_fit(points, size=size, padding=padding)).select(by, "px", "py")

    moved = displacement(drawn(old), drawn(old.unionByName(new)), by=by)
    return moved.agg(F.avg("moved").alias("mean_px"), F.max("moved").alias("max_px"), F.count("*").alias("n"))
