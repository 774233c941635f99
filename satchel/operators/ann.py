"""Approximate dense search by inverted cells.

Vectors are assigned to the nearest of ``cells`` centres; a question is scored
only against the points of its nearest centres, exactly. Fewer probes mean
less work and some missed neighbours; probing every cell is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.operators.dense import dense_topk


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), dim)
    size = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, size, out=np.zeros_like(flat), where=size > 0)


@dataclass(frozen=True)
class Cells:
    """Unit-length centres, at most a few thousand of them."""

    centres: np.ndarray

    def order(self, vectors: pa.Array) -> np.ndarray:
        """Numbers of all centres for each vector, most similar first."""
        sims = np.round(_unit(vectors, self.centres.shape[1]) @ self.centres.T, 9)
        return np.argsort(-sims, axis=1, kind="stable").astype(np.int32)

    def nearest(self, vector: Column, n: int = 1) -> Column:
        """Numbers of the ``n`` most similar centres, best first."""
        count = min(n, len(self.centres))

        @F.arrow_udf("array<int>")
        def assign(vectors: pa.Array) -> pa.Array:
            best = self.order(vectors)[:, :count]
            offsets = np.arange(0, best.size + 1, count, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(best.reshape(-1)))

        return assign(vector)


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x.cast("double") * x))


def unit_vector(vector: Column) -> Column:
    """A vector at unit length. The length is a value of its own: inside the
    division it would be made anew for each component."""
    sized = F.array(F.struct(vector.alias("v"), _length(vector).alias("size")))
    return F.get(F.transform(sized, lambda s: F.transform(s["v"], lambda x: x / s["size"])), F.lit(0))


def train_cells(points: DataFrame, cells: int, seed: int = 7, iterations: int = 10) -> Cells:
    """Cluster unit vectors with distributed k-means."""
    unit = unit_vector(F.col("embedding")).cast("array<double>")
    features = points.where(_length(F.col("embedding")) > 0).select(array_to_vector(unit).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=iterations, initMode="k-means||").fit(features)
    centres = np.array(model.clusterCenters())
    return Cells(centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12))


def assign_cells(points: DataFrame, cells: Cells) -> DataFrame:
    """Points with their cell; written out, ``cell`` serves as partition column."""
    return points.withColumn("cell", F.get(cells.nearest(F.col("embedding")), F.lit(0)))


def approximate_topk(assigned: DataFrame, queries: DataFrame, cells: Cells, probes: int, k: str = "recall") -> DataFrame:
    """Best ``k`` points among the ``probes`` nearest cells of each question."""
    return topk_in_cells(assigned, queries.withColumn("cell", F.explode(cells.nearest(F.col("qvec"), probes))), k)


def topk_in_cells(assigned: DataFrame, aimed: DataFrame, k: str = "recall") -> DataFrame:
    """Best ``k`` points of each question among the cells it is aimed at, one
    row for each (question, cell)."""
    meeting = F.concat_ws(":", F.col("cell").cast("string"), F.col("project_id"))
    return dense_topk(assigned.withColumn("meeting", meeting), aimed.withColumn("meeting", meeting), k=k, group="meeting")


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours the approximate answer holds."""
    found = approximate.select("query_id", "id").withColumn("_hit", F.lit(1))
    return exact.join(found, ["query_id", "id"], "left").agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("recall"))
