"""Exact nearest vectors from a table that is stored by pivots.

    columns/                               the types of ids and vectors
    pivots/                                the vectors that name cells
    vectors/segment=<n>/cell=<c>/ring=<r>  ids, vectors and angles
    rings/segment=<n>                      rows and smallest and largest angle of each ring

A vector lies in the cell of its nearest pivot and in a ring of that cell, by its angle to
the pivot. Angles obey the triangle inequality: with a query at angle t of a pivot,
every vector of a ring [low, high] is at least max(low - t, t - high) away. A search
reads the rings that may be nearest until they hold k rows, takes the k-th similarity as
cutoff, and then reads only rings whose bound does not exceed it. The answer is that of
a full scan.

The pivots are a bounded sample: the `pivots` different vectors with the smallest hash.
They only name cells; every row is stored. Vectors that no angle describes (another
length, a null or non-finite element, a norm of almost zero) go to cell -1, which every
search reads. A batch adds a segment; a batch that is repeated replaces its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine_to

WIDTH = 0.05  # radians of a ring
REST = -1  # the cell of vectors without an angle
TINY = 1e-6  # smallest norm of a vector with an angle
SLACK = 1e-6  # added to the cutoff against rounding


def _units(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have an angle, and these at unit length."""
    sizes = np.diff(vectors.offsets.to_numpy())
    sizes[~vectors.is_valid().to_numpy(zero_copy_only=False)] = -1
    at = np.flatnonzero(sizes == dims)
    values = vectors.values.to_numpy(zero_copy_only=False).astype("float64")
    found = values[vectors.offsets.to_numpy()[at][:, None] + np.arange(dims)]
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt(np.einsum("ij,ij->i", found, found))
    good = np.isfinite(norms) & (norms > TINY)
    return at[good], found[good] / norms[good, None]


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos((units @ pivots.T).clip(-1.0, 1.0))


def _nearest(pivots: np.ndarray):
    """Vectors -> struct of cell and angle."""

    @F.arrow_udf("struct<cell: int, angle: double>")
    def run(vectors: pa.Array) -> pa.Array:
        cell, angle = np.full(len(vectors), REST, np.int32), np.zeros(len(vectors))
        if len(pivots):
            at, units = _units(vectors, pivots.shape[1])
            angles = _angles(units, pivots)
            cell[at] = angles.argmin(axis=1)
            angle[at] = angles.min(axis=1, initial=np.inf)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle)], names=["cell", "angle"])

    return run


@dataclass(frozen=True)
class Ring:
    cell: int
    ring: int
    rows: int
    low: float
    high: float


class VectorIndex:
    """Vectors of one table under `folder`, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str, id: str = "passage_id", embedding: str = "embedding"):
        self.spark, self.folder, self.id, self.embedding = spark, folder, id, embedding

    def fit(self, rows: DataFrame, pivots: int = 64) -> VectorIndex:
        """Choose the pivots among the vectors of the commonest length, equal vectors once; then `add` batches."""
        column = F.col(self.embedding)
        sizes = rows.where(column.isNotNull()).groupBy(F.size(column).alias("dims")).count()
        common = sizes.orderBy(F.col("count").desc(), "dims").limit(1)
        rows.select(self.id, self.embedding).limit(0).write.mode("overwrite").parquet(f"{self.folder}/columns")
        usable = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        same = rows.where(column.isNotNull() & usable).withColumn("dims", F.size(column)).join(F.broadcast(common), "dims", "left_semi")
        # The hash is that of the vector, so that a vector that repeats is one pivot.
        some = same.select(F.xxhash64(column).alias("draw"), column.cast("array<double>").alias("vector"))
        some.groupBy("draw").agg(F.first("vector").alias("vector")).orderBy("draw").limit(pivots).write.mode("overwrite").parquet(f"{self.folder}/pivots")
        return self

    def pivots(self) -> np.ndarray:
        """The pivots at unit length, as `fit` has bounded their number."""
        held = self.spark.read.schema("draw long, vector array<double>").parquet(f"{self.folder}/pivots")
        vectors = [r.vector for r in held.orderBy("draw").collect()]
        if not vectors:
            return np.zeros((0, 0))
        found = np.array(vectors)
        norms = np.sqrt(np.einsum("ij,ij->i", found, found))
        good = np.isfinite(norms) & (norms > TINY)
        return found[good] / norms[good, None]

    def add(self, rows: DataFrame, segment: int = 0) -> VectorIndex:
        """Store a batch; rows without a vector are left out."""
        placed = (
            rows.where(F.col(self.embedding).isNotNull())
            .select(self.id, self.embedding)
            .withColumn("place", _nearest(self.pivots())(F.col(self.embedding)))
            .select(self.id, self.embedding, "place.angle", "place.cell")
            .withColumn("ring", F.floor(F.col("angle") / WIDTH).cast("int"))
        )
        path = f"{self.folder}/vectors/segment={segment}"
        # Rows of a ring meet in few files; Spark splits a ring that many rows share by its size.
        placed.hint("rebalance", "cell", "ring").write.mode("overwrite").partitionBy("cell", "ring").parquet(path)
        stored = self.spark.read.schema(placed.schema).parquet(path)
        rings = stored.groupBy("cell", "ring").agg(
            F.count("*").alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")
        )
        rings.write.mode("overwrite").parquet(f"{self.folder}/rings/segment={segment}")
        return self

    def rings(self) -> list[Ring]:
        """All rings of all segments together; their number is bounded by the pivots."""
        held = self.spark.read.schema("cell int, ring int, rows long, low double, high double").parquet(f"{self.folder}/rings")
        return [
            Ring(*r)
            for r in held.groupBy("cell", "ring").agg(F.sum("rows"), F.min("low"), F.max("high")).orderBy("cell", "ring").collect()
        ]

    def _read(self, rings: Sequence[Ring]) -> DataFrame:
        """The rows of some rings; Spark opens the files of these rings only."""
        columns = self.spark.read.parquet(f"{self.folder}/columns").schema
        schema = columns.add("segment", "integer").add("cell", "integer").add("ring", "integer")
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/vectors")
        place = F.struct("cell", "ring")
        return rows.where(place.isin([F.struct(F.lit(r.cell), F.lit(r.ring)) for r in rings]) if rings else F.lit(False))

    def chosen(self, query: Sequence[float], k: int, allowed: DataFrame | None = None) -> list[Ring]:
        """The rings that a search for the k nearest has to read."""
        pivots, rings = self.pivots(), self.rings()
        target = np.asarray(query, dtype="float64")
        norm = np.sqrt(target @ target)
        if not len(pivots) or len(target) != pivots.shape[1] or not np.isfinite(norm) or norm <= TINY:
            return rings  # no angle: all rows are compared
        to_pivot = _angles(target[None, :] / norm, pivots)[0]

        def bound(r: Ring) -> float:
            return 0.0 if r.cell == REST else max(0.0, r.low - to_pivot[r.cell], to_pivot[r.cell] - r.high)

        ordered = sorted(rings, key=lambda r: (bound(r), r.cell != REST, abs(r.low - to_pivot[r.cell]) if r.cell != REST else 0.0))
        first, rows = [], 0
        for r in ordered:
            if rows >= k and r.cell != REST:
                break
            first.append(r)
            rows += r.rows
        best = self._nearest_of(first, target, k, allowed)
        cutoff = best.agg(F.count("*").alias("n"), F.min("similarity").alias("least")).first()
        if cutoff.n < k:
            return rings
        angle = float(np.arccos(np.clip(cutoff.least, -1.0, 1.0))) + SLACK
        return [r for r in rings if r.cell == REST or bound(r) <= angle]

    def _nearest_of(self, rings: Sequence[Ring], target: Sequence[float], k: int, allowed: DataFrame | None) -> DataFrame:
        rows = self._read(rings)
        if allowed is not None:
            rows = rows.join(allowed.select(self.id), self.id, "left_semi")
        found = rows.select(self.id, cosine_to(target)(F.col(self.embedding)).alias("similarity"))
        return found.orderBy(F.col("similarity").desc(), self.id).limit(k)

    def topk(self, query: Sequence[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
        """id and similarity of the k nearest, as `operators.search.vector_topk` finds them.

        allowed: rows with the ids that may be found.
        """
        if k < 1:
            raise ValueError("a search needs a size of one at least")
        return self._nearest_of(self.chosen(query, k, allowed), query, k, allowed)
