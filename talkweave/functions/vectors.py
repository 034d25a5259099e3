"""Vector columns (array<float>)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind


def _sum(left: Column, right: Column, term: Callable[[Column, Column], Column]) -> Column:
    """Sum of a term over the positions both vectors have, in double."""

    def guarded(x: Column, y: Column) -> Column:
        return F.coalesce(term(x.cast("double"), y.cast("double")), F.lit(0.0))

    return F.aggregate(F.zip_with(left, right, guarded), F.lit(0.0), lambda total, x: total + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine over the shorter length; 0 for an empty vector, denominator at least 1e-12."""
    dot = _sum(left, right, lambda x, y: x * y)
    left_norm = _sum(left, right, lambda x, y: F.when(y.isNotNull(), x * x))
    right_norm = _sum(left, right, lambda x, y: F.when(x.isNotNull(), y * y))
    return dot / F.greatest(F.lit(1e-12), F.sqrt(left_norm * right_norm))


def cosine_to(query: Sequence[float]) -> Callable[[Column], Column]:
    """`cosine` with one known vector, whole Arrow batches at a time.

    About three times as fast as the expression, which visits every element.
    """
    target = np.asarray(query, dtype="float64")

    def similarity(rows: np.ndarray) -> np.ndarray:
        part = target[: rows.shape[1]]
        rows = rows[:, : len(part)].astype("float64")
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows) * (part @ part))
        return rows @ part / np.maximum(1e-12, norms)

    @F.arrow_udf("double")
    def run(vectors: pa.Array) -> pa.Array:
        present = vectors.drop_null()
        sizes = np.diff(present.offsets.to_numpy())
        values = present.values.to_numpy(zero_copy_only=False)
        start = present.offsets.to_numpy()[:-1]
        found = np.zeros(len(present))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            found[at] = similarity(values[start[at][:, None] + np.arange(size)])
        out = np.zeros(len(vectors))
        known = vectors.is_valid().to_numpy(zero_copy_only=False)
        out[known] = found
        return pa.array(out, mask=~known)

    return run


def fit_vector(vector: Column, dims: int) -> Column:
    """First dims values at unit length (a zero vector stays zero), padded with zeros."""

    def fitted(head: Column) -> Column:
        squares = _sum(head, head, lambda x, y: x * y)
        divisor = F.when(squares > 0, F.sqrt(squares)).otherwise(F.lit(1.0))
        scaled = bind(divisor, lambda n: F.transform(head, lambda x: x.cast("double") / n))
        return F.concat(scaled, F.array_repeat(F.lit(0.0), F.lit(dims) - F.size(head)))

    return bind(F.slice(vector, 1, dims), fitted).cast("array<float>")
