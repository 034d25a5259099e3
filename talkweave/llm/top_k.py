"""Exact top-k search by three phases with a uniform threshold.

Vectors are cut into SLICES parts, so a score is a sum of partial scores, and
rows are dealt into blocks; a site holds one block. Queries come in blocks as well,
and a block of queries meets every site.

1. A site lists, for each query and slice, the k best partial scores, adds the
   other slices of these rows, and sends the k best sums. The k-th best sum that a
   query has from all sites cannot be above its true k-th best score.
2. That cutoff t goes back to the sites. A row with a score of at least t has a
   partial score of at least t / SLICES in some slice; only such entries are looked at.
3. Their other partial scores are added, sums below t are dropped, and a site sends
   what is left, at most k rows a query (ties to the smaller id, so no more can
   be needed). The best k of these, over all sites, are the answer.

Sums are integers and exact: they are formed in the narrowest float whose
integers hold them all, or in 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

K = 20
SLICES = 4
SITE = 4096  # rows of a site
QUERIES = 1024  # of a block
AT_ONCE = 256  # queries scored at once


def scaled(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _partials(queries: np.ndarray, rows: np.ndarray, slices: int) -> list[np.ndarray]:
    """Partial scores of each slice, queries x rows, as exact numbers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    cuts = [rows.shape[1] * i // slices for i in range(slices + 1)]
    a, b = queries.astype(kind), rows.astype(kind)
    return [a[:, x:y] @ b[:, x:y].T for x, y in zip(cuts, cuts[1:], strict=False)]


def _sites(phase: int, k: int, slices: int):
    """Queries (qid, id, vector, cutoff) x rows (id, vector) -> qid, vec_id, score."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            width = max(int(pc.max(pc.list_value_length(t["vector"])).as_py()) for t in (left, right))
            order = pc.sort_indices(right["vec_id"])  # then a smaller place is a smaller id
            right = right.take(order)
            rows, ids = _matrix(right["vector"], width), right["vec_id"].to_numpy()
            queries, own, qid = _matrix(left["vector"], width), left["vec_id"].to_numpy(), left["qid"].to_numpy()
            cutoff = left["cutoff"].to_numpy(zero_copy_only=False) if phase == 2 else None
            for at in range(0, len(queries), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                partials = _partials(queries[part], rows, slices)
                mine = own[part, None] == ids[None, :]
                if phase == 1:
                    q, r = _best_partials(partials, mine, k)
                else:
                    low = np.where(np.isnan(cutoff[part]), -np.inf, cutoff[part])
                    wanted = np.zeros(mine.shape, bool)
                    for p in partials:
                        wanted |= p >= (low / slices)[:, None]
                    q, r = np.nonzero(wanted & ~mine)
                score = sum(p[q, r].astype(np.int64) for p in partials)
                if phase == 2:
                    keep = score >= low[q]
                    q, r, score = q[keep], r[keep], score[keep]
                by = np.lexsort((r, -score, q))
                q, r, score = q[by], r[by], score[by]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                keep = place < k
                out.append((qid[part][q[keep]], ids[r[keep]], score[keep]))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("qid", "vec_id", "score"), cols, strict=True)})

    return run


def _best_partials(partials: list[np.ndarray], mine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of the k best entries of each slice's list, each pair once."""
    n, m = mine.shape
    picked = np.zeros((n, m), bool)
    for p in partials:
        if m > k + 1:  # one more, as the query's own row may be among them
            best = np.argpartition(-p, k, axis=1)[:, : k + 1]
            picked[np.arange(n)[:, None], best] = True
        else:
            picked[:] = True
    return np.nonzero(picked & ~mine)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    factor: int = 64,
    slices: int = SLICES,
    site: int = SITE,
    queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query.

    Components become floor(factor * x). Candidates are all rows with another id
    than the query's. Defined cases: vectors that are null, or hold nulls or
    numbers that are not finite, take no part, nor do null ids; shorter vectors
    continue with zeros; ties go to the smaller id; fewer than k candidates
    are all returned; rows that repeat an id are candidates each, as queries
    they count once if their vectors are equal; an empty table gives no
    rows; other columns are not read.
    """
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"),
        scaled(F.col(vector_col), factor).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = cut_lineage(rows)
    asked = rows.where("asks").select(F.xxhash64("vec_id", "vector").alias("qid"), "vec_id", "vector").dropDuplicates(["qid"])
    asked = cut_lineage(asked)
    n_rows, n_asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    sites, blocks = max(1, -(-n_rows // site)), max(1, -(-n_asked // queries))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    held = rows.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sites)).cast("int").alias("site"), every(blocks, "block"))

    def meet(some: DataFrame, phase: int) -> DataFrame:
        block = F.pmod(F.col("qid"), F.lit(blocks)).cast("int").alias("block")
        sent = some.select("*", block, every(sites, "site"))
        pair = sent.groupBy("block", "site").cogroup(held.groupBy("block", "site"))
        return pair.applyInArrow(_sites(phase, k, slices), "qid long, vec_id long, score long")

    # Phase 1: lists of the sites, and the safe cutoff.
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    lists = meet(asked, 1).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    cutoffs = lists.where(F.col("place") == k).select("qid", F.col("score").cast("double").alias("cutoff"))
    # Phases 2 and 3: what reaches the cutoff, with whole scores.
    found = meet(asked.join(cutoffs, "qid", "left"), 2).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.join(asked.select("qid", F.col("vec_id").alias("query_id")), "qid").select("query_id", "rank", "vec_id", "score")
