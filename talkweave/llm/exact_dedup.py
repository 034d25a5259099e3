"""Exact dedup with a split of the heavy digests.

One task holds at most `counters` digests of a Misra-Gries summary, whatever it
reads. Summaries merge by addition, so a digest seen f times among n rows keeps
at least f - n / (counters + 1). Candidates are the digests whose merged count is
above that error; there can be no more than `counters` of them, which is the
proven bound of everything that is broadcast here. Their exact counts are then
taken over all rows, the verified winners go to every task, and rows that carry
them are settled where they are read. All other digests stand for at most
2 n / (counters + 1) rows each and are shuffled as usual.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

COUNTERS = 1024


def reduce_counts(values: pa.Array, counts: pa.Array, counters: int) -> tuple[pa.Array, pa.Array]:
    """Merge counters and, if too many are left, lower all by the first one that has no place."""
    merged = pa.table({"v": values, "n": counts}).group_by("v").aggregate([("n", "sum")])
    values, counts = merged["v"].combine_chunks(), merged["n_sum"].combine_chunks()
    if len(counts) <= counters:
        return values, counts
    order = pc.sort_indices(counts, sort_keys=[("", "descending")])
    cut = counts[order[counters].as_py()]
    alive = pc.greater(counts, cut)
    return values.filter(alive), pc.subtract(counts.filter(alive), cut)


def _summary(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = pa.array([], pa.binary()), pa.array([], pa.int64())
        for batch in batches:
            seen = pa.table([batch.column(0)], names=["v"]).group_by("v").aggregate([("v", "count")])
            values, counts = reduce_counts(
                pa.concat_arrays([values, seen["v"].combine_chunks()]),
                pa.concat_arrays([counts, seen["v_count"].combine_chunks()]),
                counters,
            )
        yield pa.RecordBatch.from_arrays([values, counts], names=["digest", "n"])

    return run


def frequent_digests(digests: DataFrame, total: int, counters: int = COUNTERS) -> DataFrame:
    """Digests that may be heavy: every one with over 2 total / (counters + 1) rows, at most `counters`."""
    summaries = digests.select("digest").mapInArrow(_summary(counters), "digest binary, n long")
    merged = summaries.groupBy("digest").agg(F.sum("n").alias("n"))
    return merged.where(F.col("n") > F.lit(total / (counters + 1))).select("digest")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Column | None = None,
    counters: int = COUNTERS,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Equal texts are one group, the row with the largest id stays. `normalise`
    replaces the text before comparison (None: no change). Defined cases: a null
    text is an empty one; rows that repeat both id and text count each in
    group_size and share `kept`; a null id loses against any other and stays
    only where the whole group has none; an empty table gives no rows; other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col) if normalise is None else normalise, F.lit(""))
    digests = cut_lineage(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    )
    total = digests.count()
    candidates = frequent_digests(digests, total, counters)
    keep = (F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Exact figures of the candidates, over all rows: at most `counters` rows, so broadcasts are bounded.
    winners = cut_lineage(
        digests.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(*keep)
    )
    marked = digests.join(F.broadcast(winners), "digest", "left")
    heavy = marked.where(F.col("group_size").isNotNull())
    light = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(*keep)
    settled = heavy.unionByName(light.join(groups, "digest"))
    return settled.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
