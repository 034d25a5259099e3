"""Hard-negative mining: exact scores from products modulo small primes.

Every usable row is a candidate; some rows are anchors. Tasks pack the rows they
read into chunks of some COMPONENTS numbers, and anchors into chunks as well, so what
moves is a few binary values; a pair of chunks is one group of at most one chunk of each side.

A score is an inner product of integers. In a group, both matrices are reduced modulo
primes below 2 ** PRIME_BITS, centred around zero, and multiplied in float32: sums over TILE
columns stay below 2 ** 24, so every product is exact. As many primes are taken as
the largest norms of the two chunks need (Cauchy and Schwarz), and the signed
scores come back by Chinese remaindering in mixed radix.

1. Positives: rows of an anchor's own label are multiplied with it; a group keeps the best
   `positives` of each anchor, and so does their union.
2. Negatives: rows of other labels. Of the scores inside the window that a positive
   opens, a group keeps the best `negatives`, and so does their union.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .top_k import scaled, usable

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # the window, in hundredths of the positive's score
FACTOR = 256
COMPONENTS = 1 << 19  # numbers in one chunk
AT_ONCE = 256  # anchors scored at once
PRIME_BITS = 9
TILE = 256  # columns whose sum of products of residues stays below 2 ** 24
LARGEST = 1 << 56  # scores stay below this, so that a hundredfold of one fits 64 bits

PACKED = "place long, width int, ids binary, labels binary, vectors binary"


def primes_below(bits: int) -> list[int]:
    """Odd primes below 2 ** bits, largest first."""
    sieve = np.ones(1 << bits, bool)
    sieve[:2] = False
    for p in range(2, 1 << (bits // 2 + 1)):
        sieve[p * p :: p] = False
    return [int(p) for p in np.flatnonzero(sieve)[:0:-1]]


PRIMES = primes_below(PRIME_BITS)


def _centred(values: np.ndarray, p: int) -> np.ndarray:
    """Residues around zero of whole float32 numbers below 2 ** 24, in place.

    A large quotient may be rounded to the wrong side, by one; the second turn mends that.
    """
    for _ in range(2):
        values -= np.float32(p) * np.rint(values / np.float32(p))
    return values


def _residues(values: np.ndarray, p: int) -> np.ndarray:
    return _centred((values % p).astype(np.float32), p)


def _product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, in float32 all the way."""
    left, right = _residues(a, p), _residues(b, p)
    total = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, a.shape[1], TILE):
        total = _centred(total + _centred(left[:, at : at + TILE] @ right[:, at : at + TILE].T, p), p)
    return total


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as int64, by residues and mixed radix.

    Centred digits of odd primes reach every number up to half of the primes' product.
    """
    norm = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0))
    most = norm(a) * norm(b) * (1 + 1e-9) + 1
    if most >= LARGEST:
        raise ValueError(f"scores up to {most:.3g} do not fit {LARGEST.bit_length() - 1} bits")
    scores, radix, digits = np.zeros((len(a), len(b)), np.int64), 1, []
    for p in PRIMES:
        rest, weight = _product_modulo(a, b, p), 1
        for q, digit in digits:  # what the digits so far amount to, modulo p
            rest = _centred(rest - digit * np.float32(weight % p), p)
            weight *= q
        digit = _centred(rest * np.float32(pow(radix, -1, p)), p)
        scores += radix * digit.astype(np.int64)
        digits.append((p, digit))
        radix *= p
        if radix > 2 * most:
            return scores
    raise AssertionError("the primes do not reach the largest score")


def best_places(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the k highest scores of each row, ties to the earlier place."""
    if scores.shape[1] > k:
        cutoff = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        x, y = np.nonzero(scores >= cutoff[:, None])
    else:
        x, y = (i.ravel() for i in np.indices(scores.shape))
    order = np.lexsort((y, -scores[x, y], x))
    x, y = x[order], y[order]
    keep = np.arange(len(x)) - np.searchsorted(x, x) < k
    return x[keep], y[keep]


def _pack(per_chunk: int, with_positives: bool):
    """Rows of a partition -> chunks of at most per_chunk numbers, each ordered by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            lists = batch["vector"]
            sizes = np.diff(lists.offsets.to_numpy())
            rows = max(1, per_chunk // max(1, int(sizes.max(initial=0))))
            order = np.argsort(batch["vec_id"].to_numpy(), kind="stable")
            for at in range(0, batch.num_rows, rows):
                some = batch.take(pa.array(order[at : at + rows]))
                vectors = some["vector"]
                sizes = np.diff(vectors.offsets.to_numpy())
                width = int(sizes.max(initial=0))
                matrix = np.zeros((len(sizes), width), np.int64)
                matrix[np.arange(width)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy()
                least = np.min_scalar_type(-int(np.abs(matrix).max(initial=0)) - 1)
                cols = {
                    "place": pa.array([(part << 32) + made], pa.int64()),
                    "width": pa.array([width], pa.int32()),
                    "ids": pa.array([some["vec_id"].to_numpy().tobytes()], pa.binary()),
                    "labels": pa.array([some["label"].to_numpy().tobytes()], pa.binary()),
                    "vectors": pa.array([matrix.astype(least).tobytes()], pa.binary()),
                }
                if with_positives:
                    cols["tags"] = pa.array([some["tag"].to_numpy().tobytes()], pa.binary())
                    cols["found"] = pa.array([some["found"].to_pylist()], pa.list_(some["found"].type))
                yield pa.RecordBatch.from_pydict(cols)
                made += 1

    return run


def _open(chunk: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(chunk["ids"], np.int64), np.frombuffer(chunk["labels"], np.int64)
    cells = len(ids) * chunk["width"]
    kind = np.dtype(f"i{len(chunk['vectors']) // cells}") if cells else np.dtype("i8")
    return ids, labels, np.frombuffer(chunk["vectors"], kind).reshape(len(ids), chunk["width"]).astype(np.int64)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shorter vectors go on with zeros, which add nothing: cut to the shorter width."""
    width = min(a.shape[1], b.shape[1])
    return a[:, :width], b[:, :width]


def _positives(k: int):
    """For each anchor, the k best rows of its own label in this chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        for anchors in left.to_pylist():
            a_ids, a_labels, a = _open(anchors)
            tags = np.frombuffer(anchors["tags"], np.int64)
            for rows in right.to_pylist():
                ids, labels, b = _open(rows)
                for label in np.intersect1d(a_labels, labels):
                    mine, theirs = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
                    for at in range(0, len(mine), AT_ONCE):
                        q = mine[at : at + AT_ONCE]
                        scores = exact_scores(*_same_width(a[q], b[theirs]))
                        scores[a_ids[q][:, None] == ids[theirs][None, :]] = -LARGEST
                        x, y = best_places(scores, k)  # ids ascend with their places
                        keep = scores[x, y] > -LARGEST
                        x, y = x[keep], y[keep]
                        out.append((a_ids[q[x]], tags[q[x]], ids[theirs[y]], scores[x, y]))
        return _table(out, ("anchor_id", "tag", "positive_id", "positive_score"))

    return run


def _negatives(k: int, low: int, high: int):
    """For each anchor and positive, the k best rows of other labels inside the window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        for anchors in left.to_pylist():
            a_ids, a_labels, a = _open(anchors)
            tags = np.frombuffer(anchors["tags"], np.int64)
            # Every positive is one row: whose it is, its place, id and score.
            found = [(i, n, p["positive_id"], p["positive_score"]) for i, ps in enumerate(anchors["found"]) for n, p in enumerate(ps)]
            if not found:
                continue
            owner, place, pos_id, pos = (np.array(c, np.int64) for c in zip(*found, strict=True))
            least, most = -(-(low * pos) // 100), high * pos // 100
            for rows in right.to_pylist():
                ids, labels, b = _open(rows)
                for at in range(0, len(a_ids), AT_ONCE):
                    q = np.arange(at, min(at + AT_ONCE, len(a_ids)))
                    scores = exact_scores(*_same_width(a[q], b))
                    other = (a_labels[q][:, None] != labels[None, :]) & (a_ids[q][:, None] != ids[None, :])
                    begin, end = np.searchsorted(owner, [at, at + len(q)])
                    for i in range(begin, end):
                        line = scores[owner[i] - at]
                        inside = np.flatnonzero((line >= least[i]) & (line <= most[i]) & other[owner[i] - at])
                        inside = inside[best_places(line[None, inside], k)[1]]
                        n = len(inside)
                        out.append((np.full(n, a_ids[owner[i]]), np.full(n, tags[owner[i]]), np.full(n, place[i]), np.full(n, pos_id[i]), np.full(n, pos[i]), ids[inside], line[inside]))
        return _table(out, ("anchor_id", "tag", "place", "positive_id", "positive_score", "negative_id", "negative_score"))

    return run


def _table(out: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.Table:
    cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(len(names))]
    return pa.table({n: pa.array(c.astype(np.int64), pa.int64()) for n, c in zip(names, cols, strict=True)})


def _numbered(packed: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Chunks numbered from 0 without a gap, and how many there are.

    The driver reads how many chunks each partition made, one number a partition.
    """
    part = F.shiftright("place", 32)
    sizes = sorted((r[0], r[1]) for r in packed.groupBy(part).agg(F.count("*")).collect())
    before, total = [], 0
    for at, size in sizes:
        before += [F.lit(at), F.lit(total)]
        total += size
    offset = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    return packed.withColumn(name, (offset + F.col("place").bitwiseAND((1 << 32) - 1)).cast("int")), total


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    factor: int = FACTOR,
    components: int = COMPONENTS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(factor * x); a score is the integer inner product with the
    anchor, higher ones first, ties by the smaller id. An anchor's positives are its first
    `positives` rows of the same label with another id. For each, the first `negatives` rows of
    different labels, again with another id, come whose score is between `low` and `high`
    hundredths of the positive's.

    Defined cases: rows with a null id, label or vector, or with a component that is null or
    not finite, take no part; shorter vectors go on with zeros; rows that repeat an id are
    candidates each, and are anchors once if label and vector are equal; fewer positives
    or negatives are all returned; a positive with a score below zero has no window; scores of
    2 ** 56 or more raise an error; an empty table gives no rows; other columns are not read.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & label.isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        scaled(F.col(vector_col), factor).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    rows = cut_lineage(rows)
    asked = rows.where("asks").select("vec_id", "label", "vector").dropDuplicates()
    asked = cut_lineage(asked.withColumn("tag", F.xxhash64("label", "vector")))
    held, n_held = _numbered(cut_lineage(rows.select("vec_id", "label", "vector").mapInArrow(_pack(components, False), PACKED)), "site")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    found_type = "array<struct<positive_id:long,positive_score:long>>"

    def meet(anchors: DataFrame, run, schema: str) -> DataFrame:
        packed = cut_lineage(anchors.mapInArrow(_pack(components, True), f"{PACKED}, tags binary, found array<{found_type}>"))
        packed, n = _numbered(packed, "block")
        if not n or not n_held:
            return vectors.sparkSession.createDataFrame([], schema)
        left = packed.select("*", every(n_held, "site")).groupBy("block", "site")
        return left.cogroup(held.select("*", every(n, "block")).groupBy("block", "site")).applyInArrow(run, schema)

    best = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("positive_score"), "positive_id")
    first = meet(
        asked.withColumn("found", F.array().cast(found_type)),
        _positives(positives), "anchor_id long, tag long, positive_id long, positive_score long",
    )
    first = first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    listed = first.groupBy("anchor_id", "tag").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))),
            lambda p: F.struct(p.positive_id.alias("positive_id"), p.positive_score.alias("positive_score")),
        ).alias("found")
    )
    opened = asked.join(listed.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "tag"])
    names = ("anchor_id", "tag", "place", "positive_id", "positive_score", "negative_id", "negative_score")
    second = meet(
        opened.select("vec_id", "label", "vector", "tag", "found"),
        _negatives(negatives, low, high), ", ".join(f"{n} long" for n in names),
    )
    hardest = Window.partitionBy("anchor_id", "tag", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (
        second.withColumn("rank", F.row_number().over(hardest))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
