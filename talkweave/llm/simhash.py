"""SimHash near-dedup with bit-sliced comparison.

Fingerprints come from hashed word shingles. Two fingerprints within `radius`
bits agree on at least BLOCKS - radius of BLOCKS bit ranges, so every close pair
shares one of the C(BLOCKS, radius) band keys. Only distinct fingerprints take part,
so copies cost nothing. A band bucket is compared in vertical form: bit b of all
its fingerprints is one row of packed words, a shifted XOR of the rows gives that
bit's difference for 64 pairs at a time, and carry-save counters add the rows up.
A shift is abandoned as soon as all its pairs are over the radius.

A bucket returns a forest over its close pairs, not the pairs; large buckets are
cut into parts that meet pairwise in separate tasks, so no task holds more than
two parts. Components follow by alternating star contraction.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh

WORDS = 4
RADIUS = 4
SEED = 42
BLOCKS = 6
PART = 4096  # fingerprints of one bucket that are compared at once
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SIGN = np.uint64(1 << 63)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 if over half of the shingle hashes have it; without words it is 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = (fingerprint(t.as_py(), words, seed) for t in batch.column(1))
            bits = np.fromiter(made, np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def band_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks of which close fingerprints must agree on one at least."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    ranges = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [sum(chosen) for chosen in itertools.combinations(ranges, blocks - radius)]


def _planes(fps: np.ndarray) -> np.ndarray:
    """Row b holds bit b of every fingerprint, 64 of them to a word, one spare word at the end.

    A fingerprint is a word of 64 bits, or a row of such words.
    """
    n = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    padded = np.zeros((len(bits), (n + 63) // 64 * 64 + 64), np.uint8)
    padded[:, :n] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def close_at_shift(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Packed flags of the rows i whose distance to row i + shift is at most radius; valid limits the rows."""
    words, bits = divmod(shift, 64)
    width = planes.shape[1] - words - 1
    alive = valid[:width].copy()
    low, high = np.uint64(bits), np.uint64(64 - bits)
    counters = [np.zeros(width, np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(width, np.uint64)
    for start in range(0, len(planes), 8):
        for b in range(start, start + 8):
            moved = planes[b, words : words + width]
            if bits:
                moved = (moved >> low) | (planes[b, words + 1 : words + 1 + width] << high)
            carry = planes[b, :width] ^ moved
            for k in range(len(counters)):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
        # Compare the counters with the radius, bit by bit from the top.
        greater, equal = over.copy(), ~over
        for k in range(len(counters) - 1, -1, -1):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                greater |= equal & counters[k]
                equal &= ~counters[k]
        alive &= ~greater
        over |= greater
        if not alive.any():
            break
    return alive


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(fps: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges between fingerprints of one word each, see `spanning`."""
    return [(int(fps[a]), int(fps[b])) for a, b in spanning(fps, bucket, side, radius)]


def spanning(fps: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Places of edges that span the close pairs of different sides inside the runs of `bucket`.

    Pairs that are connected already are not compared again.
    """
    n = len(fps)
    edges: list[tuple[int, int]] = []
    parent = np.arange(n)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    size_of = np.repeat(sizes, sizes)
    after = size_of - 1 - (np.arange(n) - np.repeat(starts, sizes))  # rows behind this one in its run
    held, planes = None, None
    for shift in range(1, int(sizes.max(initial=1))):
        if held is None or np.count_nonzero(size_of[held] > shift) < 0.7 * len(held):
            held = np.flatnonzero(size_of > shift)  # runs go whole, so rows that are `shift` apart stay so
            planes = _planes(fps[held])
        at = np.flatnonzero(after[held] >= shift)
        a, b = held[at], held[at + shift]
        at = at[(side[a] != side[b]) & (parent[a] != parent[b])]
        flags = np.zeros(planes.shape[1] * 64, np.uint8)
        flags[at] = 1
        found = close_at_shift(planes, shift, np.packbits(flags, bitorder="little").view(np.uint64), radius)
        hits = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
        for a, b in zip(held[hits].tolist(), held[hits + shift].tolist(), strict=True):
            x, y = _root(parent, a), _root(parent, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((a, b))
        while len(hits) and (parent != (up := parent[parent])).any():
            parent = up
    return edges


Found = tuple[np.ndarray, np.ndarray]


def by_meeting(solve: Callable[[pa.Table, np.ndarray, np.ndarray], Found], flush: int = 1 << 16):
    """Batches sorted by (band, key, i, j) -> edges. Only whole runs are compared, the last waits for its end.

    solve: rows, the run of each, its side -> both ends of each edge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def edges(held: pa.Table) -> pa.RecordBatch:
            cols = [held[c].to_numpy() for c in ("band", "key", "i", "j")]
            new = np.zeros(held.num_rows, bool)
            new[:1] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            mine = held["part"].to_numpy()
            # Only pairs of different parts in a meeting of two; all pairs in a part's own meeting.
            side = np.where(cols[2] == cols[3], np.arange(held.num_rows), -1 - mine.astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in solve(held, np.cumsum(new), side)], names=["a", "b"])

        for batch in batches:
            waiting.append(batch)
            if sum(x.num_rows for x in waiting) < flush:
                continue
            held = pa.Table.from_batches(waiting)
            last = np.ones(held.num_rows, bool)
            for c in ("band", "key", "i", "j"):
                values = held[c].to_numpy()
                last &= values == values[-1]
            cut = int(np.argmax(last))
            if cut:
                yield edges(held.slice(0, cut))
            waiting = held.slice(cut).combine_chunks().to_batches()
        if any(x.num_rows for x in waiting):
            yield edges(pa.Table.from_batches(waiting))

    return run


def _links(radius: int):
    def solve(held: pa.Table, run: np.ndarray, side: np.ndarray) -> Found:
        fps = held["fp"].to_numpy().astype(np.int64).view(np.uint64)
        found = np.array(forest(fps, run, side, radius), np.uint64).reshape(-1, 2)
        return found[:, 0].copy().view(np.int64), found[:, 1].copy().view(np.int64)

    return by_meeting(solve)


def meetings(banded: DataFrame, node: str, part: int, *more: str) -> DataFrame:
    """band, key, node -> rows of buckets with two nodes at least, sorted by band, key and the parts (i, j) that meet."""
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.xxhash64(node), F.col("parts")).cast("int")
    met = banded.join(sizes, ["band", "key"]).withColumn("parts", parts).withColumn("part", own)
    # Part p meets itself and every other part: (p, p), (p, q) for q > p, (q, p) for q < p.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = met.select("band", "key", node, *more, "part", other).select(
        "band", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", node, *more
    )
    return met.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")


def near_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """fp (distinct) -> a, b: enough close pairs to connect whatever is connected."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in band_masks(radius, blocks)])
    banded = distinct.select("fp", F.posexplode(masks).alias("band", "mask")).select(
        "fp", "band", F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    )
    return meetings(banded, "fp", part).mapInArrow(_links(radius), "a long, b long").where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """a, b -> node, root (the smallest node of its component), for nodes that have a link.

    Large-star and small-star in turn: neighbours move to the smallest node known,
    until nothing changes. Edge sets are written between rounds.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        pairs = large.join(low, "v")
        small = pairs.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(pairs.select("v", F.col("m").alias("u")))
        edges = cut_lineage(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node").unionByName(
                edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            )
        before = now


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    seed: int = SEED,
    blocks: int = BLOCKS,
    part: int = PART,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row.

    component_id is the smallest id that chains of fingerprints within `radius`
    bits reach, the row's own included. Defined cases: null, empty and blank
    texts have fingerprint zero, which links like any other; texts of fewer than
    `words` words are one shingle; equal fingerprints are always linked; rows
    that repeat an id count as documents of their own; a null id never names a component
    unless all its ids are null; an empty table gives no rows; other columns are
    not read.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, words, seed))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(distinct.select("fp"), radius, blocks, part))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    where = cut_lineage(named.join(lowest, "root").select("fp", "component_id"))
    return marked.join(where, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
