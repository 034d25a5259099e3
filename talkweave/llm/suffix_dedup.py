"""Suffix-array dedup: bytes of repeated strings of `length` bytes, over all documents.

Every start of a `length`-byte string picks the smallest hash among the
KMER-byte strings inside it. Equal strings pick equal hashes, so strings with
different hashes need never meet. Neighbouring starts mostly pick the same one; such
a run is a segment.

1. Segments are listed as (hash, document, place); a document is its id and 64 bits of its text's hash. A task keeps its own repeats
   apart and sends one row a hash, so a frequent hash is a few rows; only
   segments whose hash occurs again anywhere go on.
2. The bytes of these are cut from their documents, equal ones of a task are
   merged, and what is left goes to the shard of its hash.
3. A shard takes about CHUNK bytes of whole hashes, merges equal segments into the
   first one, builds the suffix array by induced sorting and the permuted
   common prefixes, and marks in each run of suffixes with `length` bytes in
   common the one that is first in the corpus.
4. Hashes with over HOT bytes of different segments (one passage in many different
   surroundings) are not gathered: their strings are grouped one by one, which
   combines before it shuffles and gives the same marks.

A start of a listed segment that was not marked as first has an earlier equal
string; `length` bytes from it go. Texts travel twice, compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 100
KMER = 32
CHUNK = 1 << 20  # bytes of one suffix array
HOT = 4 << 20  # bytes of segments with one hash that a shard gathers at most
BLOCK = 1 << 18  # bytes hashed at once
LOWEST = -(1 << 63)
PLACE_BITS, RUN_BITS = 31, 12  # of `at`: place, length of the run, 1 bit: a string may be twice inside
MAX_RUN = (1 << RUN_BITS) - 1
BYTES = np.random.default_rng(20240101).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
STEP = np.uint64(0x9E3779B97F4A7C15)


def kmer_hashes(data: np.ndarray, kmer: int) -> np.ndarray:
    """A 64-bit hash of every string of kmer bytes."""
    parts, width, hashes = [], 1, BYTES[data]
    while True:
        if kmer & width:
            parts.append((width, hashes))
        if width * 2 > kmer:
            break
        factor = STEP + np.uint64(2 * width)
        hashes = hashes[:-width] * factor + hashes[width:] if len(hashes) > width else hashes[:0]
        width *= 2
    n, at = max(0, len(data) - kmer + 1), 0
    out = np.zeros(n, np.uint64)
    for width, hashes in parts:
        out = out * STEP + hashes[at : at + n]
        at += width
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:]) if len(out) > reach else out[:0]
        reach *= 2
    rest = width - reach
    return np.minimum(out[:-rest], out[rest:]) if rest and len(out) > rest else out if not rest else out[:0]


def segments(texts: list[bytes], length: int, kmer: int) -> tuple[np.ndarray, ...]:
    """hash, text, place, run of each segment: runs of starts that pick the same hash.

    The fifth array tells which segments may hold a string twice: those whose
    hash is picked at more than one place (the leftmost counts, which is the same in
    equal strings).
    """
    found: list[tuple[np.ndarray, ...]] = []
    step = max(BLOCK, 4 * length)
    batch: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        sizes = np.array([len(b) for _, _, b in batch])
        first = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(b for _, _, b in batch), np.uint8)
        hashes = kmer_hashes(data, kmer)
        bits = np.uint64(len(data).bit_length())
        ranked = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        least = window_minima(ranked, length - kmer + 1) & ((np.uint64(1) << bits) - np.uint64(1))
        if not len(least):
            return
        picked = hashes[least]
        owner = np.repeat(np.arange(len(batch)), sizes)[: len(picked)]
        place = np.arange(len(picked)) - first[owner]
        inside = place + length <= sizes[owner]  # strings that run into the next text do not count
        new = np.ones(len(picked), bool)
        new[1:] = (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        begins = np.flatnonzero(new)
        long = np.diff(np.r_[begins, len(picked)]) > MAX_RUN
        if long.any():
            for b, e in zip(begins[long].tolist(), np.r_[begins, len(picked)][1:][long].tolist(), strict=True):
                new[b:e:MAX_RUN] = True
            begins = np.flatnonzero(new)
        runs = np.diff(np.r_[begins, len(picked)])
        moved = np.zeros(len(picked), np.int64)
        moved[1:] = (least[1:] != least[:-1]) & ~new[1:]
        twice = np.add.reduceat(moved, begins) > 0
        keep = inside[begins]
        begins, runs = begins[keep], runs[keep]
        text = np.array([t for t, _, _ in batch])[owner[begins]]
        start = np.array([a for _, a, _ in batch])[owner[begins]] + place[begins]
        found.append((picked[begins], text, start, runs, twice[keep]))

    size = 0
    for t, text in enumerate(texts):
        # A long text goes in pieces that overlap by a string less one byte, so every start is seen once.
        for at in range(0, max(len(text) - length + 1, 0), step):
            batch.append((t, at, text[at : at + step + length - 1]))
            size += len(batch[-1][2])
            if size >= step:
                flush()
                batch.clear()
                size = 0
    if batch:
        flush()
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(5))


def pack(place, run, twice=0):
    return (place << (RUN_BITS + 1)) | (run << 1) | twice


def unpack(at):
    return at >> (RUN_BITS + 1), (at >> 1) & MAX_RUN


def _list_segments(length: int, kmer: int, portion: int = 8 << 20):
    """d, tag, text -> hash, d, tag, at, known: 0 once in this portion, 1 first of several (or a string twice inside), 2 a later one."""

    def rows(d: np.ndarray, tag: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        key, text, place, run, twice = segments(texts, length, kmer)
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.ones(len(key), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        many = np.ones(len(key), bool)
        many[:-1] = ~new[1:]
        many[-1:] = False
        known = np.where(new, np.where(many | twice[order], 1, 0), 2).astype(np.int8)
        at = pack(place, run, twice)[order]
        cols = [sorted_.view(np.int64), d[text][order], tag[text][order], at, known]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "d", "tag", "at", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, tag = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            texts, begin, size = [], 0, 0
            for i, text in enumerate(batch.column(2)):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= portion or i == batch.num_rows - 1:
                    yield rows(d[begin : i + 1], tag[begin : i + 1], texts)
                    texts, begin, size = [], i + 1, 0

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their key -> rows whose key occurs again or is known to."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key, known = batch.column(0).to_numpy(), batch.column(4).to_numpy()
        same = key[1:] == key[:-1]
        keep = known > 0
        keep[1:] |= same
        keep[:-1] |= same
        # The last row waits for the next batch, where its like may be; what is decided stays so.
        held = batch.slice(batch.num_rows - 1)
        held = held.set_column(4, "known", pa.array(keep[-1:].astype(np.int8)))
        keep[-1] = False
        yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))
    if held is not None and held.column(4)[0].as_py() > 0:
        yield held.select([0, 1, 2, 3])


def _unpacked(z: bytes) -> bytes:
    return zstandard.decompress(z) if z else b""


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = [tool.compress(t.as_buffer()) if len(t.as_buffer()) else b"" for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], names=["d", "tag", "doc_id", "z"])


def _cut(length: int):
    """d, tag, z, list of (key, at) -> key, segment, d, tag, at: the first of equal segments of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, tuple[int, int, int, int]] = {}
            lists = batch.column(3)
            offsets, inner = lists.offsets.to_numpy(), lists.values
            keys, ats = (inner.field(k).to_numpy() for k in (0, 1))
            for i, (d, tag, z) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                text = _unpacked(z)
                part = slice(int(offsets[i]), int(offsets[i + 1]))
                place, n = unpack(ats[part])
                for key, at, p, e in zip(keys[part].tolist(), ats[part].tolist(), place.tolist(), (place + n + length - 1).tolist(), strict=True):
                    mine = (d, tag, at, key)
                    there = first.setdefault(text[p:e], mine)
                    if mine < there:
                        first[text[p:e]] = mine
            d, tag, at, key = (pa.array([x[k] for x in first.values()], pa.int64()) for k in range(4))
            cols = [key, pa.array(list(first), pa.binary()), d, tag, at]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "segment", "d", "tag", "at"])

    return run


def first_starts(
    segs: list[bytes], key: np.ndarray, d: np.ndarray, tag: np.ndarray, at: np.ndarray, length: int
) -> tuple[np.ndarray, ...]:
    """d, tag, start, run: the starts whose string is nowhere earlier in these segments.

    A segment that is the only one of its hash, and picks it at one place, has no
    string in common with any other or with itself: it is not sorted.
    """
    first: dict[bytes, int] = {}
    for i, seg in enumerate(segs):
        j = first.setdefault(seg, i)
        if j != i and (d[i], tag[i], at[i]) < (d[j], tag[j], at[j]):
            first[seg] = i
    rows = np.fromiter(first.values(), np.int64, len(first))
    _, group, members = np.unique(key[rows], return_inverse=True, return_counts=True)
    alone = (members[group] == 1) & (at[rows] & 1 == 0)
    single, rows = rows[alone], rows[~alone]
    known = (d[single], tag[single], *unpack(at[single]))
    if not len(rows):
        return known
    found = _sorted_starts([segs[i] for i in rows.tolist()], d[rows], tag[rows], at[rows], length)
    return tuple(np.concatenate(c) for c in zip(known, found, strict=True))


def _sorted_starts(segs: list[bytes], d: np.ndarray, tag: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The same for different segments, by their suffix array."""
    place, _ = unpack(at)
    sizes = np.array([len(s) for s in segs])
    text = np.frombuffer(b"\x00".join(segs), np.uint8).astype(np.uint16) + 2
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.append(text, np.uint16(0))
    text[begin[1:] - 1] = 1  # between segments
    order = suffix_array(text, 258)
    shared = permuted_common_prefixes(text, order)
    owner = np.repeat(np.arange(len(segs)), sizes + 1)
    inner = np.arange(len(text)) - begin[owner]
    whole = inner + length <= sizes[owner]
    # Documents by number, places below: one comparable value a start.
    by = np.lexsort((tag, d))
    new = np.ones(len(by), bool)
    new[1:] = (d[by][1:] != d[by][:-1]) | (tag[by][1:] != tag[by][:-1])
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(new)
    value = (number[owner] << PLACE_BITS) | (place[owner] + inner)
    ordered = order[whole[order]]
    heads = np.ones(len(ordered), bool)
    heads[1:] = shared[ordered[1:]] < length
    # Nothing stands between two suffixes that share `length` bytes but suffixes that share them too.
    least = np.minimum.reduceat(value[ordered], np.flatnonzero(heads)) if len(ordered) else value[:0]
    is_first = np.zeros(len(text) + 1, bool)
    is_first[ordered] = value[ordered] == least[np.cumsum(heads) - 1]
    edges = np.flatnonzero(is_first[1:-1] != is_first[:-2]) + 1
    if is_first[0]:
        edges = np.r_[0, edges]
    starts, stops = edges[::2], edges[1::2]
    own = owner[starts]
    return d[own], tag[own], place[own] + inner[starts], stops - starts


def _shards(length: int, chunk: int):
    def solve(held: pa.Table) -> pa.RecordBatch:
        key, d, tag, at = (held[c].to_numpy() for c in ("key", "d", "tag", "at"))
        cols = first_starts(held["segment"].to_pylist(), key, d, tag, at, length)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d", "tag", "start", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            # Batches are cut small, so that a chunk is near its size.
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                waiting.append(part)
                size += int(pc.sum(pc.binary_length(part.column(1))).as_py() or 0)
                if size < chunk:
                    continue
                held = pa.Table.from_batches(waiting)
                key = held["key"].to_numpy()
                cut = int(np.argmax(key == key[-1]))
                if cut:
                    yield solve(held.slice(0, cut))
                    waiting = held.slice(cut).combine_chunks().to_batches()
                    size = sum(int(pc.sum(pc.binary_length(x.column(1))).as_py() or 0) for x in waiting)
        if any(x.num_rows for x in waiting):
            yield solve(pa.Table.from_batches(waiting))

    return run


def _strings(length: int):
    """Segments of a hot hash -> digest of each of their strings, d, tag, start: the first of equal ones of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, tuple[int, int, int]] = {}
            for seg, d, tag, at in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                place, run_ = unpack(at)
                for k in range(run_):
                    digest = hashlib.blake2b(seg[k : k + length], digest_size=16).digest()
                    mine = (d, tag, place + k)
                    first[digest] = min(mine, first.get(digest, mine))
            cols = [pa.array([x[k] for x in first.values()], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.binary()), *cols], names=["digest", "d", "tag", "start"])

    return run


def removed_spans(size: int, listed: np.ndarray, fresh_starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal runs that go. listed, fresh_starts: rows of (start, run)."""
    if not len(listed):
        return []
    gone = np.zeros(size + 1, bool)
    for start, run in listed.tolist():
        gone[start : start + run] = True
    for start, run in fresh_starts.tolist():
        gone[start : start + run] = False
    starts = np.flatnonzero(gone)
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    first, last = np.r_[starts[0], starts[breaks + 1]], np.r_[starts[breaks], starts[-1]]
    return list(zip(first.tolist(), (last + length - first).tolist(), strict=True))


def _finish(length: int):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, kept, spans = [], [], []
                for z, listed, fresh_ in zip(*(part.column(k) for k in (1, 2, 3)), strict=True):
                    text = _unpacked(z.as_py())
                    rows = listed.values.to_numpy() if listed.is_valid else np.zeros(0, np.int64)
                    place, n = unpack(rows)
                    new = np.zeros((0, 2), np.int64)
                    if fresh_.is_valid:
                        new = np.stack([fresh_.values.field(k).to_numpy() for k in (0, 1)], axis=1)
                    gone = removed_spans(len(text), np.stack([place, n], axis=1), new, length)
                    cuts = [0, *(x for a, n in gone for x in (a, a + n)), len(text)]
                    sizes.append(len(text))
                    kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                    spans.append([{"start": a, "length": n} for a, n in gone])
                cols = [part.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, spans_type)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "kept", "spans"])

    return run


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    kmer: int = KMER,
    chunk: int = CHUNK,
    hot: int = HOT,
) -> DataFrame:
    """doc_id, n_bytes, kept (binary), spans (array of start, length in bytes): one row per input row.

    A byte goes if a string of `length` bytes that covers it also starts earlier:
    in a smaller id, or before it in the same text. Defined cases: a null text
    is empty; texts shorter than `length` stay; ids are integers, null is
    smaller than any; rows that repeat an id with other texts are ordered by a hash of
    the text, rows that repeat id and text are one document and each gets its
    result; kept bytes may end inside a character; texts are below 2 GB; an
    empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("d"),
        F.xxhash64(text).alias("tag"),
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
    )
    listed = rows.select("d", "tag", "text").mapInArrow(_list_segments(length, kmer), "key long, d long, tag long, at long, known byte")
    target = F.when(F.col("known") == 2, F.xxhash64("d", "tag", "at")).otherwise(F.col("key"))
    dealt = listed.withColumn("target", target).repartition("target").drop("target").sortWithinPartitions("key")
    again = cut_lineage(dealt.mapInArrow(_repeated, "key long, d long, tag long, at long"))
    packed = rows.mapInArrow(_compress, f"d long, tag long, doc_id {id_type}, z binary")
    # Sets: rows that repeat id and text list the same segments, and each of them is given the list.
    by_doc = again.groupBy("d", "tag").agg(F.collect_set(F.struct("key", "at")).alias("found"))
    pieces = packed.select("d", "tag", "z").join(by_doc, ["d", "tag"]).select("d", "tag", "z", "found")
    cut = cut_lineage(pieces.mapInArrow(_cut(length), "key long, segment binary, d long, tag long, at long"))
    sizes = cut.groupBy("key").agg(F.sum(F.octet_length("segment")).alias("bytes"))
    # Written first, so that its size is known: few hot hashes are looked up without another shuffle.
    crowded = cut_lineage(sizes.where(F.col("bytes") > hot).select("key"))
    shards = cut.join(crowded, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    new = shards.mapInArrow(_shards(length, chunk), "d long, tag long, start long, run long")
    strings = cut.join(crowded, "key", "left_semi").mapInArrow(_strings(length), "digest binary, d long, tag long, start long")
    ones = strings.groupBy("digest").agg(F.min(F.struct("d", "tag", "start")).alias("f")).select(
        "f.*", F.lit(1).cast("long").alias("run")
    )
    new_by_doc = new.unionByName(ones).groupBy("d", "tag").agg(F.collect_set(F.struct("start", "run")).alias("new"))
    at_by_doc = again.groupBy("d", "tag").agg(F.collect_set("at").alias("listed"))
    marks = cut_lineage(at_by_doc.join(new_by_doc, ["d", "tag"], "left"))
    whole = packed.join(marks, ["d", "tag"], "left").select("doc_id", "z", "listed", "new")
    spans = "array<struct<start:bigint,length:bigint>>"
    return whole.mapInArrow(_finish(length), f"doc_id {id_type}, n_bytes long, kept binary, spans {spans}")
