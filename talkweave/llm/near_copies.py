"""One document of each group of near copies, by wide SimHash fingerprints.

Texts that share 0.8 of their five-word shingles differ in about 15 % of the bits of
a SimHash, too many for the bands of 64 bits and too few bits to tell 0.8 from 0.6.
So a fingerprint here has LANES words of 64 bits, and the buckets in which
fingerprints are compared come from the smallest of the shingles' hashes: each of
BANDS keys is made of PICKS minima, so texts of similarity s meet with
1 - (1 - s**PICKS)**BANDS: 0.998 at 0.8. The comparison is that of `simhash`: bit planes,
carry-save counters, blocks abandoned beyond the radius, large buckets in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh
from .simhash import LOWER, PART, by_meeting, components, meetings, spanning

WORDS = 5
LANES = 4  # words of 64 bits in a fingerprint
RADIUS = 46  # of 256 bits: 39 differ on average at a similarity of 0.8, 59 at 0.6, 68 at 0.5
BANDS = 12
PICKS = 4
SEED = 42
CHUNK = 1 << 13  # shingles looked at at once
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


SALTS = _mix(np.arange(1, LANES + BANDS * PICKS + 1, dtype=np.uint64) * ODD)


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle; a text of fewer words is one shingle, a text without words has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def wide_print(text: str | None, words: int = WORDS, seed: int = SEED) -> tuple[bytes, list[int]]:
    """The fingerprint and the keys of the buckets in which it is compared.

    Shingles count once, as in the similarity. Without words both are zero.
    """
    hashes = np.unique(shingle_hashes(text, words, seed))
    ones = np.zeros(64 * LANES, np.int64)
    least = np.full(BANDS * PICKS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        lanes = _mix(part[:, None] ^ SALTS[None, :LANES])
        ones += np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for k in range(BANDS * PICKS):
            least[k] = min(least[k], ((part ^ SALTS[LANES + k]) * ODD).min())
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()
    if not len(hashes):
        return bits, [0] * BANDS
    rows = np.ascontiguousarray(least.reshape(BANDS, PICKS))
    return bits, [xxhash.xxh64_intdigest(r.tobytes(), seed) - (1 << 63) for r in rows]


def wide_prints(rows: DataFrame, keep: list[str], text_col: str, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """The columns to keep, fp (bits as binary) and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [wide_print(t.as_py(), words, seed) for t in batch.column(0)]
            more = [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *more], names=[*batch.schema.names[1:], "fp", "keys"])

    body = rows.select(F.col(text_col).cast("string").alias("llm_text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema.fields[1:])
    return body.mapInArrow(run, f"{kinds}, fp binary, keys array<bigint>")


def _links(radius: int):
    def solve(held: pa.Table, run: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(held["fp"].to_pylist())
        edges = spanning(np.frombuffer(raw, np.uint64).reshape(-1, LANES), run, side, radius)
        found = np.array(edges, np.int64).reshape(-1, 2)
        nodes = held["node"].to_numpy()
        return nodes[found[:, 0]], nodes[found[:, 1]]

    return by_meeting(solve)


def wide_links(prints: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """node, fp, keys -> a, b: enough close pairs to connect whatever meets in a bucket and is within the radius."""
    banded = prints.select("node", "fp", F.posexplode("keys").alias("band", "key"))
    return meetings(banded, "node", part, "fp").mapInArrow(_links(radius), "a long, b long").where("a <> b").distinct()


def only_numbered(rows: DataFrame, number: str, chosen: DataFrame) -> DataFrame:
    """Rows whose number is among those of `chosen`, one bit each, 64 to a word.

    Both sides have the column `number` (long, distinct in `chosen`). A row costs a quarter of a byte
    of keys and bits, so it takes far larger tables before rows are sorted to meet them.
    """
    word, bits = fresh(rows, "llm_word"), fresh(rows, "llm_bits")
    of = lambda name: F.shiftright(F.col(name), 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(number).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = cut_lineage(chosen.groupBy(of(number).alias(word)).agg(F.bit_or(bit).alias(bits)))
    met = rows.join(words, of(number) == F.col(word))
    return met.where(F.col(bits).bitwiseAND(bit) != 0).drop(word, bits)


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    seed: int = SEED,
    part: int = PART,
) -> DataFrame:
    """Documents without near copies: one row of each component stays, all columns as they were.

    It is the row with the smallest id, null after all others; of rows that share
    that id, the one with the smallest hash of the row, and of equal rows any.
    Defined cases: null, empty and blank texts are copies of each other; texts of
    fewer than `words` words are one shingle; rows that repeat an id count as
    documents of their own; an empty table gives no rows.
    """
    who = fresh(docs, "llm_row")
    # Written, so that a row has the same number whenever it is read.
    rows = cut_lineage(docs.withColumn(who, F.monotonically_increasing_id()))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rank = F.struct(
        F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(*hashed).alias("hash"), F.col(who).alias("row")
    )
    marked = wide_prints(rows.select(rank.alias("rank"), F.col(f"`{text_col}`").alias("text")), ["rank"], "text", words, seed)
    # Equal prints are one node, so copies cost nothing further.
    nodes = marked.groupBy("fp", "keys").agg(F.min("rank").alias("first"))
    nodes = cut_lineage(nodes.withColumn("node", F.col("first.row")))
    roots = components(wide_links(nodes.select("node", "fp", "keys"), radius, part)).withColumnRenamed("node", "linked")
    named = nodes.select("node", "first").join(roots, F.col("node") == F.col("linked"), "left")
    lowest = named.groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    stays = lowest.select(F.col("first.row").alias(who))
    return only_numbered(rows, who, stays).select(*[f"`{c}`" for c in docs.columns])
