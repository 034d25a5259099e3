"""Phrase collocation mining by direct-address tiling.

Words that occur `min_count` times or more are numbered by frequency, so common words have
small numbers. A chunk of text counts pairs of numbers in tiles of TILE x TILE: a tile
with many pairs is a dense table, addressed directly and filled by `bincount`; the
pairs of all other tiles are sorted and run together (coordinates and a count). Spark adds
the counts of all chunks. Pairs that are frequent over all texts go back to the chunks
that hold them, are ranked again by their frequency, and the pairs (frequent pair, word)
are counted in tiles the same way: these are the phrases of three words. A phrase
cannot occur more often than its parts, so nothing that may count is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .word_chunks import (
    BREAK, BREAK_WORD, CHUNK, UNKNOWN, number_by_count, occurrences, pack_rows, slices, unpack_rows,
    unpack_sequence, word_chunks,
)

MIN_COUNT = 10
TOP = 2000
COVERED = 50  # hundredths of a phrase's occurrences inside a longer one that drop it
SCALE = 1_000_000
SALTS = 64  # parts of a language whose best phrases meet
TILE = 512  # numbers on a side of a tile
HEAD = 64  # tiles on a side among which dense ones are looked for
DENSE = 8  # a tile is dense from TILE * TILE / DENSE pairs
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ENDS = b".,;:!?\n\x0b\x0c\r"
PIECES = bytes.maketrans(bytes(range(256)), bytes(ord(".") if c in ENDS else ord(" ") if c == 9 else LOWER[c] for c in range(256)))


def split_pieces(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words, with breaks between pieces."""
    for part in slices(text.translate(PIECES), b". "):
        yield [BREAK_WORD if w == b"." else w for w in part.replace(b".", b" . ").split()]


def count_tiles(first: np.ndarray, second: np.ndarray, tile: int = TILE, head: int = HEAD) -> tuple[np.ndarray, ...]:
    """(first, second, count) of the distinct pairs."""
    rows, columns = first // tile, second // tile
    near = (rows < head) & (columns < head)
    which = np.where(near, rows * head + columns, head * head)
    sizes = np.bincount(which, minlength=head * head + 1)[: head * head]
    out = []
    for dense in np.flatnonzero(sizes * DENSE >= tile * tile).tolist():
        here = np.flatnonzero(which == dense)
        which[here] = -1
        row, column = divmod(dense, head)
        table = np.bincount((first[here] - row * tile) * tile + second[here] - column * tile, minlength=tile * tile)
        cells = np.flatnonzero(table)
        out.append((cells // tile + row * tile, cells % tile + column * tile, table[cells]))
    rest = which >= 0
    pairs, counts = np.unique((first[rest] << 32) | second[rest], return_counts=True)
    out.append((pairs >> 32, pairs & 0xFFFFFFFF, counts))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class _Chunk:
    """A chunk's tokens as the numbers of the whole table, and which of them are counted."""

    def __init__(self, chunk: pa.Table, told: pa.Table) -> None:
        sequence = unpack_sequence(chunk["sequence"][0].as_py())
        local, number = unpack_rows(told, 1, 2)
        numbers = np.full(int(sequence.max(initial=0)) + 1, UNKNOWN, np.int64)
        numbers[BREAK] = BREAK
        numbers[local] = number
        self.numbers = numbers[sequence]
        self.ends = np.ones(len(sequence), bool)
        at = 0
        for text in chunk["texts"][0].as_py():
            self.ends[at : at + text["skip"]] = False
            at += text["length"]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of both words, and the place of the second, for pairs of known words."""
        ok = (self.numbers[:-1] > BREAK) & (self.numbers[1:] > BREAK)
        at = np.flatnonzero(ok) + 1
        return self.numbers[at - 1], self.numbers[at], at


def _pairs(chunk: pa.Table, told: pa.Table) -> pa.Table:
    pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if chunk.num_rows:
        read = _Chunk(chunk, told)
        a, b, at = read.pairs()
        counted = read.ends[at]
        a, b, n = count_tiles(a[counted], b[counted])
        pairs = (a << 32) | b
    id = chunk["chunk"][0].as_py() if chunk.num_rows else 0
    return pa.table({"chunk": np.full(len(pairs), id, np.int64), "pair": pairs, "n": n.astype(np.int64)})


def _triples(chunk: pa.Table, told: pa.Table) -> pa.Table:
    pairs, words, n = (np.zeros(0, np.int64) for _ in range(3))
    if chunk.num_rows:
        read = _Chunk(chunk, told)
        a, b, at = read.pairs()
        known, totals = unpack_rows(told, 2, 2)
        ranked = known[np.lexsort((known, -totals))]  # their place is the pair's new number
        by_code = np.argsort(ranked)
        code = (a << 32) | b
        found = np.minimum(np.searchsorted(ranked, code, sorter=by_code), max(0, len(ranked) - 1))
        rank = np.full(len(read.numbers), UNKNOWN, np.int64)  # of the pair that ends here
        if len(ranked):
            hit = ranked[by_code[found]] == code
            rank[at[hit]] = by_code[found[hit]]
        ends = np.flatnonzero((rank[:-1] >= 0) & (rank[1:] >= 0)) + 1
        ends = ends[read.ends[ends]]
        place, words, n = count_tiles(rank[ends - 1], read.numbers[ends])
        pairs = ranked[place] if len(ranked) else pairs
    return pa.table({"pair": pairs.astype(np.int64), "word": words.astype(np.int64), "n": n.astype(np.int64)})


def _score(whole: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (l * r)), exact for counts below 10 ** 16."""
    d = lambda c: f"cast({c} as decimal(16,0))"
    return F.expr(
        f"cast(cast({SCALE} as decimal(38,0)) * ({d(whole)} * {d(whole)}) as decimal(38,0)) div ({d(left)} * {d(right)})"
    )


def phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    top: int | None = TOP,
    covered: int = COVERED,
    tokens: int = CHUNK,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    Texts are lower-cased (A-Z), cut at `.,;:!?` and line ends into pieces and those at blanks
    and tabs into words. A phrase has two or three words of one piece and occurs `min_count`
    times or more in its language; a is that count, n the language's words. Of its cuts
    into a first part (l occurrences) and a rest (r) the one with the lowest
    floor(10**6 * a * a / (l * r)) counts, the earlier one if equal. A phrase goes if
    `covered` hundredths of its occurrences or more are those of one longer phrase around it.
    Rank is by score, then a, both descending, then the phrase in byte order.

    Defined cases: a null text is empty; null languages are one, `und`, together with that
    name; rows that repeat count each; a text without blanks or marks is one word; an empty
    table gives no rows; other columns are not read.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("grp"),
        F.lit(None).cast("long").alias("id"),
        F.lit(True).alias("counted"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    chunks = cut_lineage(word_chunks(texts, split_pieces, 2, False, tokens))
    seen = occurrences(chunks)
    counts = cut_lineage(seen.groupBy("grp", "word").agg(F.sum("n").alias("f")))
    sizes = counts.groupBy("grp").agg(F.sum("f").alias("n"))
    common = counts.where(F.col("f") >= min_count)
    words = cut_lineage(number_by_count(common, "f", ["grp", "word"]))

    told = seen.join(words, ["grp", "word"]).select("chunk", "local", F.col("number").cast("int").alias("number"))
    told = cut_lineage(pack_rows(told, 1))
    sequences = chunks.select("chunk", "sequence", "texts")

    def in_chunks(known: DataFrame, run, schema: str) -> DataFrame:
        return sequences.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, schema)

    # One exchange both adds up a pair and knows which chunks hold it.
    same = Window.partitionBy("pair")
    pairs = in_chunks(told, _pairs, "chunk long, pair long, n long")
    pairs = pairs.withColumns({"f": F.sum("n").over(same), "lead": F.min("chunk").over(same) == F.col("chunk")})
    held = cut_lineage(pairs.where(F.col("f") >= min_count).select("chunk", "pair", "f", "lead"))
    pairs = held.where("lead").select("pair", "f")
    back = pack_rows(held.select("chunk", "pair", "f"), 2)
    triples = in_chunks(told.unionByName(back), _triples, "pair long, word long, n long")
    triples = triples.groupBy("pair", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
    triples = cut_lineage(triples)

    first, last = F.shiftright("pair", 32), F.col("pair").bitwiseAND(0xFFFFFFFF)
    tail = F.shiftleft(last, 32).bitwiseOR(F.col("word"))
    named = lambda n: words.select(
        F.col("number").alias(f"w{n}"), F.col("word").cast("string").alias(f"t{n}"), F.col("f").alias(f"f{n}"), *(["grp"] if n == 1 else [])
    )
    of = lambda name: pairs.select(F.col("pair").alias(name), F.col("f").alias(f"{name}_f"))
    around = triples.select(F.explode(F.array("pair", tail)).alias("pair"), "a").groupBy("pair").agg(F.max("a").alias("around"))

    two = (
        pairs.join(around, "pair", "left")
        .where(F.coalesce(100 * F.col("around") < covered * F.col("f"), F.lit(True)))
        .select(F.col("f").alias("a"), first.alias("w1"), last.alias("w2"))
        .join(named(1), "w1").join(named(2), "w2")
        .select("grp", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
        .withColumn("score", _score("a", "l", "r"))
    )
    three = (
        triples.select("a", F.col("pair").alias("head"), tail.alias("rest"), first.alias("w1"), last.alias("w2"), F.col("word").alias("w3"))
        .join(of("head"), "head").join(of("rest"), "rest")
        .join(named(1), "w1").join(named(2), "w2").join(named(3), "w3")
        .withColumns({"s1": _score("a", "f1", "rest_f"), "s2": _score("a", "head_f", "f3")})
    )
    cut = F.col("s1") <= F.col("s2")
    three = three.select(
        "grp", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a",
        F.when(cut, F.col("f1")).otherwise(F.col("head_f")).alias("l"),
        F.when(cut, F.col("rest_f")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    found = two.unionByName(three)
    # First inside parts of a language, so that no task sorts all phrases of a common one.
    for group in ((["grp", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))], ["grp"]) if top is not None else (["grp"],)):
        best = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a"), "phrase")
        found = found.withColumn("rank", F.row_number().over(best))
        found = found if top is None else found.where(F.col("rank") <= top)
    return found.join(sizes, "grp").select(
        F.col("grp").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
