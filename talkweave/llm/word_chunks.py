"""Texts as chunks of word numbers, so that only distinct words and n-grams travel.

A task reads whole texts and numbers their words as they come; after `tokens` tokens
it closes a chunk: the chunk's words, how often each was counted, and the
sequence of their numbers, compressed. A text may go on in the next chunk, which then
starts with the text's last `history` tokens as context that is not counted again. So
every n-gram of up to history + 1 words ends in exactly one chunk.

Words get numbers that hold for the whole table from counts of all chunks; a chunk hears
only of its own words. Number 0 is the break between texts or pieces.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = 1 << 22  # tokens
SLICE = 1 << 22  # bytes of a text that are split at once
BREAK, UNKNOWN = 0, -1
#: Tokens that no text holds: words have no blanks.
BREAK_WORD, END_WORD = b" ", b"  "

Split = Callable[[bytes], Iterator[list[bytes]]]

SCHEMA = (
    "chunk long, grp string, words array<binary>, counts array<long>, sequence binary, "
    "texts array<struct<key:long,id:long,counted:boolean,length:int,skip:int>>"
)


def slices(data: bytes, ends: bytes, size: int = SLICE) -> Iterator[bytes]:
    """Parts of about `size` bytes, each cut behind one of the `ends`."""
    at = 0
    while at < len(data):
        cut = max(data.rfind(bytes([e]), at, at + size) for e in ends) + 1
        if cut <= at:
            found = [i for e in ends if (i := data.find(bytes([e]), at + size)) >= 0]
            cut = min(found) + 1 if found else len(data)
        if len(data) - at <= size:
            cut = len(data)
        yield data[at:cut]
        at = cut


def pack_sequence(numbers: np.ndarray) -> bytes:
    """32-bit numbers plane by plane, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sequence(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Numbers(dict):
    """Words in order of appearance, from 1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Open:
    """The chunk of one group that is being filled."""

    def __init__(self) -> None:
        self.numbers = _Numbers({BREAK_WORD: BREAK})
        self.sequence = array("i")
        self.texts: list[list] = []

    def begin(self, key: int, id: int | None, counted: bool, before: Iterable[bytes]) -> None:
        skip = self.add(before)
        self.texts.append([key, id, counted, skip, skip])

    def add(self, words: Iterable[bytes]) -> int:
        size = len(self.sequence)
        self.sequence.extend(map(self.numbers.__getitem__, words))
        return len(self.sequence) - size

    def last(self, n: int) -> list[bytes]:
        """The last n tokens of the open text."""
        numbers = self.sequence[len(self.sequence) - min(n, self.texts[-1][3]) :]
        names = dict.fromkeys(numbers)
        for word, number in self.numbers.items():
            if number in names:
                names[number] = word
        return [names[number] for number in numbers]

    def row(self, chunk: int, grp: str) -> dict:
        sequence = np.frombuffer(self.sequence, np.int32).astype(np.int64)
        counted = np.zeros(len(sequence), bool)
        at = 0
        for _, _, wanted, length, skip in self.texts:
            counted[at + skip : at + length] = wanted
            at += length
        # Frequent words get small numbers, which compress best.
        sizes = np.bincount(sequence, minlength=len(self.numbers))
        sizes[BREAK] = len(sequence) + 1
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        counts = np.bincount(place[sequence[counted]], minlength=len(order))
        words = list(self.numbers)
        return {
            "chunk": chunk,
            "grp": grp,
            "words": [words[i] for i in order[1:].tolist()],
            "counts": counts[1:],
            "sequence": pack_sequence(place[sequence]),
            "texts": [dict(zip(("key", "id", "counted", "length", "skip"), t, strict=True)) for t in self.texts],
        }


def word_chunks(texts: DataFrame, split: Split, history: int, end: bool, tokens: int = CHUNK) -> DataFrame:
    """Chunks of texts (grp string, id long, counted boolean, text binary), by group.

    `split` gives a text's words in lists; BREAK_WORD is a break. Every text starts with a
    break, and ends with END_WORD where `end` is set. A text's key is its own in the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        open_: dict[str, _Open] = {}
        key = made = held = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            types = {"texts": pa.list_(pa.struct([("key", pa.int64()), ("id", pa.int64()), ("counted", pa.bool_()), ("length", pa.int32()), ("skip", pa.int32())]))}
            types |= {"chunk": pa.int64(), "grp": pa.string(), "words": pa.list_(pa.binary()), "counts": pa.list_(pa.int64()), "sequence": pa.binary()}
            for grp in list(open_):
                row = open_.pop(grp).row(first + made, grp)
                yield pa.RecordBatch.from_pydict({n: pa.array([v], types[n]) for n, v in row.items()})
                made += 1
            held = 0

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("grp", "id", "counted", "text")]
            for grp, id, counted, text in zip(*columns, strict=True):
                chunk = open_.setdefault(grp, _Open())
                chunk.begin(first + key, id, counted, [BREAK_WORD])
                parts = split(text)
                while True:
                    words = next(parts, None)
                    if words is None:
                        if end:
                            held += chunk.add([END_WORD])
                            chunk.texts[-1][3] += 1
                        break
                    size = chunk.add(words)
                    chunk.texts[-1][3] += size
                    held += size
                    if held >= tokens:
                        before = chunk.last(history)
                        yield from close()
                        chunk = open_.setdefault(grp, _Open())
                        chunk.begin(first + key, id, counted, before)
                key += 1
                if held >= tokens:
                    yield from close()
        yield from close()

    return texts.select("grp", "id", "counted", "text").mapInArrow(run, SCHEMA)


def occurrences(chunks: DataFrame) -> DataFrame:
    """chunk, grp, local, word, n: the words of each chunk and how often they were counted."""
    listed = chunks.select("chunk", "grp", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    return listed.select(
        "chunk", "grp", (F.col("at") + 1).alias("local"), F.col("w.words").alias("word"), F.col("w.counts").alias("n")
    )


PACKED = "chunk long, level int, data binary"
PACK_ROWS = 1 << 20  # that a task gathers before it packs them


def pack_rows(rows: DataFrame, level: int) -> DataFrame:
    """Rows of whole numbers (chunk first) as one compressed value a chunk and task."""
    names = rows.columns

    def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        chunk, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((columns[0], chunk))
        chunk, table = chunk[order], np.stack([c[order] for c in columns])
        starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        data = []
        for part in np.split(table, starts[1:], axis=1):
            part = part.copy()
            part[0, 1:] -= part[0, :-1].copy()  # ascending numbers as their steps
            planes = part.view(np.uint8).reshape(*part.shape, 8).transpose(0, 2, 1)
            data.append(zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes()))
        return pa.RecordBatch.from_pydict(
            {"chunk": pa.array(chunk[starts]), "level": pa.array([level] * len(data), pa.int32()), "data": pa.array(data, pa.binary())}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch[c].to_numpy().astype(np.int64) for c in names])
                size += batch.num_rows
            if size >= PACK_ROWS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return rows.mapInArrow(run, PACKED)


def unpack_rows(told: pa.Table, level: int, columns: int) -> list[np.ndarray]:
    """The columns of a level, ascending by the first inside each packed value."""
    parts = []
    for at, data in zip(told["level"].to_pylist(), told["data"], strict=True):
        if at == level:
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), np.uint8).reshape(columns, 8, -1)
            part = planes.transpose(0, 2, 1).copy(order="C").view(np.int64)[:, :, 0]
            part[0] = np.cumsum(part[0])
            parts.append(part)
    whole = np.concatenate(parts, axis=1) if parts else np.zeros((columns, 0), np.int64)
    return list(whole)


WORD_SLOTS = 1 << 14


def number_in_slots(seen: DataFrame) -> DataFrame:
    """chunk, local, word, c, number, lead: every word's total count and number, in one exchange.

    Words are dealt to slots by hash and ranked inside their slot; numbers have gaps only at
    words that are never counted. `lead` marks one row of each word.
    """
    slot = F.pmod(F.xxhash64("word"), F.lit(WORD_SLOTS)).cast("int")
    same = Window.partitionBy("slot", "word")
    rows = seen.withColumn("slot", slot)
    rows = rows.withColumn("inside", F.dense_rank().over(Window.partitionBy("slot").orderBy("word")))
    rows = rows.withColumns({"c": F.sum("n").over(same), "lead": F.min("chunk").over(same) == F.col("chunk")})
    rows = cut_lineage(
        rows.where("c > 0").select("chunk", "local", "c", "slot", "inside", "lead", (F.col("word") == F.lit(END_WORD)).alias("is_end"))
    )
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # over WORD_SLOTS rows
    sizes = rows.groupBy("slot").agg(F.max("inside").alias("size"))
    before = sizes.select("slot", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    number = (F.col("before") + F.col("inside")).cast("int").cast("long")
    return rows.join(F.broadcast(before), "slot").select("chunk", "local", "c", "lead", "is_end", number.alias("number"))


CLASSES, SLOTS = 4, 256  # classes a doubling of the count; slots of a class


def number_by_count(rows: DataFrame, count: str, keys: list[str], out: str = "number") -> DataFrame:
    """Numbers from 1, without gaps, the frequent ones small.

    Counts are put into logarithmic classes and classes into slots; the few sizes of
    slots are added up, and rows are numbered inside their slot only.
    """
    grade = F.floor(F.log2(F.greatest(F.col(count), F.lit(1))) * CLASSES).cast("int")
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    rows = rows.withColumns({"__grade": grade, "__slot": slot})
    sizes = rows.groupBy("__grade", "__slot").agg(F.count("*").alias("__size"))
    higher = Window.orderBy(F.desc("__grade")).rowsBetween(Window.unboundedPreceding, -1)
    grades = sizes.groupBy("__grade").agg(F.sum("__size").alias("__all")).select(
        "__grade", F.coalesce(F.sum("__all").over(higher), F.lit(0)).alias("__above")
    )
    earlier = Window.partitionBy("__grade").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__grade", "__slot", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__grade", "__slot").orderBy(F.desc(count), *keys))
    placed = rows.withColumn("__inside", inside).join(sizes, ["__grade", "__slot"]).join(grades, "__grade")
    number: Column = F.col("__above") + F.col("__before") + F.col("__inside")
    return placed.withColumn(out, number).drop("__grade", "__slot", "__inside", "__before", "__above")
