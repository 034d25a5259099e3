"""A word index that follows its table, kept in segments on shared storage.

    segments/segment=<n>/first=<f>   one row per word and block of 64 texts
    gone/segment=<n>                 texts that a later segment replaces
    live/version=<v>                 the segments that count from then on

A row holds a word, a block, which texts of the block have the word (one bit each), the largest
frequency and the smallest length among them, and the texts themselves. The row of the
empty word lists all texts of a block. Blocks are filled with texts of similar length, so
that the bounds are tight. `first` is the word's first letter or digit (other letters share
32 folders), so a prefix opens the folders of its first letter only, and inside a file rows
are in word order.

A batch adds a segment; what it rebuilds is marked as gone in the segments before it.
`merge` writes the live segments as one, without what is gone. Every step writes folders
named after its batch and the version last, so a step that is repeated leaves the same
index, and readers of an older version are not disturbed.

What a step needs of local disk: `add` has one exchange, whose files go when the segment is
written; `merge` reads and writes folder by folder and moves nothing.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, DataFrameReader, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import query_tokens, tokens
from ..session import cut_lineage, settings

WIDTH = 64  # texts of a block, one bit each
AT_ONCE = 1 << 18  # words that a task counts at once
PART_BITS, COUNT_BITS = 18, 22  # of a block's number: segment, task, count
OTHER = 32  # folders of words that begin with neither a-z nor 0-9
MERGED = 1 << 24  # bytes of files that a task of a merge sorts
DOCS = "docs"


def folder_of(token: Column) -> Column:
    """The folder of a word."""
    letter = F.substring(token, 1, 1)
    return (
        F.when(token == "", F.lit(DOCS))
        .when(letter.between("a", "z") | letter.between("0", "9"), F.concat(F.lit("w"), letter))
        .otherwise(F.concat(F.lit("x"), (F.ascii(letter) % OTHER).cast("string")))
    )


def folder_of_prefix(prefix: str) -> str:
    """The same for a prefix that the driver knows; the empty one asks for the rows of texts."""
    if not prefix:
        return DOCS
    letter = prefix[0]
    return f"w{letter}" if letter.isascii() and letter.isalnum() else f"x{ord(letter) % OTHER}"


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def word_runs(width: int = 1) -> Callable[[np.ndarray], Iterator[tuple[int, int]]]:
    """Lengths of texts -> runs of AT_ONCE words at most, or of one text; whole blocks of `width` if they hold one.

    What a batch of Arrow holds depends on its texts, what is counted at once does not.
    """
    most = AT_ONCE

    def runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
        ends, start = np.cumsum(lengths), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            if stop < len(ends) and stop - start > width:
                stop -= (stop - start) % width
            yield start, stop
            start = stop

    return runs


def _blocks(segment: int, ids: list[str]):
    """Texts (ids, words) -> rows of words and blocks."""
    runs = word_runs(WIDTH)

    def block_rows(batch: pa.RecordBatch, lengths: np.ndarray, base: int) -> pa.RecordBatch:
        listed = pa.table({"doc": pc.list_parent_indices(batch["words"]).cast(pa.int64()), "token": pc.list_flatten(batch["words"])})
        counted = listed.group_by(["doc", "token"]).aggregate([([], "count_all")])
        doc = np.r_[np.arange(len(lengths)), counted["doc"].to_numpy()]
        tf = np.r_[np.zeros(len(lengths), np.int64), counted["count_all"].to_numpy()]
        token = pa.concat_arrays([pa.array([""] * len(lengths), pa.string()), counted["token"].combine_chunks().cast(pa.string())])
        code = token.dictionary_encode()
        order = np.lexsort((doc, code.indices.to_numpy(), doc // WIDTH))
        doc, tf, code = doc[order], tf[order], code.take(pa.array(order))
        key = code.indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] // WIDTH != doc[:-1] // WIDTH)])
        place, size = doc % WIDTH, lengths[doc]
        fields = {"place": pa.array(place, pa.int32())}
        fields |= {c: batch[c].take(pa.array(doc)) for c in ids}
        fields |= {"tf": pa.array(tf, pa.int32()), "length": pa.array(size, pa.int32())}
        texts = pa.StructArray.from_arrays(list(fields.values()), list(fields))
        return pa.RecordBatch.from_pydict({
            "token": code.take(pa.array(starts)).dictionary_decode(),
            "block": pa.array(base + doc[starts] // WIDTH, pa.int64()),
            "bits": pa.array(np.bitwise_or.reduceat(np.uint64(1) << place.astype(np.uint64), starts).view(np.int64)),
            "most_tf": pa.array(np.maximum.reduceat(tf, starts), pa.int32()),
            "least_length": pa.array(np.minimum.reduceat(size, starts), pa.int32()),
            "total_length": pa.array(np.add.reduceat(size, starts), pa.int64(), mask=key[starts] != 0),  # of the empty word's rows
            "texts": pa.ListArray.from_arrays(pa.array(np.r_[starts, len(doc)], pa.int32()), texts),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (segment << (PART_BITS + COUNT_BITS)) | (TaskContext.get().partitionId() << COUNT_BITS)
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pc.fill_null(pc.list_value_length(batch["words"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(lengths, kind="stable")
            for start, stop in runs(lengths[order]):
                some = order[start:stop]
                yield block_rows(batch.take(pa.array(some)), lengths[some], base)
                base += -(-len(some) // WIDTH)

    return run


class WordIndex:
    """The index in a folder; `ids` are the columns that tell its texts apart."""

    def __init__(self, spark: SparkSession, path: str, ids: str | Sequence[str]) -> None:
        self.spark, self.path = spark, path
        self.ids = [ids] if isinstance(ids, str) else list(ids)

    # --- writing ---

    def add(self, texts: DataFrame, segment: int, text: str = "text", rebuilt: DataFrame | None = None) -> WordIndex:
        """Index texts as a new segment; the earlier texts of `rebuilt` (some id columns) are gone.

        Segments are numbered by the caller, ascending, by batch. One exchange; texts are read once.
        """
        before = [s for s in self.segments(2 * segment - 1)] if segment else []
        struct = ", ".join(f"{c}: {texts.schema[c].dataType.simpleString()}" for c in self.ids)
        schema = (
            "token string, block long, bits long, most_tf int, least_length int, total_length long, "
            f"texts array<struct<place: int, {struct}, tf: int, length: int>>"
        )
        words = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("words")
        rows = texts.select(*self.ids, words).mapInArrow(_blocks(segment, self.ids), schema)
        self._write(rows, segment)
        if rebuilt is not None and before:
            keys = [c for c in rebuilt.columns if c in self.ids]
            old = self._texts(self._rows(before, [""]), before).join(rebuilt.select(*keys).distinct(), keys, "left_semi")
            old.select("block", "place", "length").write.mode("overwrite").parquet(f"{self.path}/gone/segment={segment}")
        self._publish(2 * segment, [*before, segment], rows.schema)
        return self

    def merge(self, segment: int) -> WordIndex:
        """Write the segments up to `segment` as one, without the texts that are gone."""
        old = self.segments(2 * segment)
        rows = self._merged(old)
        merged = -1 - segment  # apart from the numbers of batches
        with settings(rows.sparkSession, {"spark.sql.files.maxPartitionBytes": str(MERGED)}):
            self._write_sorted(rows, merged)
        self._publish(2 * segment + 1, [merged], rows.drop("first").schema)
        return self

    def _merged(self, segments: list[int]) -> DataFrame:
        """Rows of segments and their folder, without texts that are gone; a partition has files of one folder, so nothing is shuffled."""
        gone, reader, parts = self._gone_bits(segments), self._reader(), []
        for first, (paths, size) in sorted(self._folders(segments).items()):
            rows = self._alive(reader.parquet(*paths).drop("segment", "first"), gone)
            parts.append(rows.withColumn("first", F.lit(first)).coalesce(-(-size // MERGED) or 1))
        return reduce(DataFrame.unionAll, parts or [self._rows(segments, []).withColumn("first", F.lit(DOCS))])

    def _alive(self, rows: DataFrame, gone: DataFrame | None) -> DataFrame:
        """Rows without the texts that are gone."""
        if gone is None:
            return rows
        rows = rows.join(gone, "block", "left").withColumn("dead", F.coalesce("dead", F.lit(0).cast("long")))
        alive = F.filter("texts", lambda t: F.col("dead").bitwiseAND(_bit(t.place)) == 0)
        rows = rows.withColumn("texts", F.when(F.col("dead") == 0, F.col("texts")).otherwise(alive)).where(F.size("texts") > 0)
        total = F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + t.length)
        return rows.withColumns({
            "bits": F.col("bits").bitwiseAND(F.bitwise_not("dead")),
            "most_tf": F.array_max("texts.tf"), "least_length": F.array_min("texts.length"),
            "total_length": F.when(F.col("token") == "", F.when(F.col("dead") == 0, F.col("total_length")).otherwise(total)),
        }).drop("dead")

    def _write(self, rows: DataFrame, segment: int) -> None:
        # A frequent first letter is several tasks; a word's blocks go to any of them.
        salts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)
        rows = rows.withColumn("first", folder_of(F.col("token")))
        rows = rows.repartition("first", F.pmod(F.xxhash64("block"), F.lit(salts)))
        # Spark would keep the exchange's files until the driver's next collection of garbage.
        with settings(rows.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            self._write_sorted(rows, segment)

    def _write_sorted(self, rows: DataFrame, segment: int) -> None:
        rows = rows.sortWithinPartitions("first", "token", "block")
        writer = rows.write.mode("overwrite").option("compression", "zstd").partitionBy("first")
        writer.parquet(f"{self.path}/segments/segment={segment}")

    def _publish(self, version: int, segments: list[int], schema: StructType) -> None:
        frame = self.spark.range(1).select(
            F.array(*[F.lit(s).cast("long") for s in segments]).alias("segments"), F.lit(schema.json()).alias("schema")
        )
        frame.write.mode("overwrite").parquet(f"{self.path}/live/version={version}")

    # --- reading ---

    def _exists(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _live(self, upto: int | None = None) -> Row | None:
        """The newest version (up to a version): one row that the driver reads."""
        live = f"{self.path}/live"
        if not self._exists(live):
            return None
        rows = self.spark.read.option("basePath", live).parquet(live)
        if upto is not None:
            rows = rows.where(F.col("version") <= upto)
        return rows.orderBy(F.desc("version")).first()

    def segments(self, upto: int | None = None) -> list[int]:
        newest = self._live(upto)
        return [] if newest is None else list(newest["segments"])

    def _rows(self, segments: list[int], prefixes: Sequence[str] | None = None) -> DataFrame:
        """Rows of words with one of the prefixes; the empty one asks for the rows of texts."""
        base = f"{self.path}/segments"
        folders = [f"{base}/segment={s}" for s in segments]
        if prefixes is not None:
            named = sorted({f"first={folder_of_prefix(p)}" for p in prefixes})
            folders = [path for f in folders for n in named if self._exists(path := f"{f}/{n}")]
        reader = self._reader()
        if not folders:
            return reader.parquet(base).where(F.lit(False)).drop("segment", "first")
        rows = reader.parquet(*folders)  # other folders are not even listed
        if prefixes is not None:
            wanted = F.lit(False)
            for p in prefixes:
                wanted = wanted | (F.col("token").startswith(p) if p else F.col("token") == "")
            rows = rows.where(wanted)
        return rows.drop("segment", "first")

    def _reader(self) -> DataFrameReader:
        schema = StructType.fromJson(json.loads(self._live()["schema"]))
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/segments")

    def _folders(self, segments: list[int]) -> dict[str, tuple[list[str], int]]:
        """Folder of words -> its paths in these segments and the bytes they hold: names and sizes that the file system lists."""
        paths, sizes = defaultdict(list), defaultdict(int)
        for s in segments:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments/segment={s}")
            files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for found in files.listStatus(folder):
                name = found.getPath().getName()
                if name.startswith("first="):
                    first = name.removeprefix("first=")
                    paths[first].append(f"{self.path}/segments/segment={s}/{name}")
                    sizes[first] += files.getContentSummary(found.getPath()).getLength()
        return {first: (paths[first], sizes[first]) for first in paths}

    def _gone(self, segments: list[int]) -> DataFrame | None:
        """Texts gone by a live segment. A merged one (below zero) has left them out."""
        there = [path for s in segments if s > 0 and self._exists(path := f"{self.path}/gone/segment={s}")]
        return self.spark.read.schema("block long, place int, length int").parquet(*there).distinct() if there else None

    def _gone_bits(self, segments: list[int]) -> DataFrame | None:
        """The same, a bit each. Broadcast, as rows of words would all be shuffled otherwise: 16 bytes for 64 texts."""
        gone = self._gone(segments)
        return None if gone is None else F.broadcast(gone.groupBy("block").agg(F.bit_or(_bit(F.col("place"))).alias("dead")))

    def _texts(self, rows: DataFrame, segments: list[int]) -> DataFrame:
        gone = self._gone_bits(segments)
        if gone is None:
            return rows.select("block", "token", F.inline("texts"))
        texts = rows.join(gone, "block", "left").select("block", "token", "dead", F.inline("texts"))
        return texts.where(F.coalesce("dead", F.lit(0).cast("long")).bitwiseAND(_bit(F.col("place"))) == 0).drop("dead")

    def postings(self, prefixes: Sequence[str] | None = None) -> DataFrame:
        """ids, token, tf, length; with prefixes, only their words and folders."""
        segments = self.segments()
        rows = self._rows(segments, prefixes)
        if prefixes is None:
            rows = rows.where(F.col("token") != "")
        return self._texts(rows, segments).select(*self.ids, "token", "tf", "length")

    def lengths(self) -> DataFrame:
        """ids, length of every text, also of those without words."""
        segments = self.segments()
        return self._texts(self._rows(segments, [""]), segments).select(*self.ids, "length")

    def corpus(self) -> DataFrame:
        """texts, length: how many texts count and their length in all, from the rows of blocks."""
        segments = self.segments()
        sums = self._rows(segments, [""]).agg(
            F.sum(F.bit_count("bits")).alias("texts"), F.sum("total_length").alias("length")
        )
        gone = self._gone(segments)
        if gone is not None:
            less = gone.agg(F.struct(F.count("*").alias("texts"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).alias("s"))
            sums = sums.withColumn("less", less.scalar()).select(
                (F.col("texts") - F.col("less.texts")).alias("texts"), (F.col("length") - F.col("less.length")).alias("length")
            )
        return sums

    def terms(self, prefix: str = "") -> DataFrame:
        """token, documents, occurrences: the dictionary, or its words with a prefix."""
        words = self.postings([prefix] if prefix else None)
        return words.groupBy("token").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))

    # --- the best k by bounds of blocks ---

    def _bounds(self, words: list[str], k1: float, b: float) -> DataFrame:
        """One row per text with a hit: the most it can score, from bits and bounds of blocks alone.

        A word's row says which texts have it and how often at most; a text's own
        words are added up, and it is at least as long as each of its rows says.
        """
        segments = self.segments()
        rows, gone = self._rows(segments, words).drop("texts"), self._gone_bits(segments)
        if gone is not None:
            live = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("dead", F.lit(0).cast("long"))))
            rows = rows.join(gone, "block", "left").withColumn("bits", live)
        places = F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda p: F.col("bits").bitwiseAND(_bit(p)) != 0)
        rows = rows.select("token", "block", "most_tf", "least_length", F.explode(places).alias("place"))
        most = lambda w: F.sum(F.when(F.col("token").startswith(w), F.col("most_tf")).otherwise(0))
        rows = rows.groupBy("block", "place").agg(
            F.max("least_length").alias("least"), *[most(w).alias(f"most{i}") for i, w in enumerate(words)]
        )
        rows = cut_lineage(rows)
        found = rows.agg(F.struct(*[F.count_if(F.col(f"most{i}") > 0).alias(f"d{i}") for i in range(len(words))]).alias("s"))
        corpus = self.corpus().select(F.struct("texts", (F.col("length") / F.col("texts")).alias("mean")).alias("s"))
        rows = rows.withColumns({"found": found.scalar(), "corpus": corpus.scalar()})
        bound = F.lit(0.0)
        for i in range(len(words)):
            bound = bound + _weight(i) * _gain(F.col(f"most{i}"), F.col("least"), k1, b)
        return rows.withColumn("bound", bound * (1 + 1e-9))

    def _scores(self, chosen: DataFrame, words: list[str], k1: float, b: float) -> DataFrame:
        """Exact scores of some texts, from their blocks; lower is better."""
        rows = self._rows(self.segments(), words).join(chosen.select("block"), "block", "left_semi")
        texts = rows.select("block", "token", F.inline("texts")).join(chosen.select("block", "place"), ["block", "place"], "left_semi")
        of = lambda w: F.sum(F.when(F.col("token").startswith(w), F.col("tf")).otherwise(0))
        hits = texts.groupBy("block", "place").agg(
            *[F.first(c).alias(c) for c in (*self.ids, "length")], *[of(w).alias(f"f{i}") for i, w in enumerate(words)]
        )
        hits = hits.join(chosen.select("block", "place", "found", "corpus"), ["block", "place"])
        score = F.lit(0.0)
        for i in range(len(words)):
            score = score + _weight(i) * _gain(F.col(f"f{i}"), F.col("length"), k1, b)
        return hits.select(*self.ids, (-score).alias("score"))

    def bm25_topk(self, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """ids, score of the k best texts with any query word as a prefix; lower is better."""
        return self.bm25_pruned(query, k, k1, b)[0]

    def bm25_pruned(self, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The same, with the blocks that have a hit and those whose texts were read.

        The k blocks with the highest bounds are scored first; the k-th best of their texts is a
        cutoff that no answer can miss, and only blocks with a text whose bound reaches it are read.
        """
        words = query_tokens(query)
        if not words or not self.segments():
            none = self.lengths().select(*self.ids, F.lit(0.0).alias("score")).limit(0)
            return none, none, none
        bounds = cut_lineage(self._bounds(words, k1, b))
        top = bounds.groupBy("block").agg(F.max("bound").alias("most")).orderBy(F.desc("most"), "block").limit(k)
        least = self._scores(bounds.join(top, "block", "left_semi"), words, k1, b).orderBy("score").limit(k)
        cutoff = least.agg(F.when(F.count("*") == k, F.max("score")).alias("c")).scalar()
        chosen = bounds.where(F.coalesce(-F.col("bound") <= cutoff, F.lit(True)))
        best = self._scores(chosen, words, k1, b).orderBy("score", *self.ids).limit(k)
        return best, bounds.select("block").distinct(), chosen.select("block").distinct()


def _weight(i: int) -> Column:
    df = F.col(f"found.d{i}")
    idf = F.log((F.col("corpus.texts") - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)


def _gain(tf: Column, length: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1 - b + b * length / F.col("corpus.mean")))

