import pathlib
import random
import time
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkweave.operators import search
from talkweave.sources import word_index
from talkweave.sources.word_index import WordIndex

WORDS = [f"{a}{b}{c}" for a in "abcé7" for b in "xyz" for c in ("", "q", "ing")] + ["common", "cat", "category"]


def corpus(seed, n):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(i, f"c{i % 7}", " ".join(rng.choices(WORDS, weights, k=rng.randrange(1, 200)))) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*corpus(1, 1500), (2000, "c1", None), (2001, "c2", "... !"), (2002, "c2", "word " * 3000)]
    return spark.createDataFrame(rows, "id long, conversation string, text string").cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return WordIndex(spark, str(tmp_path_factory.mktemp("words") / "index"), "id").add(docs, 0)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_postings_equal_the_ones_counted_directly(docs, index):
    postings, lengths = search.build_token_index(docs, "id")
    assert rows_of(index.postings()) == rows_of(postings)
    assert rows_of(index.lengths()) == rows_of(lengths)
    corpus = index.corpus().first()
    assert (corpus.texts, corpus.length) == tuple(lengths.agg(F.count("*"), F.sum("length")).first())


def test_a_prefix_opens_the_folders_of_its_first_letter(index):
    files = index.postings(["cat"]).inputFiles()
    assert files and all("/first=wc/" in f for f in files)
    assert len(files) < len(index.postings().inputFiles()) / 3
    assert rows_of(index.terms("cat")) == rows_of(index.terms().where("token like 'cat%'"))
    assert rows_of(index.terms("é")) == []  # accents are folded away
    assert rows_of(index.terms("7")) == rows_of(index.terms().where("token like '7%'"))


@pytest.mark.parametrize("query, k", [("common", 10), ("cat", 10), ("ax cat", 5), ("by", 40), ("zzz", 3), ("word", 3)])
def test_bounds_skip_blocks_and_lose_nothing(docs, index, query, k):
    postings, lengths = search.build_token_index(docs, "id")
    best, blocks, chosen = index.bm25_pruned(query, k)
    want = search.bm25(postings, lengths, query, k=k).collect()
    got = best.collect()
    assert [r.id for r in got] == [r.id for r in want]
    assert [r.score for r in got] == pytest.approx([r.score for r in want])
    assert chosen.count() <= blocks.count()


def test_blocks_that_cannot_reach_the_cutoff_are_not_read(spark, tmp_path):
    rng = random.Random(5)
    texts = [(i, " ".join(["once"] * (1 if i % 200 else 20) + ["filler"] * rng.randrange(20, 60))) for i in range(2000)]
    docs = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    index = WordIndex(spark, str(tmp_path / "index"), "id").add(docs, 0)
    best, blocks, chosen = index.bm25_pruned("once", 5)
    assert all(r.id % 200 == 0 for r in best.collect())
    assert blocks.count() >= 31 and chosen.count() <= 10


def test_no_words_and_no_segments(spark, index, tmp_path):
    assert index.bm25_topk("... !", 5).collect() == []
    empty = WordIndex(spark, str(tmp_path / "none"), "id")
    assert empty.segments() == []
    empty.add(spark.createDataFrame([], "id long, text string"), 0)
    assert empty.postings().collect() == [] and empty.bm25_topk("word", 3).collect() == []


def test_batches_rebuilds_merges_and_repeats(spark, docs, tmp_path):
    index = WordIndex(spark, str(tmp_path / "index"), ["conversation", "id"])
    key = F.col("id") % 3
    stale = docs.withColumn("text", F.when(F.col("conversation") == "c3", F.lit("old words")).otherwise(F.col("text")))
    for n in range(3):
        index.add(stale.where(key == n), n)
    before = rows_of(index.postings())
    fresh = docs.where("conversation = 'c3'")
    changed = fresh.select("conversation").distinct()
    for _ in range(2):  # a batch that is repeated leaves the same index
        index.add(fresh, 3, rebuilt=changed)
        want, lengths = search.build_token_index(docs, ["conversation", "id"])
        assert rows_of(index.postings()) == rows_of(want)
        assert rows_of(index.lengths()) == rows_of(lengths)
    assert rows_of(index.terms("old")) == []
    assert before != rows_of(index.postings())
    corpus = index.corpus().first()
    assert (corpus.texts, corpus.length) == tuple(lengths.agg(F.count("*"), F.sum("length")).first())
    scores = rows_of(search.bm25(want, lengths, "ax cat", k=9))
    assert [r[:2] for r in rows_of(index.bm25_topk("ax cat", 9))] == [r[:2] for r in scores]
    index.merge(3)
    assert len(index.segments()) == 1
    assert rows_of(index.postings()) == rows_of(want)
    assert [r[:2] for r in rows_of(index.bm25_topk("ax cat", 9))] == [r[:2] for r in scores]
    index.add(docs.limit(0), 4)
    assert rows_of(index.lengths()) == rows_of(lengths)


@pytest.mark.parametrize("kind", ["blocks", "rows"])
def test_a_batch_is_counted_in_runs_of_bounded_size(monkeypatch, kind):
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(900)}" for _ in range(rng.choice([0, 3, 40, 900]))] for _ in range(700)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts))), "words": pa.array(texts, pa.list_(pa.string()))})
    monkeypatch.setattr(word_index, "AT_ONCE", 10_000)
    monkeypatch.setattr(word_index, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = word_index._blocks(0, ["id"]) if kind == "blocks" else search._count_words(["id"])
    made = list(run([batch.slice(0, 300), batch.slice(300, 0), batch.slice(300)]))
    got, sizes, blocks = Counter(), [], []
    for rows in (m.to_pylist() for m in made):
        listed = [(r["token"], t) for r in rows for t in r.get("texts", [r])]
        blocks += [r["block"] for r in rows if "block" in r and r["token"] == ""]
        sizes.append(sum(1 for token, _ in listed if token))
        got.update((t["id"], token, t["length"], t["tf"]) for token, t in listed if token)
    assert max(sizes) <= 10_000
    assert len(blocks) == len(set(blocks))
    assert got == Counter((i, w, len(t), n) for i, t in enumerate(texts) for w, n in Counter(t).items())


def test_runs_hold_whole_blocks_and_long_texts_alone():
    assert list(word_index.word_runs()(np.array([], np.int64))) == []
    many = list(word_index.word_runs(64)(np.full(1000, 1 << 11)))  # 128 texts make AT_ONCE words
    assert many[0] == (0, 128) and many[-1] == (896, 1000)
    assert list(word_index.word_runs(64)(np.array([5, 1 << 20, 1 << 20]))) == [(0, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("ids", [["id"], ["source", "id"]])
def test_memory_of_counting_does_not_follow_the_batch(monkeypatch, ids):
    rng = random.Random(6)
    monkeypatch.setattr(word_index, "AT_ONCE", 10_000)
    monkeypatch.setattr(word_index, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    peaks = []
    for texts in (200, 3200):  # of 100 words: 2 and 32 runs
        words = [[f"w{rng.randrange(900)}" for _ in range(100)] for _ in range(texts)]
        batch = pa.RecordBatch.from_pydict({
            "id": pa.array(range(texts)), "source": pa.array([f"src{i % 5}" for i in range(texts)]),
            "words": pa.array(words, pa.list_(pa.string())),
        })
        run = word_index._blocks(0, ids)
        tracemalloc.start()
        for _ in run([batch]):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]


def shuffle_bytes(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in folders for f in pathlib.Path(d.getPath()).rglob("shuffle_*.data") if f.exists())


def test_an_exchange_leaves_no_files_when_its_segment_is_written(spark, docs, tmp_path):
    index, key = WordIndex(spark, str(tmp_path / "index"), "id"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_bytes(spark), spark.conf.get(key)
    for n in range(3):
        index.add(docs.where(F.col("id") % 3 == n), n)
    index.merge(2)
    deadline = time.monotonic() + 20  # files go in the background
    while shuffle_bytes(spark) > before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert shuffle_bytes(spark) <= before
    assert spark.conf.get(key) == setting


def test_a_merge_moves_no_rows_between_tasks(spark, docs, tmp_path, monkeypatch, capsys):
    index = WordIndex(spark, str(tmp_path / "index"), ["conversation", "id"])
    for n in range(3):
        index.add(docs.where(F.col("id") % 3 == n), n)
    want = rows_of(index.postings())
    monkeypatch.setattr(word_index, "MERGED", 1 << 14)  # several tasks for a frequent letter
    written = []
    write = WordIndex._write_sorted
    monkeypatch.setattr(WordIndex, "_write_sorted", lambda self, rows, segment: (written.append(rows), write(self, rows, segment)))
    index.merge(2)
    written[0].explain()
    assert "Exchange" not in capsys.readouterr().out
    files = list((tmp_path / "index/segments/segment=-3").rglob("*.parquet"))
    assert 1 < len([f for f in files if f.parent.name == "first=wc"]) < 8
    for f in files:  # a file is of one folder and in the order of words
        words = [r.token for r in spark.read.parquet(str(f)).select("token", "block").collect()]
        assert words == sorted(words)
    assert rows_of(index.postings()) == want
    assert rows_of(index.terms("cat")) == rows_of(index.terms().where("token like 'cat%'"))


def test_texts_that_are_gone_are_left_out_of_every_folder_of_a_merge(spark, docs, tmp_path):
    index = WordIndex(spark, str(tmp_path / "index"), ["conversation", "id"])
    index.add(docs.withColumn("text", F.concat_ws(" ", "text", F.lit("stale 9 ☃ ж"))), 0)
    index.add(docs, 1, rebuilt=docs.select("conversation").distinct())
    want, lengths = search.build_token_index(docs, ["conversation", "id"])
    index.merge(1)
    assert rows_of(index.postings()) == rows_of(want)
    assert rows_of(index.lengths()) == rows_of(lengths)
    corpus = index.corpus().first()
    assert (corpus.texts, corpus.length) == tuple(lengths.agg(F.count("*"), F.sum("length")).first())
    stored = spark.read.parquet(str(tmp_path / "index/segments/segment=-2"))
    assert stored.where("token = 'stale'").count() == 0


def test_a_merge_of_segments_without_texts(spark, tmp_path):
    index = WordIndex(spark, str(tmp_path / "index"), "id")
    none = spark.createDataFrame([], "id long, text string")
    index.add(none, 0).add(none, 1).merge(1)
    assert index.segments() == [-2] and index.postings().collect() == [] and index.lengths().collect() == []


def test_texts_that_are_gone_are_left_out_without_an_exchange_of_words(spark, docs, tmp_path, capsys):
    index = WordIndex(spark, str(tmp_path / "index"), ["conversation", "id"])
    index.add(docs.withColumn("text", F.concat_ws(" ", "text", F.lit("stale"))), 0)
    index.add(docs.where("conversation = 'c3'"), 1, rebuilt=docs.where("conversation = 'c3'").select("conversation").distinct())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (index.postings(), index._merged(index.segments())):
            rows.explain()
            plan = capsys.readouterr().out
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        stale = index.terms("stale").first().documents
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert stale == docs.where("conversation <> 'c3'").count()
