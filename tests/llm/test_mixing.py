import random

import pytest
from pyspark.sql import functions as F

from talkweave.llm.common import count_words
from talkweave.llm.mixing import mix_sources, mixed_documents, targets

SCHEMA = "doc_id long, text string, source string, size string, key int, target int"


def plain_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_rounds_of_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 50, 1000, 90_000]) for i in range(12)} | {None: 70, "É": 5, "z": 5}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(frame).collect()}
    want = plain_targets(sizes, (5, 2, 1), 1.5, 2)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def made():
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c"])) for i in range(900)]
    return rows + [(900, None, "a"), (901, "", None), (902, "one\ttwo\x0bthree", None), (903, "x " * 50_000, "d"), (904, "  ", "e"), (None, "no id", "b"), (5, rows[5][1], rows[5][2]), (6, "same id, other text", "c")]


def frame_of(spark, rows=None):
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in (made() if rows is None else rows)], SCHEMA)


def test_taken_words_come_near_targets(spark):
    got = mix_sources(frame_of(spark)).collect()
    assert len(got) == len(made())
    sizes = sorted(len((t or "").split()) for _, t, _ in made())
    assert sorted(r.size for r in got) == sizes
    sums = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
        sums.setdefault((r.source_size, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in sums) - 1.5 * sum(sizes)) < 1e-6 * sum(sizes)
    for (size, target), taken in sums.items():
        if len(taken) > 50:
            assert abs(sum(taken) - target) <= 3, (size, target, sum(taken))
    # Complete epochs come first: all documents of a source are taken n or n + 1 times.
    for r in mix_sources(frame_of(spark)).groupBy("source_size", "target").agg(F.min("copies").alias("a"), F.max("copies").alias("b")).collect():
        assert r.b - r.a <= 1


def test_reruns_and_partitions_agree_and_seeds_do_not(spark):
    runs = [sorted(map(str, mix_sources(frame_of(spark).repartition(n), share=0.4, buckets=b, seed=s).select("doc_id", "size", "taken").collect())) for n, b, s in ((1, 16_384, 1), (7, 16, 1), (7, 16, 2))]
    assert runs[0] == runs[1] != runs[2]


def test_keys_follow_the_exponential_race(spark):
    rows = [(i, "w", "only") for i in range(4000)] + [(-i, "w w", "other") for i in range(1, 4000)]
    heavy = F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)
    got = mix_sources(frame_of(spark, rows), quality=heavy, share=0.5, weights=(1.0, 1.0)).where("copies > 0 and doc_id >= 0")
    even = got.where("doc_id % 2 = 0").count() / got.count()
    assert 0.5 < even < 0.75  # three to one in the beginning, all in the end


def _by_size(docs):
    return docs.groupBy(F.struct("doc_id", count_words(F.col("text")).alias("size")).alias("doc_id_size")).count()


@pytest.mark.parametrize("text", ["the same words in every row", None])
def test_rows_of_one_id_are_taken_one_by_one(spark, text):
    """A third of all rows has a null id; their texts are all the same, or all different."""
    many = [(None, text or f"{'w ' * (i % 40)}text {i}", "a" if i % 2 else "b") for i in range(600)]
    rows = many + [(i, "w " * (i % 50 + 1), "ab"[i % 2]) for i in range(1200)]
    frames = [frame_of(spark, rows).repartition(n) for n in (1, 5)]
    seen = []
    for frame in frames:
        got = mix_sources(frame, weights=(3.0, 1.0), share=0.7).cache()
        for r in got.groupBy("target").agg(F.sum("taken").alias("taken")).collect():
            assert abs(r.taken - r.target) <= 3
        assert 0 < got.where("doc_id is null and copies = 0").count() < 600
        seen.append(sorted(map(str, got.collect())))
    assert seen[0] == seen[1]
    out = mixed_documents(frames[0], weights=(3.0, 1.0), share=0.7)
    assert out.count() == mix_sources(frames[0], weights=(3.0, 1.0), share=0.7).agg(F.sum("copies")).first()[0]


def test_mixed_documents_repeat_rows(spark):
    frame = frame_of(spark)
    out = mixed_documents(frame)
    assert out.columns == frame.columns
    want = {(r.doc_id, r.size): r.n for r in mix_sources(frame).groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).collect()}
    got = {r.doc_id_size: r["count"] for r in _by_size(out).collect()}
    assert {tuple(k): v for k, v in got.items()} == {k: v for k, v in want.items() if v}
    empty = frame_of(spark, [])
    assert mix_sources(empty).count() == 0 and mixed_documents(empty).count() == 0
