import random

import numpy as np
from pyspark.sql import functions as F

from talkweave.llm.near_copies import BANDS, LANES, RADIUS, keep_one, only_numbered, shingle_hashes, wide_print

SCHEMA = "doc_id long, text string"


def similarity(a, b):
    x, y = set(shingle_hashes(a).tolist()), set(shingle_hashes(b).tolist())
    return len(x & y) / max(1, len(x | y))


def plain_groups(texts):
    """Roots by brute force over all pairs: a key in common and prints within the radius."""
    prints = [wide_print(t) for t in texts]
    bits = [int.from_bytes(p[0], "little") for p in prints]
    keys = [set(enumerate(p[1])) for p in prints]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= RADIUS and keys[i] & keys[j]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def changed(rng, words, share):
    out = list(words)
    for at in rng.sample(range(len(out)), int(share * len(out))):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def made(seed, groups, copies, share, n=200):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        rows += [(g, " ".join(words))] + [(g, changed(rng, words, share)) for _ in range(copies)]
    return rows


def test_print_is_by_majority_and_bounded():
    fp, keys = wide_print("a b c d e")
    assert len(fp) == 8 * LANES and len(keys) == BANDS
    assert wide_print(None) == wide_print(" \n") == (bytes(8 * LANES), [0] * BANDS)
    long_text = " ".join(f"w{k}" for k in range(60_000))
    assert wide_print(long_text) == wide_print(long_text.upper())


def test_recall_at_the_stated_similarity(spark):
    rows = made(5, groups=60, copies=1, share=0.02)
    pairs = [(a[1], b[1]) for a, b in zip(rows[::2], rows[1::2], strict=True) if similarity(a[1], b[1]) >= 0.8]
    assert len(pairs) > 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs for t in p)], SCHEMA)
    kept = keep_one(docs).count()
    caught = 2 * len(pairs) - kept
    assert caught >= 0.9 * len(pairs)


def test_texts_that_differ_stay(spark):
    rows = made(6, groups=80, copies=1, share=0.15)
    assert np.mean([similarity(a[1], b[1]) for a, b in zip(rows[::2], rows[1::2], strict=True)]) < 0.5
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], SCHEMA)
    assert keep_one(docs).count() == len(rows)


def test_large_group_in_small_parts(spark):
    rows = made(7, groups=3, copies=90, share=0.01, n=300)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], SCHEMA).repartition(5)
    want = sorted(set(plain_groups([t for _, t in rows])))
    assert sorted(r.doc_id for r in keep_one(docs, part=16).collect()) == want


def test_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = sorted({rows[r][0] for r in plain_groups([t for _, t in rows])})
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == want


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4), (2, "a b c", 1, 2, 3, 4)], "doc_id long, text string, node int, fp int, llm_row int, keys int")
    assert [tuple(r) for r in keep_one(docs).collect()] == [(1, "a b c", 1, 2, 3, 4)]
    assert keep_one(docs.limit(0)).count() == 0


def test_numbers_are_looked_up_by_their_bits(spark):
    many = [(p << 33) + n for p in (0, 1, 5) for n in range(200)]
    rows = spark.createDataFrame([(n, n % 7, "x") for n in [*many, 64, 64]], "number long, llm_word long, llm_bits string").repartition(3)
    chosen = [n for n in many if n % 3 == 0 or n % 64 == 63]
    got = only_numbered(rows, "number", spark.createDataFrame([(n,) for n in [*chosen, 64]], "number long"))
    assert got.columns == rows.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted((n, n % 7, "x") for n in [*chosen, 64, 64, 64])
    assert only_numbered(rows, "number", spark.createDataFrame([], "number long")).count() == 0


def test_texts_are_not_shuffled_to_meet_the_rows_that_stay(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), "id").alias("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    try:
        kept = keep_one(docs)
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
