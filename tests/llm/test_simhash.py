import random

import numpy as np
import xxhash
from pyspark.sql import Row

from talkweave.llm.near_copies import keep_one
from talkweave.llm.simhash import band_masks, components, fingerprint, forest, near_links, simhash_dedup

SCHEMA = "doc_id long, text string, component_id string, fp int"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def near(rng, base, most=4):
    for bit in rng.sample(range(64), rng.randint(0, most)):
        base ^= 1 << bit
    return base


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "One  two\nTHREE", "É a b c d e f", "x " * 500]
    texts += [" ".join(rng.choice(["aa", "Bb", "cé", "漢"]) for _ in range(rng.randint(1, 60))) for _ in range(50)]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_every_close_pair_shares_a_band():
    rng = random.Random(2)
    masks = band_masks()
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = near(rng, a)
        assert any(a & m == b & m for m in masks)


def test_forest_connects_what_brute_force_connects():
    rng = random.Random(3)
    fps, bucket = [], []
    for run in range(60):
        base = rng.getrandbits(64)
        n = rng.choice([1, 2, 3, 70, 200])
        fps += [near(rng, base if rng.random() < 0.5 else rng.getrandbits(64), 6) for _ in range(n)]
        bucket += [run] * n
    edges = forest(np.array(fps, np.uint64), np.array(bucket), np.arange(len(fps)), 4)
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    for run in range(60):
        own = [f for f, b in zip(fps, bucket, strict=True) if b == run]
        place = {f: i for i, f in enumerate(own)}
        parent = list(range(len(own)))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            if a in place and b in place:
                parent[root(place[a])] = root(place[b])
        got = [root(place[f]) for f in own]
        want = plain_components(own)
        assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_and_components_over_small_parts(spark):
    rng = random.Random(4)
    fps = set()
    base = rng.getrandbits(64)
    for _ in range(300):  # one group that every part of a bucket meets, and chains away from it
        base = near(rng, base, 2)
        fps.add(base)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    distinct = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(5)
    roots = {r.node: r.root for r in components(near_links(distinct, part=16)).collect()}
    got = [roots.get(signed(f), signed(f)) for f in fps]
    want = plain_components(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))


def test_defined_cases(spark):
    long_text = "alpha beta gamma delta " * 20_000
    rows = [
        (1, None, "x", 1), (2, "", "x", 1), (3, " \n", None, None), (4, "a b c", None, 1), (5, "A  b C", None, 1),
        (6, long_text, None, 1), (7, long_text, None, 1), (7, long_text, None, 1), (None, "lonely words here now", None, 1),
    ]
    got = simhash_dedup(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in got.collect())
    assert found == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (7, 6)]
    assert {r.fingerprint for r in got.where("doc_id < 4").collect()} == {"0" * 16}
    kept = keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "component_id", "fp"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6]
    assert simhash_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tables_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [plain_fingerprint(t) for _, t in texts]
    roots = plain_components(fps)
    want = [Row(doc_id=i, fingerprint=f"{f:016x}", component_id=texts[r][0]) for (i, _), f, r in zip(texts, fps, roots, strict=True)]
    got = sorted(simhash_dedup(docs).collect(), key=lambda r: r.doc_id)
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_one_row_of_each_component_stays(spark):
    one, two, three = (" ".join(f"{w}{k}" for k in range(60)) for w in ("apple", "birch", "cedar"))
    rows = [
        (5, one, "x", 1), (5, one, "x", 1), (5, one, "y", 1),  # the kept id again, once with other columns
        (3, two, None, 1), (5, two, None, 1),  # an id that is the smallest elsewhere
        (None, three, None, 1), (None, three, None, 1),  # nothing but null ids
        (None, two, None, 1), (None, one, None, 1),
    ]
    for parts in (1, 4):
        kept = keep_one(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(5, one), (3, two), (0, three)])
