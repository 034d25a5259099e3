import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
from compare import difference, duck, duck_rows, spark_rows
from pyspark.sql import functions as F

from talkweave.llm.exact_dedup import exact_dedup, frequent_digests, reduce_counts
from talkweave.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, keep_id string, digest int, n int, group_size int"


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force_with_heavy_digests(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "", None, f"t{rng.randint(0, 40)}", f"once {i}"])) for i in range(400)]
    rows += [(7, "hot"), (7, "hot"), (None, "hot"), (None, "alone"), (500, "long " * 100_000)]
    frame = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA).repartition(6)
    for counters in (1024, 4, 1):
        got = sorted((tuple(r) for r in exact_dedup(frame, counters=counters).collect()), key=str)
        assert got == plain(rows)
    lower = exact_dedup(frame, normalise=F.lower("text"))
    assert lower.count() == len(rows)
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_summary_bounds():
    rng = random.Random(2)
    stream = ["a"] * 300 + ["b"] * 200 + [f"x{i}" for i in range(500)]
    rng.shuffle(stream)
    values, counts = pa.array([], pa.string()), pa.array([], pa.int64())
    for at in range(0, len(stream), 50):
        part = stream[at : at + 50]
        values, counts = reduce_counts(pa.concat_arrays([values, pa.array(part)]), pa.concat_arrays([counts, pa.array([1] * 50, pa.int64())]), 9)
        assert len(values) <= 9
    kept, true = dict(zip(values.to_pylist(), counts.to_pylist(), strict=True)), Counter(stream)
    for value, n in true.items():
        assert n - len(stream) / 10 <= kept.get(value, 0) <= n


def test_candidates_hold_every_heavy_digest_and_are_few(spark):
    rows = [(b"h%d" % (i % 3),) for i in range(3000)] + [(b"r%d" % i,) for i in range(3000)]
    digests = spark.createDataFrame(rows, "digest binary").repartition(5)
    found = {bytes(r.digest) for r in frequent_digests(digests, 6000, 15).collect()}
    assert {b"h0", b"h1", b"h2"} <= found and len(found) <= 15


def test_query_against_sql(spark, sf):
    got = spark_rows(QUERIES["op6_exact_dedup"](spark, sf))
    assert difference(got, duck_rows(duck(sf), SQL["op6_exact_dedup"])) is None
