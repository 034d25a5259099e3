import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.llm.top_k import _best_partials, _partials, top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def plain(rows, k, every=3):
    good = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in good if i % every == 0}):
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, None, 1) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in top_k(frame, F.col("vec_id") % 3 == 0, **options).collect())


@pytest.mark.parametrize("site, queries", [(4096, 1024), (40, 17)])
def test_against_brute_force(spark, site, queries):
    rng = random.Random(1)
    common = [rng.gauss(0, 0.2) for _ in range(9)]
    rows = [(i, common if i % 5 == 0 else [rng.gauss(0, 0.2) for _ in range(9)]) for i in range(-30, 170)]
    assert found(spark, rows, k=7, site=site, queries=queries) == plain(rows, 7)


def test_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [inf, 0.0]), (4, [nan, 1.0]), (5, []), (6, [0.25]), (7, [-1.0, 1e6, 3.0])]
    rows += [(None, [1.0, 1.0]), (7, [-1.0, 1e6, 3.0]), (9, [1e9, 1e9]), (9, [1e9, 1e9]), (9, [2.0, 0.0])]
    assert found(spark, rows, k=4) == plain(rows, 4)
    assert found(spark, []) == []
    assert found(spark, [(3, [1.0])]) == []
    wide = [(i, [float(i % 7)] * 3000) for i in range(10)]
    assert found(spark, wide, k=20) == plain(wide, 20)


def test_a_lists_entries_hold_the_best_of_each_slice():
    rng = np.random.default_rng(2)
    queries, rows = rng.integers(-9, 9, (5, 8)), rng.integers(-9, 9, (50, 8))
    partials = _partials(queries, rows, 4)
    assert (sum(partials) == queries @ rows.T).all()
    q, r = _best_partials(partials, np.zeros((5, 50), bool), 3)
    for i in range(5):
        mine = set(r[q == i].tolist())
        for p in partials:
            third = np.sort(p[i])[-3]
            assert set(np.flatnonzero(p[i] > third).tolist()) <= mine
