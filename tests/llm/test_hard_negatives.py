import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.llm.hard_negatives import best_places, exact_scores, hard_negatives, primes_below

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, site int"


def plain(rows, positives=5, negatives=3, every=4):
    good = [
        (i, lab, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))
        for i, v, lab in rows
        if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q, lab, a in sorted({r for r in good if r[0] % every == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i, other == lab) for i, other, b in good if i != q)
        for p in [s for s in scored if s[2]][:positives]:
            inside = [s for s in scored if not s[2] and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:negatives]
            out += [(q, p[1], n + 1, s[1], -p[0], -s[0]) for n, s in enumerate(inside)]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives(frame, F.col("vec_id") % 4 == 0, **options).collect())


@pytest.mark.parametrize("components", [1 << 19, 100])
def test_against_brute_force(spark, components):
    rng = random.Random(3)
    common = [rng.gauss(0.1, 0.3) for _ in range(9)]
    rows = [(i, common if i % 3 == 0 else [rng.gauss(0.1, 0.3) for _ in range(9)], i * i % 5) for i in range(-40, 160)]
    want = plain(rows)
    assert len(want) > 200
    assert found(spark, rows, components=components) == want
    assert found(spark, rows, components=components, positives=200, negatives=2) == plain(rows, 200, 2)


def test_one_id_on_a_third_of_the_rows(spark):
    rng = random.Random(4)
    rows = [(8 if i % 3 == 0 else i, [rng.random(), rng.random()], i % 2) for i in range(120)]
    rows += [(8, [0.5, 0.5], 1)] * 40
    assert found(spark, rows, components=30) == plain(rows)


def test_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5], 1), (1, None, 1), (2, [1.0, None], 1), (3, [inf, 0.0], 1), (4, [nan, 1.0], 1), (5, [], 1)]
    rows += [(6, [0.25], 1), (7, [-1.0, 900.0, 3.0], 2), (None, [1.0, 1.0], 1), (8, [0.75, 0.5], None)]
    rows += [(9, [0.75], 2), (9, [0.75], 2), (12, [-1.0, -1.0], 3), (13, [-0.5, 1.0], 3), (16, [0.0, 0.0], 4), (17, [0.0], 4)]
    rows += [(20, [0.9, 0.4], 1), (20, [0.9, 0.4], 1)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(4, [1.0], 1)]) == []
    assert found(spark, [(3, [1.0], 1)]) == []
    wide = [(i, [float(i % 7)] * 3000, i % 2) for i in range(10)]
    assert found(spark, wide) == plain(wide)
    with pytest.raises(Exception, match="do not fit"):
        found(spark, [(0, [1e12], 1), (4, [1e12], 1)])


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for size, width in ((3, 1), (300, 64), (1 << 22, 700), (1 << 23, 3)):
        a, b = rng.integers(-size, size, (7, width)), rng.integers(-size, size, (11, width))
        assert (exact_scores(a, b) == a @ b.T).all()
    assert exact_scores(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2
    top = np.full((1, 4), (1 << 26) - 1)
    assert exact_scores(top, -top)[0, 0] == -4 * ((1 << 26) - 1) ** 2
    assert primes_below(5) == [31, 29, 23, 19, 17, 13, 11, 7, 5, 3]


def test_ties_go_to_the_earlier_place():
    x, y = best_places(np.array([[1, 3, 3, 3, 2], [0, 0, 0, 0, 0]]), 2)
    assert (x.tolist(), y.tolist()) == ([0, 0, 1, 1], [1, 2, 0, 1])
