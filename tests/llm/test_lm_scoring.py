import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.llm.lm_scoring import Automaton, lm_scores
from talkweave.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, chunk long, score string, held_out boolean"


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def held(id):
    return id is not None and zlib.crc32(str(id).encode()) % 5 == 1


def plain(rows, discount=0.75, least=2):
    """Probabilities from the definitions, one token after the other."""
    words, pairs = Counter(), Counter()
    texts = [(id, tokens_of(t)) for id, t in rows]
    for id, tokens in texts:
        if not held(id):
            words.update(tokens)
            pairs.update(zip([""] + tokens, tokens))
    starts = words[None]
    n, v = sum(words.values()), len(words)
    arcs = {p: c for p, c in pairs.items() if c >= least}
    kept = defaultdict(float)
    for (h, _), c in arcs.items():
        kept[h] += c - discount
    root = lambda w: (words[w] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for id, tokens in texts:
        base = score = 0.0
        for h, w in zip([""] + tokens, tokens):
            size = starts if h == "" else words[h]
            p = root(w)
            base += math.log10(p)
            if size:
                p *= 1 - kept[h] / size
                if (h, w) in arcs:
                    p += (arcs[h, w] - discount) / size
            score += math.log10(p)
        out.append((-1 if id is None else id, held(id), len(tokens), sum(words[t] > 0 for t in tokens), n, round(base, 6), round(score, 6)))
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], SCHEMA)
    condition = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = lm_scores(frame, condition, **options).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)


def corpus(seed, n=200):
    rng = random.Random(seed)
    words = ["The", "cat", "É", "sat", "on", "mat.", "\x1c", "a", "dog", "ran", "off"]
    return [(i, None if rng.random() < 0.05 else rng.choice([" ", "\n", "\t "]).join(rng.choices(words, [1 / (k + 1) for k in range(11)], k=rng.randrange(30)) + rng.choices([f"rare{i}", "twice"], k=rng.randrange(2)))) for i in range(n)]


@pytest.mark.parametrize("tokens, lane", [(1 << 22, 256), (50, 7), (1, 1)])
def test_against_definitions(spark, tokens, lane):
    rows = corpus(tokens, 200 if tokens > 1 else 40)
    got, want = found(spark, rows, tokens=tokens, lane=lane), plain(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], atol=2e-5)


def test_defined_cases(spark):
    assert found(spark, []) == []
    some = next(i for i in range(99) if held(i))
    assert found(spark, [(some, "only held out")]) == [(some, True, 4, 0, 0, 0.0, 0.0)]
    rows = [(None, "a b a b"), (None, "a b a b"), (7, None), (7, ""), (7, "a b"), (8, "w" * 40_000)] + [(some, "a b c")] * 3
    for tokens in (1 << 22, 3):
        got, want = found(spark, rows, tokens=tokens), plain(rows)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], atol=2e-5)
    long = [(1, "to be or not " * 30_000), (some, "not to be " * 20_000)]
    got, want = found(spark, long, tokens=5000), plain(long)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_probabilities_of_a_state_add_up():
    words, counts = np.array([1, 2, 3]), np.array([6, 4, 2])
    pairs = np.array([(0 << 32) | 1, (1 << 32) | 2, (1 << 32) | 3])
    model = Automaton(words, counts, np.array([3.5, 0, 0]), pairs, np.array([3, 3, 2]), 12, 3, 4, 2.25)
    every = np.array([1, 2, 3, -1])
    for state in (-1, 0, 1, 2, 3):
        cost, _ = model.step(np.full(4, state), every, model.read_at_root(every))
        assert np.isclose((10**cost).sum(), 1)


def test_whole_table_and_held_out_texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = plain([tuple(r) for r in rows])
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in QUERIES["op13_lm_scoring"](spark, sf).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=2e-6)
    # Also texts that it did not learn from are better predicted than by words alone.
    unseen = [r for r in got if r[1]]
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen)
