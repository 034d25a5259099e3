import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from talkweave.llm import word_chunks as wc
from talkweave.llm.collocations import count_tiles, phrases, split_pieces

SCHEMA = "text string, lang string, chunk long, grp string, word string"


def plain(rows, min_count=10, top=2000, covered=50):
    grams = defaultdict(Counter)
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                grams["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in grams.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        frequent = {g: a for g, a in f.items() if len(g) > 1 and a >= min_count}
        mine = []
        for g, a in frequent.items():
            longer = [b for h, b in frequent.items() if len(h) == 3 and len(g) == 2 and g in (h[:2], h[1:])]
            if any(100 * b >= covered * a for b in longer):
                continue
            cuts = [(1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            mine.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for place, (score, a, phrase, left, right) in enumerate(sorted(mine)[:top]):
            out.append((lang, place + 1, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(t, lang, 1, "x", "y") for t, lang in rows], SCHEMA)
    return sorted(tuple(r) for r in phrases(frame, **options).collect())


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "b", "É", "The", "of", "x.y", "d\te", "f,", "\x1c", "ß!", "q\r\nr", "nach bar", "m", "n", "o"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = ["new york city", "New York", "of the of the of the", "", " . ", "and so On; and so on"]
    return [
        (
            rng.choice([" ", "  ", "\t"]).join(rng.choice(fixed) if rng.random() < 0.2 else rng.choices(words, weights)[0] for _ in range(rng.randrange(40)))
            if rng.random() > 0.05 else None,
            rng.choice(["en", "de", None, "und", ""]),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("tokens", [1 << 22, 37, 1])
def test_against_brute_force(spark, tokens):
    rows = corpus(tokens)
    want = plain(rows)
    assert len(want) > 100
    assert found(spark, rows, tokens=tokens) == want


def test_limits_are_parameters(spark):
    rows = corpus(5, 100)
    assert found(spark, rows, min_count=3, top=7, covered=80) == plain(rows, 3, 7, 80)
    assert found(spark, rows, min_count=2, top=None) == plain(rows, 2, None)


def test_defined_cases(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("", "en"), ("....", "en"), ("word", "en")]) == []
    rows = [("one two three", "en")] * 400 + [("x" * 50_000 + " y", None)] * 10
    assert found(spark, rows) == plain(rows)
    long = [("to be or not " * 20_000, "en")]
    assert found(spark, long, tokens=1000) == plain(long)


def test_tiles_dense_and_sparse():
    rng = np.random.default_rng(3)
    first = np.concatenate([rng.integers(0, 40, 5000), rng.integers(0, 1 << 30, 500)])
    second = np.concatenate([rng.integers(0, 40, 5000), rng.integers(0, 1 << 31, 500)])
    got = {(a, b): n for a, b, n in zip(*(c.tolist() for c in count_tiles(first, second, tile=16, head=4)), strict=True)}
    assert got == Counter(zip(first.tolist(), second.tolist(), strict=True))
    assert [len(c) for c in count_tiles(first[:0], second[:0])] == [0, 0, 0]


def test_slices_keep_every_byte_and_no_word_is_cut():
    rng = random.Random(2)
    text = " ".join("w" * rng.randrange(1, 30) for _ in range(500)).encode()
    parts = list(wc.slices(text, b" ", 64))
    assert b"".join(parts) == text and all(p.endswith(b" ") for p in parts[:-1]) and len(parts) > 50
    assert list(wc.slices(b"x" * 300, b" ", 64)) == [b"x" * 300]
    assert list(split_pieces(b"A.b\tC\x0bd")) == [[b"a", wc.BREAK_WORD, b"b", b"c", wc.BREAK_WORD, b"d"]]


def test_sequences_come_back():
    numbers = np.array([0, 1, 255, 256, 70_000, (1 << 31) - 1])
    assert wc.unpack_sequence(wc.pack_sequence(numbers)).tolist() == numbers.tolist()


def test_numbers_have_no_gaps_and_follow_counts(spark):
    rows = [(f"w{i}", 1 + i % 97) for i in range(2000)]
    placed = wc.number_by_count(spark.createDataFrame(rows, "word string, n long"), "n", ["word"]).collect()
    assert sorted(r.number for r in placed) == list(range(1, 2001))
    by = sorted(placed, key=lambda r: r.number)
    assert all(a.n * 1.2 >= b.n for a, b in zip(by, by[1:]))
