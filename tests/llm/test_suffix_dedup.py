import hashlib
import random

import numpy as np
import pytest

from talkweave.llm import suffix_dedup as D
from talkweave.llm.queries import QUERIES
from talkweave.llm.suffix_array import permuted_common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, spans string, d int, key string"


def plain(docs, length):
    """Spans by a set of strings; docs: (id, text) in order."""
    seen, out = set(), {}
    for i, text in docs:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for a in range(len(raw) - length + 1):
            if raw[a : a + length] in seen:
                gone[a : a + length] = [True] * length
            seen.add(raw[a : a + length])
        spans, a = [], 0
        while a < len(raw):
            b = a
            while b < len(raw) and gone[b] == gone[a]:
                b += 1
            if gone[a]:
                spans.append((a, b - a))
            a = b
        out[i] = (len(raw), bytes(c for c, g in zip(raw, gone, strict=True) if not g), spans)
    return out


@pytest.mark.parametrize("size", [4, 2000])  # waves, and the loop
def test_suffix_array(size):
    rng = random.Random(1)
    for _ in range(200):
        n, k = rng.randint(0, 80), rng.choice([1, 2, 3])
        text = [rng.randint(1, k) for _ in range(n)] + [0]
        got = suffix_array(np.array(text), size).tolist()
        want = sorted(range(n + 1), key=lambda i: text[i:])
        assert got == want
        shared = permuted_common_prefixes(np.array(text), np.array(got))
        for a, b in zip(want, want[1:]):
            n_shared = 0
            while max(a, b) + n_shared < len(text) and text[a + n_shared] == text[b + n_shared]:
                n_shared += 1
            assert shared[b] == n_shared


def test_segments_cover_every_start_once(monkeypatch):
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab c\x00") for _ in range(rng.choice([0, 9, 10, 11, 300, 900]))) for _ in range(20)]
    texts.append(b"a" * 9000)
    for block in (D.BLOCK, 50):
        monkeypatch.setattr(D, "BLOCK", block)
        key, text, place, run, twice = D.segments(texts, 10, 4)
        starts = sorted((int(t), p + k) for t, p, n in zip(text, place.tolist(), run.tolist(), strict=True) for k in range(n))
        assert starts == [(t, a) for t, x in enumerate(texts) for a in range(len(x) - 9)]
        picked = {}
        for k, t, p, n in zip(key.tolist(), text.tolist(), place.tolist(), run.tolist(), strict=True):
            assert n <= D.MAX_RUN
            for a in range(p, p + n):
                assert picked.setdefault(texts[t][a : a + 10], k) == k


def made(seed, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(8, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 6)))
        rows.append((i, text))
    rows += [(n + 5, "xyzxy" * 6 + "pq"), (n + 6, "SCUM!! " * 20)]
    rows += [(n, "z" * 400), (n + 1, "z" * 30), (n + 2, None), (n + 3, rows[3][1]), (n + 4, passages[0] * 5)]
    return rows


@pytest.mark.parametrize("hot", [1 << 20, 300])  # no hot hash, and many
def test_against_brute_force(spark, hot):
    rows = made(3)
    want = plain(sorted(rows), 12)
    docs = spark.createDataFrame([(i, t, None, 1, "k") for i, t in rows], SCHEMA).repartition(7)
    got = D.suffix_dedup(docs, length=12, kmer=5, chunk=500, hot=hot).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, bytes(r.kept), [(s.start, s.length) for s in r.spans]) == want[r.doc_id]


def test_defined_cases(spark):
    text = "some words that come again and again in this text, " * 3000
    odd = "an id that comes twice with different texts " * 4
    rows = [(None, text, None, 1, "a"), (1, text, None, 1, "a"), (2, "", None, None, None), (3, None, None, None, None)]
    rows += [(4, odd, None, 1, "a"), (4, odd + "!", None, 1, "a"), (5, "Q" * 30 + odd, None, 1, "a"), (5, "Q" * 30 + odd, None, 1, "a")]
    got = D.suffix_dedup(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "n_bytes", "kept", "spans"]
    found = got.collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].kept == b"" and [(s.start, s.length) for s in by[1][0].spans] == [(0, len(text))]
    assert by[None][0].spans[0].start > 0 and by[None][0].n_bytes == len(text)
    assert not by[2][0].spans and not by[3][0].spans and by[3][0].n_bytes == 0
    assert by[5][0] == by[5][1] and bytes(by[5][0].kept).startswith(b"Q" * 30)
    assert D.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain(sorted((r.doc_id, r.text) for r in docs.collect()), 100)
    for r in QUERIES["op4_suffix_dedup"](spark, sf).collect():
        size, kept, spans = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (size, size - len(kept), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [1 << 20, 300])
def test_many_texts_under_one_id(spark, hot):
    """3 000 texts without an id: some share any 19 bits of a hash, and each has its own places."""
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh") for _ in range(40))
    texts = []
    for i in range(3000):
        own = "".join(rng.choice("ijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 90)))
        texts.append(f"{i:05d}" + (own + shared + own[::-1] if i % 2 else own + own[:40]))
    docs = spark.createDataFrame([(None, t, None, 1, "k") for t in texts], SCHEMA)
    order = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(cast(text as binary)) AS h").collect()}
    by_text = dict(enumerate(sorted(texts, key=order.get)))
    want = plain(list(by_text.items()), 30)
    left = sorted((n, kept, spans) for n, kept, spans in want.values())
    got = D.suffix_dedup(docs, length=30, kmer=8, chunk=5000, hot=hot).collect()
    assert sorted((r.n_bytes, bytes(r.kept), [(s.start, s.length) for s in r.spans]) for r in got) == left


@pytest.mark.parametrize("hot", [1 << 20, 300])
def test_many_rows_of_one_id_and_one_text(spark, hot):
    """They are one document: none loses what only the others hold."""
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(7, text), (None, text[:150] + "!")] * 150 + [(8, "x" + text), (9, text[50:100] + "?")]
    want = plain([(-1, text[:150] + "!"), (7, text), (8, "x" + text), (9, text[50:100] + "?")], 30)
    docs = spark.createDataFrame([(i, t, None, 1, "k") for i, t in rows], SCHEMA)
    got = D.suffix_dedup(docs, length=30, kmer=8, chunk=5000, hot=hot).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, bytes(r.kept), [(s.start, s.length) for s in r.spans]) == want[-1 if r.doc_id is None else r.doc_id]
