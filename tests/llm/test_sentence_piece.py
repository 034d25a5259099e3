import random

import numpy as np
import pytest
import sentencepiece

from talkweave.llm import sentence_piece as S

ODD = [
    "Hello world", "  two  spaces\n\nnew", " lead", "trail ", "", None, "tab\there é ü 漢字 😀", "a\xa0b", " " * 40,
    "a" * 700, "ab " * 900, "x" * 100 + "漢" * 300 + "hello" * 100, "<s> </s> <unk> <0x0A>", "\x00\x01", "▁lit ▁▁ x▁y",
]


@pytest.fixture(scope="module")
def vocab():
    return S.Vocabulary.load()


def agenda(vocab, text, key, limit):
    """The whole text with one agenda, a step at a time, over strings."""
    n_key = int(key)
    marked = [int(vocab.char_ids[32])] + [int(vocab.char_ids[ord(c)]) for c in text]
    spans = [(i, i + 1, s) for i, s in enumerate(marked)]
    while True:
        best = None
        for k in range(len(spans) - 1):
            (a, m, x), (_, e, y) = spans[k], spans[k + 1]
            made = vocab.pairs.get(x << 20 | y, -1) if x >= 0 and y >= 0 else -1
            if made >= 0 and not S._skipped(a, m, e, n_key, limit):
                best = min(best, (int(vocab.rank[made]), k, made)) if best else (int(vocab.rank[made]), k, made)
        if best is None:
            break
        _, k, made = best
        spans[k : k + 2] = [(spans[k][0], spans[k + 1][1], made)]
    out = []
    for a, _, s in spans:
        out += [s] if s >= 0 else [int(vocab.byte_ids[b]) for b in text[a - 1].encode()]
    return out


def test_without_dropout_it_is_the_library(vocab):
    model = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    texts = [t for t in ODD if t and "▁" not in t]
    got = S.encode(vocab, texts, np.arange(len(texts)))
    assert [g.tolist() for g in got] == [list(x) for x in model.encode(texts)]


@pytest.mark.parametrize("long", [4, S.LONG])
def test_dropout_against_plain_agenda(vocab, long, monkeypatch):
    monkeypatch.setattr(S, "LONG", long)
    monkeypatch.setattr(S, "CHARS", 64)
    rng = random.Random(5)
    texts = ["".join(rng.choice("thea ion  s漢\n▁") for _ in range(rng.randint(1, 200))) for _ in range(30)]
    keys = np.arange(len(texts), dtype=np.uint64)
    for p in (0.0, 0.2, 0.7, 1.0):
        limit = min(int(p * 2.0**64), S.ALL)
        mixed = S.mixed(keys ^ S.mixed(np.array([9], np.int64).view(np.uint64)))
        got = [x.tolist() for x in S.encode(vocab, texts, keys, p, 9)]
        assert got == [agenda(vocab, t, k, limit) for t, k in zip(texts, mixed, strict=True)]
        assert [vocab.decode(x) for x in got] == texts


def test_seeds_vary_and_repeat(vocab):
    text = ["the quick brown foxes of internationalisation " * 50]
    runs = [S.encode(vocab, text, np.array([1]), 0.3, seed)[0].tolist() for seed in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2]
    assert S.encode(vocab, text, np.array([2]), 0.3, 1)[0].tolist() != runs[0]
    assert len(S.encode(vocab, text, np.array([1]), 0.0)[0]) < len(runs[0])


def test_round_trip_in_spark(spark):
    rows = [(i, t, "x", [i], None) for i, t in enumerate(ODD)] + [(None, "null id", "y", None, 1), (0, ODD[0], "x", [0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, n array<int>, llm_text int")
    encoded = S.encode_documents(docs, dropout=0.3)
    assert encoded.columns == ["doc_id", "n", "llm_text", "tokens"]
    back = S.decode_documents(encoded).collect()
    want = sorted((i is not None, i or 0, t or "") for i, t, *_ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in back) == want
    same = [r.tokens for r in back if r.doc_id == 0]
    assert same[0] == same[1]
    assert S.decode_documents(S.encode_documents(spark.createDataFrame([], docs.schema))).count() == 0


def test_whole_table_decodes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    back = S.decode_documents(S.encode_documents(docs).withColumnRenamed("n_chars", "n"))
    given = docs.select("doc_id", docs["text"].alias("given"))
    assert back.join(given, "doc_id").where("text <> given").count() == 0
    assert back.count() == docs.count()


