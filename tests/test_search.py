import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.functions.text import query_tokens
from talkweave.operators import search

DOCS = [
    (0, "The cat sat. Category theory and concatenation, cat cat."),
    (1, "Crème brûlée for the CAT"),
    (2, "dogs and catalogues"),
    (3, None),
    (4, "... !!! ..."),
    (5, "café theory of cafés"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id int, text string")


def fts(rows):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO d(rowid, text) VALUES (?, ?)", rows)
    return con


def match(query, how):
    return how.join(f'"{t}"*' for t in query_tokens(query))


@pytest.mark.parametrize("query", ["cat", "cat theory", "creme cafe", "zzz", "the of and"])
def test_bm25_equals_fts5(spark, docs, query):
    postings, lengths = search.build_token_index(docs, "id")
    got = {r.id: r.score for r in search.bm25(postings, lengths, query).collect()}
    want = dict(fts(DOCS).execute("SELECT rowid, bm25(d) FROM d WHERE d MATCH ?", (match(query, " OR "),)))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


@pytest.mark.parametrize("query", ["th", "la re", "an de le", "ing"])
def test_bm25_equals_fts5_on_documents(spark, sf, query):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    postings, lengths = search.store_token_index(rows, "doc_id")
    got = {r.doc_id: r.score for r in search.bm25(postings, lengths, query).collect()}
    con = fts([tuple(r) for r in rows.collect()])
    want = dict(con.execute("SELECT rowid, bm25(d) FROM d WHERE d MATCH ?", (match(query, " OR "),)))
    assert got.keys() == want.keys() and len(want) > 0
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    both = dict(con.execute("SELECT rowid, 1 FROM d WHERE d MATCH ?", (match(query, " AND "),)))
    messages = rows.select(F.col("doc_id"), F.col("doc_id").alias("message_id"), F.lit("c").alias("conversation_id"),
                           F.expr("TIMESTAMP_NTZ'2024-01-01'").alias("sent_at"), F.lit("to_me").alias("direction"))
    found = search.search_messages(messages, postings, query, limit=5000).collect()
    assert {r.doc_id for r in found} == set(both)
    assert [r.doc_id for r in found] == sorted(both, reverse=True)


def test_fusion(spark):
    semantic = spark.createDataFrame([("a", 0.9), ("b", 0.2), ("c", -0.1)], "passage_id string, similarity double")
    lexical = spark.createDataFrame([("b", 0), ("d", 1), ("c", 2)], "passage_id string, lexical_rank int")
    got = [(r.passage_id, r.match, r.relevance) for r in search.fuse(semantic, lexical, 10).collect()]
    assert got == [("b", "hybrid", 0.2), ("a", "semantic", 0.9), ("d", "keyword", 0.0), ("c", "keyword", 0.0)]
    assert len(search.fuse(semantic, lexical, 2).collect()) == 2


def test_no_vectors_and_no_words(spark, docs):
    passages = docs.select(F.col("id").alias("passage_id"), "text", F.lit(None).cast("array<float>").alias("embedding"))
    postings, lengths = search.build_token_index(passages, "passage_id")
    rows = search.search_context(passages, postings, lengths, "cat", None).collect()
    assert {r.passage_id for r in rows} == {0, 1, 2} and {r.match for r in rows} == {"keyword"}
    assert search.bm25(postings, lengths, "! ?").count() == 0
    with pytest.raises(ValueError):
        search.search_messages(passages, postings, "! ?")


def test_models_see_every_text_once(spark, docs):
    def fn(texts):
        assert texts == sorted(texts, key=len)
        return np.array([[len(t), 0.0, 1.0] for t in texts], dtype="float32")

    got = {r.id: r.embedding for r in search.embed_passages(docs.coalesce(1), fn, dims=4).collect()}
    for i, t in DOCS:
        v = np.array([len(t or ""), 0.0, 1.0, 0.0])
        assert got[i] == pytest.approx(list(v / np.linalg.norm(v)), abs=1e-6)


def test_occurrences(spark, docs):
    got = [(r.id, r.occurrence) for r in search.find_occurrences(docs, "id", "text", "CAFÉ").orderBy("id", "occurrence").collect()]
    assert got == [(5, 0), (5, 1)]
    text = spark.createDataFrame([(1, "aaaaa")], "id int, text string")
    assert search.find_occurrences(text, "id", "text", "aa").count() == 2
    assert search.find_occurrences(text, "id", "text", "  ").count() == 0
