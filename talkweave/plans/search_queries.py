"""Index, word search, vector search, hybrid search."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import iso_text
from ..functions.redaction import redact_frame
from ..operators import search
from ..operators.filters import clamp_limit, filter_passages
from ..operators.reading import newest
from ..session import kept, new_folder
from ..sources.driver_tables import (
    KEY, messages_from_documents, passages_from_documents, query_vector, table,
)
from ..sources.vector_index import VectorIndex
from ..sources.word_index import WordIndex
from . import sql as q
from .catalog import query
from .tools import Toolbox

WORDS = ("eau", "ment")  # used as prefixes
QUERY = "Eau Mént"

TOKENS = r"""toks AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS token FROM documents)"""
POSTINGS = "postings AS (SELECT doc_id, token, count(*) AS tf FROM toks GROUP BY 1, 2)"
LENGTHS = """lengths AS (SELECT d.doc_id, count(t.token) AS length FROM documents d LEFT JOIN toks t USING (doc_id) GROUP BY 1)"""


def _bm25() -> str:
    hits = ", ".join(
        f"sum(CASE WHEN starts_with(token, '{w}') THEN tf ELSE 0 END) AS f{i}" for i, w in enumerate(WORDS)
    )
    where = " OR ".join(f"starts_with(token, '{w}')" for w in WORDS)
    dfs = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(WORDS)))
    terms = " + ".join(
        f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * length / mean))"
        for i in range(len(WORDS))
    )
    return f"""hits AS (SELECT doc_id, {hits} FROM postings WHERE {where} GROUP BY 1),
found AS (SELECT {dfs} FROM hits), corpus AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean FROM lengths),
bm AS (SELECT doc_id, -({terms}) AS score FROM hits JOIN lengths USING (doc_id), found, corpus)"""


INDEX = q.with_(TOKENS, POSTINGS, LENGTHS, _bm25())


def _texts(spark, sf, id):
    return table(spark, sf, "documents").select(F.col("doc_id").alias(id), "text")


def _words(spark, sf) -> WordIndex:
    """The index of the folder's documents, built when the first query of an application asks for it."""
    return kept(spark, ("words", sf), lambda path: WordIndex(spark, path, "doc_id").add(_texts(spark, sf, "doc_id"), 0))


def _index(spark, sf, id="doc_id", prefixes=WORDS):
    """Postings of the query's words, and all lengths."""
    index = _words(spark, sf)
    return tuple(rows.withColumnRenamed("doc_id", id) for rows in (index.postings(prefixes), index.lengths()))


@query("token_index", INDEX + "SELECT token, count(*) AS documents, sum(tf)::BIGINT AS occurrences, max(tf) AS most FROM postings GROUP BY 1")
def token_index(spark, sf):
    postings, _ = search.build_token_index(_texts(spark, sf, "doc_id"), "doc_id")
    return postings.groupBy("token").agg(
        F.count("*").alias("documents"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most")
    )


@query("corpus_stats", INDEX + """SELECT token, count(*) AS df, (SELECT count(*) FROM lengths) AS documents,
  round((SELECT avg(length) FROM lengths), 6) AS mean_length FROM postings GROUP BY 1""")
def corpus_stats(spark, sf):
    rows = search.corpus_stats(*_index(spark, sf, prefixes=None))
    return rows.withColumn("mean_length", F.round("mean_length", 6))


@query("bm25_topk", INDEX + "SELECT doc_id, round(score, 9) AS score FROM (SELECT * FROM bm ORDER BY score, doc_id LIMIT 150)")
def bm25_topk(spark, sf):
    rows = _words(spark, sf).bm25_topk(QUERY, 150)
    return rows.withColumn("score", F.round("score", 9))


@query("prefix_terms", INDEX + "SELECT token, count(*) AS documents, sum(tf)::BIGINT AS occurrences FROM postings WHERE starts_with(token, 'eau') GROUP BY 1")
def prefix_terms(spark, sf):
    return _words(spark, sf).terms("eau")


@query("index_in_batches", INDEX + "SELECT token, count(*) AS documents, sum(tf)::BIGINT AS occurrences, max(tf) AS most FROM postings GROUP BY 1")
def index_in_batches(spark, sf):
    """Five batches: one brings late texts, the last rebuilds a source that was indexed with other texts."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    moved = F.col("source") == "src1"
    late = F.col("doc_id") % 50 == 3
    batch = F.when(late, 3).otherwise(F.col("doc_id") % 7 % 3)
    docs = docs.withColumn("batch", batch)
    stale = docs.withColumn("text", F.when(moved, F.concat(F.reverse("text"), F.lit(" stale"))).otherwise(F.col("text")))
    index = WordIndex(spark, new_folder(spark), ["source", "doc_id"])
    for n in range(4):
        index.add(stale.where(F.col("batch") == n), n)
        if n == 2:
            index.merge(n)
    index.add(docs.where(moved), 4, rebuilt=docs.where(moved).select("source").distinct())
    return index.postings().groupBy("token").agg(
        F.count("*").alias("documents"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most")
    )


@query("bm25_all", INDEX + "SELECT doc_id, round(score, 9) AS score FROM bm")
def bm25_all(spark, sf):
    return search.bm25(*_index(spark, sf), QUERY).withColumn("score", F.round("score", 9))


@query("lexical_rank", INDEX + "SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) - 1 AS lexical_rank FROM bm ORDER BY 2 LIMIT 800")
def lexical_rank(spark, sf):
    return search.rank_lexical(search.bm25(*_index(spark, sf), QUERY), 800, "doc_id")


@query("search_all_tokens", INDEX + """SELECT d.doc_id AS message_id, source AS conversation_id FROM documents d JOIN hits USING (doc_id)
  WHERE f0 > 0 AND f1 > 0 AND doc_id % 2 = 0 ORDER BY d.doc_id DESC LIMIT 100""")
def search_all_tokens(spark, sf):
    messages = messages_from_documents(spark, sf)
    postings, _ = _index(spark, sf, "message_id")
    found = search.search_messages(messages, postings, QUERY, limit=100, direction="from_me")
    return found.select("message_id", "conversation_id")


@query("scan_substring", """SELECT doc_id AS message_id, source AS conversation_id FROM documents
  WHERE contains(lower(text), 'ion the') AND lang IN ('en', 'de') ORDER BY doc_id DESC LIMIT 500""")
def scan_substring(spark, sf):
    found = search.scan_messages(
        messages_from_documents(spark, sf), "Ion THE", limit=500, person_ids=["en", "de"]
    )
    return found.select("message_id", "conversation_id")


@query("validated_query", "SELECT doc_id AS message_id FROM documents WHERE contains(lower(text), 'ion the')")
def validated_query(spark, sf):
    """Blanks around a query do not count; an empty or too long one is refused."""
    for wrong in ("", " \n ", "x" * 501):
        try:
            search.scan_messages(messages_from_documents(spark, sf), wrong)
        except ValueError:
            continue
        raise AssertionError(f"a query of {len(wrong)} characters was taken")
    return search.scan_messages(messages_from_documents(spark, sf), "  Ion THE \n").select("message_id")


@query("raw_text_scan", "SELECT doc_id AS message_id, false AS shows_address FROM documents WHERE contains(lower(text), '@mail2.example') ORDER BY doc_id DESC LIMIT 5000")
def raw_text_scan(spark, sf):
    """An address is found in the texts as stored, and is not in what is shown."""
    stored = messages_from_documents(spark, sf).withColumns(
        {c: F.lit(None).cast("string") for c in ("speaker", "sender_name", "service", "subject")}
    ).withColumn("is_reply", F.lit(False))
    tools = Toolbox(KEY, messages=redact_frame(stored), raw_messages=stored)
    shown = tools.search_messages("@mail2.example", limit=5_000).shown["messages"]
    return shown.select("message_id", F.coalesce(F.col("text").contains("@mail2"), F.lit(False)).alias("shows_address"))


@query("clamped_pages", """WITH m AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id DESC) AS place FROM documents)
  SELECT asked, doc_id AS message_id FROM m, (VALUES (0, 1), (-1, 100), (20000, 10000)) AS sizes(asked, size) WHERE place <= size""")
def clamped_pages(spark, sf):
    """What pages of 0, of no given size (-1) and of 20 000 rows hold where 1 to 10 000 are allowed."""
    messages = messages_from_documents(spark, sf)
    pages = [
        newest(messages, clamp_limit(None if asked < 0 else asked, 1, 10_000, 100)).select(F.lit(asked).alias("asked"), "message_id")
        for asked in (0, -1, 20_000)
    ]
    return reduce(DataFrame.unionAll, pages)


SIMILAR = """near_passages AS (SELECT p.passage_id, list_cosine_similarity(list_transform(p.embedding, lambda x: x::DOUBLE),
    (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0)) AS similarity, p.*
  FROM passages p WHERE embedding IS NOT NULL)"""
VECTORS = q.with_(q.DOCUMENT_PASSAGES, SIMILAR.replace("SELECT p.passage_id, ", "SELECT ").replace(
    "AS similarity, p.*", "AS similarity, p.passage_id, p.start_at, p.end_at, p.direction, p.lang, p.conversation_id"))


@query("vector_topk", VECTORS + "SELECT passage_id, round(similarity, 6) AS similarity FROM (SELECT * FROM near_passages ORDER BY similarity DESC, passage_id LIMIT 100)")
def vector_topk(spark, sf):
    rows = search.vector_topk(passages_from_documents(spark, sf), query_vector(spark, sf), 100)
    return rows.withColumn("similarity", F.round("similarity", 6))


@query("vector_topk_filtered", VECTORS + """SELECT passage_id, round(similarity, 6) AS similarity FROM (SELECT * FROM near_passages
  WHERE lang = 'en' AND direction = 'to_me' AND end_at >= TIMESTAMP '2024-01-05' ORDER BY similarity DESC, passage_id LIMIT 50)""")
def vector_topk_filtered(spark, sf):
    rows = search.vector_topk(
        passages_from_documents(spark, sf), query_vector(spark, sf), 50,
        person_ids=["en"], direction="to_me", since="2024-01-05T00:00:00Z",
    )
    return rows.withColumn("similarity", F.round("similarity", 6))


def _vector_index(spark, sf) -> VectorIndex:
    """Vectors in three batches, the last of them given twice."""

    def build(folder: str) -> VectorIndex:
        passages = passages_from_documents(spark, sf)
        index = VectorIndex(spark, folder).fit(passages, 32)
        batch = F.pmod(F.xxhash64("passage_id"), F.lit(3))
        for n in (0, 1, 2, 2):
            index.add(passages.where(batch == n), n)
        return index

    return kept(spark, ("vectors", sf), build)


@query("vector_topk_pruned", VECTORS + "SELECT passage_id, round(similarity, 6) AS similarity FROM (SELECT * FROM near_passages ORDER BY similarity DESC, passage_id LIMIT 100)")
def vector_topk_pruned(spark, sf):
    rows = _vector_index(spark, sf).topk(query_vector(spark, sf), 100)
    return rows.withColumn("similarity", F.round("similarity", 6))


@query("vector_topk_pruned_filtered", VECTORS + """SELECT passage_id, round(similarity, 6) AS similarity FROM (SELECT * FROM near_passages
  WHERE lang = 'en' AND direction = 'to_me' AND end_at >= TIMESTAMP '2024-01-05' ORDER BY similarity DESC, passage_id LIMIT 50)""")
def vector_topk_pruned_filtered(spark, sf):
    allowed = filter_passages(passages_from_documents(spark, sf), person_ids=["en"], direction="to_me", since="2024-01-05T00:00:00Z")
    rows = _vector_index(spark, sf).topk(query_vector(spark, sf), 50, allowed)
    return rows.withColumn("similarity", F.round("similarity", 6))


def _fused(allowed: str, limit: int) -> str:
    pool = min(800, 5 * limit)
    return f"""sem AS (SELECT passage_id, similarity FROM near_passages {allowed} ORDER BY similarity DESC, passage_id LIMIT {pool}),
lex AS (SELECT doc_id AS passage_id, row_number() OVER (ORDER BY score, doc_id) - 1 AS lexical_rank
  FROM bm JOIN passages ON passage_id = doc_id {allowed} ORDER BY 2 LIMIT {pool}),
fused AS (SELECT passage_id, coalesce(similarity, 0) AS sim, lexical_rank FROM sem FULL OUTER JOIN lex USING (passage_id)),
ranked AS (SELECT passage_id, CASE WHEN sim > 0 THEN 1.0::DOUBLE / 61 + sim * 0.001::DOUBLE ELSE 0 END
    + CASE WHEN lexical_rank IS NOT NULL THEN 1.0::DOUBLE / (61 + lexical_rank) ELSE 0 END AS score,
  greatest(0, least(1, sim)) AS relevance,
  CASE WHEN sim > 0 AND lexical_rank IS NOT NULL THEN 'hybrid' WHEN sim > 0 THEN 'semantic' ELSE 'keyword' END AS match
  FROM fused ORDER BY score DESC, passage_id LIMIT {limit})"""


HYBRID = "SELECT passage_id, round(score, 9) AS score, round(relevance, 6) AS relevance, match, text FROM ranked JOIN passages USING (passage_id)"
HEAD = INDEX.rstrip() + ",\n" + VECTORS[len("WITH "):].rstrip() + ",\n"


def _hybrid(spark, sf, limit, **filters):
    passages = passages_from_documents(spark, sf)
    postings, lengths = _index(spark, sf, "passage_id")
    rows = search.search_context(
        passages, postings, lengths, QUERY, query_vector(spark, sf), limit, **filters
    )
    return rows.select(
        "passage_id", F.round("score", 9).alias("score"), F.round("relevance", 6).alias("relevance"),
        "match", "text",
    )


@query("hybrid_search", HEAD + _fused("", 30) + "\n" + HYBRID)
def hybrid_search(spark, sf):
    return _hybrid(spark, sf, 30)


@query("hybrid_search_filtered", HEAD + _fused("WHERE lang = 'fr' AND start_at < TIMESTAMP '2024-01-25'", 200) + "\n" + HYBRID)
def hybrid_search_filtered(spark, sf):
    return _hybrid(spark, sf, 200, person_ids=["fr"], until="2024-01-25T00:00:00Z")


@query("search_coverage", q.with_(q.DOCUMENT_PASSAGES) + f"""SELECT count(*) AS passages, count(embedding) AS embedded_passages,
  round(count(embedding) * 100.0 / count(*), 6) AS coverage_percent, {q.iso('max(end_at) FILTER (embedding IS NULL)')} AS fully_covered_after FROM passages""")
def search_coverage(spark, sf):
    rows = search.search_coverage(passages_from_documents(spark, sf))
    return rows.withColumns({
        "coverage_percent": F.round("coverage_percent", 6),
        "fully_covered_after": iso_text(F.col("fully_covered_after")),
    })


@query("pending_passages", q.with_(q.DOCUMENT_PASSAGES) + "SELECT passage_id, text FROM passages WHERE embedding IS NULL ORDER BY end_at DESC, passage_id DESC LIMIT 64")
def pending_passages(spark, sf):
    return search.pending_passages(passages_from_documents(spark, sf)).select("passage_id", "text")


@query("public_passages", HEAD + _fused("", 30) + f"""
SELECT passage_id, conversation_id, 'Talk ' || conversation_id AS conversation_name, {q.iso('start_at')} AS start_at, {q.iso('end_at')} AS end_at, 1 AS message_count, lang AS person_ids,
  direction AS directions, text, round(relevance, 6) AS relevance, match FROM ranked JOIN passages USING (passage_id)""")
def public_passages(spark, sf):
    passages = passages_from_documents(spark, sf)
    postings, lengths = _index(spark, sf, "passage_id")
    rows = search.search_context(passages, postings, lengths, QUERY, query_vector(spark, sf), 30)
    names = passages.select("conversation_id").distinct().select(
        "conversation_id", F.concat(F.lit("Talk "), "conversation_id").alias("conversation_name")
    )
    return search.public_passages(rows, names).withColumns({
        "person_ids": F.array_join("person_ids", ","),
        "directions": F.array_join("directions", ","),
        "relevance": F.round("relevance", 6),
    })


LETTERS = "abcdefgh"


def letter_embedder(texts: list[str]) -> np.ndarray:
    """A stand-in model: how often each of eight letters occurs. It measures nothing."""
    return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype="float32")


_COUNTS = ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE AS n{i}" for i, c in enumerate(LETTERS))
_NORM = " + ".join(f"n{i} * n{i}" for i in range(8))


@query("embedded_documents", f"""SELECT doc_id, 12 AS dims, round(n0 / greatest(sqrt({_NORM}), 1e-300), 3) AS first_value,
  round(n7 / greatest(sqrt({_NORM}), 1e-300), 3) AS eighth_value, 0.0::DOUBLE AS last_value FROM (SELECT doc_id, {_COUNTS} FROM documents)""")
def embedded_documents(spark, sf):
    rows = search.embed_passages(_texts(spark, sf, "doc_id"), letter_embedder, dims=12)
    return rows.select(
        "doc_id",
        F.size("embedding").alias("dims"),
        F.round(F.col("embedding")[0].cast("double"), 3).alias("first_value"),
        F.round(F.col("embedding")[7].cast("double"), 3).alias("eighth_value"),
        F.col("embedding")[11].cast("double").alias("last_value"),
    )
