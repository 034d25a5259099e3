"""Word index, ranking by words, by vector, and by both."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import iso_text
from ..functions.text import fold_text, query_tokens, required_query, tokens
from ..functions.vectors import cosine, cosine_to, fit_vector
from ..session import new_folder
from ..sources.word_index import WordIndex, word_runs
from .filters import any_contains, filter_messages, filter_passages
from .reading import newest

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF = 61


# --- index ------------------------------------------------------------------


def _count_words(ids: list[str]):
    """Texts (ids, words) -> ids, token, tf, length."""
    runs = word_runs()

    def count_run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch["words"]
        listed = pa.table({"text": pc.list_parent_indices(words), "token": pc.list_flatten(words)})
        found = listed.group_by(["text", "token"]).aggregate([([], "count_all")]).combine_chunks()
        n = batch.num_rows
        every = pa.array(np.arange(n), pa.int64())
        at = pa.concat_arrays([every, *found["text"].cast(pa.int64()).chunks])
        cols = {c: batch[c].take(at) for c in ids}
        cols["token"] = pa.concat_arrays([pa.array([""] * n, words.type.value_type), *found["token"].chunks])
        cols["tf"] = pa.concat_arrays([pa.array(np.ones(n), pa.int32()), *found["count_all"].cast(pa.int32()).chunks])
        cols["length"] = pc.list_value_length(words).cast(pa.int32()).take(at)
        return pa.RecordBatch.from_pydict(cols)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False)
            for start, stop in runs(lengths):
                yield count_run(batch.take(pa.array(np.arange(start, stop))))

    return count


def _token_rows(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, token, tf, length; a text's own row has the empty token, also when it has no words.

    The JVM finds the words; occurrences are counted on runs of whole texts from Arrow batches, so
    nothing is shuffled.
    """
    struct = [f"{c} {df.schema[c].dataType.simpleString()}" for c in ids]
    words = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("words")
    return df.select(*ids, words).mapInArrow(_count_words(ids), ", ".join([*struct, "token string, tf int, length int"]))


def _split_index(rows: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    postings = rows.filter(F.col("token") != "")
    return postings, rows.filter(F.col("token") == "").select(*ids, "length")


def build_token_index(
    df: DataFrame, id: str | Sequence[str], text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(postings: ids, token, tf, length; lengths: ids, length) over whole texts."""
    ids = [id] if isinstance(id, str) else list(id)
    return _split_index(_token_rows(df, ids, text), ids)


def store_token_index(
    df: DataFrame, id: str | Sequence[str], text: str = "text", path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The same, written once as a segment of a word index and read back."""
    index = WordIndex(df.sparkSession, path or new_folder(df.sparkSession), id).add(df, 0, text)
    return index.postings(), index.lengths()


def corpus_stats(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """`token, df` with the corpus size and mean length on every row."""
    size = lengths.agg(F.count("*").alias("n")).scalar()
    mean = lengths.agg(F.avg("length").alias("m")).scalar()
    return (
        postings.groupBy("token")
        .agg(F.count("*").alias("df"))
        .withColumns({"documents": size, "mean_length": mean})
    )


def _ids_of(postings: DataFrame) -> list[str]:
    return [c for c in postings.columns if c not in ("token", "tf", "length")]


def _prefix_hits(postings: DataFrame, words: list[str]) -> DataFrame:
    """One row per text with any match; `f0..` is how often each query word occurs as a prefix."""
    any_word = F.lit(False)
    for word in words:
        any_word = any_word | F.col("token").startswith(word)
    return (
        postings.filter(any_word)
        .groupBy(*_ids_of(postings))
        .agg(
            F.first("length").alias("length"),
            *[
                F.sum(F.when(F.col("token").startswith(w), F.col("tf")).otherwise(0)).alias(f"f{i}")
                for i, w in enumerate(words)
            ]
        )
    )


def bm25(
    postings: DataFrame,
    lengths: DataFrame,
    query: str,
    k: int | None = None,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """id and score of the texts with any query word as a prefix; lower is better.

    Corpus figures are one row, read as a scalar subquery.
    """
    ids, words = _ids_of(postings), query_tokens(query)
    if not words:
        return lengths.select(*ids, F.lit(0.0).alias("score")).limit(0)
    hits = _prefix_hits(postings, words)
    corpus = lengths.agg(
        F.struct(F.count("*").alias("texts"), F.avg("length").alias("mean")).alias("s")
    ).scalar()
    found = hits.agg(
        F.struct(*[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(words))])
        .alias("s")
    ).scalar()
    rows = hits.withColumns({"corpus": corpus, "found": found})
    score = F.lit(0.0)
    for i in range(len(words)):
        df, tf = F.col(f"found.d{i}"), F.col(f"f{i}")
        idf = F.log((F.col("corpus.texts") - df + 0.5) / (df + 0.5))
        weight = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
        norm = tf + k1 * (1 - b + b * F.col("length") / F.col("corpus.mean"))
        score = score + weight * (tf * (k1 + 1.0)) / norm
    scored = rows.select(*ids, (-score).alias("score"))
    return scored if k is None else scored.orderBy("score", *ids).limit(k)


def search_messages(
    messages: DataFrame,
    postings: DataFrame,
    query: str,
    limit: int | None = None,
    words: int | None = None,
    **filters,
) -> DataFrame:
    """Newest messages in which every query word (or the first `words`) occurs as a prefix."""
    words, ids = query_tokens(required_query(query), words), _ids_of(postings)
    if not words:
        raise ValueError("nothing in this query can be looked up by word; scan_messages can find it")
    every = F.lit(True)
    for i in range(len(words)):
        every = every & (F.col(f"f{i}") > 0)
    matching = _prefix_hits(postings, words).filter(every).select(*ids)
    found = filter_messages(messages, **filters).join(matching, ids, "left_semi")
    return newest(found, limit)


def scan_messages(
    messages: DataFrame, needle: str, limit: int | None = None, **filters
) -> DataFrame:
    """Newest messages with the literal substring, ignoring case; needs no index.

    Give it texts as they are stored and redact what it returns: a redacted text
    no longer has the address or number that was asked for.
    """
    needle = required_query(needle)
    columns = [c for c in ("text", "decoded_text") if c in messages.columns]
    found = filter_messages(messages, **filters).filter(any_contains(columns, needle))
    return newest(found, limit)


# --- vectors ----------------------------------------------------------------


def embed_passages(
    df: DataFrame, fn: Callable[[list[str]], np.ndarray], dims: int = 384, text: str = "text",
    out: str = "embedding", batch: int = 64,
) -> DataFrame:
    """Vectors from a user's model, cut or padded to dims at unit length.

    The model sees `batch` texts at a time in the tasks; texts of similar length
    are handed over together so that padding stays small.
    """

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        order = np.argsort(texts.str.len().fillna(0).to_numpy(), kind="stable")
        out = [None] * len(texts)
        for at in range(0, len(order), batch):
            places = order[at : at + batch]
            vectors = fn([texts.iat[i] or "" for i in places])
            for place, vector in zip(places, vectors, strict=True):
                out[place] = np.asarray(vector, dtype="float32")
        return pd.Series(out)

    raw = df.withColumn("__raw", run(F.col(text)))
    return raw.withColumn(out, fit_vector(F.col("__raw"), dims)).drop("__raw")


def vector_topk(
    passages: DataFrame,
    query_vector: Sequence[float] | Column,
    k: int,
    id: str = "passage_id",
    **filters,
) -> DataFrame:
    """id and similarity of the k nearest embedded passages."""
    embedding = F.col("embedding")
    similarity = (
        cosine(query_vector, embedding)
        if isinstance(query_vector, Column)
        else cosine_to(query_vector)(embedding)
    )
    rows = filter_passages(passages, **filters).filter(embedding.isNotNull())
    return (
        rows.select(id, similarity.alias("similarity"))
        .orderBy(F.col("similarity").desc(), id)
        .limit(k)
    )


def fuse(semantic: DataFrame, lexical: DataFrame, limit: int, id: str = "passage_id") -> DataFrame:
    """Merge two ranked lists by reciprocal rank.

    semantic: id, similarity. lexical: id, lexical_rank from 0.
    """
    both = semantic.join(lexical, id, "full_outer").withColumn(
        "similarity", F.coalesce("similarity", F.lit(0.0))
    )
    near, listed = F.col("similarity") > 0, F.col("lexical_rank").isNotNull()
    by_meaning = F.when(near, F.lit(1.0 / RRF) + F.col("similarity") * 0.001).otherwise(0.0)
    by_words = F.when(listed, F.lit(1.0) / (F.lit(RRF) + F.col("lexical_rank"))).otherwise(0.0)
    match = (
        F.when(near & listed, F.lit("hybrid"))
        .when(near, F.lit("semantic"))
        .otherwise(F.lit("keyword"))
    )
    return (
        both.select(
            id,
            (by_meaning + by_words).alias("score"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))).alias("relevance"),
            match.alias("match"),
        )
        .orderBy(F.col("score").desc(), id)
        .limit(limit)
    )


def rank_lexical(scored: DataFrame, pool: int, id: str = "passage_id") -> DataFrame:
    """Position from 0 in score order. Cut to the pool first: the ranking itself is one task."""
    best = scored.orderBy("score", id).limit(pool)
    place = F.row_number().over(Window.orderBy("score", id)) - 1
    return best.select(id, place.alias("lexical_rank"))


def search_context(
    passages: DataFrame,
    postings: DataFrame,
    lengths: DataFrame,
    query: str,
    query_vector: Sequence[float] | Column | None,
    limit: int = 30,
    id: str = "passage_id",
    pool: int | None = None,
    **filters,
) -> DataFrame:
    """The best passages by meaning and by words, with score, relevance and how they matched.

    The two lists that are fused hold the best `pool` rows each, five times the
    limit unless given.
    """
    if not query:
        raise ValueError("an empty query finds nothing")
    pool = 5 * limit if pool is None else pool
    if query_vector is None:
        semantic = passages.select(id, F.lit(0.0).alias("similarity")).limit(0)
    else:
        semantic = vector_topk(passages, query_vector, pool, id, **filters)
    scored = bm25(postings, lengths, query)
    if any(v not in (None, (), []) for v in filters.values()):
        allowed = filter_passages(passages, **filters).select(id)
        scored = scored.join(allowed, id, "left_semi")
    ranked = fuse(semantic, rank_lexical(scored, pool, id), limit, id)
    return passages.join(ranked, id).orderBy(F.col("score").desc(), id)


def search_coverage(passages: DataFrame) -> DataFrame:
    """How much of the passage index has vectors, and the newest passage that has none."""
    pending = F.col("embedding").isNull()
    return passages.agg(
        F.count("*").alias("passages"),
        F.count("embedding").alias("embedded_passages"),
        F.when(F.count("*") > 0, F.count("embedding") * 100.0 / F.count("*"))
        .otherwise(0.0)
        .alias("coverage_percent"),
        F.max(F.when(pending, F.col("end_at"))).alias("fully_covered_after"),
    )


def pending_passages(passages: DataFrame, n: int = 64, id: str = "passage_id") -> DataFrame:
    """The next passages to embed: newest first."""
    return (
        passages.filter(F.col("embedding").isNull())
        .orderBy(F.col("end_at").desc_nulls_last(), F.col(id).desc())
        .limit(n)
    )


# --- views ------------------------------------------------------------------


def public_messages(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Messages as shown to callers: sender as a struct, time as ISO text."""
    if names is not None:
        rows = rows.join(names.select("conversation_id", "conversation_name"), "conversation_id", "left")
    elif "conversation_name" not in rows.columns:
        rows = rows.withColumn("conversation_name", F.lit(None).cast("string"))
    if "attachments" not in rows.columns:
        rows = rows.withColumn(
            "attachments", F.array().cast("array<struct<name:string,mime_type:string>>")
        )
    sender = F.struct(F.col("speaker").alias("person_id"), F.col("sender_name").alias("name"))
    return rows.select(
        "conversation_id",
        "conversation_name",
        "message_id",
        iso_text(F.col("sent_at")).alias("sent_at"),
        "direction",
        sender.alias("sender"),
        "service",
        "text",
        "subject",
        "is_reply",
        "attachments",
    )


def public_passages(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Passages as shown to callers. names: conversation_id, conversation_name."""
    if names is not None:
        rows = rows.join(names.select("conversation_id", "conversation_name"), "conversation_id", "left")
    elif "conversation_name" not in rows.columns:
        rows = rows.withColumn("conversation_name", F.lit(None).cast("string"))
    return rows.select(
        "passage_id",
        "conversation_id",
        "conversation_name",
        iso_text(F.col("start_at")).alias("start_at"),
        iso_text(F.col("end_at")).alias("end_at"),
        "message_count",
        "person_ids",
        "directions",
        "text",
        "relevance",
        "match",
    )


def find_occurrences(df: DataFrame, id: str, text: str, needle: str) -> DataFrame:
    """`id, occurrence`: one row per non-overlapping hit, ignoring case and accents."""
    from ..functions.text import fold_literal

    folded = fold_literal(needle.strip())
    if not folded:
        return df.select(id, F.lit(0).alias("occurrence")).limit(0)
    haystack = fold_text(F.col(text))
    gone = F.length(haystack) - F.length(F.replace(haystack, F.lit(folded), F.lit("")))
    hits = (gone / len(folded)).cast("int")
    return (
        df.select(id, hits.alias("hits"))
        .filter(F.col("hits") > 0)
        .select(id, F.explode(F.sequence(F.lit(0), F.col("hits") - 1)).alias("occurrence"))
    )
