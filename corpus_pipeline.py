"""A training corpus from raw documents.

Languages are identified and what is in none is dropped; boilerplate lines go;
of near copies one document stays; sources are mixed to their target weights;
the mix is encoded. Every stage reads what the one before has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm.language_id import keep_languages
from talkweave.llm.line_dedup import line_dedup
from talkweave.llm.mixing import mixed_documents
from talkweave.llm.near_copies import keep_one
from talkweave.llm.sentence_piece import encode_documents
from talkweave.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies, sampling and dropout have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return keep_languages(docs)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate; a document of nothing else goes, an empty one stays."""
    clean = line_dedup(docs, lines_col="llm_n_lines", dropped_col="llm_n_dropped")
    clean = clean.where("llm_n_dropped = 0 or trim(text) <> ''").drop("llm_n_lines", "llm_n_dropped")
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType))
    return clean


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: 0.8 of their shingles of five words are the same."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them, once for every epoch."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each text."""
    return encode_documents(docs.select("doc_id", "lang", "source", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", clean_lines),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix),
    ("sentence_piece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
