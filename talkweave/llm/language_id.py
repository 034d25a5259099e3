"""Language identification with a string kernel.

The kernel of two texts counts the n-grams of one to three characters that both
have (a blended spectrum of presences; n-grams are hashed to 16 bits), divided by
the geometric mean of their own counts. A bounded number of labelled texts of every
language is drawn for training, some of them are landmarks; the Nyström map
turns kernel values with the landmarks into coordinates, and a kernel ridge
regression in these coordinates is solved for every language against the rest.
All maps fold into one matrix of slots and languages, so a batch of texts is scored
by one product with its presences.

The sample is all that the driver sees, as sets of hashed n-grams: `per_language`
texts of each language, or as many fewer as make SAMPLES of all languages (one of
each at least); the landmarks are bounded by MARKS in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh

ORDERS = 3
BITS = 16
PER_LANGUAGE = 256  # labelled texts of a language that are used for training
LANDMARKS = 32  # of them, landmarks
SAMPLES = 16_384  # labelled texts of all languages
MARKS = 1_024  # landmarks of all languages
RIDGE = 0.1
SALTS = 16  # parts of a language that are cut to the sample's size before they meet
ROWS = 64  # texts scored at once
CHARS = 1 << 20  # characters looked at at once
MIN_SCORE = 0.1  # even one-word texts of a known language score more
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _slots(codes: np.ndarray, order: int) -> np.ndarray:
    """Hashes of all n-grams of one order."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.full(n, order, np.uint64)
    for k in range(order):
        key = (key << np.uint64(21)) ^ codes[k : k + n]
    key *= np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(64 - BITS)).astype(np.int64)


def mark(text: str | None, row: np.ndarray) -> bool:
    """Set the slots of a text's n-grams; True if it has a letter. Works through long texts piece by piece."""
    found, tail = False, np.zeros(0, np.uint64)
    for at in range(0, len(text or ""), CHARS):
        codes = np.frombuffer(text[at : at + CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        if not letter.any() and not found and not len(tail):
            tail = np.array([32], np.uint64)
            continue
        found |= bool(letter.any())
        # All that is no letter is one blank.
        codes = np.concatenate((tail, np.where(letter, codes, 32).astype(np.uint64)))
        blank = codes == 32
        codes = codes[np.r_[True, ~(blank[1:] & blank[:-1])]]
        for order in range(1, ORDERS + 1):
            row[_slots(codes, order)] = 1
        tail = codes[-(ORDERS - 1) :]
    return found


def presences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of slots for each text, and which texts have a letter."""
    rows = np.zeros((len(texts), 1 << BITS), np.uint8)
    return rows, np.array([mark(t, r) for t, r in zip(texts, rows, strict=True)], bool)


@dataclass
class Model:
    languages: list[str]  # by code point
    slots: np.ndarray  # that a landmark has
    weights: np.ndarray  # slots x languages: presences in landmarks, scaled, times coefficients

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's place (-1: no letter) and its score, 0 to 1."""
        rows, known = presences(texts)
        own = np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.int64), 1)).astype(np.float64)
        values = (rows[:, self.slots].astype(np.float64) @ self.weights) / own[:, None]
        best = values.argmax(axis=1) if values.shape[1] else np.full(len(texts), -1)
        top = values.max(axis=1, initial=0.0).clip(0.0, 1.0)
        return np.where(known, best, -1), np.where(known & (best >= 0), top, 0.0)


def fit(samples: list[tuple[str, list[int]]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression of each language against the rest, in Nyström coordinates.

    samples: language and slots of each text, in a fixed order. The first
    `landmarks` of every language are landmarks, MARKS at most of all languages (or
    one of each); languages weigh the same.
    """
    languages = sorted({lang for lang, _ in samples})
    if not samples:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)))
    landmarks = max(1, min(landmarks, MARKS // len(languages)))
    place = {lang: k for k, lang in enumerate(languages)}
    labels = np.array([place[lang] for lang, _ in samples])
    chosen = np.concatenate([np.flatnonzero(labels == k)[:landmarks] for k in range(len(languages))])
    slots = np.unique(np.concatenate([np.asarray(samples[i][1], np.int64) for i in chosen]))
    sizes = np.array([max(1, len(s)) for _, s in samples], np.float64)

    def dense(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(slots)), np.float32)
        for k, i in enumerate(rows):
            mine = np.asarray(samples[i][1], np.int64)
            at = np.searchsorted(slots, mine).clip(max=len(slots) - 1)
            out[k, at[slots[at] == mine]] = 1
        return out

    marks = dense(chosen)
    scale = 1 / np.sqrt(sizes[chosen])
    kernel = np.empty((len(samples), len(chosen)))
    for at in range(0, len(samples), 256):
        rows = np.arange(at, min(at + 256, len(samples)))
        kernel[rows] = (dense(rows) @ marks.T) * scale / np.sqrt(sizes[rows])[:, None]
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-8 * values.max()
    to_coordinates = vectors[:, good] / np.sqrt(values[good])
    coordinates = kernel @ to_coordinates
    weigh = 1 / np.bincount(labels)[labels]
    target = (labels[:, None] == np.arange(len(languages))).astype(float)
    gram = (coordinates * weigh[:, None]).T @ coordinates
    level = ridge * np.trace(gram) / len(gram)
    solved = np.linalg.solve(gram + level * np.eye(len(gram)), (coordinates * weigh[:, None]).T @ target)
    return Model(languages, slots, marks.T.astype(np.float64) @ (scale[:, None] * (to_coordinates @ solved)))


def held_out(identifier: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(identifier.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _slot_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows, known = presences(part.column(1).to_pylist())
            sets = pa.array([np.flatnonzero(r).astype(np.int32) for r in rows], pa.list_(pa.int32()))
            made = pa.RecordBatch.from_arrays([part.column(0), sets, part.column(2)], names=["lang", "slots", "rows"])
            yield made.filter(pa.array(known))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    landmarks: int = LANDMARKS,
    ridge: float = RIDGE,
) -> Model:
    """A model of texts and languages that are not held out.

    Of each language `per_language` rows are drawn by a hash of id and text, exactly,
    whatever repeats: equal rows count as often as they stand there. With more than
    SAMPLES / per_language languages, each gets SAMPLES / languages rows, one at least.
    """
    ident = F.col(id_col)
    drawn = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & ~held_out(ident)).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(ident.cast("string"), F.col(text_col), F.lit("train")).alias("draw"),
        F.col(text_col).alias("text"),
    )
    # Spark keeps the first rows of each task before it shuffles, so a common language moves no more than a rare one.
    first = drawn.select("lang", "draw", F.pmod("draw", F.lit(SALTS)).alias("salt"))
    for group in (("lang", "salt"), ("lang",)):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("draw"))
        first = first.withColumn("n", place).where(F.col("n") <= per_language)
    # The draws that are in, with the place of the first and how many rows have it.
    wanted = cut_lineage(first.groupBy("lang", "draw").agg(F.min("n").alias("at"), F.count("*").alias("rows")))
    languages = wanted.select("lang").distinct().count()
    share = max(1, min(per_language, SAMPLES // max(1, languages)))
    wanted = wanted.where(F.col("at") <= share).withColumn("rows", F.least("rows", F.lit(share) - F.col("at") + 1))
    some = drawn.join(wanted, ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text"), F.first("rows").alias("rows"))
    sets = some.select("lang", "text", "rows").mapInArrow(_slot_sets, "lang string, slots array<int>, rows long")
    samples = sorted((r.lang, list(r.slots)) for r in sets.collect() for _ in range(r.rows))
    order = np.random.default_rng(0).permutation(len(samples))
    return fit([samples[i] for i in order], landmarks, ridge)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep, lang_pred and score, from nothing but the texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*held.value.languages, UNKNOWN], object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                best, score = held.value.score(part.column(0).to_pylist())
                more = [pa.array(names[best], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *more], names=[*part.schema.names[1:], "lang_pred", "score"])

    rows = docs.select(F.col(text_col).cast("string").alias(fresh(docs, "llm_text")), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row.

    Defined cases: a null text or one without a letter is `und` with score 0 and
    is never learned from; null languages are not learned; equal scores go to the
    language that is first by code point; without labelled rows all is `und`; rows
    that repeat an id are judged one by one; a null id is not held out and is learned from; an empty table
    gives no rows; other columns are not read.
    """
    model = train(docs, id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model, ["doc_id", "held_out"])


def keep_languages(
    docs: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options
) -> DataFrame:
    """Documents in a language the model knows, all columns as they were.

    A document is rejected if it has no letter, or if no language scores `min_score`.
    """
    model = train(docs, id_col, text_col, lang_col, **options)
    pred, score = fresh(docs, "llm_pred"), fresh(docs, "llm_score")
    body = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    found = predict(body, model, body.columns, f"c{docs.columns.index(text_col)}").toDF(*docs.columns, pred, score)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)).drop(pred, score)
