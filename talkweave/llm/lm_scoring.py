"""Scoring with a weighted backoff automaton.

The model holds words and pairs of words with absolute discounts. As an automaton: the
root has an arc for every word; a word is a state, with an arc for each pair it
begins and a failure arc to the root; the start of a text is a state of its own. Reading a word
takes the state's arc for it, or pays the weight of the failure arc and tries
again at the root. The sum of what the arcs cost is the text's log-probability.

    root:  p(w)     = (c(w) + 0.5) / (N + 0.5 * (V + 1)), also for a word never seen
    arc:   p(w | h) = (c(h w) - D) / c(h) + b(h) * p(w)      for pairs seen twice or more
    fail:  b(h)     = 1 - sum of (c(h w) - D) / c(h) over the arcs of h

A pair seen once is discounted to nothing, so it has no arc. The probabilities of each
state add up to one, with one share for all unknown words.

Nothing of the model is gathered in one place: chunks of texts send their distinct pairs, Spark adds
them up, and each chunk gets back what is known of its own words and pairs, which is the
part of the automaton that its texts can reach. There they are traversed from left to
right, LANE tokens side by side: a lane starts one word early, which leads to the same state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .word_chunks import (
    BREAK, CHUNK, UNKNOWN, number_in_slots, occurrences, pack_rows, slices, unpack_rows, unpack_sequence, word_chunks,
)

DISCOUNT = 0.75
LEAST_PAIR = 2  # a pair needs this many occurrences for an arc
LANE = 256  # tokens
ROOT = -1
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def split_words(text: bytes) -> Iterator[list[bytes]]:
    for part in slices(text.translate(LOWER), b" "):
        yield part.split()


class Automaton:
    """States are word numbers; BREAK is the start of a text, ROOT the empty history.

    `words`: number, count. `pairs`: (first << 32 | second) in order, and their count.
    `kept`: for each state, the discounted sum of its arcs.
    """

    def __init__(
        self, words: np.ndarray, counts: np.ndarray, kept: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray,
        tokens: int, distinct: int, texts: int, kept_at_start: float, discount: float = DISCOUNT,
    ) -> None:
        self.order = np.argsort(words)
        self.words = words[self.order]
        self.total = tokens + 0.5 * (distinct + 1)
        self.unknown = 0.5 / self.total
        self.root = (counts[self.order] + 0.5) / self.total
        self.failure = 1 - kept[self.order] / np.maximum(1, counts[self.order])
        self.failure_at_start = 1 - kept_at_start / max(1, texts)
        self.pairs = pairs
        first, second = self._place(pairs >> 32), self._place(pairs & 0xFFFFFFFF)
        start = pairs >> 32 == BREAK
        sizes = np.where(start, max(1, texts), counts[self.order][first] if len(words) else 1)
        fails = np.where(start, self.failure_at_start, self.failure[first] if len(words) else 1)
        lower = self.root[second] if len(words) else np.zeros(0)
        self.arcs = np.log10((pair_counts - discount) / sizes + fails * lower)
        with np.errstate(divide="ignore"):
            self.root, self.failure = np.log10(self.root), np.log10(self.failure)
            self.failure_at_start = np.log10(self.failure_at_start)
        self.unknown = np.log10(self.unknown)

    def _place(self, numbers: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.words, numbers), max(0, len(self.words) - 1))

    def read_at_root(self, numbers: np.ndarray) -> np.ndarray:
        """log10 of the root's arc for each word."""
        out = np.full(len(numbers), self.unknown)
        known = numbers > BREAK
        out[known] = self.root[self._place(numbers[known])]
        return out

    def _fail(self, states: np.ndarray) -> np.ndarray:
        out = np.zeros(len(states))
        out[states == BREAK] = self.failure_at_start
        words = states > BREAK
        out[words] = self.failure[self._place(states[words])]
        return out

    def step(self, states: np.ndarray, numbers: np.ndarray, at_root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one word in each lane: what it costs, and the next states."""
        cost = np.zeros(len(states))
        going = np.flatnonzero((states != ROOT) & (numbers > BREAK)) if len(self.pairs) else np.zeros(0, np.int64)
        want = (states[going] << 32) | numbers[going]
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        has = self.pairs[at] == want if len(going) else np.zeros(0, bool)
        cost[going[has]] = self.arcs[at[has]]
        failing = np.ones(len(states), bool)
        failing[going[has]] = False
        cost[failing] = self._fail(states[failing]) + at_root[failing]
        return cost, np.where(numbers > BREAK, numbers, ROOT)

    def traverse(self, numbers: np.ndarray, at_root: np.ndarray, lane: int = LANE) -> np.ndarray:
        """Cost of every token of a sequence in which BREAK starts a new text."""
        n = len(numbers)
        lanes = -(-n // lane)
        starts = np.arange(lanes) * lane
        out = np.zeros(n)
        # One word earlier each lane's state is known: it depends on that word alone.
        before = np.where(starts > 0, numbers[np.maximum(starts - 1, 0)], BREAK)
        states = np.where(before >= BREAK, before, ROOT)
        for step in range(lane):
            here = starts + step
            here = here[here < n]
            states = states[: len(here)]
            word = numbers[here]
            cost, states = self.step(states, word, at_root[here])
            out[here] = cost
            fresh = word == BREAK
            out[here[fresh]] = 0
            states[fresh] = BREAK
        return out


def _numbers(chunk: pa.Table, local: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """Tokens as numbers of the whole table, whether each is new here, and learned from."""
    sequence = unpack_sequence(chunk["sequence"][0].as_py())
    numbers = np.full(int(sequence.max(initial=0)) + 1, UNKNOWN, np.int64)
    numbers[BREAK] = BREAK
    numbers[local] = number
    texts = chunk["texts"][0].as_py()
    new, learned, at = np.ones(len(sequence), bool), np.zeros(len(sequence), bool), 0
    for text in texts:
        new[at : at + text["skip"]] = False
        learned[at + text["skip"] : at + text["length"]] = text["counted"]
        at += text["length"]
    return numbers[sequence], new, learned, texts


def _pairs(least: int):
    """Distinct pairs of a chunk, and how often they occur where the model learns."""

    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        pairs, n, id = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if chunk.num_rows:
            id = chunk["chunk"][0].as_py()
            local, number, count = unpack_rows(told, 1, 3)
            often = count >= least  # no pair with a rarer word occurs often enough
            numbers, new, learned, _ = _numbers(chunk, local[often], number[often])
            often = numbers >= BREAK
            at = np.flatnonzero(often[:-1] & often[1:] & (numbers[1:] > BREAK) & new[1:]) + 1
            codes = (numbers[at - 1] << 32) | numbers[at]
            order = np.argsort(codes, kind="stable")
            codes, trained = codes[order], learned[at][order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
            pairs = codes[first]
            n = np.add.reduceat(trained, first) if len(first) else n
        return pa.table({"chunk": np.full(len(pairs), id, np.int64), "pair": pairs, "n": n.astype(np.int64)})

    return run


def _score(discount: float, lane: int):
    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        cols: dict[str, list] = {c: [] for c in ("key", "id", "counted", "n_tokens", "n_known", "base", "score")}
        if chunk.num_rows:
            local, number, count, arcs_sum, arcs = unpack_rows(told, 1, 5)
            numbers, new, _, texts = _numbers(chunk, local, number)
            c = {n: chunk[n][0].as_py() for n in ("tokens", "distinct", "n_texts", "start_sum", "start_arcs")}
            pairs, pair_counts = unpack_rows(told, 2, 2)
            order = np.argsort(pairs, kind="stable")
            model = Automaton(
                number, count, arcs_sum - discount * arcs, pairs[order], pair_counts[order],
                c["tokens"], c["distinct"], c["n_texts"], c["start_sum"] - discount * c["start_arcs"], discount,
            ) if c["tokens"] else None
            base = model.read_at_root(numbers) if model else np.full(len(numbers), np.log10(1.0))
            cost = model.traverse(numbers, base, lane) if model else base
            known, at = numbers > BREAK, 0
            for text in texts:
                part = slice(at + text["skip"], at + text["length"])
                at += text["length"]
                row = (text["key"], text["id"], text["counted"], part.stop - part.start, int(known[part].sum()), float(base[part].sum()), float(cost[part].sum()))
                for column, value in zip(cols.values(), row, strict=True):
                    column.append(value)
        types = dict(zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))
        return pa.table({n: pa.array(v, types[n]) for n, v in cols.items()})

    return run


def lm_scores(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    discount: float = DISCOUNT,
    least_pair: int = LEAST_PAIR,
    tokens: int = CHUNK,
    lane: int = LANE,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    Words are runs of anything but ASCII blanks, lower-cased (A-Z); each text ends with one
    end token. The model learns from the rows that are not held out; a null condition
    counts as not held out. base_score is what the root alone gives.

    Defined cases: a null text is empty and has the end token only; rows that repeat, or share
    an id, are scored and learned from each; null ids stay null; a word of any length is one token;
    with nothing to learn from, every token is unknown and its probability, 0.5 / 0.5, is one;
    an empty table gives no rows; other columns are not read.
    """
    texts = docs.select(
        F.lit("").alias("grp"),
        F.col(id_col).cast("long").alias("id"),
        (~F.coalesce(held_out, F.lit(False))).alias("counted"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    chunks = cut_lineage(word_chunks(texts, split_words, 1, True, tokens))
    words = number_in_slots(occurrences(chunks).drop("grp"))
    sequences = chunks.select("chunk", "sequence", "texts")

    # One exchange both adds up a pair and knows which chunks hold it.
    same = Window.partitionBy("pair")
    told = pack_rows(words.select("chunk", "local", "number", "c"), 1)
    pairs = sequences.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        _pairs(least_pair), "chunk long, pair long, n long"
    )
    pairs = pairs.withColumns({"c": F.sum("n").over(same), "lead": F.min("chunk").over(same) == F.col("chunk")})
    pairs = cut_lineage(pairs.where(F.col("c") >= least_pair).select("chunk", "pair", "c", "lead"))
    begins = F.shiftright("pair", 32).alias("number")
    kept = pairs.where("lead").groupBy(begins).agg(F.sum("c").alias("arcs_sum"), F.count("*").alias("arcs"))
    kept = cut_lineage(kept)

    none = F.lit(0).cast("long")
    figures = words.where("lead").agg(
        F.struct(
            F.coalesce(F.sum("c"), none).alias("tokens"),
            F.count("*").alias("distinct"),
            F.coalesce(F.sum(F.when(F.col("is_end"), F.col("c"))), none).alias("n_texts"),
        ).alias("f")
    )
    at_start = kept.where(F.col("number") == BREAK).agg(
        F.struct(F.coalesce(F.sum("arcs_sum"), none).alias("start_sum"), F.coalesce(F.sum("arcs"), none).alias("start_arcs")).alias("s")
    )
    figures = cut_lineage(figures)
    states = words.join(kept, "number", "left").select(
        "chunk", "local", "number", "c", F.coalesce("arcs_sum", none).alias("arcs_sum"), F.coalesce("arcs", none).alias("arcs")
    )
    told = pack_rows(states, 1).unionByName(pack_rows(pairs.select("chunk", "pair", "c"), 2))
    given = sequences.withColumns({"f": figures.scalar(), "s": at_start.scalar()}).select(
        "chunk", "sequence", "texts", "f.*", "s.*"
    )
    scored = given.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        _score(discount, lane),
        "key long, id long, counted boolean, n_tokens long, n_known long, base double, score double",
    )
    # A text that runs over several chunks is the sum of its parts.
    whole = scored.groupBy("key", "id", "counted").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return whole.withColumn("f", figures.scalar()).select(
        F.col("id").alias("doc_id"), (~F.col("counted")).alias("held_out"), "n_tokens", "n_known",
        F.col("f.tokens").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
