"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text becomes symbols, one a character, and adjacent symbols whose joint string
is a piece are candidate merges. The best candidate of a unit is merged first
(score, then position), its neighbours become new candidates, and so on. Every
candidate is identified by its document and its start, middle and end; a keyed
hash of these skips it for good with probability `dropout`. So a rerun gives the
same pieces, another seed gives others, and all of them spell the text.

No piece has a blank inside or spans a character without a piece, so a text
falls apart into units (blanks and the word behind them) that are independent.
Short units advance together, one merge each a round, as array operations; units
of over LONG symbols keep an agenda of their own in a heap. Both obey the same
order. Characters without a piece, and the blank mark itself where a text has
it, are spelled in bytes, so decoding is lossless.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 42
LONG = 192  # symbols of a unit that has its own agenda
CHARS = 1 << 17  # characters encoded at once
BLANK = "▁"
NEVER = np.int64(1 << 62)
ALL = (1 << 64) - 1
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[3]
    x = (x ^ (x >> np.uint64(29))) * MIX[0]
    return x ^ (x >> np.uint64(32))


@dataclass
class Vocabulary:
    char_ids: np.ndarray  # by code point, -1 without a piece
    byte_ids: np.ndarray
    keys: np.ndarray  # open addressing: left << 20 | right
    merged: np.ndarray  # piece of the slot
    rank: np.ndarray  # by piece; equal scores have equal ranks
    spelled: np.ndarray  # bytes of all pieces, one after the other
    starts: np.ndarray
    probes: int

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The merges for one look-up at a time."""
        used = np.flatnonzero(self.keys >= 0)
        return dict(zip(self.keys[used].tolist(), self.merged[used].tolist(), strict=True))

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        with open(path, "rb") as file:
            model = sentencepiece.SentencePieceProcessor(model_proto=file.read())
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        is_byte = [model.is_byte(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(names) if not is_byte[i] and not special[i]}
        chars = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                chars[ord(piece)] = i
        chars[ord(" ")], chars[ord(BLANK)] = ids.get(BLANK, -1), -1
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        scores = np.array([model.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        pairs = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        size = 1 << max(10, (8 * len(pairs)).bit_length())
        keys, merged, probes = np.full(size, -1, np.int64), np.full(size, -1, np.int32), 1
        for left, right, i in pairs:
            key = left << 20 | right
            slot, tried = int(cls.slot(np.array([key]), size)[0]), 1
            while keys[slot] >= 0:
                slot, tried = (slot + 1) % size, tried + 1
            keys[slot], merged[slot], probes = key, i, max(probes, tried)
        spelled = [bytes([int(p[3:5], 16)]) if b else b"" if s else p.replace(BLANK, " ").encode() for p, b, s in zip(names, is_byte, special, strict=True)]
        starts = np.concatenate(([0], np.cumsum([len(s) for s in spelled])))
        return cls(chars, byte_ids, keys, merged, rank, np.frombuffer(b"".join(spelled), np.uint8), starts, probes)

    @staticmethod
    def slot(key: np.ndarray, size: int) -> np.ndarray:
        return ((key.astype(np.uint64) * MIX[0]) >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, -1 if none."""
        key = (left.astype(np.int64) << 20) | right
        at = self.slot(key, len(self.keys))
        out = np.full(len(key), -1, np.int32)
        there = self.keys[at]
        hit = there == key
        out[hit] = self.merged[at[hit]]
        open_ = np.flatnonzero(~hit & (there >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % len(self.keys)
            there = self.keys[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text; the blank that encoding puts in front is taken off."""
        ids = np.asarray(ids, np.int64)
        lengths = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return ""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.spelled[at].tobytes().decode("utf-8", "surrogatepass")[1:]


def _candidates(vocab: Vocabulary, left, right, start, middle, end, key, limit) -> tuple[np.ndarray, np.ndarray]:
    """Piece and rank of adjacent symbols; NEVER where there is none or the hash skips it."""
    piece = vocab.merge(left, right)
    rank = np.full(len(piece), NEVER)
    at = np.flatnonzero(piece >= 0)
    if limit:
        where = (start[at].astype(np.uint64) * MIX[0]) ^ (middle[at].astype(np.uint64) * MIX[1]) ^ (end[at].astype(np.uint64) * MIX[2])
        at = at[mixed(mixed(where) ^ key[at]) >= np.uint64(limit)]
    rank[at] = vocab.rank[piece[at]]
    return piece, rank


def _agenda(vocab: Vocabulary, symbols: np.ndarray, offset: int, key: int, limit: int) -> tuple[list[int], list[int]]:
    """Merge one long unit with a heap of candidates; the symbols left and their starts in the unit."""
    n = len(symbols)
    sym, before, after, ends = symbols.tolist(), list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    alive = [True] * n
    starts = np.arange(n - 1) + offset
    keys = np.full(n - 1, key, np.uint64)
    piece, rank = _candidates(vocab, symbols[:-1], symbols[1:], starts, starts + 1, starts + 2, keys, limit)
    heap = [(r, i, i + 1, i + 2, p) for i, (r, p) in enumerate(zip(rank.tolist(), piece.tolist(), strict=True)) if r < NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, j, end, p = heapq.heappop(heap)
        if not (alive[i] and j < n and after[i] == j and alive[j] and ends[j] == end):
            continue  # a neighbour has changed since
        sym[i], alive[j], after[i], ends[i] = p, False, after[j], end
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x < 0 or y >= n:
                continue
            made = vocab.pairs.get(sym[x] << 20 | sym[y], -1)
            if made >= 0 and not _skipped(x + offset, y + offset, ends[y] + offset, key, limit):
                heapq.heappush(heap, (int(vocab.rank[made]), x, y, ends[y], made))
    keep = [i for i in range(n) if alive[i]]
    return [sym[i] for i in keep], keep


def _skipped(start: int, middle: int, end: int, key: int, limit: int) -> bool:
    """The hash of `_candidates` for one candidate."""
    if not limit:
        return False
    where = start * int(MIX[0]) & ALL ^ middle * int(MIX[1]) & ALL ^ end * int(MIX[2]) & ALL
    for x in (0, int(key)):
        where ^= x
        where = (where ^ where >> 32) * int(MIX[3]) & ALL
        where = (where ^ where >> 29) * int(MIX[0]) & ALL
        where ^= where >> 32
    return where < limit


def _merge_units(vocab: Vocabulary, sym, start, unit, keys, shifts, limit: int):
    """All short units together: one merge a unit and round. Returns symbols and starts in order of start.

    keys and shifts belong to units: the document's key, and what turns a place
    of the batch into an offset of the document.
    """
    done: list[tuple[np.ndarray, np.ndarray]] = []
    last = np.r_[unit[1:] != unit[:-1], True][: len(unit)]
    end = start + 1
    piece, rank = np.full(len(sym), -1, np.int32), np.full(len(sym), NEVER)

    def refresh(at):
        own = unit[at]
        where = (x + shifts[own] for x in (start[at], start[at + 1], end[at + 1]))
        piece[at], rank[at] = _candidates(vocab, sym[at], sym[at + 1], *where, keys[own], limit)

    refresh(np.flatnonzero(~last))
    while len(sym):
        heads = np.concatenate(([0], np.flatnonzero(last[:-1]) + 1))
        order = np.where(rank < NEVER, (rank << 32) | np.arange(len(sym)), NEVER)
        best = np.minimum.reduceat(order, heads)
        # Units without a candidate are finished.
        keep = np.repeat(best < NEVER, np.diff(np.r_[heads, len(sym)]))
        done.append((sym[~keep], start[~keep]))
        at = best[best < NEVER] & 0xFFFFFFFF
        if not len(at):
            break
        sym[at], end[at], last[at] = piece[at], end[at + 1], last[at + 1]
        keep[at + 1] = False
        at = (np.cumsum(keep) - 1)[at]
        sym, start, end, unit, last, piece, rank = (x[keep] for x in (sym, start, end, unit, last, piece, rank))
        rank[at[last[at]]] = NEVER
        stale = np.zeros(len(sym), bool)
        stale[at] = True
        stale[at - 1] |= at > 0
        stale &= ~last  # a unit's last symbol has no pair
        refresh(np.flatnonzero(stale))
    sym, start = (np.concatenate([d[k] for d in done]) if done else x for k, x in ((0, sym), (1, start)))
    order = np.argsort(start, kind="stable")
    return sym[order], start[order]


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, int, str]]]:
    """(text, first character, characters) in batches of about CHARS; long texts are cut in front of a word."""
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text or ""):
            cut = at + CHARS
            while cut < len(text) and not (text[cut] == " " and text[cut - 1] != " "):
                cut = text.find(" ", cut + 1)
                cut = len(text) if cut < 0 else cut
            held.append((i, at, text[at:cut]))
            size, at = size + min(cut, len(text)) - at, cut
            if size >= CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def encode(vocab: Vocabulary, texts: list[str | None], keys: np.ndarray, dropout: float = 0.0, seed: int = SEED) -> list[np.ndarray]:
    """Ids of each text. keys: a number a text (uint64); equal keys, texts and seeds give equal ids."""
    limit = min(int(dropout * 2.0**64), (1 << 64) - 1)
    keys = mixed(np.asarray(keys, np.uint64) ^ mixed(np.array([seed], np.int64).view(np.uint64)))
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for batch in _pieces(texts):
        bodies = [" " + t if at == 0 else t for _, at, t in batch]
        lengths = np.array([len(b) for b in bodies])
        codes = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(lengths) - lengths
        symbols = vocab.char_ids[codes]
        blank = codes == 32
        new = np.zeros(len(codes), bool)
        new[1:] = (blank[1:] & ~blank[:-1]) | (symbols[1:] < 0) | (symbols[:-1] < 0)
        new[first] = True
        unit = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        sizes = np.diff(np.r_[begins, len(codes)])
        # Offsets in the document, whose blank in front is 0, do not depend on the batch.
        doc = np.repeat(np.arange(len(batch)), lengths)
        shifts = (np.array([at + (at > 0) for _, at, _ in batch]) - first)[doc[begins]]
        own = keys[np.array([i for i, _, _ in batch])][doc[begins]]
        short = np.flatnonzero((sizes <= LONG)[unit])
        found = [_merge_units(vocab, symbols[short].copy(), short, unit[short], own, shifts, limit)]
        for u in np.flatnonzero(sizes > LONG).tolist():
            a, n = int(begins[u]), int(sizes[u])
            got, where = _agenda(vocab, symbols[a : a + n], a + int(shifts[u]), own[u], limit)
            found.append((np.array(got, np.int32), np.array(where) + a))
        made, places = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        if len(found) > 1:
            order = np.argsort(places, kind="stable")
            made, places = made[order], places[order]
        ids, counts = _spell(vocab, made, codes[places])
        ends = np.cumsum(np.bincount(doc[places], weights=counts, minlength=len(batch))).astype(np.int64).tolist()
        for (i, _, _), a, b in zip(batch, [0, *ends], ends, strict=False):
            parts[i].append(ids[a:b])
    return [np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts]


def _spell(vocab: Vocabulary, symbols: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and how many each symbol has: bytes for a character without a piece."""
    odd = np.flatnonzero(symbols < 0)
    counts = np.ones(len(symbols), np.int64)
    if not len(odd):
        return symbols.astype(np.int32), counts
    chars = codes[odd].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    raw = [c.encode("utf-8", "surrogatepass") for c in chars]
    counts[odd] = [len(r) for r in raw]
    ids = np.repeat(symbols, counts)
    ids[np.repeat(symbols < 0, counts)] = vocab.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return ids.astype(np.int32), counts


def _document_keys(ids: pa.Array) -> np.ndarray:
    """A number for each document id: integers as they are, anything else by a hash of its text."""
    if pa.types.is_integer(ids.type):
        return ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return np.array([xxhash.xxh64_intdigest(str(x).encode()) for x in ids.to_pylist()], np.uint64)


def encode_documents(
    docs: DataFrame,
    model: str = MODEL,
    dropout: float = DROPOUT,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    out: str = "tokens",
) -> DataFrame:
    """The columns of docs without the text, and `out`, array<int>: the ids of the whole text.

    The model file is read on the driver; its tables (some MB) go to all tasks.
    Defined cases: null and empty texts have no ids; rows that repeat id and text have
    equal ids; a null id has the key -1; an empty table gives no rows; a column
    named like `out` is replaced, all others are passed through.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    others = [c for c in docs.columns if c not in (text_col, out)]
    place = others.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = encode(held.value, part.column(0).to_pylist(), _document_keys(part.column(place + 1)), dropout, seed)
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists], names=[*part.schema.names[1:], out])

    rows = docs.select(F.col(text_col).cast("string").alias(fresh(docs, "llm_text")), *others)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}`{out}` array<int>")


def decode_documents(encoded: DataFrame, model: str = MODEL, tokens: str = "tokens", out: str = "text") -> DataFrame:
    """The columns and the text that the ids spell; null ids are an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    others = [c for c in encoded.columns if c != out]
    place = others.index(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            texts = [held.value.decode(x.values.to_numpy() if x.is_valid else []) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.select(*others).schema.fields)
    return encoded.select(*others).mapInArrow(run, f"{kinds}`{out}` string")
