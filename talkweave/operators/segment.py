"""Passages, speaker turns and exchange windows.

All three walk a conversation in message order. None of them gathers a whole
conversation in one task: rows are ranked by counted slots (`ranking`), grouped
into pages, pieces or blocks of a fixed size, and only those are arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bind
from ..functions.clock import iso_text, micros
from ..functions.text import content, mask_links
from ..session import cut_lineage
from .ranking import SLOT_BITS, rank_by_id, slot_of

KEY = "conversation_id"
FAN = 512  # pieces composed at a time in a monologue longer than one piece


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _sorted_rows(*fields: Column) -> Column:
    return F.sort_array(F.collect_list(F.struct(*fields)))


def _clipped(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


# --- passages ---------------------------------------------------------------


def passage_line(df: DataFrame) -> Column:
    """`sent_at · author: body`, or null for a blank message."""
    said = content(_optional(df, "subject", "string"), F.col("text"))
    author = F.when(F.col("direction") == "from_me", F.lit("You")).otherwise(
        F.coalesce(_optional(df, "sender_name", "string"), F.lit("Contact"))
    )
    when = F.coalesce(iso_text(F.col("sent_at")), F.lit("Unknown date"))
    head = F.concat(when, F.lit(" · "), author, F.lit(": "))
    return bind(said, lambda body: F.when(body != "", F.concat(head, body)))


def build_passages(
    messages: DataFrame,
    size: int = 8,
    stride: int = 6,
    page: int = 512,
    max_chars: int | None = None,
    bits: int = SLOT_BITS,
) -> DataFrame:
    """Overlapping windows of `size` messages, starting every `stride` inside each page.

    Blank messages take a place in the window but add no text; a window without
    any text is dropped.
    """
    rows = messages.select(
        KEY,
        "message_id",
        "sent_at",
        "direction",
        passage_line(messages).alias("line"),
        _optional(messages, "person_ids", "array<string>").alias("person_ids"),
    )
    ranked = rank_by_id(rows, [KEY], "message_id", bits=bits)
    pages = (
        ranked.withColumn("page", F.floor((F.col("rank") - 1) / page))
        .groupBy(KEY, "page")
        .agg(
            F.first("person_ids", ignorenulls=True).alias("person_ids"),
            _sorted_rows(
                F.col("message_id"), F.col("sent_at"), F.col("direction"), F.col("line")
            ).alias("rows"),
        )
    )
    starts = F.sequence(F.lit(0), F.size("rows") - 1, F.lit(stride))
    windows = pages.select(
        KEY,
        "person_ids",
        F.explode(
            F.transform(starts, lambda at: F.slice(F.col("rows"), at + 1, F.lit(size)))
        ).alias("w"),
    )
    first, last = F.col("w")[0], F.element_at("w", -1)
    text = _clipped(F.array_join(F.col("w.line"), "\n"), max_chars)
    return windows.select(
        F.concat_ws(
            "_", F.lit("passage"), KEY, first["message_id"], last["message_id"]
        ).alias("passage_id"),
        KEY,
        first["message_id"].alias("start_message_id"),
        last["message_id"].alias("end_message_id"),
        first["sent_at"].alias("start_at"),
        last["sent_at"].alias("end_at"),
        "person_ids",
        F.array_sort(F.array_distinct(F.col("w.direction"))).alias("directions"),
        text.alias("text"),
        F.size("w").alias("message_count"),
    ).filter(F.col("text") != "")


# --- turns ------------------------------------------------------------------


def _utterances(messages: DataFrame, bits: int) -> DataFrame:
    """Non-blank messages with who spoke, when, and how long."""
    said = content(_optional(messages, "subject", "string"), F.col("text"))
    speaker = F.when(F.col("direction") == "from_me", F.lit("me")).otherwise(
        F.coalesce(_optional(messages, "speaker", "string"), F.lit("contact"))
    )
    return (
        messages.select(
            KEY,
            "message_id",
            "sent_at",
            "direction",
            speaker.alias("speaker"),
            said.alias("said"),
        )
        .filter(F.col("said") != "")
        .withColumn("body", mask_links(F.col("said")))
        .drop("said")
        .withColumn("tick", micros(F.col("sent_at")))
        .withColumn("chars", F.length("body"))
        .withColumn("slot", slot_of(F.col("message_id"), bits))
    )


def _continues(previous: Column, current: Column, gap_seconds: int, max_chars: int) -> Column:
    """Could current join the turn of the message just before it?"""
    gap = current["tick"] - previous["tick"]
    return F.coalesce(
        (previous["speaker"] == current["speaker"])
        & gap.between(0, gap_seconds * 1_000_000)
        & (previous["chars"] + current["chars"] + 1 <= max_chars),
        F.lit(False),
    )


def _islands(rows: DataFrame, gap_seconds: int, max_chars: int) -> DataFrame:
    """Adds `island` (id of its first message) and `pos` (0-based place in it).

    An island is a run in which every message may continue the one before it;
    only the caps can still split it. What crosses a slot border is one small
    row per slot: its last message, its size and the start of its last island.
    """
    here = Window.partitionBy(KEY, "slot").orderBy("message_id")
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    me = F.struct("speaker", "tick", "chars")

    def numbered(df: DataFrame) -> DataFrame:
        previous = F.lag(me).over(here)
        return df.select(
            "*",
            F.row_number().over(here).alias("inside"),
            (~_continues(previous, me, gap_seconds, max_chars)).alias("starts"),
        )

    narrow = rows.select(KEY, "slot", "message_id", "speaker", "tick", "chars")
    inner = (F.col("inside") > 1) & F.col("starts")
    slots = (
        numbered(narrow)
        .groupBy(KEY, "slot")
        .agg(
            F.min_by(me, "message_id").alias("head"),
            F.max_by(me, "message_id").alias("tail"),
            F.min("message_id").alias("head_id"),
            F.count("*").alias("size"),
            F.max(F.when(inner, F.struct("message_id", "inside"))).alias("last_start"),
        )
    )
    by_slot = Window.partitionBy(KEY).orderBy("slot")
    earlier = by_slot.rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn(
        "head_starts",
        ~_continues(F.lag("tail").over(by_slot), F.col("head"), gap_seconds, max_chars),
    ).withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    newest = F.coalesce(
        F.when(
            F.col("last_start").isNotNull(),
            F.struct(
                F.col("last_start.message_id").alias("island"),
                (F.col("before") + F.col("last_start.inside")).alias("rank"),
            ),
        ),
        F.when(
            F.col("head_starts"),
            F.struct(F.col("head_id").alias("island"), (F.col("before") + 1).alias("rank")),
        ),
    )
    slots = slots.withColumn("newest", newest).select(
        KEY, "slot", "head_starts", "before", F.max("newest").over(earlier).alias("carried")
    )
    joined = numbered(rows).join(slots, [KEY, "slot"], "left")
    rank = F.col("before") + F.col("inside")
    starts = F.when(F.col("inside") == 1, F.col("head_starts")).otherwise(F.col("starts"))
    own = F.max(
        F.when(starts, F.struct(F.col("message_id").alias("island"), rank.alias("rank")))
    ).over(so_far)
    return (
        joined.withColumn("start", F.coalesce(own, F.col("carried")))
        .withColumn("island", F.col("start.island"))
        .withColumn("pos", rank - F.col("start.rank"))
        .drop("inside", "starts", "head_starts", "before", "carried", "start", "slot")
    )


def _pieces(rows: DataFrame, piece_rows: int, lookahead: int) -> DataFrame:
    """Cut islands into pieces; the first rows of a piece are also shown to the one before."""
    piece = F.floor(F.col("pos") / piece_rows)
    peek = (F.col("pos") >= piece_rows) & (F.col("pos") % piece_rows < lookahead)
    placed = rows.withColumn(
        "piece", F.explode(F.when(peek, F.array(piece - 1, piece)).otherwise(F.array(piece)))
    )
    return placed.withColumn("at", (F.col("pos") - F.col("piece") * piece_rows).cast("int"))


def _opens(count: Column, chars: Column, row: Column, max_messages: int, max_chars: int) -> Column:
    return (
        (count == 0) | (count >= max_messages) | (chars + row["chars"] + 1 > max_chars)
    )


def _exits(rows: Column, piece_rows: int, max_messages: int, max_chars: int) -> Column:
    """For each possible first turn start in a piece, the first turn start in the next one.

    The value max_messages stands for "none": the piece is all one turn's tail.
    """

    def walk(entry: Column) -> Column:
        initial = F.struct(
            F.lit(0).alias("count"), F.lit(0).alias("chars"), F.lit(max_messages).alias("exit")
        )

        def step(acc: Column, row: Column) -> Column:
            opens = _opens(acc["count"], acc["chars"], row, max_messages, max_chars)
            beyond = opens & (row["at"] >= piece_rows) & (acc["exit"] == max_messages)
            return F.struct(
                F.when(opens, 1).otherwise(acc["count"] + 1).alias("count"),
                F.when(opens, F.least(row["chars"], F.lit(max_chars)))
                .otherwise(acc["chars"] + row["chars"] + 1)
                .alias("chars"),
                F.when(beyond, row["at"] - piece_rows).otherwise(acc["exit"]).alias("exit"),
            )

        tail = F.slice(rows, entry + 1, F.greatest(F.size(rows) - entry, F.lit(0)))
        return F.aggregate(tail, initial, step, lambda acc: acc["exit"])

    return F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(max_messages - 1)), walk),
        F.array(F.lit(max_messages)),
    )


def _then(entry: Column, exits: Column) -> Column:
    return F.element_at(exits, entry + 1)


def _entries(pieces: DataFrame, max_messages: int) -> DataFrame:
    """Where the first turn starts in each piece, from every piece's exits.

    Exits compose, so groups of FAN pieces are folded into one, twice, before
    anything is walked in sequence; then the way back down.
    """
    group = [KEY, "island"]
    base = pieces.withColumn("g0", F.floor(F.col("piece") / FAN)).withColumn(
        "g1", F.floor(F.col("piece") / (FAN * FAN))
    )

    def fold(items: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(max_messages)),
            lambda e: F.aggregate(items, e, lambda acc, item: _then(acc, item["exits"])),
        )

    def descend(df: DataFrame, start: Column, index: str) -> DataFrame:
        walked = F.aggregate(
            F.col("items"),
            F.array(start.cast("int")),
            lambda acc, item: F.concat(
                acc, F.array(_then(F.element_at(acc, -1), item["exits"]))
            ),
        )
        pairs = F.arrays_zip(
            F.col("items")[index].alias(index), F.slice(walked, 1, F.size("items")).alias("entry")
        )
        return df.select(*[c for c in df.columns if c not in ("items", "entry", index)],
                         F.inline(pairs))

    level0 = base.groupBy(*group, "g1", "g0").agg(
        _sorted_rows(F.col("piece"), F.col("exits")).alias("items")
    )
    level1 = (
        level0.select(*group, "g1", "g0", fold(F.col("items")).alias("exits"))
        .groupBy(*group, "g1")
        .agg(_sorted_rows(F.col("g0"), F.col("exits")).alias("items"))
    )
    level2 = (
        level1.select(*group, "g1", fold(F.col("items")).alias("exits"))
        .groupBy(*group)
        .agg(_sorted_rows(F.col("g1"), F.col("exits")).alias("items"))
    )
    top = descend(level2, F.lit(0), "g1")
    middle = descend(level1.join(top, [*group, "g1"]), F.col("entry"), "g0")
    return descend(
        level0.drop("g1").join(middle.drop("g1"), [*group, "g0"]), F.col("entry"), "piece"
    ).drop("g0")


def _piece_entries(
    narrow: DataFrame, max_messages: int, max_chars: int, piece_rows: int
) -> DataFrame:
    """First turn start of every piece of every island longer than one piece."""
    group = [KEY, "island", "piece"]
    longer = narrow.filter(F.col("pos") == piece_rows).select(KEY, "island")
    exits = (
        _pieces(narrow.join(longer, [KEY, "island"], "left_semi"), piece_rows, max_messages)
        .groupBy(*group)
        .agg(_sorted_rows(F.col("at"), F.col("chars")).alias("rows"))
        .select(*group, _exits(F.col("rows"), piece_rows, max_messages, max_chars).alias("exits"))
    )
    # Written once: every level of the walk reads them.
    return _entries(cut_lineage(exits), max_messages)


def build_turns(
    messages: DataFrame,
    gap_seconds: int = 120,
    max_messages: int = 20,
    max_chars: int = 2_000,
    numbered: bool = True,
    bits: int = SLOT_BITS,
    piece_rows: int = 1_024,
    clip_chars: int | None = None,
) -> DataFrame:
    """Adjacent messages of one speaker joined into turns.

    A message joins the open turn when the speaker is the same, 0 <= gap <=
    gap_seconds, and neither cap would be exceeded. Filling a turn up to its
    caps is sequential, so it runs inside islands cut into pieces; a monologue
    longer than one piece gets the start of each piece from `_entries`. A first
    message above max_chars stays whole; `clip_chars` cuts the text that is shown.
    """
    # Written once: long islands, their pieces and all others are read from it.
    islands = cut_lineage(_islands(_utterances(messages, bits), gap_seconds, max_chars))
    placed = _pieces(islands, piece_rows, max_messages)
    narrow = islands.select(KEY, "island", "pos", F.col("chars").cast("int").alias("chars"))
    group = [KEY, "island", "piece"]
    pieces = placed.groupBy(*group).agg(
        F.first("direction").alias("direction"),
        F.first("speaker").alias("speaker"),
        _sorted_rows(
            F.col("at"), F.col("chars"), F.col("message_id"), F.col("sent_at"), F.col("body")
        ).alias("rows"),
    )

    pieces = pieces.join(_piece_entries(narrow, max_messages, max_chars, piece_rows), group, "left")
    entry = F.coalesce(F.col("entry"), F.lit(0))

    def step(acc: Column, row: Column) -> Column:
        opens = _opens(acc["count"], acc["chars"], row, max_messages, max_chars)
        return F.struct(
            F.when(opens, F.concat(acc["starts"], F.array(row["at"])))
            .otherwise(acc["starts"])
            .alias("starts"),
            F.when(opens, 1).otherwise(acc["count"] + 1).alias("count"),
            F.when(opens, F.least(row["chars"], F.lit(max_chars)))
            .otherwise(acc["chars"] + row["chars"] + 1)
            .alias("chars"),
        )

    tail = F.slice("rows", entry + 1, F.greatest(F.size("rows") - entry, F.lit(0)))
    starts = F.aggregate(
        tail,
        F.struct(
            F.array().cast("array<int>").alias("starts"),
            F.lit(0).alias("count"),
            F.lit(0).alias("chars"),
        ),
        step,
        lambda acc: acc["starts"],
    )
    spans = pieces.withColumn("starts", starts).withColumn(
        "turn",
        F.explode(
            F.filter(
                F.transform(
                    "starts",
                    lambda s, i: F.struct(
                        s.alias("at"),
                        F.slice(
                            F.col("rows"),
                            s + 1,
                            F.coalesce(F.get("starts", i + 1), F.size("rows")) - s,
                        ).alias("rows"),
                    ),
                ),
                lambda t: t["at"] < piece_rows,
            )
        ),
    )
    first, last = F.col("turn.rows")[0], F.element_at("turn.rows", -1)
    turns = spans.select(
        KEY,
        first["message_id"].alias("start_message_id"),
        last["message_id"].alias("end_message_id"),
        first["sent_at"].alias("start_at"),
        last["sent_at"].alias("end_at"),
        "direction",
        "speaker",
        F.size("turn.rows").alias("message_count"),
        _clipped(F.array_join(F.col("turn.rows.body"), "\n"), clip_chars).alias("text"),
    )
    return number_turns(turns, bits) if numbered else turns


def number_turns(turns: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """Adds `turn_no`. The turns are written first: numbering reads them twice."""
    stored = cut_lineage(turns)
    ranked = rank_by_id(stored, [KEY], "start_message_id", out="turn_no", bits=bits)
    return ranked.withColumn("turn_no", F.col("turn_no").cast("int"))


# --- exchange windows -------------------------------------------------------


def build_exchange_windows(
    turns: DataFrame,
    size: int = 5,
    stride: int = 4,
    min_turns: int = 3,
    min_speakers: int = 2,
    max_chars: int | None = None,
    block: int = 64,
) -> DataFrame:
    """Overlapping windows over turns with at least two speakers.

    `block` windows share one group; the turns a block's last window reaches
    into the next block are copied to it.
    """
    width, overlap = block * stride, max(size - stride, 0)
    if overlap > width:
        raise ValueError("block is too small for this size and stride")
    if "turn_no" not in turns.columns:
        turns = number_turns(turns)
    at = F.col("turn_no").cast("long") - 1
    own = F.floor(at / width)
    peek = (at >= width) & (at % width < overlap)
    placed = turns.withColumn(
        "block", F.explode(F.when(peek, F.array(own - 1, own)).otherwise(F.array(own)))
    ).withColumn("at", (at - F.col("block") * width).cast("int"))
    blocks = placed.groupBy(KEY, "block").agg(
        _sorted_rows(
            *[
                F.col(c)
                for c in (
                    "at", "start_message_id", "end_message_id", "start_at", "end_at",
                    "direction", "speaker", "text",
                )
            ]
        ).alias("rows")
    )
    last_start = F.least(F.size("rows"), F.lit(width)) - 1
    windows = blocks.select(
        KEY,
        F.explode(
            F.transform(
                F.sequence(F.lit(0), last_start, F.lit(stride)),
                lambda s: F.slice(F.col("rows"), s + 1, F.lit(size)),
            )
        ).alias("w"),
    ).filter(
        (F.size("w") >= min_turns)
        & (F.size(F.array_distinct(F.col("w.speaker"))) >= min_speakers)
    )
    first, last = F.col("w")[0], F.element_at("w", -1)
    return windows.select(
        KEY,
        first["start_message_id"].alias("start_message_id"),
        last["end_message_id"].alias("end_message_id"),
        first["start_at"].alias("start_at"),
        last["end_at"].alias("end_at"),
        F.size("w").alias("turn_count"),
        F.array_sort(F.array_distinct(F.col("w.direction"))).alias("directions"),
        _clipped(F.array_join(F.col("w.text"), "\n"), max_chars).alias("text"),
    )
