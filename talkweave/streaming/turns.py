"""Speaker turns as a stream: each turn is written once, when nothing can join it any more.

The state of a conversation is its open turn and the messages that are not yet safe to read.
A message is safe when the watermark has passed it: then no earlier one can come. Safe
messages are taken in the order of their ids. A turn closes when the next message cannot
join it, or by a timer, when the watermark has passed the longest gap. So a batch costs
what its messages and the conversations that they touch cost, whatever came before.

The state is bounded: the caps of a turn, and the messages of one watermark delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.clock import micros
from ..functions.text import content, mask_links

KEY = "conversation_id"
OPEN = (
    "speaker string, direction string, first_id long, last_id long, first_tick long, last_tick long, "
    "last_chars long, chars long, done_id long, bodies array<string>"
)
WAITING = "ids array<long>, ticks array<long>, speakers array<string>, directions array<string>, said array<string>"
OUT = (
    f"{KEY} string, start_message_id long, end_message_id long, start_tick long, end_tick long, "
    "direction string, speaker string, message_count int, text string, late boolean"
)
NOBODY = (None, None, None, None, None, None, 0, 0, None, [])


def _utterances(messages: DataFrame) -> DataFrame:
    """Non-blank messages with who spoke; a native projection in front of the state."""
    optional = lambda name: F.col(name) if name in messages.columns else F.lit(None).cast("string")
    speaker = F.when(F.col("direction") == "from_me", F.lit("me")).otherwise(F.coalesce(optional("speaker"), F.lit("contact")))
    said = messages.select(
        F.col(KEY).cast("string").alias(KEY), F.col("message_id").cast("long").alias("message_id"),
        F.col("sent_at").cast("timestamp").alias("sent_at"), micros(F.col("sent_at")).alias("tick"), "direction",
        speaker.alias("speaker"), content(optional("subject"), F.col("text")).alias("said"),
    )
    return said.where("said <> ''").withColumn("said", mask_links(F.col("said")))


class TurnRules:
    """Joins messages of one conversation, as `operators.segment.build_turns` does for whole tables."""

    def __init__(self, gap_seconds: int, max_messages: int, max_chars: int) -> None:
        self.gap, self.max_messages, self.max_chars = gap_seconds * 1_000_000, max_messages, max_chars

    def joins(self, turn: dict, tick: int, speaker: str, said: str) -> bool:
        return (
            turn["speaker"] == speaker
            and 0 <= tick - turn["last_tick"] <= self.gap
            and turn["last_chars"] + len(said) + 1 <= self.max_chars
            and len(turn["bodies"]) < self.max_messages
            and turn["chars"] + len(said) + 1 <= self.max_chars
        )

    def open(self, id: int, tick: int, speaker: str, direction: str, said: str) -> dict:
        return {
            "speaker": speaker, "direction": direction, "first_id": id, "last_id": id, "first_tick": tick, "last_tick": tick,
            "last_chars": len(said), "chars": min(len(said), self.max_chars), "bodies": [said],
        }

    def extend(self, turn: dict, id: int, tick: int, said: str) -> None:
        turn |= {"last_id": id, "last_tick": tick, "last_chars": len(said), "chars": turn["chars"] + len(said) + 1}
        turn["bodies"].append(said)

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fields, waiting_fields = [f.split()[0] for f in OPEN.split(", ")], [f.split()[0] for f in WAITING.split(", ")]
        stored = dict(zip([*fields, *waiting_fields], state.get, strict=True)) if state.exists else {}
        turn = {f: stored[f] for f in fields} if stored.get("speaker") is not None else None
        if turn is not None:
            turn["bodies"] = list(turn["bodies"])
        done = stored.get("done_id")
        waiting = list(zip(*(stored[f] for f in waiting_fields), strict=True)) if stored else []
        timeless = []
        for rows in batches if not state.hasTimedOut else ():
            columns = (rows[c].tolist() for c in ("message_id", "tick", "speaker", "direction", "said"))
            for id, tick, *rest in zip(*columns, strict=True):
                (timeless if pd.isna(tick) else waiting).append((id, None if pd.isna(tick) else int(tick), *rest))
        watermark = state.getCurrentWatermarkMs() * 1000
        safe = sorted(m for m in waiting if m[1] <= watermark)
        waiting = [m for m in waiting if m[1] > watermark]
        out = []

        def close(turn: dict, late: bool = False) -> None:
            out.append((
                key[0], turn["first_id"], turn["last_id"], turn["first_tick"], turn["last_tick"], turn["direction"],
                turn["speaker"], len(turn["bodies"]), "\n".join(turn["bodies"]), late,
            ))

        for id, tick, speaker, direction, said in timeless:
            close(self.open(id, tick, speaker, direction, said), late=True)
        for id, tick, speaker, direction, said in safe:
            if done is not None and id <= done:
                close(self.open(id, tick, speaker, direction, said), late=True)
                continue
            done = id
            if turn is not None and self.joins(turn, tick, speaker, said):
                self.extend(turn, id, tick, said)
                continue
            if turn is not None:
                close(turn)
            turn = self.open(id, tick, speaker, direction, said)
        # What is to come is later than the watermark, and so are the waiting messages.
        if turn is not None and turn["last_tick"] + self.gap <= watermark:
            close(turn)
            turn = None
        held = tuple({**turn, "done_id": done}[f] for f in fields) if turn else (*NOBODY[:8], done, [])
        columns = [list(c) for c in zip(*waiting, strict=True)] if waiting else [[] for _ in waiting_fields]
        state.update((*held, *columns))
        timers = [m[1] for m in waiting] + ([turn["last_tick"] + self.gap] if turn else [])
        if timers:
            state.setTimeoutTimestamp(max(-(-min(timers) // 1000), state.getCurrentWatermarkMs() + 1))
        # A frame costs more than the rules do, and most calls close nothing; objects keep whole numbers beside nulls.
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")], dtype=object)


def closed_turns(
    messages: DataFrame, delay: str = "10 minutes", gap_seconds: int = 120, max_messages: int = 20, max_chars: int = 2_000
) -> DataFrame:
    """The turns of a stream of messages, each once, append-only; the columns of `build_turns` and `late`.

    Rule for late messages: those that come after the watermark has passed them are dropped by
    Spark, which counts them in the query's progress (`numRowsDroppedByWatermark`). A message
    without a time, or one in time but with an id below one that was already taken, comes
    out as a turn of its own with `late` set. With in-order ids the rows equal those
    of `build_turns` over all messages that the watermark has passed by the gap.
    """
    rules = TurnRules(gap_seconds, max_messages, max_chars)
    said = _utterances(messages).withWatermark("sent_at", delay)
    turns = said.groupBy(KEY).applyInPandasWithState(rules, OUT, f"{OPEN}, {WAITING}", "append", "EventTimeTimeout")
    kind = messages.schema["sent_at"].dataType
    at = lambda c: F.timestamp_micros(c).cast(kind)
    return turns.select(
        KEY, "start_message_id", "end_message_id", at("start_tick").alias("start_at"), at("end_tick").alias("end_at"),
        "direction", "speaker", "message_count", "text", "late",
    )


def stream_turns(stream: DataFrame, sink: str, checkpoint: str, available_now: bool = True, **rules) -> StreamingQuery:
    """Append closed turns to `sink`; a batch that is repeated is written once."""
    writer = closed_turns(stream, **rules).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
