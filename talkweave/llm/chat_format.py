"""Chat formatting in budgeted windows, with DataFrame functions only.

Template of a turn: `<|turn|>role<|text|>text<|end|>`. Inside roles and texts a
backslash is doubled and `<|` becomes `<\\|`, so no text can hold a control string
and every text reads back as it was.

Turns have a size of about four characters a token. Prefix sums of the sizes,
counted from the first turn after the leading system turn, deal the turns into
spans: a span ends where the running total passes the next multiple of half the
room, and a turn larger than that stands alone. A window is the system turn,
repeated; up to `history` turns before the span, as far as they fit their share,
repeated; and the turns of the span. Only the span's turns of the target role
carry loss, so a text that is repeated is masked where it repeats. A window of
more than one new turn never exceeds the budget unless the system turn alone takes
over half of it; no text is ever cut.

The frame is shuffled once, by conversation; running sums stream over its sorted
turns and spill, and only one window's turns are gathered in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
BUDGET = 2_048
HISTORY = 2
TARGET = "assistant"
SYSTEM = "system"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def chat_windows(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    target: str = TARGET,
) -> DataFrame:
    """conv_id, window (from 0), formatted, n_repeated, n_new, tokens, loss (array of start, length).

    loss spans are 1-based code points of `formatted`. Defined cases: null role
    and text are empty; rows are ordered by turn (null first), ties by role and
    text, so rows that repeat stay as turns of their own; rows of a null
    conversation are one conversation; an empty table gives no rows; other
    columns are not read. A conversation whose first turn is not a system turn
    has none to retain.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.withColumn("place", F.row_number().over(order)).select(
        "conv_id",
        "place",
        "role",
        head.alias("head"),
        escape(F.col("text")).alias("body"),
        F.ceil((F.length(head) + F.length(escape(F.col("text"))) + len(END)) / 4).alias("tokens"),
        ((F.col("place") == 1) & (F.col("role") == SYSTEM)).alias("is_system"),
    )
    line = Window.partitionBy("conv_id").orderBy("place")
    piece = F.struct("head", "body", "role", "tokens", "place")
    rows = rows.withColumns(
        {
            "system": F.first(F.when(F.col("is_system"), piece)).over(line.rowsBetween(Window.unboundedPreceding, 0)),
            "before": F.coalesce(
                F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))).over(
                    line.rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        }
    )
    share = F.lit(budget // 8 if history else 0)
    room = F.greatest(F.lit(budget) - F.coalesce(F.col("system.tokens"), F.lit(0)) - share, F.lit(budget // 4))
    stride = F.floor(room / 2)
    rows = rows.withColumn("large", F.coalesce(F.col("tokens") > stride, F.lit(False)) & ~F.col("is_system"))
    rows = rows.withColumns(
        {
            "bin": F.when(F.col("is_system"), F.lit(0)).otherwise(F.floor(F.col("before") / stride)),
            "larges": F.coalesce(
                F.sum(F.col("large").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        }
    )
    past = [F.lag(piece, back).over(line) for back in range(1, history + 1)]
    rows = rows.withColumn("past", F.array(*past) if past else F.array().cast("array<struct<head:string,body:string,role:string,tokens:bigint,place:int>>"))
    spans = rows.groupBy("conv_id", "bin", "larges", "large").agg(
        F.sort_array(F.collect_list(F.struct("place", "head", "body", "role", "tokens"))).alias("new"),
        F.min_by("past", "place").alias("past"),
        F.min_by("system", "place").alias("system"),
        F.min("place").alias("first"),
    )
    # Earlier turns as far as their sizes add up to the share, nearest first; the system turn is not history.
    fits = F.aggregate(
        "past",
        F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda a, x: F.struct(
            (a.used + F.coalesce(x.tokens, F.lit(0))).cast("long").alias("used"),
            (a.n + F.when(a.open & _usable(x, a.used, share), 1).otherwise(0)).alias("n"),
            (a.open & _usable(x, a.used, share)).alias("open"),
        ),
        lambda a: a.n,
    )
    plain = lambda x: F.struct(x.head.alias("head"), x.body.alias("body"), x.role.alias("role"), x.tokens.alias("tokens"))
    none = F.array().cast("array<struct<head:string,body:string,role:string,tokens:bigint>>")
    lead = F.when(F.col("system").isNotNull() & (F.col("first") > 1), F.array(plain(F.col("system")))).otherwise(none)
    spans = spans.select(
        "conv_id",
        "first",
        F.concat(lead, F.reverse(F.transform(F.slice("past", F.lit(1), fits), plain))).alias("repeated"),
        F.transform("new", plain).alias("new"),
    )
    spans = spans.withColumn("window", F.row_number().over(Window.partitionBy("conv_id").orderBy("first")) - 1)
    whole = F.concat("repeated", "new")
    size = lambda x: F.length(x.head) + F.length(x.body) + F.lit(len(END))
    lengths = F.aggregate("repeated", F.lit(0), lambda n, x: n + size(x))
    targets = F.aggregate(
        "new",
        F.struct(lengths.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a.at + size(x)).alias("at"),
            F.when(
                x.role == target,
                F.concat(a.spans, F.array(F.struct((a.at + F.length(x.head) + 1).alias("start"), F.length(x.body).alias("length")))),
            )
            .otherwise(a.spans)
            .alias("spans"),
        ),
        lambda a: a.spans,
    )
    return spans.select(
        "conv_id",
        "window",
        F.array_join(F.transform(whole, lambda x: F.concat(x.head, x.body, F.lit(END))), "").alias("formatted"),
        F.size("repeated").cast("long").alias("n_repeated"),
        F.size("new").cast("long").alias("n_new"),
        F.aggregate(whole, F.lit(0).cast("long"), lambda n, x: n + x.tokens).alias("tokens"),
        targets.alias("loss"),
    )


def _usable(x: Column, used: Column, share: Column) -> Column:
    whole = x.tokens.isNotNull() & ((used + x.tokens) <= share)
    return F.coalesce(whole & ~((x.place == 1) & (x.role == SYSTEM)), F.lit(False))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), losses (array of text): every turn once, from the formatted text."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>", -1), F.col("n_repeated").cast("int") + 2, F.col("n_new").cast("int"))

    def parsed(piece: Column) -> Column:
        sides = F.split(piece, r"<\|text\|>", -1)
        body = F.substring(sides[1], F.lit(1), F.length(sides[1]) - len(END))
        return F.struct(unescape(sides[0]).alias("role"), unescape(body).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s.start, s.length)))
    read = windows.select(
        "conv_id",
        F.struct("window", F.transform(pieces, parsed).alias("turns"), masked.alias("losses"), F.length("formatted").alias("chars")).alias("w"),
    )
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    return whole.select(
        "conv_id",
        F.flatten(F.col("ws.turns")).alias("turns"),
        F.flatten(F.col("ws.losses")).alias("losses"),
        F.aggregate("ws.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"),
    )
