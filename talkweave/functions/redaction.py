"""Redaction of personal data as one JVM-side column expression.

The sixteen rules run in order, each on the output of the one before. A rule
first marks its candidates in the text, then splits at the marks, so that every
second piece is a candidate that can be checked and replaced where it stands.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import bind
from .text import trim_all

# Unicode noncharacters, reserved for a program's internal use.
MARK = "\ufdd0\ufdd1"


# Shapes every number rule needs somewhere in the text, and the tags that stand for them.
RUN, PAIR, NUMBER_WORD = MARK + "run", MARK + "pair", MARK + "word"
NUMBERS = {
    RUN: r"(?U)\d[\d().\-\s]{5,}\d",
    PAIR: r"(?U)\d[,\s]+-?\d",
    NUMBER_WORD: r"(?U)\d\s+\S",
}


def _digits(candidate: Column) -> Column:
    return F.regexp_replace(candidate, r"(?U)\D", "")


def valid_ipv4(candidate: Column) -> Column:
    octets = F.split(candidate, r"\.")
    return (F.size(octets) == 4) & F.forall(
        octets, lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False))
    )


def valid_phone(candidate: Column) -> Column:
    trimmed = trim_all(candidate)
    return ~trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.length(_digits(trimmed)) >= 7)


def valid_card(candidate: Column) -> Column:
    """Luhn, 13 to 19 digits, not all the same."""
    figures = F.transform(
        F.split(F.reverse(_digits(candidate)), "(?!^)(?!$)"), lambda x: x.try_cast("int")
    )
    weighted = F.transform(
        figures,
        lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)),
    )
    total = F.aggregate(weighted, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return (
        F.size(figures).between(13, 19)
        & (F.size(F.array_distinct(figures)) > 1)
        & (total % 10 == 0)
    )


@dataclass(frozen=True)
class Rule:
    category: str
    pattern: str
    ignore_case: bool = False
    valid: Callable[[Column], Column] | None = None
    # Any of these in the lower-cased text, or one of NUMBERS by name, lets the pattern run.
    needs: tuple[str, ...] = ()

    @property
    def regex(self) -> str:
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern


# The categories, patterns and their order decide what is redacted.
RULES = (
    Rule("link", r"""\b(?:https?://|www\.)[^\s<>\"']+""", needs=("http", "www.")),
    Rule("email address", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", True, needs=("@",)),
    Rule("access token", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
         needs=("eyj",)),
    Rule("access token",
         r"\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AKIA[A-Z0-9]{16})\b",
         needs=("sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "akia")),
    Rule("credential",
         r"""\b(?:password|passcode|verification\s+code|one[- ]time\s+(?:password|code)|otp|security\s+code|pin)\s*(?:is|:|=)\s*[\"']?[^\s,\"']{4,128}[\"']?""",
         True, needs=("password", "passcode", "verification", "one-time", "one time", "otp", "security", "pin")),
    Rule("government identifier", r"\b\d{3}-\d{2}-\d{4}\b", needs=(RUN,)),
    Rule("government identifier",
         r"\b(?:passport|driver'?s?\s+license|license|tax\s+id)\s*(?:number|no\.?|#)?\s*(?:is|:|=)?\s*[A-Z0-9-]{5,24}\b",
         True, needs=("passport", "license", "tax")),
    Rule("payment card", r"\b(?:\d[ -]?){12,18}\d\b", valid=valid_card, needs=(RUN,)),
    Rule("bank identifier", r"\b(?:routing|aba)\s*(?:number|no\.?|#)?\s*(?:is|:|=)?\s*\d{9}\b",
         True, needs=("routing", "aba")),
    Rule("bank identifier", r"\b(?:account|acct)\s*(?:number|no\.?|#)\s*(?:is|:|=)?\s*[A-Z0-9-]{6,24}\b",
         True, needs=("account", "acct")),
    Rule("IP address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", valid=valid_ipv4, needs=(RUN,)),
    Rule("precise location",
         r"(?<![\d.])-?(?:[1-8]?\d(?:\.\d{4,})|90(?:\.0+)?)[,\s]+-?(?:1[0-7]\d(?:\.\d{4,})|(?:\d?\d)(?:\.\d{4,})|180(?:\.0+)?)(?![\d.])",
         needs=(PAIR,)),
    Rule("postal address", r"\bP\.?\s*O\.?\s+Box\s+\d+[A-Z]?\b", True, needs=("box",)),
    Rule("street address",
         r"\b\d{1,6}\s+(?:(?:N|S|E|W|NE|NW|SE|SW)\.?\s+)?(?:[\p{L}0-9.'’-]+\s+){1,7}(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Circle|Cir\.?|Highway|Hwy\.?|Parkway|Pkwy\.?|Place|Pl\.?|Terrace|Ter\.?)(?:\s+(?:Apt\.?|Apartment|Unit|Suite|Ste\.?)\s*[A-Z0-9-]+)?\b",
         True, needs=(NUMBER_WORD,)),
    Rule("birth date", r"\b(?:date\s+of\s+birth|dob)\s*(?:is|:|=)?\s*(?:\d{1,2}[\/-]){2}\d{2,4}\b",
         True, needs=("birth", "dob")),
    Rule("phone number", r"(?:\+?\d[\d().\-\s]{5,}\d)", valid=valid_phone, needs=(RUN,)),
)

CATEGORIES = tuple(sorted({rule.category for rule in RULES}))


def token(category: str) -> str:
    return f"[redacted: {category}]"


def _marked(text: Column, rule: Rule) -> Column:
    return F.split(F.regexp_replace(text, rule.regex, f"{MARK}$0{MARK}"), MARK)


def _accepted(rule: Rule, piece: Column, position: Column) -> Column:
    candidate = position % 2 == 1
    return candidate & rule.valid(piece) if rule.valid else candidate


def _replace(text: Column, rule: Rule) -> Column:
    if rule.valid is None:
        return F.regexp_replace(text, rule.regex, token(rule.category))
    pieces = F.transform(
        _marked(text, rule),
        lambda piece, i: F.when(_accepted(rule, piece, i), token(rule.category)).otherwise(piece),
    )
    return F.array_join(pieces, "")


def _gates(text: Column) -> Column:
    """One flag per rule: could its pattern match at all? False lets the text skip the pattern."""
    needles = F.expr(
        "array(" + ", ".join(
            "array(" + ", ".join(f"'{needle}'" for needle in rule.needs) + ")" for rule in RULES
        ) + ")"
    )
    # The two letters whose case-insensitive partners lower() does not reach.
    low = F.lower(F.translate(text, "\u0130\u017f", "is"))
    shapes = [F.when(text.rlike(shape), F.lit(tag)).otherwise("") for tag, shape in NUMBERS.items()]
    return bind(
        F.concat(low, *shapes),
        lambda clues: F.transform(
            needles, lambda words: F.exists(words, lambda word: F.contains(clues, word))
        ),
    )


def _redact_step(number: int, rule: Rule) -> Callable[[Column], Column]:
    return lambda s: F.struct(
        F.when(s["gates"][number], _replace(s["text"], rule)).otherwise(s["text"]).alias("text"),
        s["gates"].alias("gates"),
    )


def redact(text: Column) -> Column:
    """Every accepted match replaced by `[redacted: <category>]`."""

    def all_rules(gates: Column) -> Column:
        state = F.struct(text.alias("text"), gates.alias("gates"))
        for number, rule in enumerate(RULES):
            state = bind(state, _redact_step(number, rule))
        return F.when(F.exists(gates, lambda g: g), state["text"]).otherwise(text)

    return bind(_gates(text), all_rules)


def redact_each(*texts: Column) -> Column:
    """An array of the redacted texts; one expression for all of them keeps plans small."""
    return F.transform(F.array(*texts), redact)


def _count_step(number: int, rule: Rule) -> Callable[[Column], Column]:
    def checked(parts: Column) -> Column:
        return F.transform(
            parts,
            lambda piece, i: F.struct(
                piece.alias("piece"),
                F.coalesce(_accepted(rule, piece, i), F.lit(False)).alias("hit"),
            ),
        )

    def step(s: Column) -> Column:
        pieces = F.when(s["gates"][number], _marked(s["text"], rule)).otherwise(F.array(s["text"]))

        def rebuilt(parts: Column) -> Column:
            shown = F.transform(
                parts, lambda p: F.when(p["hit"], token(rule.category)).otherwise(p["piece"])
            )
            count = F.size(F.filter(parts, lambda p: p["hit"]))
            return F.struct(
                F.array_join(shown, "").alias("text"),
                s["gates"].alias("gates"),
                F.concat(s["hits"], F.array(count)).alias("hits"),
            )

        return bind(bind(pieces, checked), rebuilt)

    return step


def redaction_hits(text: Column) -> Column:
    """Number of accepted matches per rule, in rule order (array<int>)."""
    none = F.array().cast("array<int>")
    state = F.struct(text.alias("text"), _gates(text).alias("gates"), none.alias("hits"))
    for number, rule in enumerate(RULES):
        state = bind(state, _count_step(number, rule))
    return state["hits"]


def safe_label(text: Column) -> Column:
    """The trimmed label, or null when it is empty or anything in it had to be redacted."""
    return bind(
        trim_all(redact(text)),
        lambda clean: F.when((clean != "") & ~clean.contains("[redacted:"), clean),
    )


def safe_labels(*texts: Column) -> Column:
    """An array of safe labels, from one expression."""
    return F.transform(F.array(*texts), safe_label)


def redact_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, redact(F.col(col)))


def _rewrite(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return redact(value)
    if isinstance(kind, T.ArrayType) and _has_text(kind):
        return F.transform(value, lambda x: _rewrite(x, kind.elementType))
    if isinstance(kind, T.MapType) and _has_text(kind.valueType):
        return F.transform_values(value, lambda _, v: _rewrite(v, kind.valueType))
    if isinstance(kind, T.StructType) and _has_text(kind):
        fields = [_rewrite(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_text(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    return isinstance(kind, T.StringType)


def redact_frame(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Redact every string anywhere in the frame; names, map keys and numbers stay."""
    flat = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep
    ]
    if flat:
        df = df.withColumn("__redacted", redact_each(*[F.col(f"`{name}`") for name in flat]))

    def shown(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if field.name in flat:
            column = F.col("__redacted")[flat.index(field.name)]
        elif field.name not in keep:
            column = _rewrite(column, field.dataType)
        return column.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields if f.name != "__redacted"])


def _leaves(value: Column, kind: T.DataType) -> Column:
    """All strings inside a value, as one array."""
    if isinstance(kind, T.StringType):
        return F.array(value)
    if isinstance(kind, T.ArrayType):
        return F.flatten(F.transform(value, lambda x: _leaves(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        return _leaves(F.map_values(value), T.ArrayType(kind.valueType))
    parts = [_leaves(value[f.name], f.dataType) for f in kind.fields if _has_text(f.dataType)]
    return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])


def redaction_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """`category, n` for the redactions a frame needs; no row for a category without any.

    Counts are added up inside each task first; only one small row per task moves.
    """
    fields = [f for f in df.schema.fields if _has_text(f.dataType) and (not cols or f.name in cols)]
    texts = [_leaves(F.col(f"`{f.name}`"), f.dataType) for f in fields]
    empty = F.array().cast("array<string>")
    every = F.concat(empty, *[F.coalesce(t, empty) for t in texts])
    zeros = F.array_repeat(F.lit(0), len(RULES))
    hits = F.aggregate(
        F.filter(every, lambda t: t.isNotNull()),
        zeros,
        lambda total, t: F.zip_with(total, redaction_hits(t), lambda a, b: a + b),
    )
    sums = [F.sum(F.col("hits")[i]).alias(f"r{i}") for i in range(len(RULES))]
    totals = df.select(hits.alias("hits")).agg(*sums)
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(rule.category).alias("category"), F.col(f"r{i}").alias("n"))
                for i, rule in enumerate(RULES)
            ]
        )
    )
    return (
        totals.select(rows.alias("row"))
        .groupBy(F.col("row.category").alias("category"))
        .agg(F.sum("row.n").alias("n"))
        .filter("n > 0")
    )


def redaction_total(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: how many redactions, and the sorted categories."""
    return redaction_summary(df, cols).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.array_sort(F.collect_list("category")).alias("categories"),
    )
