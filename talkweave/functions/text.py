"""Text columns: content assembly, tokens, folding, labels."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

MAX_QUERY_CHARS = 500
# Patterns that decide results.
# Letters, digits and private-use characters of lower-cased text; ASCII is tested first.
TOKEN = r"[a-z0-9[\p{L}\p{N}\p{Co}&&[^\x00-\x7f]]]+"
LINK = r"https?://\S+|www\.\S+"

# The characters Unicode calls white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_all(value: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.trim(value, F.lit(WHITE_SPACE))


def content(subject: Column, text: Column) -> Column:
    """Subject and text joined by a dash, trimmed; empty when both are missing."""
    return trim_all(F.concat_ws(" — ", subject, text))


def mask_links(value: Column) -> Column:
    """Replace web addresses by `http`; text without a candidate skips the pattern."""
    return bind(
        value,
        lambda v: F.when(
            v.contains("http") | v.contains("www."), F.regexp_replace(v, LINK, "http")
        ).otherwise(v),
    )


def clip_title(value: Column) -> Column:
    """One line of at most 64 characters."""
    return bind(
        trim_all(F.regexp_replace(value, r"(?U)\s+", " ")),
        lambda line: F.when(F.length(line) <= 64, line).otherwise(
            F.concat(F.substring(line, 1, 61), F.lit("…"))
        ),
    )


def normalize_answer(value: Column) -> Column:
    """A space after a sentence end that runs into the next one; at most one empty line."""
    spaced = F.regexp_replace(value, r"([.!?])(?=[A-Z][a-z])", "$1 ")
    return trim_all(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def private_attachment_name(value: Column) -> Column:
    """`[attachment]` plus the lower-cased extension; null for a blank name."""
    name = trim_all(value)
    extension = F.regexp_extract(name, r"\.[A-Za-z0-9]{1,10}$", 0)
    return F.when(name != "", F.concat(F.lit("[attachment]"), F.lower(extension)))


def enum_label(code: Column, labels: dict[int, str], default: str) -> Column:
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit(default))


@functools.lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Accented characters and their base letters, then the marks that simply vanish.

    Built from the Unicode decomposition rules, so there is no list to maintain.
    """
    source, target, marks = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        category = unicodedata.category(char)
        if category == "Mn":
            marks.append(char)
        elif category[0] == "L" and not 0xAC00 <= code <= 0xD7A3:
            parts = unicodedata.normalize("NFD", char)
            if len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
                source.append(char)
                target.append(parts[0])
    return "".join(source) + "".join(marks), "".join(target)


def fold_text(value: Column) -> Column:
    """Lower case without accents. Pure ASCII skips the translation table."""
    source, target = _fold_table()
    return bind(
        F.lower(value),
        lambda low: F.when(F.length(low) == F.octet_length(low), low).otherwise(
            F.translate(low, source, target)
        ),
    )


def tokens(value: Column) -> Column:
    """Folded words of the whole text, in order, with repeats."""
    return F.regexp_extract_all(fold_text(value), F.lit(TOKEN), F.lit(0))


def fold_literal(value: str) -> str:
    source, target = _fold_table()
    table = {ord(s): (target[i] if i < len(target) else None) for i, s in enumerate(source)}
    return value.lower().translate(table)


def query_tokens(query: str, most: int | None = None) -> list[str]:
    """Distinct words of two or more letters or digits, folded like the index; at most the first `most`."""
    words, current = [], []
    for char in unicodedata.normalize("NFKC", query) + " ":
        if unicodedata.category(char)[0] in "LN":
            current.append(char)
        else:
            if len(current) > 1:
                words.append("".join(current))
            current = []
    first = list(dict.fromkeys(words))[:most]
    return list(dict.fromkeys(fold_literal(word) for word in first))


def required_query(query: str | None) -> str:
    needle = (query or "").strip()
    if not needle:
        raise ValueError("an empty query finds nothing")
    if len(needle) > MAX_QUERY_CHARS:
        raise ValueError(f"a query has at most {MAX_QUERY_CHARS} characters")
    return needle


def contains_ci(value: Column, needle: str) -> Column:
    """Case-insensitive literal substring; `%` and `_` have no special meaning."""
    return F.lower(value).contains(needle.lower())
