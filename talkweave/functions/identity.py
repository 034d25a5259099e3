"""Keyed opaque ids and contact identifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind
from .text import trim_all

PERSON_ID_CHARS = 18
CALENDAR_ID_CHARS = 22


def opaque_id(namespace: str, value: Column, key: bytes, n: int = PERSON_ID_CHARS) -> Column:
    """`namespace_` + the first n base64url characters of HMAC-SHA256(key, "namespace:value").

    HMAC is two nested SHA-256 calls over constant pads, so it needs no UDF.
    """
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in key))
    message = F.concat(F.lit(f"{namespace}:"), value.cast("string")).cast("binary")
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    digest = F.unhex(F.sha2(F.concat(outer_pad, inner), 256))
    encoded = F.translate(F.base64(digest), "+/=", "-_")
    return F.concat(F.lit(f"{namespace}_"), F.substring(encoded, 1, n))


def normalize_identifier(value: Column) -> Column:
    """Lower-cased e-mail, or the digits of a phone number with a leading 1 for ten digits."""

    def phone(digits: Column) -> Column:
        return F.when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).otherwise(digits)

    return bind(
        F.lower(trim_all(value)),
        lambda raw: F.when(raw.contains("@"), raw).otherwise(
            bind(F.regexp_replace(raw, r"[^\p{N}]", ""), phone)
        ),
    )


def profile_name(first: Column, last: Column, nickname: Column, organization: Column) -> Column:
    """`first last`, else the nickname, else the organisation."""
    full = F.trim(F.concat_ws(" ", first, last))
    return F.when(full != "", full).otherwise(F.coalesce(nickname, organization))
