"""Time columns: archive epochs, ISO-8601 text, calendar periods."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the archive format.
EPOCH_2001 = 978_307_200
NANOSECOND_THRESHOLD = 1_000_000_000_000

ISO_OUT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
ISO_IN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def archive_seconds(value: Column) -> Column:
    """Seconds since 2001 from a column that mixes seconds and nanoseconds."""
    value = value.cast("long")
    return F.when(
        F.abs(value) > NANOSECOND_THRESHOLD, F.call_function("div", value, F.lit(1_000_000_000))
    ).otherwise(value)


def normalize_epoch(value: Column) -> Column:
    """Timestamp from an archive date (seconds or nanoseconds since 2001)."""
    return F.timestamp_seconds(archive_seconds(value) + F.lit(EPOCH_2001))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_OUT)


def parse_iso(value: Column) -> Column:
    """Timestamp of ISO-8601 text with or without a fraction; null when it is neither."""
    return F.when(value.rlike(ISO_IN), F.try_to_timestamp(value))


def iso_argument(value, label: str) -> datetime | None:
    """Check one driver-side time argument; naive UTC, so it compares with both timestamp types."""
    if value is None or value == "":
        return None
    if isinstance(value, str):
        try:
            if "T" not in value:
                raise ValueError(value)
            value = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            raise ValueError(f"{label}: not a date and time such as 2024-01-31T12:00:00Z") from None
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def time_literal(value: datetime) -> Column:
    """A TIMESTAMP_NTZ literal that does not depend on the Python process's zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def period(ts: Column, bucket: str = "month") -> Column:
    """`YYYY`, `YYYY-Qn` or `YYYY-MM`; an unknown bucket means month."""
    if bucket == "year":
        return F.date_format(ts, "yyyy")
    if bucket == "quarter":
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-Q"), F.quarter(ts).cast("string"))
    return F.date_format(ts, "yyyy-MM")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
