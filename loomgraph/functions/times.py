"""Time texts in several ISO spellings, independent of the session's time zone."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, optional time, optional fraction, optional offset.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?$"
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def micros_of_text(col: Column) -> Column:
    """Microseconds since the epoch of an ISO text (no offset means UTC, no time means
    midnight); null for anything else."""
    text = F.trim(col)
    dated = F.when(F.length(text) == 10, F.concat(text, F.lit(" 00:00:00"))).otherwise(text)
    dated = F.regexp_replace(dated, r"^(.{10}[T ]\d{2}:\d{2})($|[^:])", "$1:00$2")
    zoned = F.when(F.substring(dated, 11, 64).rlike(_OFFSET), dated).otherwise(F.concat(dated, F.lit("Z")))
    return F.when(text.rlike(ISO), F.unix_micros(zoned.try_cast("timestamp_ltz")))


def micros_of(moment: str) -> int:
    """Microseconds since the epoch of a UTC moment such as 2026-06-30 00:00:00."""
    at = datetime.fromisoformat(moment).replace(tzinfo=timezone.utc)
    return int(at.timestamp()) * 1_000_000 + at.microsecond


def tidy_name(col: Column) -> Column:
    """Trimmed of white space, in lower case."""
    return F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
