"""The four written forms of time stamps and conversions between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL, SLASH = "MM-dd-yyyy_HH:mm:ss", "MM/dd/yyyy HH:mm:ss"
ISO_FORMS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd")


def parse(x: Column, *forms: str) -> Column:
    """First form that fits, else null.  ``Z`` is read as a letter: no shift of zone."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(x), F.lit(f)) for f in forms))


def local_from_iso(x: Column, now: Column) -> Column:
    """ISO or UTC text to ``MM-dd-yyyy_HH:mm:ss``; unreadable text as it is, blank text as ``now``."""
    raw = F.trim(F.coalesce(x, F.lit("")))
    return F.when(raw == "", F.date_format(now, LOCAL)).otherwise(F.coalesce(F.date_format(parse(raw, *ISO_FORMS), LOCAL), raw))


def compact(x: Column, now: Column) -> Column:
    """Any form to ``yyyyMMdd_HHmmss``; ``now`` where it cannot be read."""
    return F.date_format(F.coalesce(parse(F.coalesce(x, F.lit("")), LOCAL, SLASH, *ISO_FORMS), now), "yyyyMMdd_HHmmss")


def iso(x: Column) -> Column:
    """Any form to ISO text, which sorts by time; null where it cannot be read."""
    return F.date_format(parse(x, LOCAL, SLASH, *ISO_FORMS), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def memory_date(x: Column, now: Column) -> Column:
    return F.date_format(F.coalesce(parse(F.coalesce(x, F.lit("")), LOCAL, SLASH, "MM/dd/yyyy"), now), "MM-dd-yyyy")


def dashed(x: Column) -> Column:
    return F.coalesce(F.date_format(parse(x, "MM/dd/yyyy"), "MM-dd-yyyy"), F.replace(F.trim(x), F.lit("/"), F.lit("-")))


def latency_ms(given: Column, start: Column, end: Column) -> Column:
    """A non-negative given value, else end - start, else 0."""
    span = F.unix_millis(end) - F.unix_millis(start)
    return F.when(given >= 0, given).when(span >= 0, span).otherwise(F.lit(0)).cast("long")


def first_byte_ms(given: Column, streaming: Column, first_token: Column) -> Column:
    return F.when(streaming & first_token.isNotNull() & (given >= 0), given).cast("long")
