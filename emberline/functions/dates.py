"""Dates and times in text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params

NTZ = "timestamp_ntz"
#: Shape of a full date with one kind of separator, bounded by non-digits.
DATE = r"(?<!\d)(\d{4})([-./])(\d{1,2})\2(\d{1,2})(?!\d)"


def relative_time(text: Column, reference: Column) -> Column:
    """``now``, ``today``, ``yesterday``, a signed count of days, hours or minutes
    (``-3d``, ``10m``), or an ISO time; null for anything else."""
    raw = F.trim(text)
    low = F.lower(raw)
    midnight = F.date_trunc("day", reference).cast(NTZ)
    shape = r"^([+-]?)(\d{1,9})([dhm])$"
    n = F.regexp_extract(low, shape, 2).try_cast("long") * F.when(low.startswith("-"), -1).otherwise(1)
    minutes = n * F.when(low.endswith("d"), 1440).when(low.endswith("h"), 60).otherwise(1)
    moved = F.timestamp_add("MINUTE", minutes.cast("int"), reference).cast(NTZ)
    return (
        F.when(low == "now", reference)
        .when(low == "today", midnight)
        .when(low == "yesterday", midnight - F.expr("INTERVAL 1 DAY"))
        .when(low.rlike(shape), moved)
        .otherwise(raw.try_cast(NTZ))
    )


def recorded_at(value: Column, p: Params = DEFAULTS) -> Column:
    """Local wall time of epoch seconds, epoch milliseconds (beyond 10**10) or an ISO time.

    An ISO time without a zone is local already; a bare ``HH:MM`` is null.
    """
    number = F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.try_cast("double"))
    seconds = F.when(number > 1e10, number / 1000).otherwise(number)
    of_epoch = F.timestamp_micros((seconds * 1_000_000).cast("long"))
    text = F.trim(value)
    dated = text.rlike(r"^.{4}-.{2}-")
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    moved = F.convert_timezone(F.lit("UTC"), F.lit(p.zone), F.when(zoned & dated, text.try_cast("timestamp")).cast(NTZ))
    return F.when(number.isNotNull(), F.convert_timezone(F.lit("UTC"), F.lit(p.zone), of_epoch.cast(NTZ))).when(dated & zoned, moved).when(dated, text.try_cast(NTZ))


def first_date(text: Column, today: Column, least_year: int = 2024) -> Column:
    """The first full date in ``text`` that exists, is not before ``least_year`` and not after ``today``."""
    found = F.regexp_extract_all(text, F.lit(DATE), F.lit(0))
    parts = F.transform(found, lambda x: F.split(x, "[-./]"))
    dates = F.transform(parts, lambda p: F.concat_ws("-", p[0], F.lpad(p[1], 2, "0"), F.lpad(p[2], 2, "0")).try_cast("date"))
    return F.try_element_at(F.filter(dates, lambda x: x.isNotNull() & (F.year(x) >= least_year) & (x <= today)), F.lit(1))


#: Confidence of an inferred time by its source.
CONFIDENCE = {"existing_event_at": 1.0, "name": 0.9, "tag": 0.8, "content": 0.5, "legacy_created": 0.3}


def inferred_date(name: Column, tags: Column, content: Column | None, today: Column) -> Column:
    """struct<day, source>: the first date of the name, else of the tags in their order,
    else, if content is given, of the content."""
    of_tags = F.try_element_at(F.filter(F.transform(tags, lambda t: first_date(t, today)), lambda x: x.isNotNull()), F.lit(1))
    by = [("name", first_date(name, today)), ("tag", of_tags)] + ([("content", first_date(content, today))] if content is not None else [])
    day, source = F.lit(None).cast("date"), F.lit("no-date-found")
    for label, x in reversed(by):
        source = F.when(x.isNotNull(), F.lit(label)).otherwise(source)
        day = F.coalesce(x, day)
    return F.struct(day.alias("day"), source.alias("source"))


def canonical_utc(value: Column, naive_is_utc: bool = False) -> Column:
    """struct<at, error>: UTC text with microseconds, or why it is refused.

    Only full ISO times with a zone pass; one without a zone only under ``naive_is_utc``.
    """
    naive = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?$")
    zoned = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$")
    at = value.try_cast("timestamp")
    good = zoned | (naive & F.lit(naive_is_utc))
    text = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    error = F.when(at.isNull() | ~(naive | zoned), "invalid").when(~good, "timezone_missing")
    return F.struct(F.when(error.isNull(), text).alias("at"), error.alias("error"))
