"""Times of three classes that never compare: aware (0), naive (1), missing (2).

An event carries ts_class and ts_us (microseconds of the UTC instant, or of the naive wall clock).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AWARE, NAIVE, MISSING = 0, 1, 2

# The accepted forms of a timestamp text.
ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:[.,](\d{1,6}))?\s*(Z|z|UTC|[+-]\d{2}:?\d{2})?$"
BSD = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})$"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
OFFSET = r"(Z|z|UTC|[+-]\d{2}:?\d{2})$"


def group(text: Column, pattern: str, n: int) -> Column:
    """The n-th group of the first match, null where it is empty or nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def strip(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def cleaned(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"^(\d{4})/(\d{2})/(\d{2})", "$1-$2-$3")


def micros(wall_clock: Column) -> Column:
    """Microseconds since 1970 of a wall clock text 'yyyy-MM-dd HH:mm:ss[.ffffff]', read as UTC; null if it is no time."""
    return F.unix_micros(F.try_to_timestamp(F.concat(wall_clock, F.lit("+00:00"))))


def offset_text(text: Column) -> Column:
    """The offset as written, null for a naive text."""
    return F.when(cleaned(text).rlike(ISO), group(cleaned(text), OFFSET, 1))


def is_aware(text: Column) -> Column:
    return F.coalesce(cleaned(text).rlike(ISO) & cleaned(text).rlike(OFFSET), F.lit(False))


def normalize(text: Column) -> tuple[Column, Column]:
    """(ts_class, ts_us) of an ISO, blank, slash or ` UTC` form. Date-only and year-less texts are missing."""
    t = cleaned(text)
    wall = F.concat(group(t, ISO, 1), F.lit(" "), group(t, ISO, 2), F.lit("."), F.rpad(F.regexp_extract(t, ISO, 3), 6, "0"))
    zone = F.regexp_extract(t, ISO, 4)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.when(digits == "", 0).otherwise(F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
    shift = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    us = micros(wall) - shift.cast("long") * 60_000_000
    return F.when(us.isNull(), MISSING).when(zone == "", NAIVE).otherwise(AWARE), us


def normalize_bsd(text: Column, year: int | Column | None) -> Column:
    """Microseconds of the naive time of `Mmm dd hh:mm:ss` with an explicit year; null without one or for a bad date."""
    if year is None:
        return F.lit(None).cast("long")
    year = F.lit(year) if isinstance(year, int) else year
    month = F.array_position(F.array(*map(F.lit, MONTHS)), group(text, BSD, 1))
    wall = F.format_string("%04d-%02d-%02d ", year, month, group(text, BSD, 2).try_cast("int"))
    return micros(F.when(text.rlike(BSD), F.concat(wall, F.array_join(F.array(*(group(text, BSD, k) for k in (3, 4, 5))), ":"))))


def epoch_seconds(value: Column) -> Column:
    """Numeric seconds to microseconds of an aware time."""
    return F.round(value.try_cast("double") * 1_000_000).cast("long")


def iso_text(ts_class: Column, ts_us: Column) -> Column:
    """Canonical ISO text: fraction only if not zero, `Z` for aware times; null if missing."""
    at = F.timestamp_micros(ts_us)
    fraction = F.when(ts_us % 1_000_000 != 0, F.date_format(at, ".SSSSSS")).otherwise("")
    return F.when(ts_class != MISSING, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.when(ts_class == AWARE, "Z").otherwise("")))


def class_name(ts_class: Column) -> Column:
    return F.when(ts_class == AWARE, "AWARE").when(ts_class == NAIVE, "NAIVE").otherwise("MISSING")


def comparable(class_a: Column, class_b: Column) -> Column:
    return (class_a == class_b) & (class_a != MISSING)


def delta_seconds(class_a: Column, us_a: Column, class_b: Column, us_b: Column) -> Column:
    """Absolute seconds between two times; null across classes or if one is missing."""
    return F.when(comparable(class_a, class_b), F.abs(us_a - us_b) / F.lit(1_000_000.0))


def ordered(class_a: Column, us_a: Column, class_b: Column, us_b: Column) -> Column:
    """Whether the first is not later; null if they do not compare."""
    return F.when(comparable(class_a, class_b), us_a <= us_b)
