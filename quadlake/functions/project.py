"""Scalar projections: derived ids, display forms, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions import fixed
from quadlake.functions.filters import any_of


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def compact_id(dept, number) -> Column:
    """Department without blanks, then the number: 'I&C SCI','45C' -> 'I&CSCI45C'."""
    return F.concat(F.replace(_c(dept), F.lit(" "), F.lit("")), _c(number))


def digits_or_zero(text) -> Column:
    only = F.regexp_replace(_c(text), r"\D", "")
    return F.coalesce(F.nullif(only, F.lit("")).try_cast("int"), F.lit(0))


def derive_ids(df: DataFrame, dept: str, number: str) -> DataFrame:
    return df.withColumns({
        "course_id": compact_id(dept, number),
        "course_numeric": digits_or_zero(number),
        "shortened_dept": F.replace(_c(dept), F.lit(" "), F.lit("")),
    })


def term_id(year, term) -> Column:
    return F.concat_ws(" ", _c(year), _c(term))


def impute_flag(text, patterns: Sequence[str]) -> Column:
    """True where the text contains one of the patterns; a null text is false."""
    return F.coalesce(any_of(_c(text).contains(p) for p in patterns), F.lit(False))


def flags_to_list(flags: Mapping[str, str]) -> Column:
    """Labels of the set flags, in the order of `flags`."""
    labels = F.array(*[F.when(_c(col), F.lit(label)) for label, col in flags.items()])
    return F.filter(labels, lambda x: x.isNotNull())


def positive_map(counts: Mapping[str, str]) -> Column:
    """Sparse map label -> count, positive counts only."""
    entries = [x for label, col in counts.items() for x in (F.lit(label), _c(col))]
    return F.map_filter(F.create_map(*entries), lambda _, v: v > 0)


def label(code, mapping: Mapping[str, str]) -> Column:
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), _c(code))


def pad_code(col, width: int = 5) -> Column:
    """Left-pad with zeros; codes that are already wider stay whole."""
    text = _c(col).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def null_if_negative(col) -> Column:
    return F.when(_c(col) >= 0, _c(col))


def count_text(col) -> Column:
    """Stored count (negative = unknown) as display text."""
    return F.coalesce(null_if_negative(col).cast("string"), F.lit(""))


def term_name(year, term, style: str = "short") -> Column:
    """'2024 Fall' (short), '2024 Fall Quarter' (long) or 'Fall Quarter 2024' (week)."""
    if style == "short":
        return F.concat_ws(" ", _c(year), _c(term))
    if style == "long":
        return F.concat_ws(" ", _c(year), label(term, fixed.TERM_LONG))
    return F.concat_ws(" ", label(term, fixed.TERM_WEEK), _c(year))


def utc_text(local_ts, tz: str, suffix: str) -> Column:
    """Wall-clock timestamp in `tz` as an ISO string in UTC."""
    utc = F.to_utc_timestamp(_c(local_ts).cast("timestamp"), tz)
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(suffix))


def room_url(url, location, room_id, bases: Mapping[str, str], default_base: str) -> Column:
    base = F.coalesce(label(location, bases), F.lit(default_base))
    return F.coalesce(_c(url), F.concat(base, _c(room_id)))


def slot_url(url, location, room_id, start, tz: str, bases: Mapping[str, str],
             default_base: str) -> Column:
    base = F.coalesce(label(location, bases), F.lit(default_base))
    dated = F.concat(base, _c(room_id), F.lit("?date="), utc_text(start, tz, "Z"),
                     F.lit("#submit_times"))
    return F.coalesce(_c(url), dated)


def iso_day(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd")


def collapse_term(term) -> Column:
    return F.when(_c(term).startswith("Summer"), "Summer").otherwise(_c(term))


def hour_minute(minutes) -> Column:
    m = _c(minutes)
    return F.struct(F.floor(m / 60).cast("int").alias("hour"), (m % 60).alias("minute"))


def content_id(payload) -> Column:
    """First ten characters of the base64url form of the payload's md5."""
    raw = F.base64(F.unhex(F.md5(_c(payload).cast("binary"))))
    return F.substring(F.translate(raw, "+/", "-_"), 1, 10)


def level_of(number) -> Column:
    n = _c(number)
    return (F.when(n < 100, "LowerDiv").when(n < 200, "UpperDiv").otherwise("Graduate"))


def sort_codes(codes) -> Column:
    """Array of struct(department, numeric, number) by department, number value, then text."""
    return F.array_sort(_c(codes))
