"""Predicate factories: each returns one Column, so Catalyst sees plain filters.

Parameters left as None add no predicate; zero is a real bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions import fixed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def conjuncts(*maybe: Column | None) -> Column:
    """AND of whichever conditions were given."""
    given = [c for c in maybe if c is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def has_category(flags: Mapping[str, str], codes: Sequence[str] | None) -> Column | None:
    """True where the flag of at least one of the category codes is set."""
    if not codes:
        return None
    unknown = [c for c in codes if c not in flags]
    if unknown:
        raise ValueError(f"unknown categories: {unknown}")
    return any_of(_c(flags[c]) for c in codes)


def level_band(number, level: str | None, lower: int = 1) -> Column | None:
    """Course level as a band of course numbers; `lower` opens the lowest band."""
    if level is None:
        return None
    lo, hi = fixed.LEVEL_BANDS[level]
    if level == "LowerDiv":
        lo = lower
    return _c(number) >= lo if hi is None else _c(number).between(lo, hi)


def split_number_list(text: str) -> list[tuple[str, object]]:
    """'46,6B,51-53' -> [('int', 46), ('text', '6B'), ('range', (51, 53))]."""
    items: list[tuple[str, object]] = []
    for part in (p.strip() for p in text.split(",")):
        if "-" in part:
            lo, _, hi = part.partition("-")
            if not (lo.strip().isdigit() and hi.strip().isdigit()):
                raise ValueError(f"not a range of whole numbers: {part!r}")
            items.append(("range", (int(lo), int(hi))))
        elif part.isdigit():
            items.append(("int", int(part)))
        else:
            items.append(("text", part))
    return items


def number_list(number, text, items: str | None) -> Column | None:
    """Any of: equal number, equal text, number inside a range."""
    if items is None:
        return None
    parsed = split_number_list(items)
    ints = [v for kind, v in parsed if kind == "int"]
    texts = [v for kind, v in parsed if kind == "text"]
    conditions = [_c(number).between(*v) for kind, v in parsed if kind == "range"]
    if ints:
        conditions.append(_c(number).isin(ints))
    if texts:
        conditions.append(_c(text).isin(texts))
    return any_of(conditions)


def code_ranges(code, items: str | None) -> Column | None:
    """Section codes given as a list of codes and ranges."""
    if items is None:
        return None
    parsed = split_number_list(items)
    if any(kind == "text" for kind, _ in parsed):
        raise ValueError(f"section codes must be whole numbers: {items!r}")
    return number_list(code, code, items)


def split_days(text: str) -> list[str]:
    """'Mon,W,Thur,Fr' -> ['M', 'W', 'Th', 'F']."""
    days = [d.strip() for d in text.split(",")]
    unknown = [d for d in days if d not in fixed.DAY_ALIASES]
    if unknown:
        raise ValueError(f"unknown days: {unknown}")
    return [fixed.DAY_ALIASES[d] for d in days]


def any_day(flags: Mapping[str, str], days: str | None) -> Column | None:
    """Meets on at least one of the days; `flags` maps M..Su to boolean columns."""
    return None if days is None else any_of(_c(flags[d]) for d in split_days(days))


def unit_bounds(lo_col, hi_col, lo=None, hi=None) -> Column | None:
    parts = []
    if lo is not None:
        parts.append(_c(lo_col) >= lo)
    if hi is not None:
        parts.append(_c(hi_col) <= hi)
    return conjuncts(*parts) if parts else None


def fill_status(mode: str | None, status, enrolled, total, capacity) -> Column | None:
    """Fill modes; a null status satisfies none of the status tests."""
    if mode is None:
        return None
    status = _c(status)
    modes = {
        "SkipFull": status != "FULL",
        "SkipFullWaitlist": (status != "FULL") & (status != "Waitl"),
        "FullOnly": status.isin("FULL", "Waitl"),
        "Overenrolled": (_c(enrolled) > _c(capacity)) | (_c(total) > _c(capacity)),
    }
    return modes[mode]


def tristate(flag, mode: str | None) -> Column | None:
    """Exclude / Include / Only rows whose flag is set."""
    if mode is None or mode == "Include":
        return None
    return {"Exclude": ~_c(flag), "Only": _c(flag)}[mode]


def units_is(units, value: str | None) -> Column | None:
    if value is None:
        return None
    return _c(units).like("%-%") if value == "VAR" else _c(units) == value


_TIME = re.compile(r"^(\d{1,2}):(\d{2})\s*([ap]m?)?$", re.IGNORECASE)


def minute_of_day(text: str) -> int:
    """'2:00pm' or '14:00' -> 840."""
    m = _TIME.match(text.strip())
    if not m:
        raise ValueError(f"not a time of day: {text!r}")
    hour, minute, half = int(m[1]), int(m[2]), (m[3] or "").lower()[:1]
    if half:
        if not 1 <= hour <= 12:
            raise ValueError(f"not a 12-hour time: {text!r}")
        hour = hour % 12 + (12 if half == "p" else 0)
    if hour > 23 or minute > 59:
        raise ValueError(f"not a time of day: {text!r}")
    return hour * 60 + minute


def time_window(start, end, after: str | None = None, before: str | None = None) -> Column | None:
    """Starts at or after one time of day and ends at or before another (minutes)."""
    parts = []
    if after is not None:
        parts.append(_c(start) >= minute_of_day(after))
    if before is not None:
        parts.append(_c(end) <= minute_of_day(before))
    return conjuncts(*parts) if parts else None


def exclude_codes(flags: Mapping[str, str], codes: Sequence[str] | None) -> Column | None:
    """None of the given restriction flags is set."""
    return all_of(~_c(flags[c]) for c in codes) if codes else None


def ilike_contains(col, text: str | None) -> Column | None:
    return None if text is None else _c(col).ilike(f"%{text}%")


def ilike_prefix(col, text: str | None) -> Column | None:
    return None if text is None else _c(col).ilike(f"{text}%")


def eq_upper(col, text: str | None) -> Column | None:
    return None if text is None else _c(col) == text.upper()


def any_positive(*cols) -> Column:
    return any_of(_c(c) > 0 for c in cols)


def term_ordinal(term, order: Mapping[str, int] = fixed.TERM_ORDER) -> Column:
    entries = [F.lit(x) for pair in order.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), _c(term))


def term_between(year, term, since: tuple | None = None, until: tuple | None = None) -> Column | None:
    """Inclusive bounds (year, term); a bound without a term takes the whole year."""
    year, order = _c(year), term_ordinal(term)

    def side(bound, beyond, within):
        y, q = bound
        same = year == y
        if q is not None:
            same = same & within(order, fixed.TERM_ORDER[q])
        return same | beyond(year, y)

    parts = []
    if since is not None:
        parts.append(side(since, lambda a, b: a > b, lambda a, b: a >= b))
    if until is not None:
        parts.append(side(until, lambda a, b: a < b, lambda a, b: a <= b))
    return conjuncts(*parts) if parts else None


def overlaps_open(start, end, after=None, before=None, as_of=None) -> Column | None:
    """Ranges that overlap [after, before]; ranges without an end always stay.

    Without bounds, ranges that ended before `as_of` go.
    """
    parts = []
    if before is not None:
        parts.append(_c(start) <= F.lit(before).cast("date"))
    if after is not None:
        parts.append(_c(end) >= F.lit(after).cast("date"))
    if not parts and as_of is not None:
        parts.append(_c(end) >= F.lit(as_of).cast("date"))
    return _c(end).isNull() | conjuncts(*parts) if parts else None


def current_or_recent(start, end, touched, as_of, after=None, before=None) -> Column:
    """Not over yet (open-ended: touched in the last two weeks), or inside given bounds."""
    parts = []
    if after is not None:
        parts.append(_c(start) >= F.lit(after).cast("timestamp_ntz"))
    if before is not None:
        day_after = F.date_add(F.lit(before).cast("date"), 1).cast("timestamp_ntz")
        parts.append(_c(start) < day_after)
    if parts:
        return conjuncts(*parts)
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = _c(touched) >= now - F.expr("INTERVAL 14 DAYS")
    return (_c(end) >= now) | (_c(end).isNull() & recent)


def expand_umbrella(value: str, members: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """'Summer' -> its three sessions; any other value -> itself."""
    members = members or {"Summer": fixed.SUMMER_SESSIONS}
    return list(members.get(value, [value]))


def lookup(df: DataFrame, key: str, values, in_filter: int = 1_000) -> DataFrame:
    """Rows whose key is one value, one of a list of any length, or in a one-column DataFrame.

    A list of at most `in_filter` values goes into the filter, where scans can use it; a longer
    one becomes a table and is joined.
    """
    if isinstance(values, (list, tuple, set)) and len(values) > in_filter:
        kind = df.schema[key].dataType.simpleString()
        values = df.sparkSession.createDataFrame([(v,) for v in values], f"`{key}` {kind}")
    if isinstance(values, DataFrame):
        wanted = values.select(F.col(values.columns[0]).alias(key)).distinct()
        return df.join(wanted, key, "left_semi")
    if isinstance(values, (list, tuple, set)):
        return df.where(_c(key).isin(list(values)))
    return df.where(_c(key) == values)


def non_empty(col) -> Column:
    return _c(col) != ""


def slot_overlap(start, end, dates: Sequence[str] | None = None,
                 ranges: Sequence[tuple[str, str]] | None = None) -> Column:
    """Slot lies on one of the dates and touches one of the time-of-day ranges."""

    def minutes(ts):
        return F.hour(ts) * 60 + F.minute(ts)

    start, end = _c(start), _c(end)
    parts = []
    if dates:
        parts.append(start.cast("date").isin([F.lit(d).cast("date") for d in dates]))
    if ranges:
        parts.append(any_of(
            (minutes(end) > minute_of_day(lo)) & (minutes(start) < minute_of_day(hi))
            for lo, hi in ranges))
    return conjuncts(*parts)
