"""Natural-language date filters → inclusive epoch-millisecond ranges.

The grammar is parsed once on the driver; the result is two BIGINT literals
that Spark compares against the ``timestamp`` column (and may push into a
Parquet scan).  ``now`` is a parameter so results are repeatable.
All calendar arithmetic happens in one zone (UTC unless given).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone, tzinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accepted forms (patterns) and the error texts.
_RELATIVE = re.compile(r"^last (\d+) (day|week|month)s?$")
_RANGE = re.compile(r"^(\d{4}-\d{2}-\d{2})\s+to\s+(\d{4}-\d{2}-\d{2})$")
_ISO = re.compile(r"^(\d{4}-\d{2}(?:-\d{2})?)$")
_MONTH = re.compile(r"^\d{4}-\d{2}$")
SUPPORTED_FORMATS = ('"today", "yesterday", "last N days/weeks/months", '
                     '"YYYY-MM-DD", "YYYY-MM", "YYYY-MM-DD to YYYY-MM-DD"')
ERR_RANGE = "Invalid date range: {text}"
ERR_ORDER = "Start date must be before end date: {text}"
ERR_DATE = "Invalid date: {text}"
ERR_FORMAT = "Unrecognized date filter format: {text}. Supported formats: {formats}"


@dataclass(frozen=True)
class DateRange:
    """Inclusive range ``[start_ms, end_ms]``."""

    start_ms: int
    end_ms: int


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _ms(dt: datetime) -> int:
    return (dt - _EPOCH) // timedelta(milliseconds=1)


def _start_of(d: date, tz: tzinfo) -> datetime:
    return datetime.combine(d, time(0, 0, 0, 0), tz)


def _end_of(d: date, tz: tzinfo) -> datetime:
    return datetime.combine(d, time(23, 59, 59, 999000), tz)


def _months_back_overflowing(d: date, n: int) -> date:
    """Move ``d`` back ``n`` months keeping the day number and letting it
    overflow into the next month (31 Mar - 1 month = 2 Mar in 2024)."""
    idx = d.year * 12 + (d.month - 1) - n
    if idx < 12:
        return date.min
    first = date(idx // 12, idx % 12 + 1, 1)
    return first + timedelta(days=d.day - 1)


def _iso_date(text: str) -> date | None:
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


def parse_date_filter(text: str, now: datetime | None = None,
                      tz: tzinfo = timezone.utc) -> DateRange:
    """Parse a date filter; raise ``ValueError`` for anything else.

    Forms: ``today``, ``yesterday``, ``last N day(s)|week(s)|month(s)``
    (start at midnight N units ago, end *now*), ``YYYY-MM-DD``,
    ``YYYY-MM`` (whole month, leap-aware) and ``YYYY-MM-DD to YYYY-MM-DD``
    (both days whole).  Impossible dates such as 2024-02-30 are errors.
    """
    if text is None:
        raise ValueError("date filter must be a string")
    norm = text.strip().lower()
    now = (now or datetime.now(tz)).astimezone(tz)
    today = now.date()

    if norm == "today":
        return DateRange(_ms(_start_of(today, tz)), _ms(_end_of(today, tz)))
    if norm == "yesterday":
        y = today - timedelta(days=1)
        return DateRange(_ms(_start_of(y, tz)), _ms(_end_of(y, tz)))

    m = _RELATIVE.match(norm)
    if m:
        n, unit = int(m.group(1)), m.group(2)
        # Counts that reach before the first date mean all of the past.
        days = {"day": n, "week": 7 * n}.get(unit)
        if days is not None:
            start = today - timedelta(days=days) if days < today.toordinal() else date.min
        else:
            start = _months_back_overflowing(today, n)
        return DateRange(_ms(_start_of(start, tz)), _ms(now))

    m = _RANGE.match(norm)
    if m:
        a, b = _iso_date(m.group(1)), _iso_date(m.group(2))
        if a is None or b is None:
            raise ValueError(ERR_RANGE.format(text=text))
        start, end = _start_of(a, tz), _end_of(b, tz)
        if start > end:
            raise ValueError(ERR_ORDER.format(text=text))
        return DateRange(_ms(start), _ms(end))

    m = _ISO.match(norm)
    if m:
        s = m.group(1)
        if _MONTH.match(s):
            first = _iso_date(s + "-01")
            if first is None:
                raise ValueError(ERR_DATE.format(text=text))
            nxt = date(first.year + (first.month == 12), first.month % 12 + 1, 1)
            last = nxt - timedelta(days=1)
            return DateRange(_ms(_start_of(first, tz)), _ms(_end_of(last, tz)))
        d = _iso_date(s)
        if d is None:
            raise ValueError(ERR_DATE.format(text=text))
        return DateRange(_ms(_start_of(d, tz)), _ms(_end_of(d, tz)))

    raise ValueError(ERR_FORMAT.format(text=text, formats=SUPPORTED_FORMATS))


def in_range(ts: Column, rng: DateRange) -> Column:
    """Both ends inclusive."""
    return ts.between(F.lit(rng.start_ms), F.lit(rng.end_ms))


def filter_by_date(df: DataFrame, rng: DateRange | None, ts_col: str = "timestamp") -> DataFrame:
    """Keep rows whose ``ts_col`` (epoch ms) lies in ``rng``; ``None`` keeps all."""
    if rng is None:
        return df
    return df.where(in_range(F.col(ts_col), rng))
