from datetime import datetime, timezone

import pytest

from convsift.functions.dates import filter_by_date, parse_date_filter, DateRange

NOW = datetime(2024, 3, 31, 15, 45, 10, tzinfo=timezone.utc)


def ms(s):
    return int(datetime.fromisoformat(s).replace(tzinfo=timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize("text,start,end", [
    ("today", "2024-03-31T00:00:00", "2024-03-31T23:59:59.999"),
    ("  TODAY ", "2024-03-31T00:00:00", "2024-03-31T23:59:59.999"),
    ("Yesterday", "2024-03-30T00:00:00", "2024-03-30T23:59:59.999"),
    ("last 7 days", "2024-03-24T00:00:00", "2024-03-31T15:45:10"),
    ("LAST 1 DAY", "2024-03-30T00:00:00", "2024-03-31T15:45:10"),
    ("last 2 weeks", "2024-03-17T00:00:00", "2024-03-31T15:45:10"),
    ("last 1 month", "2024-03-02T00:00:00", "2024-03-31T15:45:10"),   # 31 Feb overflows to 2 Mar
    ("last 3 months", "2023-12-31T00:00:00", "2024-03-31T15:45:10"),
    ("2024-01-15", "2024-01-15T00:00:00", "2024-01-15T23:59:59.999"),
    ("2024-02", "2024-02-01T00:00:00", "2024-02-29T23:59:59.999"),
    ("2023-02", "2023-02-01T00:00:00", "2023-02-28T23:59:59.999"),
    ("2024-12", "2024-12-01T00:00:00", "2024-12-31T23:59:59.999"),
    ("2024-01-01 to 2024-01-31", "2024-01-01T00:00:00", "2024-01-31T23:59:59.999"),
])
def test_parse(text, start, end):
    r = parse_date_filter(text, now=NOW)
    assert (r.start_ms, r.end_ms) == (ms(start), ms(end))


@pytest.mark.parametrize("text,msg", [
    ("invalid", "Unrecognized date filter format"),
    ("2024-13-45", "Invalid date"),
    ("2024-02-30", "Invalid date"),
    ("2024-13", "Invalid date"),
    ("2024-12-31 to 2024-01-01", "Start date must be before end date"),
    ("2024-01-01 to 2024-02-31", "Invalid date range"),
])
def test_errors(text, msg):
    with pytest.raises(ValueError, match=msg):
        parse_date_filter(text, now=NOW)


def test_filter_inclusive_bounds(spark):
    rows = [("1", ms("2024-01-15T10:00:00")), ("2", ms("2024-01-16T14:30:00")),
            ("3", ms("2024-01-17T09:15:00")), ("4", ms("2024-02-01T12:00:00"))]
    df = spark.createDataFrame(rows, "id string, timestamp long")
    ids = lambda rng: sorted(r.id for r in filter_by_date(df, rng).collect())
    assert ids(DateRange(ms("2024-01-15T00:00:00"), ms("2024-01-17T23:59:59.999"))) == ["1", "2", "3"]
    assert ids(parse_date_filter("2024-01-16")) == ["2"]
    assert ids(DateRange(ms("2024-01-15T10:00:00"), ms("2024-01-16T14:30:00"))) == ["1", "2"]
    assert ids(parse_date_filter("2024-02")) == ["4"]
    assert ids(parse_date_filter("2023-01")) == []
    assert filter_by_date(df, None).count() == 4


@pytest.mark.parametrize("text", ["last 99999999 days", "last 99999999999 weeks", "last 99999 months"])
def test_counts_beyond_the_calendar_mean_all_of_the_past(text):
    r = parse_date_filter(text, now=NOW)
    assert r.start_ms < ms("0002-01-01T00:00:00") and r.end_ms == ms("2024-03-31T15:45:10")
