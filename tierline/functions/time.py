"""Time column helpers (the session time zone is UTC, see ``session``)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierline.functions.numeric import col_


def to_instant(c) -> Column:
    """Any timestamp-like value to TIMESTAMP (UTC instant); unparsable -> null.

    Strings are parsed leniently (``try_cast``), so one bad value does not fail
    the batch; the nulls it leaves are counted by the contract check.
    """
    return col_(c).cast("string").try_cast("timestamp")


def hour_start(c) -> Column:
    return F.date_trunc("hour", col_(c)).cast("timestamp")


def plus_hours(c, hours: int) -> Column:
    return col_(c) + F.make_interval(hours=F.lit(hours))


def plus_minutes(c, minutes: int) -> Column:
    return col_(c) + F.make_interval(mins=F.lit(minutes))


def minutes_between(later, earlier) -> Column:
    """Elapsed minutes as DOUBLE, microsecond-exact."""
    return (F.unix_micros(col_(later).cast("timestamp")) - F.unix_micros(col_(earlier).cast("timestamp"))) / F.lit(60_000_000.0)


def instant(value) -> Column:
    """A point in time as a TIMESTAMP column.

    Columns pass through; text is parsed in the session zone (UTC); a naive
    ``datetime`` is read as UTC wall-clock time and an aware one converted.
    Python datetimes are never handed to Spark as objects, because PySpark
    would convert them with the local zone of the Python process.
    """
    if value is None:
        return F.lit(None).cast("timestamp")
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return F.lit(value.isoformat(sep=" ")).cast("timestamp")
    if isinstance(value, dt.date):
        return F.lit(value.isoformat()).cast("timestamp")
    return F.lit(str(value)).cast("timestamp")


def instant_micros(micros: int | None) -> Column:
    """A TIMESTAMP literal from epoch microseconds (exact, zone-free)."""
    if micros is None:
        return F.lit(None).cast("timestamp")
    return F.timestamp_micros(F.lit(int(micros)))


def zone_transitions(zones: list[str], first_year: int = 1970, last_year: int = 2037) -> list[tuple[str, int, int, int, str]]:
    """(zone, from, to, offset, abbreviation) of every interval between changes of the zones' clocks.

    ``from`` and ``to`` are epoch seconds (``to`` exclusive), the offset is in
    minutes east of UTC. Taken from the tz database of the driver: a few rows a
    zone and year, whatever the data. Intervals cover the whole span given.
    """
    from zoneinfo import ZoneInfo

    def second(year: int) -> int:
        return int(dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc).timestamp())

    rows = []
    for name in sorted(set(zones)):
        zone = ZoneInfo(name)

        def clock(at: int) -> tuple[int, str]:
            local = dt.datetime.fromtimestamp(at, zone)
            return int(local.utcoffset().total_seconds() // 60), local.tzname()

        start = at = second(first_year)
        end, now = second(last_year + 1), clock(at)
        while at < end:
            ahead = min(at + 7 * 86400, end)        # clocks never change back and forth within a week
            then = clock(ahead)
            if then != now:
                low, high = at, ahead               # the first second of the new clock
                while high - low > 1:
                    mid = (low + high) // 2
                    low, high = (mid, high) if clock(mid) == now else (low, mid)
                rows.append((name, start, high, *now))
                start, now = high, clock(high)
                ahead = high
            at = ahead
        rows.append((name, start, end, *now))
    return rows
