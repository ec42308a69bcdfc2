"""Date expressions; days and instants are parameters, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import fnv1a, let, mulberry32


def local_day(ts: Column, hours: int = 9) -> Column:
    """The day of a UTC time in a zone some hours ahead."""
    return F.to_date(ts + F.expr(f"INTERVAL {hours} HOURS"))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def iso_week_key(day: Column) -> Column:
    """``YYYY-Www`` by the Thursday rule."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), day).cast("string"), 2, "0"))


def minutes(hhmm: Column) -> Column:
    """Minutes of ``HH:MM``; null if it is none."""
    return F.regexp_extract(hhmm, r"^(\d{1,2}):(\d{2})$", 1).try_cast("int") * 60 + F.regexp_extract(hhmm, r"^(\d{1,2}):(\d{2})$", 2).try_cast("int")


def hhmm(mins: Column) -> Column:
    m = F.pmod(mins, F.lit(1440))
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def open_now(opens: Column, closes: Column, all_day: Column, now: Column) -> Column:
    """Whether a place is open; null if hours are unknown. Hours over midnight never match."""
    return F.when(F.coalesce(all_day, F.lit(False)), F.lit(True)).otherwise((now >= minutes(opens)) & (now < minutes(closes)))


def publish_slots(start: Column, count: Column, every: Column) -> Column:
    """Sorted ``HH:MM`` slots from a start, some minutes apart."""
    return F.array_sort(F.transform(F.sequence(F.lit(0), count - 1), lambda i: hhmm(minutes(start) + i * every)))


def due_slots(slots: Column, now: Column) -> Column:
    return F.size(F.filter(slots, lambda s: minutes(s) <= now))


def local_time_utc(day: Column, at: Column, hours: int = 9) -> Column:
    """The UTC time of ``HH:MM`` on a day in a zone some hours ahead, as ISO text with milliseconds."""
    ts = F.to_timestamp_ntz(F.concat_ws(" ", day.cast("string"), at), F.lit("yyyy-MM-dd HH:mm")) - F.expr(f"INTERVAL {hours} HOURS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))


def lagged_range(as_of: Column, back: int = 30, lag: int = 3) -> tuple[Column, Column]:
    """The first and the last day of a range that ends some days before."""
    return F.date_sub(as_of, back), F.date_sub(as_of, lag)


def publish_times(mode: Column, count: Column, at: Column, times: Column, first: Column, last: Column, seed: Column) -> Column:
    """Sorted ``HH:MM`` slots of a schedule.

    ``instant`` gives midnight, ``individual`` the given times (the last for those beyond them), ``random`` times between
    ``first`` and ``last`` that depend on the seed only, every other mode ``at``; unset times are 09:00 and 18:00.
    """
    nine = F.coalesce(F.nullif(at, F.lit("")), F.lit("09:00"))
    a, b = minutes(F.coalesce(F.nullif(first, F.lit("")), F.lit("09:00"))), minutes(F.coalesce(F.nullif(last, F.lit("")), F.lit("18:00")))
    bounds = F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    start = lambda r: fnv1a(F.concat_ws("|", seed, r["low"].cast("string"), r["high"].cast("string"), count.cast("string")))
    nth = lambda r, h, i: let(r["low"] + F.floor(mulberry32(h, i) * (r["high"] - r["low"] + 1)).cast("int"), hhmm)
    drawn = let(bounds, lambda r: let(start(r), lambda h: F.transform(F.sequence(F.lit(1), count), lambda i: nth(r, h, i))))
    given = F.coalesce(times, F.array().cast("array<string>"))
    own = lambda i: F.coalesce(F.nullif(F.get(given, i - 1), F.lit("")), F.nullif(F.get(given, F.size(given) - 1), F.lit("")), nine)
    each = lambda i: F.when(mode == "instant", F.lit("00:00")).when(mode == "individual", own(i)).otherwise(nine)
    return F.array_sort(F.when(mode == "random", drawn).otherwise(F.transform(F.sequence(F.lit(1), count), each)))


#: Numbers of the days of the week.
WEEKDAYS = {"sun": 1, "mon": 2, "tue": 3, "wed": 4, "thu": 5, "fri": 6, "sat": 7}


def triggers(days: Column) -> Column:
    """Weekdays (1 to 7) of an alarm; none or all seven mean one daily trigger, 0."""
    known = F.create_map(*[F.lit(x) for pair in WEEKDAYS.items() for x in pair])
    return F.when((F.size(days) == 0) | (F.size(days) == 7), F.array(F.lit(0))).otherwise(F.transform(days, lambda d: F.coalesce(F.try_element_at(known, d), F.lit(1))))
