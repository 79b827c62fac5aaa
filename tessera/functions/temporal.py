"""Date and time functions. An interval is a struct of months, days and micros, so it can be stored and compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, HOUR = 86_400_000_000, 3_600_000_000


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def micros(x) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (the session's zone must be UTC)."""
    return F.unix_micros(_c(x).cast("timestamp"))


def of_micros(x) -> Column:
    return F.timestamp_micros(_c(x)).cast("timestamp_ntz")


def interval(months=0, days=0, micros_=0) -> Column:
    return F.struct(_c(months).cast("int").alias("months"), _c(days).cast("int").alias("days"), _c(micros_).cast("long").alias("micros"))


def make_interval(years=0, months=0, weeks=0, days=0, hours=0, mins=0, secs=0.0) -> Column:
    return interval(_c(years) * 12 + _c(months), _c(weeks) * 7 + _c(days), (_c(hours).cast("long") * 3600 + _c(mins).cast("long") * 60 + _c(secs).cast("double")) * 1_000_000)


def interval_qualified(literal: str, qualifier: str) -> Column:
    """A whole number of one unit, or ``years-months``."""
    unit = qualifier.strip().lower()
    if unit == "year to month":
        y, m = literal.split("-")
        return make_interval(years=int(y), months=int(m))
    names = {"year": "years", "month": "months", "week": "weeks", "day": "days", "hour": "hours", "minute": "mins", "second": "secs"}
    return make_interval(**{names[unit]: float(literal) if unit == "second" else int(literal)})


def make_duration(days, hours, minutes, seconds) -> Column:
    """Microseconds."""
    return (_c(days).cast("long") * DAY + _c(hours).cast("long") * HOUR + _c(minutes).cast("long") * 60_000_000 + _c(seconds).cast("double") * 1_000_000).cast("long")


def justify_hours(i: Column) -> Column:
    """Whole days of the time part become days."""
    d = F.floor(i["micros"] / DAY)
    return interval(i["months"], i["days"] + d, i["micros"] - d * DAY)


def justify_days(i: Column) -> Column:
    m = F.floor(i["days"] / 30)
    return interval(i["months"] + m, i["days"] - m * 30, i["micros"])


def justify_interval(i: Column) -> Column:
    return justify_days(justify_hours(i))


def age(later, earlier) -> Column:
    """Whole months, then days, then time between two timestamps."""
    a, b = _c(later).cast("timestamp_ntz"), _c(earlier).cast("timestamp_ntz")
    months = F.timestamp_diff("MONTH", b, a)
    rest = micros(a) - micros(F.timestamp_add("MONTH", months, b))
    days = F.floor(rest / DAY)
    return interval(months, days, rest - days * DAY)


def cyclical_encode(x, period: float) -> Column:
    turn = 2 * F.pi() * _c(x) / period
    return F.array(F.sin(turn).cast("float"), F.cos(turn).cast("float"))


def date_add(part: str, n, x) -> Column:
    return F.timestamp_add(part.upper().rstrip("S"), _c(n).cast("int"), _c(x).cast("timestamp_ntz"))


def date_bin(stride_micros: int, x, origin) -> Column:
    """The start of the stride, counted from the origin, that holds a timestamp."""
    if stride_micros <= 0:
        raise ValueError("a stride is longer than nothing")
    o = micros(origin)
    return of_micros(o + F.floor((micros(x) - o) / stride_micros) * stride_micros)


def date_diff(part: str, start, end) -> Column:
    """Boundaries crossed for calendar parts, whole weeks of days, fractions for parts of a day."""
    a, b, p = _c(start), _c(end), part.lower().rstrip("s")
    if p == "year":
        out = F.year(b) - F.year(a)
    elif p == "quarter":
        out = (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)
    elif p == "month":
        out = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    elif p == "week":
        out = F.floor(F.datediff(b, a) / 7)
    elif p == "day":
        out = F.datediff(b, a)
    else:
        out = (micros(b) - micros(a)) / {"hour": HOUR, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}[p]
    return out.cast("float")


def date_part(field: str, x) -> Column:
    """Sunday is day 0 of a week by ``dow`` and Monday day 1 by ``isodow``."""
    f, c = field.lower(), _c(x)
    if f == "dow":
        return (F.dayofweek(c) - 1).cast("double")
    if f == "isodow":
        return (F.weekday(c) + 1).cast("double")
    if f == "epoch":
        return micros(c) / 1_000_000
    return F.date_part(F.lit(f), c).cast("double")


def date_trunc(field: str, x) -> Column:
    return F.date_trunc(field, _c(x)).cast("timestamp_ntz")


def dayofweek(x) -> Column:
    """1 is Monday."""
    return F.weekday(_c(x)) + 1


def _duration(divisor: float):
    return lambda micros_: (_c(micros_) / divisor).cast("float")


duration_seconds, duration_minutes, duration_hours, duration_days = map(_duration, (1e6, 6e7, 3.6e9, 8.64e10))


def make_time(hour, minute, second) -> Column:
    """Microseconds of the day."""
    return (_c(hour).cast("long") * HOUR + _c(minute).cast("long") * 60_000_000 + _c(second).cast("double") * 1_000_000).cast("long")


def time_diff(start, end) -> Column:
    return F.pmod(_c(end) - _c(start), F.lit(DAY))


def make_timestamp(year, month, day, hour, minute, second) -> Column:
    return F.make_timestamp_ntz(*map(_c, (year, month, day, hour, minute, second)))


for _name in ("make_date", "now", "year", "month", "day", "hour", "minute", "second", "quarter", "dayofyear"):
    globals()[_name] = getattr(F, _name)
