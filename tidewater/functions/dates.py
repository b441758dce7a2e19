"""Dates and times. An interval is months and microseconds; a month too many rolls over into the next."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of a format and what they are here, longest first.
FIELDS = {"YYYY": "yyyy", "HH24": "HH", "HH12": "hh", "Mon": "MMM", "Day": "EEEE", "YY": "yy", "MM": "MM", "DD": "dd", "HH": "hh", "MI": "mm", "SS": "ss", "AM": "a", "PM": "a"}
_FIELD = re.compile("|".join(sorted(FIELDS, key=len, reverse=True)))
MICROS_A_DAY = 86_400_000_000


def pattern(format: str) -> str:
    """A format of YYYY, MM, DD, HH24, HH12, MI, SS, Mon, Day, AM as one of this engine; other letters stand for themselves."""
    out, at = "", 0
    plain = lambda x: re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", x.replace("'", "''"))
    for m in _FIELD.finditer(format):
        out += plain(format[at : m.start()]) + FIELDS[m[0]]
        at = m.end()
    return out + plain(format[at:])


def to_char(t: Column, format: str) -> Column:
    return F.date_format(t, pattern(format))


def to_date(s: Column, format: str) -> Column:
    """Null for what does not fit."""
    return F.to_date(F.try_to_timestamp(s, F.lit(pattern(format))))


def to_timestamp(s: Column, format: str) -> Column:
    return F.try_to_timestamp(s, F.lit(pattern(format))).cast("timestamp_ntz")


def interval(months: int = 0, days: int = 0, micros: int = 0) -> tuple[int, int]:
    return months, days * MICROS_A_DAY + micros


def date_add(d: Column, step: tuple[int, int]) -> Column:
    """Months first, by the first of the month, so that January 31 and a month is March 2 or 3; then whole days."""
    months, micros = step
    return F.date_add(F.add_months(F.trunc(d, "MM"), F.lit(months)), F.day(d) - 1 + F.lit(micros // MICROS_A_DAY if micros >= 0 else -(-micros // MICROS_A_DAY)))


def date_sub(d: Column, step: tuple[int, int]) -> Column:
    return date_add(d, (-step[0], -step[1]))


def datediff(a: Column, b: Column) -> Column:
    """Days from b to a."""
    return F.datediff(a, b)


def extract(field: str, t: Column) -> Column:
    """A field as a double: year, quarter, month, week, day, dow (0: Sunday), doy, hour, minute, second, millisecond, microsecond, epoch."""
    field = field.lower()
    micros = F.unix_micros(t.cast("timestamp"))
    special = {
        "dow": lambda: F.dayofweek(t) - 1,
        "doy": lambda: F.dayofyear(t),
        "epoch": lambda: micros / 1e6,
        "second": lambda: F.pmod(micros, F.lit(60_000_000)) / 1e6,
        "millisecond": lambda: F.pmod(micros, F.lit(60_000_000)) / 1e3,
        "microsecond": lambda: F.pmod(micros, F.lit(60_000_000)),
        "timezone": lambda: F.lit(0),
    }
    return (special[field]() if field in special else F.date_part(F.lit(field), t)).cast("double")


def date_trunc(field: str, t: Column) -> Column:
    return F.date_trunc(field, t)


def age(a: Column, b: Column) -> Column:
    """From b to a as struct(months, micros): whole months by the days of the month, then days and time left.

    If the later one has the smaller day, a month is borrowed, with the days of the month before the later one.
    """
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    late, early = F.greatest(a, b), F.least(a, b)
    in_day = lambda t: F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.date_trunc("DAY", t.cast("timestamp")))
    borrowed = (F.day(late) < F.day(early)).cast("int")
    months = (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early) - borrowed
    days = F.day(late) - F.day(early) + borrowed * F.day(F.date_sub(F.trunc(late, "MM"), 1))
    micros = days.cast("bigint") * MICROS_A_DAY + in_day(late) - in_day(early)
    sign = F.when(a < b, F.lit(-1)).otherwise(F.lit(1))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct((sign * months).cast("bigint").alias("months"), (sign * micros).cast("bigint").alias("micros")))


def now() -> Column:
    return F.current_timestamp()


def current_time() -> Column:
    """Microseconds since midnight, UTC."""
    return F.pmod(F.unix_micros(F.current_timestamp()), F.lit(MICROS_A_DAY))
