"""Time expressions. Dates follow ``spark.sql.session.timeZone``; only ``to_epoch_ms`` has a fixed offset."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = "yyyy-MM-dd"
STAMP = "yyyy-MM-dd HH:mm:ss"

_UNIT_US = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
            "hour": 3_600_000_000, "day": 86_400_000_000}


def duration_us(text: str) -> int:
    """Microseconds of a duration such as ``"10 seconds"`` or ``"1 day 2 hours"``."""
    total = 0
    for number, unit in re.findall(r"(\d+)\s*([a-z]+)", text.lower()):
        total += int(number) * _UNIT_US[unit.rstrip("s")]
    if total <= 0:
        raise ValueError(f"not a duration: {text!r}")
    return total


def to_epoch_ms(text: Column, full: bool = False, offset: str = "+08:00") -> Column:
    """Epoch milliseconds of a date (or, with ``full``, a date and time) read at a fixed offset."""
    stamp = text if full else F.concat(text, F.lit(" 00:00:00"))
    return F.unix_millis(F.to_timestamp(F.concat(stamp, F.lit(offset)), STAMP + "XXX"))


def ms_to_time(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def ms_to_date(ms: Column) -> Column:
    return F.date_format(ms_to_time(ms), DATE)


def ms_to_stamp(ms: Column) -> Column:
    return F.date_format(ms_to_time(ms), STAMP)


def stamp(time: Column) -> Column:
    return F.date_format(time, STAMP)


def date_of_text(text: Column) -> Column:
    """Date part of ``yyyy-MM-dd HH:mm:ss`` text."""
    return F.split(text, " ")[0]


def text_to_time(text: Column) -> Column:
    """Event time of ``yyyy-MM-dd HH:mm:ss`` text; unreadable text gives null."""
    return text.try_cast("timestamp")


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def now_seconds() -> Column:
    return F.unix_timestamp(F.current_timestamp())


def day_number(time: Column) -> Column:
    """Local calendar day as a day count."""
    return F.unix_date(F.to_date(time))


def slot(time: Column, width_us: int) -> Column:
    """Start, in epoch microseconds, of the fixed-width slot holding ``time``."""
    us = F.unix_micros(time)
    return us - F.pmod(us, F.lit(width_us))
