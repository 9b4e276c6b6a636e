"""Time helpers on naive timestamps. None of them looks at the session time zone."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

DAY = 86_400
UNIT_SECONDS = {"min": 60, "h": 3_600, "d": DAY, "w": 7 * DAY}


def parse_freq(freq: str) -> tuple[int, str]:
    """'1d' -> (1, 'd'); 'h' -> (1, 'h')."""
    m = re.fullmatch(r"(\d*)\s*(min|h|d|w)", freq.strip().lower())
    if not m:
        raise ValueError(f"frequency must look like '1h', '1d' or '1w', got {freq!r}")
    return int(m.group(1) or 1), m.group(2)


def freq_seconds(freq: str) -> int:
    n, unit = parse_freq(freq)
    return n * UNIT_SECONDS[unit]


def day_number(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def midnight(c: Column) -> Column:
    return c.cast("date").cast("timestamp_ntz")


def epoch_seconds(c: Column) -> Column:
    return (day_number(c).cast("bigint") * DAY + F.hour(c) * 3600
            + F.minute(c) * 60 + F.second(c))


def epoch_micros(c: Column) -> Column:
    fraction = F.date_part(F.lit("SECONDS"), c) * 1_000_000
    return ((day_number(c).cast("bigint") * DAY + F.hour(c) * 3600 + F.minute(c) * 60)
            * 1_000_000 + fraction.cast("bigint"))


def add_seconds(c: Column, seconds: Column) -> Column:
    return c + F.make_dt_interval(secs=seconds)


def from_epoch_seconds(s: Column) -> Column:
    day = F.date_from_unix_date(F.floor(s / DAY).cast("int")).cast("timestamp_ntz")
    return add_seconds(day, F.pmod(s, F.lit(DAY)))


def monday(c: Column) -> Column:
    return F.date_sub(c.cast("date"), F.weekday(c)).cast("timestamp_ntz")


def sunday(c: Column) -> Column:
    """Label of the Monday..Sunday week that holds the stamp."""
    return F.date_add(c.cast("date"), 6 - F.weekday(c)).cast("timestamp_ntz")


def hour_start(c: Column) -> Column:
    return add_seconds(midnight(c), F.hour(c) * 3600)


def span_chunk(c: Column, span_days: int) -> Column:
    """Number of the fixed time span that holds the stamp: the unit of parallel work inside one series."""
    return F.floor(day_number(c) / span_days).cast("int")
