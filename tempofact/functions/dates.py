"""Dates: relative phrases, tolerant parsing, calendar differences."""

from __future__ import annotations

import re
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tempofact.functions.text import NUMBER_WORDS
from tempofact.session import ship

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
NUMBER = r"\d+|a|an|one|two|three|four|five|six|seven|eight|nine|ten"
UNIT = r"day|week|month|year"
# The phrases that are understood.
PHRASES = re.compile(
    rf"\b(?:(?P<n>{NUMBER})\s+(?P<unit>{UNIT})s?\s+(?P<way>ago|later|after|hence)|(?P<two>the\s+day\s+before\s+yesterday)|(?P<one>yesterday)"
    rf"|last\s+(?P<last>week|month|year)|last\s+(?P<weekday>{'|'.join(DAYS)})|(?P<zero>today|this\s+(?:morning|afternoon|evening))"
    rf"|how\s+many\s+(?P<many>{UNIT})s?\s+(?:ago|have\s+passed|has\s+passed|since)|(?P<long>how\s+long\s+(?:ago|since))|in\s+the\s+past\s+(?P<past>\d+)\s+(?P<past_unit>{UNIT})s?)\b",
    re.IGNORECASE,
)
# How far back an open question looks, in days or in units.
LONG_AGO, MANY_UNITS = 90, 6


def window_of(text: str | None, today: date, tolerance: int = 1) -> tuple[date, date] | None:
    """The window [from, to) of the leftmost relative phrase: its day and ``tolerance`` days on each side.

    A month has 30 days and a year 365. "how many units ago" looks at half of six units back. None for a day outside the calendar.
    """
    m = PHRASES.search(text or "")
    if not m:
        return None
    got = {k: v.lower() for k, v in m.groupdict().items() if v}
    try:
        if "past" in got:
            return today - timedelta(days=int(got["past"]) * UNIT_DAYS[got["past_unit"]]), today + timedelta(days=1)
        if "unit" in got:
            n = int(got["n"]) if got["n"].isdigit() else NUMBER_WORDS[got["n"]]
            back = n * UNIT_DAYS[got["unit"]] * (1 if got["way"] == "ago" else -1)
        elif "weekday" in got:
            back = (today.weekday() - DAYS.index(got["weekday"])) % 7 or 7
        elif "last" in got:
            back = UNIT_DAYS[got["last"]]
        elif "many" in got:
            back = MANY_UNITS * UNIT_DAYS[got["many"]] // 2
        else:
            back = next(days for name, days in (("two", 2), ("one", 1), ("zero", 0), ("long", LONG_AGO)) if name in got)
        at = today - timedelta(days=back)
        return at - timedelta(days=tolerance), at + timedelta(days=tolerance + 1)
    except (OverflowError, ValueError):
        return None


def window_udf(today: date, tolerance: int = 1):  # noqa: ANN201
    @F.pandas_udf("struct<start:date,end:date>")
    def run(text: pd.Series) -> pd.DataFrame:
        got = [window_of(t, today, tolerance) or (None, None) for t in text]
        return pd.DataFrame(got, columns=["start", "end"])

    return run


def window_at_udf(tolerance: int = 1):  # noqa: ANN201
    """As ``window_udf``, of a text and the day it was asked on; without a day there is no window."""
    @F.pandas_udf("struct<start:date,end:date>")
    def run(text: pd.Series, day: pd.Series) -> pd.DataFrame:
        got = [(None, None) if d is None or d is pd.NaT else window_of(t, d, tolerance) or (None, None) for t, d in zip(text, day)]
        return pd.DataFrame(got, columns=["start", "end"])

    return run


def previous_weekday(d: Column, weekday: int) -> Column:
    """The last such day strictly before d; Monday is 0."""
    back = F.pmod(F.weekday(d) - weekday, F.lit(7))
    return F.date_sub(d, F.when(back == 0, 7).otherwise(back))


def parse_iso(text: Column) -> Column:
    """Tolerant: Z, a missing zone and 'null' are understood, anything else malformed is null."""
    t = F.regexp_replace(F.nullif(F.trim(text), F.lit("null")), "Z$", "")
    return F.try_to_timestamp(F.regexp_replace(t, "T", " ")).cast("timestamp_ntz")


def parse_weekday_stamp(text: Column) -> Column:
    """'2023/05/30 (Tue) 23:40'."""
    return F.try_to_timestamp(F.regexp_replace(text, r" \(\w+\)", ""), F.lit("yyyy/MM/dd HH:mm")).cast("timestamp_ntz")


def months_between(a: Column, b: Column) -> Column:
    """Month transitions from a to b."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def years_between(a: Column, b: Column) -> Column:
    """Anniversaries of a up to b."""
    early = (F.month(b) < F.month(a)) | ((F.month(b) == F.month(a)) & (F.dayofmonth(b) < F.dayofmonth(a)))
    return F.year(b) - F.year(a) - F.when(early, 1).otherwise(0)


def total_days(spans: Column) -> Column:
    """Sum of abs(end - start) in days over an array of (start, end)."""
    return F.aggregate(spans, F.lit(0), lambda acc, s: acc + F.abs(F.datediff(s["end"], s["start"])))


ship(__name__)
