"""Timestamp expressions (H1-H4).

Flow timestamps are integer ticks of 1/100 s from the start of a period and may
run past one day. H1 keeps hours unwrapped (``24:20:42``); H2 and H3 wrap at
midnight like a clock (Q8).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import idiv

TICKS_PER_SECOND = 100


def ts_seconds(ts="timestamp") -> Column:
    """H4: whole seconds."""
    return idiv(ts, TICKS_PER_SECOND)


def ts_to_hours(ts="timestamp") -> Column:
    """H1: ``HH:MM:SS`` with unwrapped hours (three digits past 99 h)."""
    sec = ts_seconds(ts)
    return F.format_string("%02d:%02d:%02d", idiv(sec, 3600), idiv(sec % 3600, 60), sec % 60)


def hour_of_day(ts="timestamp") -> Column:
    """H2: ``HH``, wrapping at 24."""
    return F.format_string("%02d", idiv(ts_seconds(ts), 3600) % 24)


def minute_of_day(ts="timestamp") -> Column:
    """H3: ``HH:MM``, wrapping at 24."""
    sec = ts_seconds(ts)
    return F.format_string("%02d:%02d", idiv(sec, 3600) % 24, idiv(sec % 3600, 60))
