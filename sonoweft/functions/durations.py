"""Spans of time as text for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_duration(seconds: Column) -> Column:
    """``3.4s``, ``2m 03s`` or ``1h 02m 03s``; parts of a second are dropped from a minute on. Null stays null."""
    s = F.floor(seconds).cast("long")
    minutes = F.format_string("%dm %02ds", F.floor(s / 60), s % 60)
    hours = F.format_string("%dh %02dm %02ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    short = F.format_string("%.1fs", F.bround(seconds.cast("double"), 1))
    return F.when(seconds < 60, short).when(seconds < 3600, minutes).when(seconds >= 3600, hours)


def real_time_factor(elapsed: Column, audio: Column) -> Column:
    """Time spent for each second of audio, ``0.031x``; a dash where there is no audio or its length is unknown."""
    factor = F.format_string("%.3fx", F.bround(elapsed.cast("double") / audio, 3))
    return F.when(audio > 0, factor).otherwise(F.lit("—"))
