"""Typed times next to the raw strings of the services."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unix_time(seconds: Column) -> Column:
    """Unix seconds kept as text -> timestamp; NULL if it is no number."""
    return F.timestamp_seconds(seconds.try_cast("bigint"))


def iso_time(text: Column) -> Column:
    """ISO text -> timestamp; NULL if it is none."""
    return text.try_cast("timestamp")


def whole_seconds(duration_ms: Column) -> Column:
    """Milliseconds -> whole seconds; NULL for missing and for 0."""
    seconds = F.floor(duration_ms / F.lit(1000)).cast("bigint")
    return F.when(duration_ms != 0, seconds)
