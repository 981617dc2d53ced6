"""Dates and numbers of feeds, window numbers, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_millis_to_date(value: Column) -> Column:
    """The UTC date of milliseconds since 1970, given as text or number; null for 0, blank and junk."""
    n = value.cast("string").try_cast("bigint")
    return F.to_date(F.timestamp_millis(F.nullif(n, F.lit(0).cast("bigint"))))


def iso_date(value: Column) -> Column:
    """The date in a text of one of three forms: 2026-03-14T00:00:00, 2026-03-14 or 03/14/2026."""
    text = F.trim(value)
    stamp = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z*$"), F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2})", 1), F.lit("yyyy-M-d'T'H:m:s")))
    day = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}Z*$"), F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit("yyyy-M-d")))
    us = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}Z*$"), F.try_to_timestamp(F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("M/d/yyyy")))
    return F.to_date(F.coalesce(stamp, day, us))


def to_float(value: Column) -> Column:
    return value.cast("string").try_cast("double")


def window_number(day: Column, as_of: Column, days: int) -> Column:
    """Which window of ``days`` before the date ``as_of`` holds a day: 0 is the last, negative are later days."""
    return F.floor((F.datediff(as_of, day) - 1) / days).cast("int")


def window_key(*parts: Column) -> Column:
    """40 hex digits that stand for the parts, joined by colons."""
    return F.left(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), F.lit(40))


def quarter_key(ts: Column) -> Column:
    """Like 2026:Q1."""
    return F.concat(F.year(ts).cast("string"), F.lit(":Q"), F.quarter(ts).cast("string"))


def hash_key(secret: Column) -> Column:
    """What is stored of an access key."""
    return F.sha2(secret.cast("binary"), 256)
