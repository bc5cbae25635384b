"""Ages, freshness limits and deadlines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def iso_time(text: Column) -> Column:
    """ISO time text to timestamp; unreadable text is unknown."""
    return text.try_cast("timestamp")


def age_seconds(then: Column, now: Column) -> Column:
    return F.unix_micros(now) / F.lit(1e6) - F.unix_micros(then) / F.lit(1e6)


def is_fresh(fetched_at: Column, now: Column, ttl_minutes: Column) -> Column:
    """Not older than the limit; exactly at the limit still counts."""
    age = F.unix_micros(now) - F.unix_micros(fetched_at)
    return F.coalesce(age <= ttl_minutes.cast("bigint") * F.lit(60_000_000), F.lit(False))


def deadline(until: Column) -> Column:
    """A bare date runs to the last second of that day."""
    return F.when(
        until == F.date_trunc("day", until), until + F.expr("INTERVAL 86399 SECONDS")
    ).otherwise(until)
