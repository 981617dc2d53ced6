"""Lists, timelines, feeds: filters, paging and totals, with their argument checks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Page(NamedTuple):
    rows: DataFrame
    total: DataFrame  # one row: total


def check_range(name: str, value, low, high) -> None:
    if value is not None and not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")


def paged(df: DataFrame, order: list, page: int = 1, size: int = 25) -> Page:
    check_range("page", page, 1, 1 << 31)
    check_range("page_size", size, 1, 200)
    return Page(df.orderBy(*order).offset((page - 1) * size).limit(size), df.agg(F.count("*").alias("total")))


def list_firms(firms: DataFrame, q: str | None = None, firm_type: str | None = None, asset_class: str | None = None, locality: str | None = None, page: int = 1, size: int = 25) -> Page:
    """Active firms by name: name like ``q``, type, class, locality."""
    df = firms.where("is_active")
    if q:
        df = df.where(F.col("name").ilike(f"%{q}%"))
    if firm_type:
        df = df.where(F.col("firm_type") == firm_type)
    if asset_class:
        df = df.where(F.array_contains("asset_classes", asset_class))
    if locality:
        df = df.where(F.array_contains("localities", locality))
    return paged(df, ["name", "id"], page, size)


def get_row(df: DataFrame, key, column: str = "id") -> DataFrame:
    """The row with a key; no row if there is none."""
    return df.where(F.col(column) == key)


def firm_timeline(signals: DataFrame, firm_id, signal_types=(), page: int = 1, size: int = 25) -> Page:
    df = signals.where(F.col("firm_id") == firm_id)
    df = df.where(F.col("signal_type").isin(*signal_types)) if signal_types else df
    return paged(df, [F.desc_nulls_last("occurred_at"), "id"], page, size)


def list_signals(signals: DataFrame, firm_id=None, signal_type=None, locality=None, asset_class=None, min_score=None, is_derived=None, limit: int = 50, offset: int = 0) -> Page:
    """The feed, latest first; every filter that is given must hold."""
    check_range("min_score", min_score, 0, 1)
    check_range("limit", limit, 1, 200)
    check_range("offset", offset, 0, 1 << 31)
    df = signals
    for name, wanted in (("firm_id", firm_id), ("signal_type", signal_type), ("locality", locality), ("asset_class", asset_class), ("is_derived", is_derived)):
        df = df.where(F.col(name) == wanted) if wanted is not None else df
    df = df.where(F.col("score") >= min_score) if min_score is not None else df
    return Page(df.orderBy(F.desc_nulls_last("occurred_at"), "id").offset(offset).limit(limit), df.agg(F.count("*").alias("total")))


def own_keys(keys: DataFrame, user_id) -> DataFrame:
    return keys.where((F.col("user_id") == user_id) & F.col("revoked_at").isNull()).orderBy("id")


def own_alerts(alerts: DataFrame, user_id) -> DataFrame:
    return alerts.where(F.col("user_id") == user_id).orderBy("id")


def key_is_valid(now: Column) -> Column:
    """Over keys: not revoked, and not past its end."""
    return F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n: a count of each."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


def failing_sources(sources: DataFrame, most: int = 10) -> DataFrame:
    return sources.where("consecutive_failures > 0").orderBy(F.desc("consecutive_failures"), "id").limit(most)


def verify_seeds(sources: DataFrame, probes: DataFrame) -> DataFrame:
    """Sources with verdict ok, moved or broken, from ``probes`` (base_url, status, final_url, error)."""
    plain = lambda c: F.regexp_replace(c, "/+$", "")
    verdict = F.when(F.col("error").isNotNull() | F.col("status").isNull() | (F.col("status") >= 400), "broken").when(plain("final_url") != plain("base_url"), "moved").otherwise("ok")
    return sources.where("is_active").join(probes, "base_url", "left").withColumn("verdict", verdict)


def pivot_rollup(permits: DataFrame, *by: str, how: str = "rollup") -> DataFrame:
    """Counts and values of permits over all groupings of a rollup or cube; which() tells the grouping apart from nulls."""
    grouped = permits.rollup(*by) if how == "rollup" else permits.cube(*by)
    return grouped.agg(F.count("*").alias("n"), F.sum("valuation_usd").alias("valuation"), F.grouping_id().cast("int").alias("which"))
