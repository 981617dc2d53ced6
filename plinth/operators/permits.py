"""Permits: attribution, upsert, signals, and owners from parcels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import classify, text
from plinth.operators.resolve import learned_aliases, resolve, review_queue, with_alias_memory
from plinth.operators.upsert import first_rows, new_only, upsert
from plinth.schemas import row_id
from plinth.session import kept


def permit_id(locality: Column, number: Column) -> Column:
    return row_id(locality, number)


class PermitBatch(NamedTuple):
    permits: DataFrame  # the table's next state, with __change
    signals: DataFrame  # new rows only
    aliases: DataFrame  # new rows only
    queue: DataFrame  # new rows only
    stats: DataFrame  # created, updated, resolved, ambiguous, unattributed, signals_created


def permit_signals(permits: DataFrame, now: Column, floor: float = classify.SIGNAL_FLOOR) -> DataFrame:
    """A signal for each permit whose value reaches ``floor``."""
    value = F.coalesce(F.col("valuation_usd").cast("double"), F.lit(0.0))
    name = F.coalesce(F.nullif("applicant_name_raw", F.lit("")), F.col("permit_number").cast("string"))
    kind = F.coalesce(F.nullif("permit_type", F.lit("")), F.lit("permit"))
    key = F.concat(F.lit("permit:"), "locality", F.lit(":"), F.col("permit_number").cast("string"))
    return permits.where(value >= floor).select(
        row_id(key).alias("id"),
        "firm_id",
        F.lit("permit_filing").alias("signal_type"),
        F.concat(name, F.lit(" — "), kind, F.lit(" in "), "locality").alias("title"),
        F.concat(name, F.lit(" filed a "), kind, F.lit(" at "), F.coalesce(F.nullif("address", F.lit("")), "locality"), F.lit(" valued at "), text.money(value), F.lit(".")).alias("summary"),
        classify.permit_score(F.col("valuation_usd"), F.col("permit_type")).alias("score"),
        "locality",
        F.lit(None).cast("string").alias("asset_class"),
        F.coalesce("issued_date", "filed_date").cast("timestamp").alias("occurred_at"),
        now.alias("detected_at"),
        F.to_json(F.struct("permit_number", "parcel_id", value.alias("valuation_usd"))).alias("payload"),
        F.lit(False).alias("is_derived"),
        key.alias("dedupe_key"),
    )


def ingest_permits(records: DataFrame, old: DataFrame, firms: DataFrame, aliases: DataFrame, signals: DataFrame, queue: DataFrame, now: Column, order: str = "position") -> PermitBatch:
    """A batch of feed records, attributed and merged into permits.

    ``records``: the columns of a permit record, and in ``order`` each row's position in
    the feed, a whole number from 0 that no other row has. Every row with an applicant is
    attributed, and what one row teaches holds for the later ones. Rows that repeat a
    (locality, permit number) are merged in feed order: a value stays until a later row
    has another, method and confidence are the last row's even if it has none, and the
    firm is the last one found and never cleared. The same rules merge the batch into
    ``old``. A signal speaks of the first row that reaches the floor, with the firm known
    by then.
    """
    keys = ["locality", "permit_number"]
    at = F.lpad(F.col(order).cast("long").cast("string"), 20, "0")
    rows = records.withColumns({"mention_id": F.concat_ws("\x1f", at, "locality", F.col("permit_number").cast("string")), "id": permit_id(F.col("locality"), F.col("permit_number"))})
    named = F.trim(F.coalesce("applicant_name_raw", F.lit(""))) != ""
    mentions = rows.where(named).select("mention_id", F.col("applicant_name_raw").alias("text"), "address", F.lit(None).cast("string").alias("phone"), "parcel_id")
    told = kept(with_alias_memory(resolve(mentions, firms)), "told")  # what all outputs below are made of
    hit = told.select("mention_id", F.col("status").alias("told"), F.col("firm_id").alias("firm_id"), F.col("method").alias("resolution_method"), F.when(F.col("status") == "resolved", F.col("confidence")).alias("resolution_confidence"))
    each = rows.join(hit, "mention_id", "left")
    values = [c for c in records.columns if c not in (*keys, order, "id", "mention_field", "raw", "source_url")] + ["firm_id"]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("mention_id"))).alias(c) for c in values]
    last = each.groupBy(*keys).agg(F.max("id").alias("id"), *latest, F.max_by(F.struct("resolution_method", "resolution_confidence"), "mention_id").alias("told"))
    new = last.select(*keys, "id", *values, "told.resolution_method", "told.resolution_confidence")
    permits = upsert(old.drop("__change"), new, keys, overwrite=["resolution_method", "resolution_confidence"], keep=["id"])
    # The firm that the permit has after each row.
    so_far = Window.partitionBy(*keys).orderBy("mention_id").rowsBetween(Window.unboundedPreceding, 0)
    before = old.select(*keys, F.col("firm_id").cast("string").alias("__firm"))
    running = each.withColumn("firm_id", F.last("firm_id", ignorenulls=True).over(so_far)).alias("e")
    on = F.col("e.locality").eqNullSafe(F.col("b.locality")) & F.col("e.permit_number").eqNullSafe(F.col("b.permit_number"))
    spoken = running.join(before.alias("b"), on, "left").select("e.*", F.col("b.__firm")).withColumn("firm_id", F.coalesce("firm_id", "__firm"))
    loud = spoken.where(F.coalesce(F.col("valuation_usd").cast("double"), F.lit(0.0)) >= classify.SIGNAL_FLOOR)
    fresh = new_only(permit_signals(first_rows(loud, keys, ["mention_id"]), now), signals, ["dedupe_key"], ["id"])
    queued = review_queue(told.join(rows.select("mention_id", F.col("id").alias("origin_id")), "mention_id"), queue, "permits")
    learned = learned_aliases(told, aliases)
    n = each.agg(F.count("*").alias("__rows"), F.count_if(F.col("told") == "resolved").alias("resolved"), F.count_if(F.col("told") == "ambiguous").alias("ambiguous"), F.count_if(F.col("told").isNull() | F.col("told").isin("unmatched", "rejected")).alias("unattributed"))
    changed = permits.agg(F.count_if(F.col("__change") == "insert").alias("created"))
    stats = changed.crossJoin(n).withColumn("updated", F.col("__rows") - F.col("created")).crossJoin(fresh.agg(F.count("*").alias("signals_created")))  # one row each
    stats = stats.select("created", "updated", "resolved", "ambiguous", "unattributed", "signals_created")
    return PermitBatch(permits, fresh, learned, queued, stats)


def unattributed_with_parcel(permits: DataFrame, locality: str) -> DataFrame:
    """Permits of a locality to find an owner for, the latest first; those without a date before them."""
    return permits.where(F.col("firm_id").isNull() & F.col("parcel_id").isNotNull() & (F.col("locality") == locality)).orderBy(F.desc_nulls_first("filed_date"), "permit_number")


def with_parcel_owners(permits: DataFrame, owners: DataFrame) -> DataFrame:
    """Permits with owner_name, null where the parcel has no owner row. ``owners``: parcel_id, owner_name."""
    known = owners.where("owner_name IS NOT NULL AND owner_name <> ''").groupBy("parcel_id").agg(F.max("owner_name").alias("owner_name"))
    return permits.join(known, "parcel_id", "left")


class Enrichment(NamedTuple):
    permits: DataFrame
    signals: DataFrame
    aliases: DataFrame
    queue: DataFrame
    stats: DataFrame


def enrich_with_owners(permits: DataFrame, owners: DataFrame, firms: DataFrame, aliases: DataFrame, signals: DataFrame, queue: DataFrame, locality: str) -> Enrichment:
    """Attribute permits through the owners of their parcels, and their signals too where these have no firm."""
    rows = with_parcel_owners(unattributed_with_parcel(permits, locality), owners)
    # In the order of the selection: the latest day first, after those without one; of a day, numbers by size and then as text.
    day = F.coalesce(F.lpad((F.lit(10_000_000) - F.datediff("filed_date", F.lit("1970-01-01").cast("date"))).cast("string"), 10, "0"), F.lit(""))
    number = F.col("permit_number").cast("string")
    rows = rows.withColumn("mention_id", F.concat_ws("\x1f", day, F.lpad(F.length(number).cast("string"), 6, "0"), number))
    none = F.lit(None).cast("string")
    owned = rows.where("owner_name IS NOT NULL").select("mention_id", F.col("owner_name").alias("text"), none.alias("address"), none.alias("phone"), none.alias("parcel_id"))
    told = kept(with_alias_memory(resolve(owned, firms)), "told")  # what all outputs below are made of
    hit = rows.join(told.select("mention_id", F.col("status").alias("told"), F.col("firm_id").alias("found_id"), "method", "confidence"), "mention_id", "left")
    change = hit.where("owner_name IS NOT NULL").select("locality", "permit_number", "owner_name", "told", "found_id", "method", "confidence")
    got = F.col("told") == "resolved"
    after = permits.join(change, ["locality", "permit_number"], "left").withColumns(
        {
            "applicant_name_raw": F.coalesce("owner_name", "applicant_name_raw"),
            "firm_id": F.when(got, F.col("found_id")).otherwise(F.col("firm_id").cast("string")),
            "resolution_method": F.when(got, F.col("method")).otherwise(F.col("resolution_method")),
            "resolution_confidence": F.when(got, F.col("confidence")).otherwise(F.col("resolution_confidence")),
        }
    )
    found = change.where(got).select(F.concat(F.lit("permit:"), "locality", F.lit(":"), F.col("permit_number").cast("string")).alias("dedupe_key"), "found_id")
    filled = signals.join(found, "dedupe_key", "left").withColumn("firm_id", F.coalesce(F.col("firm_id").cast("string"), "found_id")).drop("found_id").select(*signals.columns)
    stats = hit.agg(
        F.count("*").alias("examined"),
        F.count_if(got).alias("attributed"),
        F.count_if(F.col("told") == "ambiguous").alias("queued"),
        F.count_if(F.col("owner_name").isNull()).alias("no_owner"),
        F.count_if(F.col("owner_name").isNotNull() & ~F.coalesce(got, F.lit(False))).alias("unresolved"),
    )
    queued = review_queue(told.join(rows.select("mention_id", permit_id(F.col("locality"), F.col("permit_number")).alias("origin_id")), "mention_id"), queue, "permits")
    return Enrichment(after.select(*permits.columns), filled, learned_aliases(told, aliases), queued, stats)
