"""Projects announced in the news."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import classify, naming
from plinth.operators.resolve import resolve
from plinth.operators.upsert import new_only, upsert
from plinth.schemas import row_id
from plinth.session import kept


class ProjectBatch(NamedTuple):
    projects: DataFrame
    signals: DataFrame
    stats: DataFrame


def attribute_announcements(announcements: DataFrame, firms: DataFrame) -> DataFrame:
    """``announcements`` (ann_id, headline, firm_names, …) with firm_id: the first named firm that resolves, else the headline's."""
    names = F.concat(F.coalesce("firm_names", F.array().cast("array<string>")), F.array("headline"))
    tried = announcements.select("ann_id", F.posexplode(names).alias("place", "text")).where("text IS NOT NULL AND text <> ''")
    none = F.lit(None).cast("string")
    mentions = tried.select(F.struct("ann_id", "place").alias("mention_id"), "text", none.alias("address"), none.alias("phone"), none.alias("parcel_id"))
    mentions = mentions.withColumn("mention_id", F.concat_ws("\x1f", F.col("mention_id.ann_id").cast("string"), F.col("mention_id.place").cast("string")))
    keys = tried.select("ann_id", "place", F.concat_ws("\x1f", F.col("ann_id").cast("string"), F.col("place").cast("string")).alias("mention_id"))
    told = resolve(mentions, firms).where("status = 'resolved'").join(keys, "mention_id")
    first = kept(told.groupBy("ann_id").agg(F.min_by("firm_id", "place").alias("firm_id")), "told")
    return announcements.join(first, "ann_id", "left")


def ingest_announcements(announcements: DataFrame, old: DataFrame, signals: DataFrame, now: Column, firms: DataFrame | None = None) -> ProjectBatch:
    """Announcements merged into projects by (canonical_name, locality), and a signal for each that is new.

    ``announcements``: ann_id, headline, project_name, firm_names, project_type, locality,
    address, unit_count, square_feet, acreage, est_value_usd, announced_date, summary.
    Several with one key in a batch are merged in the order of ann_id: a value stays until
    a later row has another, the name is the first one's. Without a name, a row is passed over.
    """
    rows = attribute_announcements(announcements, firms) if firms is not None else announcements.withColumn("firm_id", F.lit(None).cast("string"))
    name = F.coalesce(F.nullif("project_name", F.lit("")), F.nullif("headline", F.lit("")))
    rows = rows.withColumn("name", F.left(name, F.lit(400))).where("name IS NOT NULL").withColumn("canonical_name", F.left(naming.canonicalize(F.col("name")), F.lit(400)))
    rows = rows.withColumn("description", F.col("summary"))
    kept = ["firm_id", "project_type", "address", "unit_count", "square_feet", "acreage", "est_value_usd", "announced_date", "description"]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ann_id"))).alias(c) for c in kept]
    last = rows.groupBy("canonical_name", "locality").agg(F.min_by("name", "ann_id").alias("name"), *latest)
    new = last.select(row_id(F.col("canonical_name"), F.col("locality")).alias("id"), "canonical_name", "locality", "name", *kept, F.lit("proposed").alias("status"))
    projects = upsert(old.drop("__change"), new, ["canonical_name", "locality"], keep=["id", "name", "status"])
    key = F.left(F.concat(F.lit("announcement:"), "canonical_name", F.lit(":"), F.coalesce("locality", F.lit("va"))), F.lit(200))
    spoken = rows.select(
        row_id(key).alias("id"), "firm_id", classify.headline_signal(F.col("headline")).alias("signal_type"), F.left("headline", F.lit(400)).alias("title"), "summary",
        classify.project_score(F.col("est_value_usd"), F.col("unit_count"), F.col("square_feet")).alias("score"), "locality", F.col("project_type").alias("asset_class"),
        F.coalesce(F.col("announced_date").cast("timestamp"), now).alias("occurred_at"), now.alias("detected_at"),
        F.to_json(F.struct("unit_count", "square_feet", "acreage", "est_value_usd", F.lit("reported").alias("confidence"))).alias("payload"), F.lit(False).alias("is_derived"), key.alias("dedupe_key"), "ann_id",
    )
    fresh = new_only(spoken, signals, ["dedupe_key"], ["ann_id"]).drop("ann_id")
    changed = projects.agg(F.count_if(F.col("__change") == "insert").alias("created"))
    stats = changed.crossJoin(rows.agg(F.count("*").alias("__rows"), F.count("firm_id").alias("resolved"), F.count_if(F.col("firm_id").isNull()).alias("unattributed"))).withColumn("updated", F.col("__rows") - F.col("created")).crossJoin(fresh.agg(F.count("*").alias("signals_created")))
    stats = stats.select("created", "updated", "resolved", "unattributed", "signals_created")
    return ProjectBatch(projects, fresh, stats)
