"""Access keys and alert subscriptions of users: made, switched, revoked, removed. Each gives the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import dates
from plinth.schemas import row_id

PREFIX = 12


def with_alerts(alerts: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """``alerts`` and the new ones of ``wanted`` (user_id, name, filters, channel, channel_target), active and never fired; several of one name are told apart."""
    same = Window.partitionBy("user_id", "name").orderBy("channel", "channel_target", F.to_json("filters"))
    numbered = wanted.withColumn("__n", F.row_number().over(same))
    id_ = F.when(F.col("__n") == 1, row_id(F.col("user_id"), F.col("name"), now)).otherwise(row_id(F.col("user_id"), F.col("name"), now, F.col("__n")))
    new = numbered.withColumn("id", id_).drop("__n").withColumns({"is_active": F.lit(True), "last_fired_at": F.lit(None).cast("timestamp"), "fire_count": F.lit(0), "created_at": now})
    return alerts.unionByName(new, allowMissingColumns=True)


def _own(user: str, key: str, wanted: DataFrame, table: DataFrame) -> DataFrame:
    """``table`` with __hit on rows that ``wanted`` (user_id, id) names and that are the user's own."""
    named = wanted.select(F.col("user_id").alias("__user"), F.col("id").alias("__id")).distinct().withColumn("__hit", F.lit(True))
    on = (table[user] == named["__user"]) & (table[key] == named["__id"])
    return table.join(named, on, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False))).drop("__user", "__id")


def toggled(alerts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Alerts with those that their owner names switched on or off."""
    return _own("user_id", "id", wanted, alerts).withColumn("is_active", F.col("is_active") != F.col("__hit")).drop("__hit")


def without_alerts(alerts: DataFrame, deliveries: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts without those that their owner removes, and deliveries without theirs."""
    marked = _own("user_id", "id", wanted, alerts)
    gone = marked.where("__hit").select(F.col("id").alias("alert_id"))
    return marked.where("NOT __hit").drop("__hit"), deliveries.join(gone, "alert_id", "left_anti")


def with_keys(keys: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """``keys`` and new ones of ``wanted`` (user_id, name, secret, expires_at): the hash and a prefix of each secret are kept, the secret isn't."""
    new = wanted.select(
        row_id(F.col("user_id"), dates.hash_key(F.col("secret"))).alias("id"), "user_id", "name", F.left("secret", F.lit(PREFIX)).alias("prefix"), dates.hash_key(F.col("secret")).alias("key_hash"),
        "expires_at", F.lit(None).cast("timestamp").alias("revoked_at"), now.alias("created_at"),
    )
    return keys.unionByName(new, allowMissingColumns=True)


def revoked(keys: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Keys with those that their owner revokes marked; a key that was revoked keeps its time."""
    return _own("user_id", "id", wanted, keys).withColumn("revoked_at", F.when(F.col("__hit"), F.coalesce("revoked_at", now)).otherwise(F.col("revoked_at"))).drop("__hit")
