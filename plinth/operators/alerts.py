"""Alerts: which signals match which subscriptions, what is new, and how it is sent."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.text import day_label
from plinth.operators import outbox
from plinth.schemas import row_id
from plinth.session import kept, shared_dir, spread

# Hours looked back, signals named in a message, where webhooks may go.
LOOKBACK_HOURS, EMAIL_ROWS, SLACK_ROWS, WEBHOOK = 25, 10, 5, "https://hooks.slack.com/"
#: Into how many shares the signals of one value are cut.
SALTS = 16
#: Combinations of facets' values that an alert is found by, at most.
KEYS = 4096


def matches() -> Column:
    """Over a row of alert (filters) and signal: every facet that isn't empty holds the signal's value."""
    out = F.col("score") >= F.coalesce("filters.min_score", F.lit(0.0))
    for facet, value in (("firm_ids", F.col("firm_id").cast("string")), ("signal_types", F.col("signal_type")), ("localities", F.col("locality")), ("asset_classes", F.col("asset_class"))):
        f = F.col(f"filters.{facet}")
        out = out & (F.coalesce(F.size(f), F.lit(0)).isin(0, -1) | F.coalesce(F.array_contains(f, value), F.lit(False)))
    return out


_FACETS = ("firm_ids", "localities", "signal_types", "asset_classes")


def alert_keys(alerts: DataFrame) -> DataFrame:
    """``alerts`` with __mask (which facets its keys have) and __key, a row for each combination of one value of each of these facets.

    Facets are taken in order as long as an alert has no more than ``KEYS`` combinations;
    the rest is left to :func:`matches`. An alert without a facet has one key, which every
    signal has.
    """
    df = alerts.withColumn("__mask", F.lit(0))
    product = F.lit(1)
    for i, facet in enumerate(_FACETS):
        values = F.array_distinct(F.filter(F.coalesce(f"filters.{facet}", F.array().cast("array<string>")), lambda v: v.isNotNull()))
        full = F.coalesce(F.size(f"filters.{facet}"), F.lit(0)) > 0
        df = df.withColumn(f"__v{i}", values).withColumn(f"__p{i}", product * F.greatest(F.size(f"__v{i}"), F.lit(1)))
        used = full & (F.col(f"__p{i}") <= KEYS)
        df = df.withColumns({f"__p{i}": F.when(used, F.col(f"__p{i}")).otherwise(product), "__mask": F.col("__mask") + F.when(used, 1 << i).otherwise(0)})
        product = F.col(f"__p{i}")
    df = df.withColumn("__key", F.col("__mask").cast("string"))
    for i, _ in enumerate(_FACETS):
        used = F.col("__mask").bitwiseAND(1 << i) > 0
        # A facet of nulls alone is met by no signal.
        df = df.withColumn("__v", F.explode(F.when(used, F.col(f"__v{i}")).otherwise(F.array(F.lit("")))))
        df = df.withColumn("__key", F.when(used, F.concat("__key", F.lit("\x1f"), "__v")).otherwise(F.col("__key")))
    return df.drop("__v", *[f"__{k}{i}" for k in "vp" for i in range(len(_FACETS))])


def alert_matches(signals: DataFrame, alerts: DataFrame) -> DataFrame:
    """alert and signal columns (alert_id, signal_id, …) of each pair of an active alert and a signal that it matches.

    An alert meets a signal by an equi-join on the values of all its facets at once, so it
    doesn't meet signals of a common type in other places; its score is a condition of the
    join. A signal has a key for each set of facets that alerts have, 16 at most. Keys
    have SALTS salts too, so that one that many signals share is spread over tasks; a row
    of an alert is sent once for each salt. Signals are dealt by their ids before they get
    their keys: a join with few alerts reads what each task made of its part of the table,
    and recent signals may be in one part of it.
    """
    a = alert_keys(alerts.where("is_active").select(F.col("id").alias("alert_id"), F.col("name").alias("alert_name"), "channel", "channel_target", "filters"))
    s = spread(signals.select(F.col("id").alias("signal_id"), "firm_id", "signal_type", "title", "score", "locality", "asset_class", "occurred_at"), "signal_id")
    values = (F.col("firm_id").cast("string"), F.col("locality"), F.col("signal_type"), F.col("asset_class"))
    masks = sorted(r[0] for r in a.select("__mask").distinct().collect())  # 16 at most
    key = lambda mask: F.concat(F.lit(str(mask)), *[x for i, v in enumerate(values) if mask >> i & 1 for x in (F.lit("\x1f"), v)])
    keyed = s.withColumns({"__key": F.explode(F.array_compact(F.array(*map(key, masks or [0])))), "__salt": F.pmod(F.xxhash64("signal_id"), F.lit(SALTS)).cast("int")})
    each = a.drop("__mask").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"__key": "__k", "__salt": "__s"})
    met = each.join(keyed, (F.col("__k") == F.col("__key")) & (F.col("__s") == F.col("__salt")) & matches())
    return met.drop("__key", "__k", "__salt", "__s", "filters")


def recent(signals: DataFrame, now: Column, hours: int = LOOKBACK_HOURS) -> DataFrame:
    return signals.where(F.col("detected_at") >= F.timestamp_add("HOUR", F.lit(-hours), now))


def new_matches(matched: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Pairs without a delivery row, whatever its status: a failed one isn't tried again. Deliveries grow without bound and are never broadcast."""
    return matched.join(deliveries.select("alert_id", "signal_id").hint("merge"), ["alert_id", "signal_id"], "left_anti")


def pending_deliveries(fresh: DataFrame) -> DataFrame:
    """The rows written before anything is sent."""
    return fresh.select(row_id(F.col("alert_id"), F.col("signal_id")).alias("id"), "alert_id", "signal_id", "channel", F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("delivered_at"), F.lit(1).alias("attempts"))


def _listed(matched: DataFrame, most: int, line: Column) -> DataFrame:
    """Of each alert the first ``most`` lines, in order of time and id, and the number of signals."""
    order = Window.partitionBy("alert_id").orderBy(F.asc_nulls_first("occurred_at"), "signal_id")
    # The filter on row_number keeps the first few of each task before the shuffle; the count is a partial sum.
    first = matched.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    lines = first.groupBy("alert_id", "alert_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return lines.join(matched.groupBy("alert_id").agg(F.count("*").alias("n")), "alert_id")


def email_bodies(matched: DataFrame, product: str = "Plinth") -> DataFrame:
    """alert_id, n, body."""
    line = F.concat(F.lit("• ["), day_label(F.col("occurred_at")), F.lit("] "), "title", F.lit(" (score="), F.format_string("%.2f", "score"), F.lit(")"))
    more = F.when(F.col("n") > EMAIL_ROWS, F.concat(F.lit("\n… and "), (F.col("n") - EMAIL_ROWS).cast("string"), F.lit(" more."))).otherwise("")
    return _listed(matched, EMAIL_ROWS, line).select("alert_id", "n", F.concat(F.lit(f"{product} alert: "), "alert_name", F.lit("\n\n"), F.array_join("lines", "\n"), more).alias("body"))


def slack_texts(matched: DataFrame, product: str = "Plinth") -> DataFrame:
    """alert_id, n, body."""
    line = F.concat(F.lit("\n• ["), day_label(F.col("occurred_at")), F.lit("] "), "title")
    more = F.when(F.col("n") > SLACK_ROWS, F.concat(F.lit("\n_… and "), (F.col("n") - SLACK_ROWS).cast("string"), F.lit(" more_"))).otherwise("")
    return _listed(matched, SLACK_ROWS, line).select("alert_id", "n", F.concat(F.lit(f"*{product} — "), "alert_name", F.lit("*\n"), F.array_join("lines", ""), more).alias("body"))


class RecordingSink:
    """Keeps what would be sent, a file in shared storage for each message; the interface of other sinks: send(channel, target, body) -> whether it went."""

    def __init__(self, default_webhook: str | None = None, folder: str | None = None):
        self.default_webhook = default_webhook
        self.folder = folder or shared_dir(SparkSession.active(), "recorded")

    def send(self, channel: str, target: str | None, body: str) -> bool:
        if channel == "slack":
            target = target or self.default_webhook
            if not target or not target.startswith(WEBHOOK):
                return False
        elif channel != "email" or not target:
            return False
        store, root = outbox._folder(self.folder)
        store.create_dir(root)
        outbox._put(store, f"{root}/{uuid.uuid4().hex}", json.dumps([channel, target, body]))
        return True

    @property
    def sent(self) -> list[tuple[str, str, str]]:
        """What was kept, in no order: for tests and for looking at a small run."""
        from pyarrow import fs

        store, root = outbox._folder(self.folder)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [tuple(json.loads(outbox._get(store, f.path))) for f in found if not f.base_name.startswith(".")]


def deliver(signals: DataFrame, alerts: DataFrame, deliveries: DataFrame, now: Column, sink: Any, since_hours: int = LOOKBACK_HOURS, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Send what is new; returns the delivery rows with their outcome.

    ``keep`` stores the pending rows (a table) before anything is sent, so that no pair is
    sent twice. Messages, one for each alert, go out from the executors (``outbox``). New
    pairs are stored, as bodies, counts and outcomes are all made of them.
    """
    fresh = kept(new_matches(alert_matches(recent(signals, now, since_hours), alerts), deliveries), "new-matches")
    pending = keep(pending_deliveries(fresh))
    sure = fresh.join(pending.select("alert_id", "signal_id"), ["alert_id", "signal_id"], "left_semi")
    to = sure.groupBy("alert_id").agg(F.first("channel").alias("channel"), F.first("channel_target").alias("target"))
    bodies = email_bodies(sure).withColumn("kind", F.lit("email")).unionByName(slack_texts(sure).withColumn("kind", F.lit("slack")))
    messages = to.join(bodies, "alert_id").where("kind = channel OR (kind = 'email' AND channel NOT IN ('email', 'slack'))")
    told = outbox.sent(messages.withColumn("message_id", F.col("alert_id").cast("string")), sink)
    told = told.groupBy("message_id").agg(F.bool_or("ok").alias("ok"))
    return pending.join(told, F.col("alert_id").cast("string") == F.col("message_id"), "left").drop("message_id").withColumn("status", F.when(F.col("ok"), "sent").otherwise("failed")).withColumn("delivered_at", F.when(F.col("ok"), now)).drop("ok")


def fired(alerts: DataFrame, outcome: DataFrame, now: Column) -> DataFrame:
    """Alerts after a delivery: when they last fired and how often."""
    n = outcome.where("status = 'sent'").groupBy(F.col("alert_id").alias("id")).agg(F.count("*").alias("__n"))
    return alerts.join(n, "id", "left").withColumns({"last_fired_at": F.when(F.col("__n").isNotNull(), now).otherwise(F.col("last_fired_at")), "fire_count": F.col("fire_count") + F.coalesce("__n", F.lit(0))}).drop("__n")


def delivery_stats(alerts: DataFrame, matched: DataFrame, outcome: DataFrame) -> DataFrame:
    """alerts_checked, signals_matched, deliveries_sent, deliveries_skipped."""
    checked = alerts.where("is_active").agg(F.count("*").alias("alerts_checked"))
    sent = outcome.agg(F.count("*").alias("signals_matched"), F.count_if(F.col("status") == "sent").alias("deliveries_sent"))
    return checked.crossJoin(sent).crossJoin(matched.agg(F.count("*").alias("__all"))).withColumn("deliveries_skipped", F.col("__all") - F.col("signals_matched")).drop("__all")
