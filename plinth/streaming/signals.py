"""Signals as streams: dedupe, windows, sessions, rate limits, alerts and snapshot diffs.

Batch and stream share the operators: what is here adds watermarks, state and sinks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from plinth.functions import naming
from plinth.operators import alerts as A
from plinth.operators import roster
from plinth.session import shared_dir, workers_find_package

LATENESS, RATE_WINDOW = "2 days", 60.0
# Requests a minute.
RATE_LIMITS = {"free": 20, "pro": 120, "enterprise": 1000, "anonymous": 10}


def parquet_stream(spark: SparkSession, folder: str, name: str, files_each: int = 1000) -> DataFrame:
    """The Parquet files called ``name`` in a folder, as a stream; its schema is read from them."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_each).parquet(folder)


def deduplicated(signals: DataFrame, late: str = LATENESS) -> DataFrame:
    """The first signal of each key: runs overlap, so the same signal comes again."""
    return signals.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["dedupe_key"])


def tumbling(signals: DataFrame, length: str = "90 days", late: str = LATENESS, start: str = "0 seconds") -> DataFrame:
    """Signals of each firm and window. Rows without a time are never late: they are left to the batch rule for prior activity."""
    w = F.window("occurred_at", length, startTime=start)
    return signals.where("occurred_at IS NOT NULL").withWatermark("occurred_at", late).groupBy(w, "firm_id").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def sliding(signals: DataFrame, length: str, step: str, late: str = LATENESS) -> DataFrame:
    return signals.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", length, step), "signal_type").agg(F.count("*").alias("n"))


def sessions(signals: DataFrame, gap: str, late: str = LATENESS) -> DataFrame:
    """Runs of a firm's signals without a pause as long as ``gap``."""
    return signals.withWatermark("occurred_at", late).groupBy(F.session_window("occurred_at", gap), "firm_id").agg(F.count("*").alias("n"))


#: State of single rows needs this store.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _row_state(df: DataFrame) -> None:
    """Let the session's next streams keep their state by row; ones that were started before keep theirs."""
    if df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _ROCKSDB:
        df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    workers_find_package(df.sparkSession)


class _Limited(StatefulProcessor):
    """A key's window: when it began, and how many requests it has let pass. A key that is idle for ``forget`` is forgotten."""

    def __init__(self, limit: int, seconds: float, forget: int | None):
        self.limit, self.seconds, self.forget = limit, seconds, forget

    def init(self, handle) -> None:
        self.window = handle.getValueState("window", "start double, n long", self.forget)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A batch's requests of one key come in several parts, in any order: put in order as a whole, 16 bytes each.
        rows = pd.concat([p[["at", "id"]] for p in rows], ignore_index=True).sort_values(["at", "id"], ignore_index=True)
        at, n, limit, seconds = rows["at"].to_numpy(), len(rows), self.limit, self.seconds
        start, used = self.window.get() if self.window.exists() else (None, 0)
        allowed, i = np.zeros(n, bool), 0
        while i < n:
            if start is None or at[i] - start >= seconds:
                start, used = float(at[i]), 0
            end = int(np.searchsorted(at, start + seconds))
            while end > i and at[end - 1] - start >= seconds:  # sums and differences round differently
                end -= 1
            while end < n and at[end] - start < seconds:
                end += 1
            allowed[i : min(end, i + max(0, limit - used))] = True
            used, i = min(limit, used + end - i), end
        self.window.update((float(start), int(used)))
        for k in range(0, n, 10_000):
            yield pd.DataFrame({"uid": key[0], "id": rows["id"][k : k + 10_000], "allowed": allowed[k : k + 10_000]})

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, limit: int, seconds: float = RATE_WINDOW, forget: str | None = None) -> DataFrame:
    """uid, id, allowed of each request (uid, id, ts): a window begins with the first request after the last one's end.

    A key's requests of one batch are put in the order of time and id, in memory: the
    source's trigger bounds them. One that comes in a later batch than a later request
    counts when it comes. A key's state is one row. With ``forget``, which must be longer
    than a window, it goes when the key has made no request for so much processing time;
    such a stream never comes to an end, so it isn't for a trigger that takes what is there now.
    """
    _row_state(requests)
    rows = requests.select(F.col("uid").cast("string"), F.col("id").cast("long"), (F.unix_micros("ts") / 1e6).alias("at"))
    processor = _Limited(limit, seconds, int(pd.Timedelta(forget).total_seconds() * 1000) if forget else None)
    return rows.groupBy("uid").transformWithStateInPandas(processor, "uid string, id long, allowed boolean", "Append", "ProcessingTime" if forget else "None")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet files, exactly once, all that is there now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_snapshot(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Overwrite a table with an aggregate's whole result after each batch."""
    return stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(spark: SparkSession, stream: DataFrame, sink: Callable = to_table) -> DataFrame:
    """What a stream gives for all that is there now, through a sink in shared storage."""
    base = shared_dir(spark, "stream")
    sink(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "alert_id long, signal_id long")


def alert_fan_out(signals: DataFrame, alerts: DataFrame, ledger: str, checkpoint: str, now: Column, send: Callable[[DataFrame], None]) -> StreamingQuery:
    """Match each batch of a signal stream; pairs go to the ledger before ``send`` gets them, so none is sent twice."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fresh = A.new_matches(A.alert_matches(df, alerts), _ledger(spark, ledger))
        A.pending_deliveries(fresh).withColumn("batch", F.lit(number)).write.mode("append").parquet(ledger)
        send(A.email_bodies(fresh.join(spark.read.parquet(ledger).where(F.col("batch") == number).select("alert_id", "signal_id"), ["alert_id", "signal_id"], "left_semi")))

    return signals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A group's state is written anew when it has this many rows more than twice its keys.
_SLACK = 64


class _Snapshots(StatefulProcessor):
    """What a group's last snapshot had: a list of changes, of which the last of each key counts, for each key that was ever in one."""

    def init(self, handle) -> None:
        self.held = handle.getListState("held", "key string, payload string, is_open boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # The list is read and written in one call each, not one for each key.
        known, held = 0, {}
        for k, payload, is_open in self.held.get():
            known, held[k] = known + 1, (payload, is_open)
        shots: dict[int, dict[str, tuple]] = {}
        for r in rows:  # of each snapshot and key the first by its place
            shot, at = shots.setdefault(r.seen, {}), (r.place is None, r.place or 0)
            if r.key not in shot or at < shot[r.key][0]:
                shot[r.key] = (at, r.payload)
        written = []
        for seen in sorted(shots):
            now = {k: payload for k, (_, payload) in sorted(shots[seen].items(), key=lambda e: e[1][0])}
            before = sum(is_open for _, is_open in held.values())
            changes = []
            for k, payload in now.items():
                was = held.get(k)
                change = "open" if was is None else "reopen" if not was[1] else "update" if was[0] != payload else None
                if change:
                    changes.append((k, change, payload, True))
            changes += [(k, "close", payload, False) for k, (payload, is_open) in held.items() if is_open and k not in now]
            for k, change, payload, is_open in changes:  # only rows that change are written
                held[k] = (payload, is_open)
                written.append((k, payload, is_open))
                yield Row(group=key[0], seen=seen, key=k, change=change, payload=payload, open_before=before, open_after=len(now))
        if known + len(written) > 2 * len(held) + _SLACK:
            self.held.put([(k, payload, is_open) for k, (payload, is_open) in held.items()])
        elif written:
            self.held.appendList(written)

    def close(self) -> None:
        pass


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """group, seen_at, key, change, payload, open_before, open_after: what is new, back, different or gone in each snapshot of a group.

    ``rows``: group, key, place, seen_at, payload (text), a row for each thing that a
    group's page shows. Rows of one group and seen_at are a snapshot, of which the first
    of each key counts; a group without rows has none, so nothing of it is closed. A
    snapshot must not be cut by a batch; several in one batch are taken in order. State is
    a list of rows for each group, to which those that change are added; it is cut to a row for each key
    when it has grown to over twice as many.
    """
    _row_state(rows)
    given = rows.select(F.col("group").cast("string").alias("group"), F.col("key").cast("string").alias("key"), F.col("place").cast("long").alias("place"), F.unix_micros("seen_at").alias("seen"), F.col("payload").cast("string").alias("payload"))
    kind = "`group` string, seen long, key string, change string, payload string, open_before long, open_after long"
    out = given.where("key IS NOT NULL AND seen IS NOT NULL").groupBy("group").transformWithState(_Snapshots(), kind, "Append", "None")
    return out.select("group", F.timestamp_micros("seen").alias("seen_at"), "key", "change", "payload", "open_before", "open_after")


def job_snapshots(listings: DataFrame) -> DataFrame:
    """Rows of careers pages (firm_id, place, title, location, seen_at) as snapshot_changes takes them: postings are the same if title and location are, but for case."""
    key = F.concat_ws("\x1f", F.lower("title"), F.lower(F.coalesce("location", F.lit(""))))
    return listings.select(F.col("firm_id").alias("group"), key.alias("key"), "place", "seen_at", F.to_json(F.struct("title", "location")).alias("payload"))


def roster_snapshots(members: DataFrame) -> DataFrame:
    """Rows of team pages (firm_id, place, name, title, seen_at): people are the same if their names are; another title is an update."""
    return members.select(F.col("firm_id").alias("group"), naming.normalize_person(F.col("name")).alias("key"), "place", "seen_at", F.to_json(F.struct("name", "title")).alias("payload")).where("key <> ''")


def hiring_surges(changes: DataFrame) -> DataFrame:
    """firm_id, seen_at, open_before, open_after of snapshots with a surge of open roles (the rule of ``roster.job_diff``); a snapshot that changes nothing is none."""
    b, a = F.col("open_before"), F.col("open_after")
    surge = (a >= roster.SURGE_OPEN) & ((b == 0) | (a >= b * roster.SURGE_RATIO))
    return changes.where(surge).groupBy(F.col("group").alias("firm_id"), "seen_at").agg(F.first("open_before").alias("open_before"), F.first("open_after").alias("open_after"))
