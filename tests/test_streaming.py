from datetime import datetime

from pyspark.sql import functions as F

from plinth.plans import catalogue, made
from plinth.streaming import signals as S

SF = "/root/testdata/sf0.001"


def brute_limits(rows, limit, seconds):
    state, out = {}, {}
    for uid, id_, at in sorted(rows, key=lambda r: (r[2], r[1])):
        start, n = state.get(uid, (None, 0))
        if start is None or at - start >= seconds:
            state[uid], out[id_] = (at, 1), True
        elif n >= limit:
            out[id_] = False
        else:
            state[uid], out[id_] = (start, n + 1), True
    return out


def test_rate_limit(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select((F.col("user_id") % 10).alias("u"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).collect()
    want = brute_limits([(r.u, r.event_id, r.t / 1e6) for r in rows], 2, 21600.0)
    got = {r.id: r.allowed for r in made.stream_rate_limit(spark, SF).collect()}
    assert got == want and len(set(want.values())) == 2


def test_rate_limit_of_a_key_with_many_requests(spark, tmp_path):
    """Far more requests of one key than a part of a batch holds, in any order."""
    import random

    rng = random.Random(1)
    rows = [("u", k, rng.randrange(200_000)) for k in range(25_000)]
    spark.createDataFrame(rows, "uid string, id long, at long").select("uid", "id", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("uid string, id long, ts timestamp").parquet(f"{tmp_path}/in")
    got = {r.id: r.allowed for r in S.finished(spark, S.rate_limited(stream, 3, 60.0)).collect()}
    assert got == brute_limits([(u, k, float(t)) for u, k, t in rows], 3, 60.0)


def test_alert_fan_out_resumes(spark, tmp_path):
    from plinth.plans import proxies as P

    sent = []
    signals = P.signal_columns(S.parquet_stream(spark, SF, "events.parquet"))
    run = lambda check: S.alert_fan_out(signals, catalogue._alerts(spark), f"{tmp_path}/ledger", f"{tmp_path}/{check}", F.lit("2024-02-01").cast("timestamp"), lambda df: sent.extend((r.alert_id, r.n) for r in df.collect())).awaitTermination()
    run("one")
    first = sorted(sent)
    want = catalogue.alert_matches(spark, SF).groupBy("alert_id").count().collect()
    assert first == sorted((r.alert_id, r["count"]) for r in want)
    run("two")  # the same signals once more, as after a lost checkpoint
    assert sorted(sent) == first


def test_snapshots_in_two_runs(spark, tmp_path):
    """The state outlives a run: people who come, go, come back and change titles; copies of a name; several snapshots in one batch."""
    kind = "firm_id string, place int, name string, title string, seen_at timestamp"
    shots = [
        [(1, [("Ann Lee", "VP"), ("Bob Ray", None), ("Ann Lee", "copy")])],
        [(2, [("Ann Lee", "CEO")]), (3, [("Ann Lee", "CEO"), ("Bob Ray", None), ("Cy Dow", None)])],
    ]
    for run in shots:
        rows = [("f", k, n, t, datetime(2026, day, 1)) for day, people in run for k, (n, t) in enumerate(people)]
        spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{tmp_path}/in")
        changes = S.snapshot_changes(S.roster_snapshots(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")))
        S.to_table(changes, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = sorted((r.seen_at.month, r.key, r.change, r.open_before, r.open_after) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [
        (1, "ann lee", "open", 0, 2), (1, "bob ray", "open", 0, 2), (2, "ann lee", "update", 2, 1), (2, "bob ray", "close", 2, 1), (3, "bob ray", "reopen", 1, 3), (3, "cy dow", "open", 1, 3),
    ]
    assert S.hiring_surges(spark.read.parquet(f"{tmp_path}/out")).count() == 0


def test_rate_limit_goes_on_in_a_second_run(spark, tmp_path):
    rows = [("u", k, k * 10) for k in range(12)]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, "uid string, id long, at long").select("uid", "id", F.timestamp_seconds("at").alias("ts")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("uid string, id long, ts timestamp").parquet(f"{tmp_path}/in")
        S.to_table(S.rate_limited(stream, 5, 60.0), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert {r.id: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()} == brute_limits([(u, k, float(t)) for u, k, t in rows], 5, 60.0)


def test_tumbling_has_no_undated_rows(spark, tmp_path):
    rows = [(1, datetime(2026, 1, 1), 0.5), (1, None, 0.5)]
    spark.createDataFrame(rows, "firm_id int, occurred_at timestamp, score double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("firm_id int, occurred_at timestamp, score double").parquet(f"{tmp_path}/in")
    got = S.finished(spark, S.tumbling(stream), S.to_snapshot).collect()
    assert [r.n for r in got] == [1]


def test_snapshot_state_is_read_and_written_in_one_call_each():
    from types import SimpleNamespace

    from pyspark.sql import Row

    calls, stored = [], []
    held = SimpleNamespace(get=lambda: calls.append("get") or iter(list(stored)), appendList=lambda new: calls.append("append") or stored.extend(new), put=lambda new: calls.append("put") or stored.__setitem__(slice(None), new))
    processor = S._Snapshots()
    processor.init(SimpleNamespace(getListState=lambda name, schema: held))
    for n in range(9):  # every other snapshot lacks half of the keys
        rows = (Row(key=f"k{k}", place=k, seen=n, payload="p") for k in range(500) if n % 2 == 0 or k % 2)
        got = list(processor.handleInputRows(("g",), rows, None))
        assert [r.change for r in got] == (["open"] * 500 if n == 0 else ["close"] * 250 if n % 2 else ["reopen"] * 250)
        assert calls.count("get") == n + 1 and len(calls) == 2 * (n + 1) and len(stored) <= 2 * 500 + S._SLACK
    assert "put" in calls
