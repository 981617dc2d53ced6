"""Trends: one current window and four before it for each firm, and signals derived from them.

Each fact table is read once: a row's window number follows from its date, so there is
no range join, and facts are aggregated by (firm, window) before they meet the spine of
firms and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import classify, dates
from plinth.operators.upsert import new_only, upsert
from plinth.schemas import row_id
from plinth.session import spread

# Thresholds.
DAYS, BASELINES, SURGE_RATIO, SURGE_JOBS, PIVOT_NOW, PIVOT_BEFORE, ANOMALY_Z = 90, 4, 1.5, 5, 0.30, 0.10, 2.0


def _in_scope(facts: DataFrame, firms: DataFrame) -> DataFrame:
    """Facts of active firms, in the firm's own county where it has one."""
    scope = firms.where("is_active").select(F.col("id").alias("firm_id"), "county")
    return facts.join(scope, "firm_id").where(F.col("county").isNull() | (F.col("locality") == F.col("county"))).drop("county")


def _numbered(facts: DataFrame, day: str, as_of: Column, days: int) -> DataFrame:
    return facts.withColumn("w", dates.window_number(F.col(day), as_of, days)).where(F.col("w").between(0, BASELINES))


def asset_class_mix(permits: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and asset_class_mix: each class's share of the permits that have a class, to three places."""
    by_class = permits.withColumn("c", classify.permit_asset_class(F.col("permit_type"))).where("c IS NOT NULL").groupBy(*keys, "c").agg(F.count("*").alias("n"))
    entry = F.struct("c", "n")
    return by_class.groupBy(*keys).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(entry)).alias("e")).select(
        *keys, F.map_from_entries(F.transform("e", lambda x: F.struct(x["c"], F.bround(x["n"] / F.col("total"), 3)))).alias("asset_class_mix")
    )


def open_jobs(jobs: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(firm_id, w, open_job_count): jobs seen by the window's end, the end itself included, and not closed by its start."""
    end = lambda w: F.timestamp_add("DAY", -w * days, as_of.cast("timestamp"))
    held = F.filter(F.sequence(F.lit(0), F.lit(BASELINES)), lambda w: (F.col("first_seen_at") <= end(w)) & (F.col("closed_at").isNull() | (F.col("closed_at") > end(w + 1))))
    return jobs.select("firm_id", F.explode(held).alias("w")).groupBy("firm_id", "w").agg(F.count("*").alias("open_job_count"))


def trend_windows(firms: DataFrame, permits: DataFrame, jobs: DataFrame, signals: DataFrame, projects: DataFrame, as_of: Column, days: int = DAYS) -> DataFrame:
    """firm_id, locality, w, period_start, period_end and the five measures, for w 0 (current) to 4, zeros filled in.

    ``as_of`` is a date: windows are [start, end) of whole UTC days before it. Permits and
    projects count in the firm's county only, jobs and signals everywhere.
    """
    counted = _numbered(_in_scope(permits, firms), "filed_date", as_of, days)
    none = F.lit(0).cast("long")
    measures = ("permit_count", "open_job_count", "news_mention_count", "new_project_count")
    value = F.lit(None).cast(counted.schema["valuation_usd"].dataType)
    tagged = lambda df, name, n=F.lit(1).cast("long"), v=value: df.select("firm_id", "w", *[(n if m == name else none).alias(m) for m in measures], v.alias("valuation_usd"))
    # The facts of all tables in one, so that firms and windows are met once.
    facts = tagged(counted, "permit_count", v=F.col("valuation_usd"))
    for df, name, n in (
        (open_jobs(jobs, as_of, days), "open_job_count", F.col("open_job_count")),
        (_numbered(signals.where("NOT is_derived"), "occurred_at", as_of, days), "news_mention_count", F.lit(1).cast("long")),
        (_numbered(_in_scope(projects, firms), "announced_date", as_of, days), "new_project_count", F.lit(1).cast("long")),
    ):
        facts = facts.unionByName(tagged(df, name, n))
    sums = facts.groupBy("firm_id", "w").agg(*[F.sum(m).alias(m) for m in measures], F.sum("valuation_usd").cast("double").alias("valuation_sum_usd"))
    spine = firms.where("is_active").select(F.col("id").alias("firm_id"), F.col("county").alias("locality"), F.explode(F.sequence(F.lit(0), F.lit(BASELINES))).alias("w"))
    out = spine.join(sums, ["firm_id", "w"], "left").join(asset_class_mix(counted, ["firm_id", "w"]), ["firm_id", "w"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    start = lambda k: F.date_sub(as_of, (F.col("w") + k) * days).cast("timestamp")
    return out.select(
        "firm_id", "locality", "w", start(1).alias("period_start"), start(0).alias("period_end"), zero("permit_count"), F.coalesce("valuation_sum_usd", F.lit(0.0)).alias("valuation_sum_usd"),
        zero("open_job_count"), zero("news_mention_count"), zero("new_project_count"), F.coalesce("asset_class_mix", F.create_map().cast("map<string,double>")).alias("asset_class_mix"),
    )


def _derived(kind: str, title: Column, summary: Column, score: Column, key: Column, payload: Column, start: Column, locality: Column | None = None) -> list[Column]:
    return [
        row_id(key).alias("id"), F.col("firm_id"), F.lit(kind).alias("signal_type"), title.alias("title"), summary.alias("summary"), score.cast("double").alias("score"),
        (F.lit(None).cast("string") if locality is None else locality).alias("locality"), start.alias("occurred_at"), payload.alias("payload"), F.lit(True).alias("is_derived"), key.alias("dedupe_key"),
    ]


def _named(rows: DataFrame, firms: DataFrame) -> DataFrame:
    return rows.join(firms.select(F.col("id").alias("firm_id"), F.col("name").alias("firm_name")), "firm_id")


def _text(c: Column) -> Column:
    return c.cast("string")


def hiring_surges(windows: DataFrame, firms: DataFrame) -> DataFrame:
    """Firms with at least five open jobs and half as many again as the mean of the windows before."""
    g = windows.groupBy("firm_id").agg(
        F.max(F.when(F.col("w") == 0, F.col("open_job_count"))).alias("current_jobs"),
        (F.sum(F.when(F.col("w") > 0, F.col("open_job_count"))) / BASELINES).alias("baseline_avg"),
        F.max(F.when(F.col("w") == 0, F.col("period_start"))).alias("start"),
    )
    hit = _named(g.where((F.col("current_jobs") >= SURGE_JOBS) & (F.col("baseline_avg") != 0) & (F.col("current_jobs") >= F.col("baseline_avg") * SURGE_RATIO)), firms)
    ratio = F.col("current_jobs") / F.greatest("baseline_avg", F.lit(1.0))
    key = dates.window_key(F.lit("hiring_surge"), _text(F.col("firm_id")), F.date_format("start", "yyyy-MM-dd"))
    return hit.select(
        *_derived(
            "hiring_surge", F.concat("firm_name", F.lit(" hiring surge")),
            F.concat("firm_name", F.lit(" has "), _text(F.col("current_jobs")), F.lit(" open roles — "), F.format_string("%.1f", ratio), F.lit("× the recent baseline.")),
            F.least(F.lit(0.95), 0.6 + (ratio - 1.5) * 0.1), key, F.to_json(F.struct("current_jobs", F.bround("baseline_avg", 1).alias("baseline_avg"))), F.col("start"),
        ),
        "current_jobs", "baseline_avg",
    )


def asset_class_pivots(windows: DataFrame, firms: DataFrame) -> DataFrame:
    """Firm and class where the class has .30 of the current window and had under .10 on average before; a missing class counts as 0."""
    shares = windows.select("firm_id", "w", "period_start", F.explode("asset_class_mix").alias("asset_class", "share"))
    g = shares.groupBy("firm_id", "asset_class").agg(
        F.max(F.when(F.col("w") == 0, F.col("share"))).alias("current_share"),
        (F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("share"))), F.lit(0.0)) / BASELINES).alias("baseline_share"),
        F.max(F.when(F.col("w") == 0, F.col("period_start"))).alias("start"),
    )
    # Shares have three places: comparing at ten keeps sums of binary fractions from deciding.
    hit = _named(g.where((F.round("current_share", 10) >= PIVOT_NOW) & (F.round("baseline_share", 10) < PIVOT_BEFORE)), firms)
    label = F.replace("asset_class", F.lit("_"), F.lit(" "))
    percent = lambda c: F.concat(F.bround(F.col(c) * 100, 0).cast("int").cast("string"), F.lit("%"))
    key = dates.window_key(F.lit("asset_class_pivot"), F.col("asset_class"), _text(F.col("firm_id")), F.date_format("start", "yyyy-MM-dd"))
    return hit.select(
        *_derived(
            "asset_class_pivot", F.concat("firm_name", F.lit(" pivoting to "), label),
            F.concat("firm_name", F.lit("'s recent permits are "), percent("current_share"), F.lit(" "), label, F.lit(" — up from "), percent("baseline_share"), F.lit(" historically.")),
            F.lit(0.75), key, F.to_json(F.struct("asset_class", "current_share", "baseline_share")), F.col("start"),
        ),
        "asset_class", "current_share", "baseline_share",
    )


def geographic_expansions(permits: DataFrame, firms: DataFrame, as_of: Column, days: int = DAYS) -> DataFrame:
    """Firm and locality with permits since the window's start and none before or without a date."""
    start = F.date_sub(as_of, days)
    active = firms.where("is_active").select(F.col("id").alias("firm_id"))
    # Most permits are a group of their own, so they are dealt over a given number of tasks, and only the pairs that are left meet the firms.
    facts = spread(permits.where("firm_id IS NOT NULL AND locality IS NOT NULL").select("firm_id", "locality", "filed_date"), "firm_id", "locality")
    g = facts.groupBy("firm_id", "locality").agg(
        F.max(F.coalesce(F.col("filed_date") >= start, F.lit(False))).alias("now"), F.max(F.coalesce(F.col("filed_date") < start, F.lit(True))).alias("before")
    )
    hit = _named(g.where("now AND NOT before").join(active, "firm_id", "left_semi"), firms)
    key = dates.window_key(F.lit("geographic_expansion"), F.col("locality"), _text(F.col("firm_id")), F.date_format(start, "yyyy-MM-dd"))
    return hit.select(
        *_derived(
            "geographic_expansion", F.concat("firm_name", F.lit(" expanding into "), "locality"), F.concat("firm_name", F.lit(" filed first permits in "), "locality", F.lit(" this quarter.")),
            F.lit(0.70), key, F.to_json(F.struct(F.col("locality").alias("new_locality"))), start.cast("timestamp"), F.col("locality"),
        )
    )


def permit_volume_anomalies(windows: DataFrame, firms: DataFrame) -> DataFrame:
    """Firms whose permits exceed the mean of the windows before by two sample deviations or more."""
    before = F.when(F.col("w") > 0, F.col("permit_count"))
    g = windows.groupBy("firm_id").agg(
        F.max(F.when(F.col("w") == 0, F.col("permit_count"))).alias("permit_count"), F.avg(before).alias("mean"), F.stddev_samp(before).alias("stdev"),
        F.max(F.when(F.col("w") == 0, F.col("period_start"))).alias("start"),
    )
    z = (F.col("permit_count") - F.col("mean")) / F.col("stdev")
    hit = _named(g.where(F.col("stdev") != 0).withColumn("zscore", z).where(F.round("zscore", 10) >= ANOMALY_Z), firms)
    key = dates.window_key(F.lit("permit_volume_anomaly"), _text(F.col("firm_id")), F.date_format("start", "yyyy-MM-dd"))
    return hit.select(
        *_derived(
            "permit_volume_anomaly", F.concat("firm_name", F.lit(" permit volume spike")),
            F.concat("firm_name", F.lit(" filed "), _text(F.col("permit_count")), F.lit(" permits this quarter — "), F.format_string("%.1f", "zscore"), F.lit("σ above baseline (avg "), F.format_string("%.0f", "mean"), F.lit(").")),
            F.least(F.lit(0.95), 0.65 + F.col("zscore") * 0.05), key,
            F.to_json(F.struct("permit_count", F.bround("mean", 1).alias("baseline_mean"), F.bround("stdev", 1).alias("baseline_stdev"), F.bround("zscore", 2).alias("zscore"))), F.col("start"),
        ),
        "permit_count", "mean", "stdev", "zscore",
    )


def run_trend_detection(firms: DataFrame, permits: DataFrame, jobs: DataFrame, signals: DataFrame, projects: DataFrame, as_of: Column, days: int = DAYS, old_windows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The trend windows and the derived signals that aren't there yet.

    With ``old_windows``, the windows are the merged table: an anomaly score that was set
    stays where this run finds none.
    """
    windows = trend_windows(firms, permits, jobs, signals, projects, as_of, days)
    anomalies = permit_volume_anomalies(windows, firms)
    common = ["id", "firm_id", "signal_type", "title", "summary", "score", "locality", "occurred_at", "payload", "is_derived", "dedupe_key"]
    found = [hiring_surges(windows, firms), asset_class_pivots(windows, firms), geographic_expansions(permits, firms, as_of, days), anomalies]
    rows = found[0].select(*common)
    for more in found[1:]:
        rows = rows.unionByName(more.select(*common))
    scores = anomalies.select("firm_id", F.lit(0).alias("w"), F.bround("zscore", 2).alias("anomaly_score"))
    windows = windows.join(scores, ["firm_id", "w"], "left")
    if old_windows is not None:
        windows = upsert(old_windows, windows.drop("w"), ["firm_id", "locality", "period_start"])
    return windows, new_only(rows, signals, ["dedupe_key"], ["id"])


def trend_stats(signals: DataFrame) -> DataFrame:
    """How many of each kind were found."""
    return signals.agg(
        F.count("*").alias("signals_emitted"),
        *[F.count_if(F.col("signal_type") == kind).alias(name) for kind, name in (("hiring_surge", "hiring_surges"), ("asset_class_pivot", "pivots"), ("geographic_expansion", "expansions"), ("permit_volume_anomaly", "anomalies"))],
    )
