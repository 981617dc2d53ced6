"""The registered queries of the domain's operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import classify, dates, fuzzy, naming, vectors
from plinth.functions import text as T
from plinth.operators import alerts, digest, documents, permits, query, resolve, retrieve, roster, trends, upsert
from plinth.plans import proxies as P
from plinth.sources import html
from plinth.session import table
from plinth.streaming import signals as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None, tables: str = ""):
    """Register a query under its function's name; ``tables`` are the domain's tables that ``sql`` reads."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = P.with_sql(tables, sql) if tables else sql
        return f

    return put


_AS_OF = f"DATE '{P.AS_OF_PERMITS}'"
_NOW = f"TIMESTAMP '{P.AS_OF_EVENTS} 00:00:00'"


def _day(text: str):
    return F.lit(text).cast("date")


# Lists, timelines, feeds -----------------------------------------------------------------------


@_query("SELECT id, name, county, firm_type FROM firms WHERE is_active AND name ILIKE '%00001%' AND firm_type = 'BUILDING' ORDER BY name, id LIMIT 10 OFFSET 0", "firms")
def firm_list_page(spark, d):
    return query.list_firms(P.firms(spark, d), q="00001", firm_type="BUILDING", page=1, size=10).rows.drop("is_active")


@_query("SELECT id, name, county, firm_type FROM firms WHERE id = 42", "firms")
def firm_point_lookup(spark, d):
    return query.get_row(P.firms(spark, d), 42).drop("is_active")


@_query("SELECT id, signal_type, occurred_at FROM signals WHERE firm_id = 8 AND signal_type IN ('key_hire', 'departure') ORDER BY occurred_at DESC NULLS LAST, id LIMIT 20 OFFSET 20", "signals")
def firm_timeline_page(spark, d):
    return query.firm_timeline(P.signals(spark, d), 8, ("key_hire", "departure"), page=2, size=20).rows.select("id", "signal_type", "occurred_at")


@_query("SELECT id, firm_id, signal_type, score FROM signals WHERE locality = 'L3' AND asset_class = 'office' AND score >= 0.5 AND NOT is_derived ORDER BY occurred_at DESC NULLS LAST, id LIMIT 50", "signals")
def signal_feed_filtered(spark, d):
    return query.list_signals(P.signals(spark, d), locality="L3", asset_class="office", min_score=0.5, is_derived=False).rows.select("id", "firm_id", "signal_type", "score")


@_query("SELECT count(*) AS total FROM signals WHERE score >= 0.25", "signals")
def signal_feed_total(spark, d):
    return query.list_signals(P.signals(spark, d), min_score=0.25).total


_COLLECTED = "SELECT firm_id AS id, list_sort(list(DISTINCT permit_type)) AS asset_classes, list_sort(list(DISTINCT locality)) AS localities FROM filings GROUP BY firm_id"


@_query(f", f AS ({_COLLECTED}) SELECT id, len(asset_classes) AS n_classes, len(localities) AS n_localities FROM f WHERE list_has_any(asset_classes, ['Office Interior', 'Retail Sign']) AND list_has_any(localities, ['NATION_3'])", "filings")
def facet_overlap_search(spark, d):
    f = P.filings(spark, d).groupBy(F.col("firm_id").alias("id")).agg(F.array_sort(F.collect_set("permit_type")).alias("asset_classes"), F.array_sort(F.collect_set("locality")).alias("localities")).withColumn("is_active", F.lit(True))
    hit = f.where(retrieve.facets(("Office Interior", "Retail Sign"), ("NATION_3",)))
    return hit.select("id", F.size("asset_classes").cast("long").alias("n_classes"), F.size("localities").cast("long").alias("n_localities"))


@_query(
    "SELECT table_name, n FROM (SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'customer', count(*) FROM customer)"
)
def table_counts(spark, d):
    return query.table_counts({n: table(spark, d, n) for n in ("orders", "events", "documents", "customer")})


_SOURCES = "SELECT user_id AS id, CAST(count(*) FILTER (event_type = 'error') AS INT) AS consecutive_failures, max(ts) AS last_crawled_at, CAST(user_id % 96 AS INT) AS cadence_hours, CASE WHEN user_id % 5 = 0 THEN false WHEN user_id % 5 = 1 THEN true END AS robots_allowed, user_id % 4 <> 0 AS is_active FROM events GROUP BY user_id"


def _sources(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    g = e.groupBy(F.col("user_id").alias("id")).agg(F.count_if(F.col("event_type") == "error").cast("int").alias("consecutive_failures"), F.max(F.col("ts").cast("timestamp")).alias("last_crawled_at"))
    return g.withColumns({"cadence_hours": (F.col("id") % 96).cast("int"), "robots_allowed": F.when(F.col("id") % 5 == 0, False).when(F.col("id") % 5 == 1, True), "is_active": F.col("id") % 4 != 0})


@_query(f"WITH s AS ({_SOURCES}) SELECT id, consecutive_failures FROM s WHERE consecutive_failures > 0 ORDER BY consecutive_failures DESC, id LIMIT 10")
def failing_sources_top10(spark, d):
    return query.failing_sources(_sources(spark, d)).select("id", "consecutive_failures")


@_query(f"WITH s AS ({_SOURCES}) SELECT id FROM s WHERE is_active AND robots_allowed IS DISTINCT FROM false AND (last_crawled_at IS NULL OR epoch_us({_NOW}) - epoch_us(last_crawled_at) >= cadence_hours * 3600000000::BIGINT)")
def due_sources(spark, d):
    return documents.due_sources(_sources(spark, d), F.lit(f"{P.AS_OF_EVENTS} 00:00:00").cast("timestamp")).select("id")


@_query(f"SELECT id FROM (SELECT user_id AS id, CASE WHEN user_id % 3 = 0 THEN max(ts) END AS revoked_at, CASE WHEN user_id % 2 = 0 THEN max(ts) + INTERVAL 12 HOUR END AS expires_at FROM events GROUP BY user_id) WHERE revoked_at IS NULL AND (expires_at IS NULL OR expires_at > {_NOW})")
def valid_keys(spark, d):
    last = F.max(F.col("ts").cast("timestamp"))
    keys = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(last.alias("last"))
    keys = keys.select("id", F.when(F.col("id") % 3 == 0, F.col("last")).alias("revoked_at"), F.when(F.col("id") % 2 == 0, F.timestamp_add("HOUR", F.lit(12), F.col("last"))).alias("expires_at"))
    return keys.where(query.key_is_valid(F.lit(f"{P.AS_OF_EVENTS} 00:00:00").cast("timestamp"))).select("id")


# Permits, trends -------------------------------------------------------------------------------


@_query("SELECT locality, permit_type, count(*) AS n, round(sum(valuation_usd), 2) AS valuation, CAST(grouping(locality, permit_type) AS INT) AS which FROM permits GROUP BY ROLLUP (locality, permit_type)", "permits")
def permit_type_rollup(spark, d):
    return query.pivot_rollup(P.permits(spark, d), "locality", "permit_type").withColumn("valuation", F.round("valuation", 2))


@_query("SELECT status, permit_type, count(*) AS n, round(sum(valuation_usd), 2) AS valuation, CAST(grouping(status, permit_type) AS INT) AS which FROM permits GROUP BY CUBE (status, permit_type)", "permits")
def permit_cube(spark, d):
    return query.pivot_rollup(P.permits(spark, d), "status", "permit_type", how="cube").withColumn("valuation", F.round("valuation", 2))


_W = f"CAST(floor((date_diff('day', filed_date, {_AS_OF}) - 1) / 90) AS INT)"
_EVENT_W = f"CAST(floor((date_diff('day', CAST(occurred_at AS DATE), DATE '{P.AS_OF_EVENTS}') - 1) / {P.EVENT_DAYS}) AS INT)"
_JOB_ENDS = f"({_NOW} - to_days(w * {P.EVENT_DAYS}))", f"({_NOW} - to_days((w + 1) * {P.EVENT_DAYS}))"


@_query(
    f""", p AS (SELECT firm_id, {_W} AS w, count(*) AS n, sum(valuation_usd) AS v FROM permits GROUP BY ALL)
SELECT f.id AS firm_id, f.county AS locality, w.w, CAST({_AS_OF} - CAST((w.w + 1) * 90 AS INT) AS TIMESTAMP) AS period_start, CAST(coalesce(p.n, 0) AS INT) AS permit_count, round(coalesce(p.v, 0.0), 2) AS valuation_sum_usd
FROM firms f, (SELECT CAST(range AS INT) AS w FROM range(5)) w LEFT JOIN p ON p.firm_id = f.id AND p.w = w.w""",
    "firms permits",
)
def trend_windows(spark, d):
    rows = trends.trend_windows(P.firms(spark, d), P.permits(spark, d), P.jobs(spark, d), P.signals(spark, d), P.no_projects(spark), _day(P.AS_OF_PERMITS))
    return rows.select("firm_id", "locality", "w", "period_start", "permit_count", F.round("valuation_sum_usd", 2).alias("valuation_sum_usd"))


@_query(
    f""", j AS (SELECT firm_id, w, count(*) AS n FROM jobs, (SELECT CAST(range AS INT) AS w FROM range(5)) WHERE first_seen_at <= {_JOB_ENDS[0]} AND (closed_at IS NULL OR closed_at > {_JOB_ENDS[1]}) GROUP BY ALL),
s AS (SELECT firm_id, {_EVENT_W} AS w, count(*) AS n FROM signals WHERE NOT is_derived GROUP BY ALL)
SELECT f.id AS firm_id, w.w, CAST(coalesce(j.n, 0) AS INT) AS open_job_count, CAST(coalesce(s.n, 0) AS INT) AS news_mention_count
FROM firms f, (SELECT CAST(range AS INT) AS w FROM range(5)) w LEFT JOIN j ON j.firm_id = f.id AND j.w = w.w LEFT JOIN s ON s.firm_id = f.id AND s.w = w.w""",
    "firms jobs signals",
)
def trend_windows_events(spark, d):
    rows = trends.trend_windows(P.firms(spark, d), P.permits(spark, d), P.jobs(spark, d), P.signals(spark, d), P.no_projects(spark), _day(P.AS_OF_EVENTS), P.EVENT_DAYS)
    return rows.select("firm_id", "w", "open_job_count", "news_mention_count")


_CLASS = "CASE " + " ".join(f"WHEN contains(lower(permit_type), '{w}') THEN '{c}'" for w, c in classify.PERMIT_CLASS_WORDS) + " END"
_MIX = f"c AS (SELECT firm_id, {_W} AS w, {_CLASS} AS asset_class, count(*) AS n FROM filings GROUP BY ALL), m AS (SELECT firm_id, w, asset_class, round_even(n / sum(n) OVER (PARTITION BY firm_id, w), 3) AS share FROM c WHERE asset_class IS NOT NULL AND w BETWEEN 0 AND 4)"


@_query(f", {_MIX} SELECT firm_id, w, asset_class, round(share, 3) AS share FROM m", "filings")
def asset_class_mix(spark, d):
    rows = P.filings(spark, d).withColumn("w", dates.window_number(F.col("filed_date"), _day(P.AS_OF_PERMITS), 90)).where("w BETWEEN 0 AND 4")
    return trends.asset_class_mix(rows, ["firm_id", "w"]).select("firm_id", "w", F.explode("asset_class_mix").alias("asset_class", "share")).withColumn("share", F.round("share", 3))


def _event_windows(spark, d) -> DataFrame:
    none = P.permits(spark, d).limit(0)
    return trends.trend_windows(P.firms(spark, d), none, P.jobs(spark, d), P.signals(spark, d).limit(0), P.no_projects(spark), _day(P.AS_OF_EVENTS), P.EVENT_DAYS)


_KEY = "left(sha256(concat_ws(':', {})), 40)"


@_query(
    f""", j AS (SELECT firm_id, w, count(*) AS n FROM jobs, (SELECT CAST(range AS INT) AS w FROM range(5)) WHERE first_seen_at <= {_JOB_ENDS[0]} AND (closed_at IS NULL OR closed_at > {_JOB_ENDS[1]}) GROUP BY ALL),
g AS (SELECT f.id AS firm_id, coalesce(max(n) FILTER (w = 0), 0) AS cur, coalesce(sum(n) FILTER (w > 0), 0) / 4.0 AS avg FROM firms f LEFT JOIN j ON j.firm_id = f.id GROUP BY f.id)
SELECT firm_id, CAST(cur AS INT) AS current_jobs, CAST(avg AS DOUBLE) AS baseline_avg, round(CAST(least(0.95, 0.6 + (cur / greatest(avg, 1) - 1.5) * 0.1) AS DOUBLE), 6) AS score, {_KEY.format(f"'hiring_surge', firm_id, CAST(DATE '{P.AS_OF_EVENTS}' - {P.EVENT_DAYS} AS VARCHAR)")} AS dedupe_key
FROM g WHERE cur >= 5 AND avg <> 0 AND cur >= 1.5 * avg""",
    "firms jobs",
)
def hiring_surge(spark, d):
    return trends.hiring_surges(_event_windows(spark, d), P.firms(spark, d)).select("firm_id", "current_jobs", "baseline_avg", F.round("score", 6).alias("score"), "dedupe_key")


def _filing_windows(spark, d) -> DataFrame:
    f = P.firms(spark, d).withColumn("county", F.lit(None).cast("string"))
    return trends.trend_windows(f, P.filings(spark, d), P.jobs(spark, d).limit(0), P.signals(spark, d).limit(0), P.no_projects(spark), _day(P.AS_OF_PERMITS))


@_query(
    f""", {_MIX}, g AS (SELECT firm_id, asset_class, max(share) FILTER (w = 0) AS cur, coalesce(sum(share) FILTER (w > 0), 0) / 4 AS base FROM m GROUP BY ALL)
SELECT firm_id, asset_class, round(cur, 3) AS current_share, round(base, 6) AS baseline_share, {_KEY.format(f"'asset_class_pivot', asset_class, firm_id, CAST({_AS_OF} - 90 AS VARCHAR)")} AS dedupe_key FROM g WHERE round(cur, 10) >= 0.3 AND round(base, 10) < 0.1""",
    "filings",
)
def asset_class_pivot(spark, d):
    return trends.asset_class_pivots(_filing_windows(spark, d), P.firms(spark, d)).select("firm_id", "asset_class", F.round("current_share", 3).alias("current_share"), F.round("baseline_share", 6).alias("baseline_share"), "dedupe_key")


@_query(
    f""", g AS (SELECT firm_id, locality, bool_or(filed_date >= {_AS_OF} - 90) AS now, bool_or(filed_date < {_AS_OF} - 90 OR filed_date IS NULL) AS before FROM filings GROUP BY ALL)
SELECT firm_id, locality, concat(name, ' expanding into ', locality) AS title, {_KEY.format(f"'geographic_expansion', locality, firm_id, CAST({_AS_OF} - 90 AS VARCHAR)")} AS dedupe_key FROM g JOIN firms ON id = firm_id WHERE now AND NOT before""",
    "firms filings",
)
def geographic_expansion(spark, d):
    return trends.geographic_expansions(P.filings(spark, d), P.firms(spark, d), _day(P.AS_OF_PERMITS)).select("firm_id", "locality", "title", "dedupe_key")


@_query(
    f""", p AS (SELECT firm_id, {_W} AS w, count(*) AS n FROM permits GROUP BY ALL),
s AS (SELECT f.id, w.w, coalesce(n, 0) AS n FROM firms f, (SELECT CAST(range AS INT) AS w FROM range(5)) w LEFT JOIN p ON p.firm_id = f.id AND p.w = w.w),
g AS (SELECT id, max(n) FILTER (w = 0) AS cur, avg(n) FILTER (w > 0) AS mean, stddev_samp(n) FILTER (w > 0) AS sd FROM s GROUP BY id)
SELECT id AS firm_id, CAST(cur AS INT) AS permit_count, mean, round(sd, 6) AS stdev, round((cur - mean) / sd, 6) AS zscore, round(least(0.95, 0.65 + (cur - mean) / sd * 0.05), 6) AS score, {_KEY.format(f"'permit_volume_anomaly', id, CAST({_AS_OF} - 90 AS VARCHAR)")} AS dedupe_key
FROM g WHERE sd <> 0 AND round((cur - mean) / sd, 10) >= 2""",
    "firms permits",
)
def permit_volume_anomaly(spark, d):
    w = trends.trend_windows(P.firms(spark, d), P.permits(spark, d), P.jobs(spark, d).limit(0), P.signals(spark, d).limit(0), P.no_projects(spark), _day(P.AS_OF_PERMITS))
    r = trends.permit_volume_anomalies(w, P.firms(spark, d))
    return r.select("firm_id", "permit_count", "mean", *[F.round(c, 6).alias(c) for c in ("stdev", "zscore", "score")], "dedupe_key")


_SCORE = "round_even(least(1.0, CASE WHEN valuation_usd >= 50000000 THEN 0.95 WHEN valuation_usd >= 10000000 THEN 0.85 WHEN valuation_usd >= 5000000 THEN 0.7 WHEN valuation_usd >= 1000000 THEN 0.55 ELSE 0.35 END + CASE WHEN contains(lower({t}), 'commercial') OR contains(lower({t}), 'site plan') OR contains(lower({t}), 'rezoning') OR contains(lower({t}), 'data center') THEN 0.1 ELSE 0 END), 2)"


def _as_records(p: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return p.withColumns({"applicant_name_raw": none, "address": none, "parcel_id": none})


@_query(f"SELECT concat('permit:', locality, ':', permit_number) AS dedupe_key, firm_id, CAST({_SCORE.format(t='permit_type')} AS DOUBLE) AS score, CAST(issued_date AS TIMESTAMP) AS occurred_at FROM permits WHERE valuation_usd >= 1000000", "permits")
def permit_signals(spark, d):
    return permits.permit_signals(_as_records(P.permits(spark, d)), F.lit("2024-01-01").cast("timestamp")).select("dedupe_key", "firm_id", "score", "occurred_at")


@_query(f"SELECT permit_type, score, count(*) AS n FROM (SELECT permit_type, CAST({_SCORE.format(t='permit_type')} AS DOUBLE) AS score FROM (SELECT permit_type, valuation_usd * 600 AS valuation_usd FROM filings)) GROUP BY ALL", "filings")
def permit_score_tiers(spark, d):
    return P.filings(spark, d).select("permit_type", classify.permit_score(F.col("valuation_usd") * 600, F.col("permit_type")).alias("score")).groupBy("permit_type", "score").agg(F.count("*").alias("n"))


_ALL_PARCELS = "SELECT permit_number, locality, CASE WHEN permit_number % 3 = 0 THEN permit_number % 120 END AS parcel_id FROM permits"


@_query(f", p AS ({_ALL_PARCELS}) SELECT permit_number, parcel_id, s_name AS owner_name FROM p LEFT JOIN supplier ON s_suppkey = parcel_id", "permits")
def parcel_owner_enrich_all(spark, d):
    """All permits, most of them without a parcel."""
    k = F.col("permit_number")
    p = P.permits(spark, d).select("permit_number", F.when(k % 3 == 0, k % 120).alias("parcel_id"))
    owners = table(spark, d, "supplier").select(F.col("s_suppkey").alias("parcel_id"), F.col("s_name").alias("owner_name"))
    return permits.with_parcel_owners(p, owners).select("permit_number", "parcel_id", "owner_name")


_OLD_NEW = "o AS (SELECT locality, permit_number, firm_id, status, valuation_usd FROM permits WHERE filed_date < DATE '1998-07-01'), n AS (SELECT locality, permit_number, CASE WHEN permit_number % 2 = 0 THEN firm_id + 1 END AS firm_id, CASE WHEN permit_number % 5 <> 0 THEN 'X' END AS status, CASE WHEN permit_number % 7 <> 0 THEN valuation_usd * 2 END AS valuation_usd FROM permits WHERE filed_date >= DATE '1998-01-01')"


def _old_new(spark, d) -> tuple[DataFrame, DataFrame]:
    p, k = P.permits(spark, d), F.col("permit_number")
    old = p.where("filed_date < DATE '1998-07-01'").select("locality", "permit_number", "firm_id", "status", "valuation_usd")
    new = p.where("filed_date >= DATE '1998-01-01'").select("locality", "permit_number", F.when(k % 2 == 0, F.col("firm_id") + 1).alias("firm_id"), F.when(k % 5 != 0, "X").alias("status"), F.when(k % 7 != 0, F.col("valuation_usd") * 2).alias("valuation_usd"))
    return old, new


@_query(
    f""", {_OLD_NEW} SELECT coalesce(o.locality, n.locality) AS locality, coalesce(o.permit_number, n.permit_number) AS permit_number, coalesce(n.firm_id, o.firm_id) AS firm_id,
CASE WHEN n.permit_number IS NOT NULL THEN n.status ELSE o.status END AS status, round(coalesce(n.valuation_usd, o.valuation_usd), 2) AS valuation_usd,
CASE WHEN o.permit_number IS NULL THEN 'insert' WHEN n.permit_number IS NULL THEN 'keep' ELSE 'update' END AS change FROM o FULL JOIN n ON o.locality = n.locality AND o.permit_number = n.permit_number""",
    "permits",
)
def upsert_permits(spark, d):
    old, new = _old_new(spark, d)
    return upsert.upsert(old, new, ["locality", "permit_number"], overwrite=["status"]).withColumn("valuation_usd", F.round("valuation_usd", 2)).withColumnRenamed("__change", "change")


@_query(", o AS (SELECT dedupe_key FROM signals WHERE occurred_at < TIMESTAMP '2024-01-15'), n AS (SELECT dedupe_key, min(id) AS id FROM signals WHERE occurred_at >= TIMESTAMP '2024-01-14' GROUP BY dedupe_key) SELECT n.dedupe_key, n.id FROM n ANTI JOIN o USING (dedupe_key)", "signals")
def insert_if_absent(spark, d):
    s = P.signals(spark, d).select("dedupe_key", "id", "occurred_at")
    cut = lambda day: F.lit(day).cast("timestamp")
    return upsert.new_only(s.where(F.col("occurred_at") >= cut("2024-01-14")).drop("occurred_at"), s.where(F.col("occurred_at") < cut("2024-01-15")), ["dedupe_key"], ["id"])


@_query("SELECT firm_id, count(*) AS n_parcels FROM (SELECT DISTINCT firm_id, locality FROM filings) GROUP BY firm_id", "filings")
def firm_parcel_sets(spark, d):
    p = P.filings(spark, d).groupBy("firm_id").agg(F.collect_set("locality").alias("parcels"))
    return p.select("firm_id", F.size("parcels").cast("long").alias("n_parcels"))


@_query("SELECT DISTINCT firm_id, locality FROM filings WHERE filed_date >= DATE '1999-01-01' EXCEPT SELECT DISTINCT firm_id, locality FROM filings WHERE filed_date < DATE '1999-01-01'", "filings")
def locality_set_difference(spark, d):
    f = P.filings(spark, d).select("firm_id", "locality", "filed_date")
    return f.where("filed_date >= DATE '1999-01-01'").select("firm_id", "locality").subtract(f.where("filed_date < DATE '1999-01-01'").select("firm_id", "locality"))


# Names, scores ---------------------------------------------------------------------------------

#: Names that exercise the rules, made from keys: (suffix, by which remainder).
_ENDINGS = (", Inc.", " Holding Companies, LLC", " & Partners L.P.", " Phase III LLC", " Société", " Group of Virginia Corp", " Trust", "")
_NAME_SQL = "concat('Firm ', p_name, ' ', p_brand, [" + ", ".join("'" + e.replace("'", "''") + "'" for e in _ENDINGS) + "][p_partkey % 8 + 1])"


def _names(spark, d) -> DataFrame:
    ending = F.array(*[F.lit(e) for e in _ENDINGS])[(F.col("p_partkey") % 8).cast("int")]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Firm "), "p_name", F.lit(" "), "p_brand", ending).alias("name"))


_BASIC = r"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({x})), '&', ' and '), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_CANON = f"""b AS (SELECT id, name, {_BASIC.format(x="name")} AS basic FROM t),
k AS (SELECT id, name, basic, list_filter(string_split(trim(regexp_replace(regexp_replace(basic, '{naming.PHASE}', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS tokens FROM b),
s AS (SELECT *, list_filter(tokens, lambda w: NOT list_contains({_LIST(naming.ENTITY_SUFFIXES)}, w)) AS named0 FROM k),
s2 AS (SELECT *, CASE WHEN len(named0) > 0 THEN named0 ELSE tokens[1:1] END AS named FROM s),
r AS (SELECT *, list_filter(named, lambda w: NOT regexp_matches(w, '{naming.ROMAN}')) AS kept0 FROM s2),
canon AS (SELECT id, name, CASE WHEN len(tokens) = 0 THEN basic ELSE array_to_string(CASE WHEN len(kept0) > 0 THEN kept0 ELSE named END, ' ') END AS canonical FROM r)"""
_T = f"WITH t AS (SELECT p_partkey AS id, {_NAME_SQL} AS name FROM part), "


@_query(f"{_T}{_CANON} SELECT id, canonical FROM canon")
def canonical_names(spark, d):
    return _names(spark, d).select("id", naming.canonicalize(F.col("name")).alias("canonical"))


@_query(f"{_T}{_CANON}, w AS (SELECT id, list_distinct(string_split(canonical, ' ')) AS a FROM canon), x AS (SELECT id, a, list_filter(a, lambda v: NOT list_contains({_LIST(naming.DESCRIPTOR_WORDS)}, v)) AS f FROM w) SELECT id, array_to_string(list_sort(CASE WHEN len(f) > 0 THEN f ELSE a END), ' ') AS tokens FROM x")
def distinct_tokens(spark, d):
    return _names(spark, d).select("id", F.array_join(F.array_sort(naming.distinctive_tokens(F.col("name"))), " ").alias("tokens"))


@_query("WITH t AS (SELECT c_custkey AS id, concat('+1 (703) ', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '-', CASE WHEN c_custkey % 4 = 0 THEN '01' ELSE '0100' END) AS phone FROM customer), n AS (SELECT id, regexp_replace(phone, '[^0-9]', '', 'g') AS x FROM t), m AS (SELECT id, CASE WHEN length(x) = 11 AND x[1] = '1' THEN x[2:] ELSE x END AS x FROM n) SELECT id, CASE WHEN length(x) = 10 THEN x END AS phone FROM m")
def phone_norm(spark, d):
    k = F.col("c_custkey")
    phone = F.concat(F.lit("+1 (703) "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-"), F.when(k % 4 == 0, "01").otherwise("0100"))
    return table(spark, d, "customer").select(k.alias("id"), naming.normalize_phone(phone).alias("phone"))


_STREETS = ("Reston Boulevard, Suite", "NORTH Main Street #", "Old Mill Road & Pike", "Sunset Hills Pkwy;")


@_query(
    f"WITH t AS (SELECT c_custkey AS id, concat(c_custkey, ' ', {_LIST(_STREETS)}[c_custkey % 4 + 1], ' ', c_nationkey) AS name FROM customer), b AS (SELECT id, string_split({_BASIC.format(x='name')}, ' ') AS w FROM t) SELECT id, array_to_string(list_transform(w, lambda v: coalesce(map_extract_value(MAP {{{', '.join(f'{chr(39)}{a}{chr(39)}: {chr(39)}{b}{chr(39)}' for a, b in naming.STREET_WORDS.items())}}}, v), v)), ' ') AS address FROM b"
)
def address_norm(spark, d):
    k = F.col("c_custkey")
    street = F.array(*[F.lit(s) for s in _STREETS])[(k % 4).cast("int")]
    text = F.concat(k.cast("string"), F.lit(" "), street, F.lit(" "), F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select(k.alias("id"), naming.normalize_address(text).alias("address"))


@_query(f"{_T} b AS (SELECT id, replace({_BASIC.format(x='name')}, ' ', '-') AS x FROM t) SELECT id, left(trim(regexp_replace(x, '-+', '-', 'g'), '-'), 160) AS slug FROM b")
def slug(spark, d):
    return _names(spark, d).select("id", naming.slugify(F.col("name")).alias("slug"))


_PEOPLE = ("Dr. ", "Mrs. ", "", "Prof "), (" Jr., MBA", ", CCIM", " III", " Ph.D.", "")


@_query(
    f"WITH t AS (SELECT s_suppkey AS id, concat({_LIST(_PEOPLE[0])}[s_suppkey % 4 + 1], 'Robert ', replace(s_name, '#', ' '), {_LIST(_PEOPLE[1])}[s_suppkey % 5 + 1]) AS name FROM supplier), b AS (SELECT id, array_to_string(list_filter(string_split({_BASIC.format(x='name')}, ' '), lambda w: NOT list_contains({_LIST(naming.HONORIFICS)}, w)), ' ') AS x FROM t) SELECT id, trim(regexp_replace(x, '(?:(?:^| )(?:{'|'.join(naming.CREDENTIALS)}))+$', '')) AS person FROM b"
)
def person_norm(spark, d):
    k = F.col("s_suppkey")
    pick = lambda values, n: F.array(*[F.lit(v) for v in values])[(k % n).cast("int")]
    name = F.concat(pick(_PEOPLE[0], 4), F.lit("Robert "), F.replace("s_name", F.lit("#"), F.lit(" ")), pick(_PEOPLE[1], 5))
    return table(spark, d, "supplier").select(k.alias("id"), naming.normalize_person(name).alias("person"))


def _resolver_firms(spark, d) -> DataFrame:
    f = table(spark, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).agg(F.min("p_partkey").alias("id"))
    none = F.lit(None).cast("string")
    return f.select("id", "name", naming.canonicalize(F.col("name")).alias("canonical_name"), F.array(F.concat(F.lit("alt "), "name")).alias("aliases"), none.alias("address"), none.alias("phone"), F.array().cast("array<string>").alias("parcel_ids"))


def _mentions(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_name", "p_brand", F.lit("LLC"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Alt "), F.upper("p_name"), F.lit(" "), "p_brand", F.lit(", Inc."))).otherwise(F.concat_ws(" ", "p_name", F.lit("nowhere")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("mention_id"), text.alias("text"), none.alias("address"), none.alias("phone"), none.alias("parcel_id"))


@_query(
    f"""WITH t AS (SELECT min(p_partkey) AS id, concat_ws(' ', p_name, p_brand) AS name FROM part GROUP BY 2), {_CANON},
ex AS (SELECT canonical, min(id) AS exact_id FROM canon GROUP BY 1),
m AS (SELECT p_partkey AS mention_id, CASE p_partkey % 3 WHEN 0 THEN concat_ws(' ', p_name, p_brand) WHEN 1 THEN concat('alt ', p_name, ' ', p_brand) ELSE concat(p_name, ' nowhere') END AS x FROM part),
mc AS (SELECT mention_id, {_BASIC.format(x="x")} AS canonical FROM m),
al AS (SELECT concat('alt ', canonical) AS canonical, min(id) AS alias_id FROM canon GROUP BY 1)
SELECT mention_id, exact_id, alias_id FROM mc LEFT JOIN ex USING (canonical) LEFT JOIN al USING (canonical)"""
)
def resolve_exact_alias(spark, d):
    m = _mentions(spark, d).withColumn("canonical", naming.canonicalize(F.col("text")))
    return resolve.exact_and_alias(m, _resolver_firms(spark, d)).select("mention_id", "exact_id", "alias_id")


_ONE = ["bar", "cor", "dun", "fal", "gar", "hol", "kes", "lom", "mar", "nor"]
_TWO = ["bury", "dale", "field", "ford", "gate", "ham", "ley", "more", "ridge", "stone", "ton", "vale", "well", "wick", "wood", "worth", "by", "shaw", "den", "combe"]


def _place(n):
    """One of 200 names of places."""
    pick = lambda words, k: F.get(F.array(*[F.lit(w) for w in words]), k.cast("int"))
    return F.initcap(F.concat(pick(_ONE, n % 10), pick(_TWO, F.floor(n % 200 / 10))))


def resolver_case(spark, d) -> tuple[DataFrame, DataFrame]:
    """Mentions and firms: every word of a name is shared by many firms; some mentions are misspelt, cut short or come with a phone, an address or a parcel."""
    k = F.col("c_custkey")
    q = F.floor(k / 200)
    one, two = _place(k % 200), _place((k * 7 + q) % 200)
    phone, street = F.concat(F.lit("703"), F.lpad((k % 10_000_000).cast("string"), 7, "0")), F.concat(k.cast("string"), F.lit(" Main Street"))
    name = F.concat_ws(" ", one, two, F.lit("Development LLC"))
    none = F.lit(None).cast("string")
    f = table(spark, d, "customer").select(k.alias("id"), name.alias("name"), naming.canonicalize(name).alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), street.alias("address"), phone.alias("phone"), F.array(F.concat(F.lit("lot "), k.cast("string"))).alias("parcel_ids"))
    typo = F.concat_ws(" ", one, F.concat(F.left(two, F.length(two) - 2), F.right(two, F.lit(1))), F.lit("Dev. Inc."))
    kind = k % 8
    text = F.when(kind == 0, F.concat_ws(" ", F.upper(one), two, F.lit("Development, L.L.C."))).when(kind == 1, one).when(kind == 2, F.concat_ws(" ", two, one, F.lit("Partners"))).when(kind == 6, F.concat_ws(" ", one, F.concat(two, F.lit("e")), F.lit("Development LLC"))).when(kind == 7, F.concat_ws(" ", one, F.lit("Nowhere"))).otherwise(typo)
    m = table(spark, d, "customer").select(k.alias("mention_id"), text.alias("text"), F.when(kind == 4, street).alias("address"), F.when(kind == 3, phone).alias("phone"), F.when(kind == 5, F.concat(F.lit("lot "), k.cast("string"))).otherwise(none).alias("parcel_id"))
    return m, f


@_query()
def resolve_full(spark, d):
    """Whole names; compared with brute force in the tests."""
    m, f = resolver_case(spark, d)
    return resolve.with_alias_memory(resolve.resolve(m, f)).select("mention_id", "status", "firm_id", "method", F.round("confidence", 6).alias("confidence"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3)))))"


@_query(f"WITH g AS (SELECT p_partkey AS id, p_name AS name, {_GRAMS.format(x='p_name')} AS a, {_GRAMS.format(x=chr(39) + 'red wigdet' + chr(39))} AS b FROM part), s AS (SELECT id, name, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM g) SELECT id, name, round(similarity, 6) AS similarity FROM s WHERE similarity > 0.1 ORDER BY s.similarity DESC, id LIMIT 25")
def trigram_search(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(True).alias("is_active"))
    return retrieve.search_trigram(f, "red wigdet", limit=25).select("id", "name", F.round("similarity", 6).alias("similarity"))


@_query()
def token_ratios(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    pairs = names.withColumn("other", F.lit("red widget of the small bolt"))
    return pairs.select("p_name", F.round(fuzzy.token_sort_column(F.col("p_name"), F.col("other")), 6).alias("sort_ratio"), F.round(fuzzy.token_set_column(F.col("p_name"), F.col("other")), 6).alias("set_ratio"))


# Classification --------------------------------------------------------------------------------

_TITLES = ("Chief Development Officer", "Leasing Associate", "Acquisitions Analyst", "Construction Superintendent", "Developer Relations", "Gardener", "VP, Head of Brokerage")
_SENIOR = " OR ".join(f"contains(x, '{m}')" for m in classify.SENIOR_MARKERS)


@_query(
    f"SELECT id, CASE WHEN {_SENIOR} THEN 'executive' WHEN contains(x, 'broker') OR contains(x, 'leasing') THEN 'broker' WHEN contains(x, 'acquisition') THEN 'acquisitions' WHEN contains(x, 'construction') OR contains(x, 'superintendent') THEN 'construction' WHEN contains(x, 'develop') THEN 'developer' ELSE 'other' END AS role, {_SENIOR} AS senior FROM (SELECT p_partkey AS id, lower({_LIST(_TITLES)}[p_size % 7 + 1]) AS x FROM part)"
)
def role_classification(spark, d):
    title = F.array(*[F.lit(t) for t in _TITLES])[F.col("p_size") % 7]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.role(title).alias("role"), classify.is_senior(title).alias("senior"))


@_query("SELECT p_partkey AS id, CASE WHEN v >= 100000000 OR u >= 500 OR s >= 500000 THEN 0.9 WHEN v >= 25000000 OR u >= 200 OR s >= 150000 THEN 0.75 WHEN v >= 5000000 OR u >= 50 OR s >= 25000 THEN 0.6 ELSE 0.45 END::DOUBLE AS score FROM (SELECT p_partkey, p_retailprice * 20000 AS v, p_size * 12 AS u, p_size * p_size * 220 AS s FROM part)")
def project_score(spark, d):
    z = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.project_score(F.col("p_retailprice") * 20000, z * 12, z * z * 220).alias("score"))


_HEADLINES = ("Comstock acquires land in Reston", "A JV for Ashburn", "Joint Venture breaks ground", "Firm buys site", "New tower proposed")


@_query(
    f"SELECT id, CASE WHEN contains(h, 'acquire') OR contains(h, 'acquisition') OR contains(h, 'buys') OR contains(h, 'purchased') THEN 'land_acquisition' WHEN contains(h, 'joint venture') OR contains(h, ' jv ') THEN 'joint_venture' ELSE 'new_project' END AS signal_type, nullif(regexp_extract(x, '\\b({'|'.join(classify.LOCALITIES)})\\b', 1), '') AS locality FROM (SELECT p_partkey AS id, {_LIST(_HEADLINES)}[p_size % 5 + 1] AS x, lower(x) AS h FROM part)"
)
def signal_type_from_headline(spark, d):
    h = F.array(*[F.lit(t) for t in _HEADLINES])[F.col("p_size") % 5]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.headline_signal(h).alias("signal_type"), classify.locality(h).alias("locality"))


_FIGURES = "concat('The $', p_size, '.5 million project has ', p_size * 7, ' units, ', p_size, ',000 square feet and ', p_size, '.25 acres for ', p_name)"


@_query(f"WITH t AS (SELECT p_partkey AS id, {_FIGURES} AS x FROM part) SELECT id, CAST(regexp_extract(x, '\\$\\s?([\\d,]+(?:\\.\\d+)?)', 1) AS DOUBLE) * 1000000 AS money, CAST(regexp_extract(x, '([\\d,]+) units', 1) AS INT) AS units, CAST(replace(regexp_extract(x, '([\\d,]+) square feet', 1), ',', '') AS INT) AS sqft, CAST(regexp_extract(x, '([\\d.]+) acres', 1) AS DOUBLE) AS acres FROM t")
def money_units_sqft(spark, d):
    z = F.col("p_size").cast("string")
    x = F.concat(F.lit("The $"), z, F.lit(".5 million project has "), (F.col("p_size") * 7).cast("string"), F.lit(" units, "), z, F.lit(",000 square feet and "), z, F.lit(".25 acres for "), F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.parse_money(x).alias("money"), classify.units(x).alias("units"), classify.square_feet(x).alias("sqft"), classify.acres(x).alias("acres"))


@_query(
    "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS from_millis, CASE event_id % 3 WHEN 2 THEN NULL ELSE CAST(ts AS DATE) END AS from_iso FROM events"
)
def epoch_iso_dates(spark, d):
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    millis = F.when(k % 4 == 0, F.lit("0")).otherwise(F.unix_millis(ts).cast("string"))
    iso = F.when(k % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(k % 3 == 1, F.date_format(ts, "MM/dd/yyyy")).otherwise(F.lit("soon"))
    return table(spark, d, "events").select(k.alias("id"), dates.epoch_millis_to_date(millis).alias("from_millis"), dates.iso_date(iso).alias("from_iso"))


# Documents, retrieval --------------------------------------------------------------------------

_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@_query(f"SELECT sha256({_STRIP}) AS content_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def content_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


_CHALLENGE = " OR ".join(f"contains(x, '{m}')" for m in T.CHALLENGE_MARKERS)
_BODY = f"CASE WHEN doc_id % 50 = 7 THEN concat('Verify you are human. ', {_STRIP}) ELSE {_STRIP} END"


def _bodies(spark, d) -> DataFrame:
    text = T.strip(F.col("text"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("Verify you are human. "), text)).otherwise(text).alias("cleaned_text"))


@_query(
    f"""WITH t AS (SELECT doc_id, {_BODY} AS body FROM documents), g AS (SELECT doc_id, body, lower(left(body, 2000)) AS x, sha256(body) AS h FROM t),
o AS (SELECT doc_id, h, body, CASE WHEN length(body) < 200 THEN 'too_short' WHEN {_CHALLENGE} THEN 'bot_challenge' END AS gate FROM g)
SELECT doc_id AS id, h AS content_hash, CAST(len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) AS INT) AS word_count, coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY h, gate IS NULL ORDER BY doc_id) = 1 THEN 'stored' ELSE 'duplicate' END) AS outcome FROM o"""
)
def persist_outcome(spark, d):
    none = spark.createDataFrame([], "content_hash string")
    return documents.persist_outcomes(_bodies(spark, d), none, ["id"]).select("id", "content_hash", "word_count", "outcome")


@_query("SELECT doc_id AS id, CAST(len(w) AS INT) AS n_words, CAST(greatest(1, floor(len(w) * 1.3)) AS INT) AS tokens FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)")
def word_counts(spark, d):
    n = T.word_count(F.col("text"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), n.alias("n_words"), T.rough_tokens(n).alias("tokens"))


@_query(f"SELECT id, {_CHALLENGE} AS challenge FROM (SELECT doc_id AS id, lower(left({_BODY}, 2000)) AS x FROM documents)")
def bot_challenge_flags(spark, d):
    return _bodies(spark, d).select("id", T.looks_like_challenge(F.col("cleaned_text")).alias("challenge"))


@_query(
    f"""WITH t AS (SELECT doc_id, {_BODY} AS body FROM documents), g AS (SELECT doc_id, body, lower(left(body, 2000)) AS x, sha256(body) AS h FROM t), s AS (SELECT doc_id, source FROM documents),
o AS (SELECT doc_id, h, CASE WHEN length(body) < 200 THEN 'too_short' WHEN {_CHALLENGE} THEN 'bot_challenge' END AS gate FROM g),
u AS (SELECT doc_id, coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY h, gate IS NULL ORDER BY doc_id) = 1 THEN 'stored' ELSE 'duplicate' END) AS outcome FROM o)
SELECT source, count(*) FILTER (outcome = 'stored') AS stored, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome NOT IN ('stored', 'duplicate', 'failed')) AS skipped FROM u JOIN s USING (doc_id) GROUP BY source"""
)
def crawl_batch_stats(spark, d):
    none = spark.createDataFrame([], "content_hash string")
    return documents.batch_stats(documents.persist_outcomes(_bodies(spark, d), none, ["id"]), "source")




@_query(
    "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) <= 346 THEN 1 ELSE 1 + CAST(ceil((len(w) - 346) / 308) AS BIGINT) END)) AS k FROM t WHERE len(w) > 0) SELECT doc_id, CAST(k AS INT) AS chunk_index, CAST(NULL AS INT) AS page_number, sha256(array_to_string(w[k * 308 + 1 : k * 308 + 346], ' ')) AS text_hash, CAST(greatest(1, floor(least(346, len(w) - k * 308) * 1.3)) AS INT) AS token_count FROM c"
)
def chunk_documents(spark, d):
    r = documents.chunk_text(table(spark, d, "documents"), "doc_id", "text")
    return r.select("doc_id", "chunk_index", "page_number", F.sha2("text", 256).alias("text_hash"), "token_count")




_PAGED_WHOLE = "concat('lost ', '<!-- page:', doc_id % 9 + 1, ' -->', left(text, length(text) // 2), '\n<!-- page:40 -->  <!--  page:41-->', substr(text, length(text) // 2 + 1))"


@_query(
    f"""WITH t AS (SELECT doc_id, {_PAGED_WHOLE} AS x FROM documents),
p AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(x, '<!--\\s*page:(\\d+)\\s*-->', 1), regexp_split_to_array(x, '<!--\\s*page:\\d+\\s*-->')[2:])) AS z, generate_subscripts(regexp_extract_all(x, '<!--\\s*page:(\\d+)\\s*-->', 1), 1) AS s FROM t),
w AS (SELECT doc_id, s, CAST(z[1] AS INT) AS page, list_filter(regexp_split_to_array(z[2], '\\s+'), lambda v: v <> '') AS w FROM p),
c AS (SELECT doc_id, s, page, w, unnest(range(CASE WHEN len(w) <= 346 THEN 1 ELSE 1 + CAST(ceil((len(w) - 346) / 308) AS BIGINT) END)) AS k FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, k) - 1 AS INT) AS chunk_index, page AS page_number, sha256(array_to_string(w[k * 308 + 1 : k * 308 + 346], ' ')) AS text_hash FROM c"""
)
def page_split_chunks_whole(spark, d):
    """The whole text of every document, a half on each side of an empty page."""
    half = F.floor(F.length("text") / 2).cast("int")
    body = F.concat(F.lit("lost "), F.lit("<!-- page:"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" -->"), F.left("text", half), F.lit("\n<!-- page:40 -->  <!--  page:41-->"), F.substring("text", half + 1, F.length("text")))
    docs = table(spark, d, "documents").select("doc_id", body.alias("text"))
    return documents.chunk_text(docs, "doc_id", "text").select("doc_id", "chunk_index", "page_number", F.sha2("text", 256).alias("text_hash"))


_VECTOR = [round(((i * 37) % 64 - 31.5) / 100, 4) for i in range(64)]
_DIST = "1 - list_sum(list_transform(list_zip(e, q), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(e, lambda z: z * z)) * list_sum(list_transform(q, lambda z: z * z)))"
_VECS = f"WITH v AS (SELECT vec_id AS id, label AS firm_id, CAST(embedding AS DOUBLE[]) AS e, CAST({_VECTOR} AS DOUBLE[]) AS q FROM embeddings), r AS (SELECT id, firm_id, {_DIST} AS distance FROM v)"


@_query(f"{_VECS} SELECT id, round(distance, 6) AS distance FROM r WHERE distance <= 0.95 ORDER BY r.distance, id LIMIT 8")
def vector_topk(spark, d):
    return retrieve.top_chunks(P.chunks(spark, d), _VECTOR, least=0.05).select("id", F.round("distance", 6).alias("distance"))


@_query(f"{_VECS} SELECT id, round(distance, 6) AS distance FROM r WHERE distance <= 1.5 AND firm_id = 3 ORDER BY r.distance, id LIMIT 5")
def vector_topk_firm(spark, d):
    return retrieve.top_chunks(P.chunks(spark, d), _VECTOR, firm_id=3, k=5, least=-0.5).select("id", F.round("distance", 6).alias("distance"))


@_query(
    f"""{_VECS}, k AS (SELECT id, distance FROM r WHERE distance <= 1.5 ORDER BY r.distance, id LIMIT 20), t AS (SELECT k.id, k.distance, text FROM k JOIN documents ON doc_id = k.id),
b AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY distance, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, row_number() OVER (ORDER BY distance, id) AS rank FROM t)
SELECT CAST(rank AS INT) AS rank, concat('d/', id) AS url, length(text) AS n_chars FROM b WHERE used < 12000"""
)
def context_budget(spark, d):
    found = retrieve.top_chunks(P.chunks(spark, d), _VECTOR, k=20, least=-0.5).select("id", "distance").withColumn("document_id", F.col("id"))
    docs = table(spark, d, "documents")
    url = F.concat(F.lit("d/"), F.col("doc_id").cast("string"))
    rows = retrieve.with_sources(found, docs.select(F.col("doc_id").alias("id"), url.alias("url"), url.alias("final_url"))).join(docs.select(F.col("doc_id").alias("id"), "text"), "id").withColumn("page_number", F.lit(None).cast("int"))
    return retrieve.context(rows).select("rank", "url", F.length(F.regexp_replace("passage", r"^\[Source: [^\n]*\n", "")).alias("n_chars")).withColumn("n_chars", F.col("n_chars").cast("long"))


# Alerts, digest, rosters ------------------------------------------------------------------------

#: (id, name, firms, types, localities, classes, least score): a subscription of each kind.
_ALERTS = [
    (1, "hires of two firms", ["8", "46"], ["key_hire"], [], [], 0.0),
    (2, "land", [], ["land_acquisition"], [], [], 0.4),
    (3, "offices in L3", [], [], ["L3"], ["office"], 0.1),
    (4, "the best", [], [], [], [], 0.9),
]
_ALERT_WHERE = "(a = 1 AND firm_id IN (8, 46) AND signal_type = 'key_hire' OR a = 2 AND signal_type = 'land_acquisition' AND score >= 0.4 OR a = 3 AND locality = 'L3' AND asset_class = 'office' AND score >= 0.1 OR a = 4 AND score >= 0.9)"


def _alerts(spark) -> DataFrame:
    rows = [(i, n, (f, t, lo, c, m), "email", "x@example.org", True) for i, n, f, t, lo, c, m in _ALERTS]
    return spark.createDataFrame(rows, "id long, name string, filters struct<firm_ids array<string>, signal_types array<string>, localities array<string>, asset_classes array<string>, min_score double>, channel string, channel_target string, is_active boolean")


@_query(f"SELECT a AS alert_id, id AS signal_id FROM signals, (SELECT range AS a FROM range(1, 5)) WHERE {_ALERT_WHERE}", "signals")
def alert_matches(spark, d):
    return alerts.alert_matches(P.signals(spark, d), _alerts(spark)).select("alert_id", "signal_id")


@_query(f"SELECT a AS alert_id, id AS signal_id FROM signals, (SELECT range AS a FROM range(1, 5)) WHERE {_ALERT_WHERE} AND id % 2 = 1", "signals")
def alert_new_matches(spark, d):
    m = alerts.alert_matches(P.signals(spark, d), _alerts(spark))
    sent = P.signals(spark, d).where("id % 2 = 0").select(F.explode(F.array(*[F.lit(a).cast("long") for a in (1, 2, 3, 4)])).alias("alert_id"), F.col("id").alias("signal_id"))
    return alerts.new_matches(m, sent).select("alert_id", "signal_id")


@_query(
    f""", m AS (SELECT a, ['hires of two firms', 'land', 'offices in L3', 'the best'][a] AS name, id, title, score, occurred_at FROM signals, (SELECT range AS a FROM range(1, 5)) WHERE {_ALERT_WHERE}),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY occurred_at NULLS FIRST, id) AS k FROM m)
SELECT a AS alert_id, count(*) AS n, concat('Plinth alert: ', any_value(name), chr(10), chr(10), string_agg(concat('• [', strftime(occurred_at, '%b %-d'), '] ', title, ' (score=', printf('%.2f', score), ')'), chr(10) ORDER BY k) FILTER (k <= 10), CASE WHEN count(*) > 10 THEN concat(chr(10), '… and ', count(*) - 10, ' more.') ELSE '' END) AS body FROM r GROUP BY a""",
    "signals",
)
def alert_email_top10(spark, d):
    return alerts.email_bodies(alerts.alert_matches(P.signals(spark, d), _alerts(spark)))


_WEEK = "occurred_at >= TIMESTAMP '2024-01-15' AND occurred_at <= TIMESTAMP '2024-01-22' AND score >= 0.5"


@_query(
    f""", r AS (SELECT *, signal_type = 'hiring_surge' AS lead FROM signals WHERE {_WEEK}), k AS (SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY lead DESC, score DESC, id) AS rank FROM r)
SELECT firm_id, name AS firm_name, max(score) AS max_score, count(*) AS n_signals, string_agg(concat('- ', CASE WHEN lead THEN '★' ELSE '·' END, ' [', strftime(occurred_at, '%b %-d'), '] ', title), chr(10) ORDER BY rank) FILTER (rank <= 10) AS narrative FROM k JOIN firms f ON f.id = firm_id GROUP BY firm_id, name""",
    "signals firms",
)
def digest_sections(spark, d):
    return digest.sections(P.signals(spark, d), P.firms(spark, d), F.lit("2024-01-18 09:00:00").cast("timestamp")).drop("signal_ids")


@_query(f", r AS (SELECT firm_id FROM signals JOIN firms f ON f.id = firm_id WHERE {_WEEK}) SELECT DATE '2024-01-15' AS period_start, DATE '2024-01-22' AS period_end, 'Plinth Weekly — January 15–January 22, 2024' AS title, CAST(count(*) AS INT) AS signal_count, CAST(count(DISTINCT firm_id) AS INT) AS firm_count FROM r", "signals firms")
def digest_week(spark, d):
    return digest.digest(P.signals(spark, d), P.firms(spark, d), F.lit("2024-01-18 09:00:00").cast("timestamp")).select("period_start", "period_end", "title", "signal_count", "firm_count")


_ROSTERS = "o AS (SELECT DISTINCT user_id AS firm_id, concat('person ', event_id % 60) AS canonical_name FROM events WHERE ts < TIMESTAMP '2024-01-16'), n AS (SELECT DISTINCT user_id AS firm_id, concat('person ', event_id % 60) AS canonical_name FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND user_id % 10 <> 0)"


@_query(
    f"""WITH {_ROSTERS}, j AS (SELECT coalesce(o.firm_id, n.firm_id) AS firm_id, coalesce(o.canonical_name, n.canonical_name) AS canonical_name, o.firm_id IS NOT NULL AS was, n.firm_id IS NOT NULL AS comes FROM o FULL JOIN n ON o.firm_id = n.firm_id AND o.canonical_name = n.canonical_name)
SELECT firm_id, canonical_name, CASE WHEN comes AND was THEN 'update' WHEN comes THEN 'hire' WHEN firm_id IN (SELECT firm_id FROM n) THEN 'departure' ELSE 'keep' END AS change, comes OR firm_id NOT IN (SELECT firm_id FROM n) AS is_current FROM j"""
)
def roster_diff(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("firm_id"), F.concat(F.lit("Person "), (F.col("event_id") % 60).cast("string")).alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("place"))
    cut, none = F.lit("2024-01-16").cast("timestamp"), F.lit(None).cast("string")
    old = e.where(F.col("ts") < cut).select("firm_id", "name").distinct().select(F.concat_ws("/", F.col("firm_id").cast("string"), "name").alias("id"), "firm_id", "name", naming.normalize_person(F.col("name")).alias("canonical_name"), none.alias("title"), F.lit("other").alias("role_type"), none.alias("email"), none.alias("linkedin_url"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("is_current"), cut.alias("first_seen_at"), cut.alias("last_seen_at"))
    new = e.where((F.col("ts") >= cut) & (F.col("firm_id") % 10 != 0)).select("firm_id", "place", "name", none.alias("title"), none.alias("email"), none.alias("linkedin_url"))
    known = spark.createDataFrame([], "dedupe_key string")
    return roster.roster_diff(old, new, known, F.lit("2024-01-31").cast("timestamp")).state.select("firm_id", "canonical_name", F.col("__change").alias("change"), "is_current")


@_query(
    """WITH o AS (SELECT DISTINCT user_id AS firm_id, concat('Analyst ', event_id % 40) AS title, event_id % 40 % 3 <> 0 AS is_open FROM events WHERE ts < TIMESTAMP '2024-01-16'),
n AS (SELECT DISTINCT user_id AS firm_id, concat('Analyst ', event_id % 40) AS title FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND user_id % 10 <> 0),
j AS (SELECT coalesce(o.firm_id, n.firm_id) AS firm_id, coalesce(o.title, n.title) AS title, o.is_open, o.firm_id IS NOT NULL AS was, n.firm_id IS NOT NULL AS comes FROM o FULL JOIN n ON o.firm_id = n.firm_id AND o.title = n.title)
SELECT firm_id, title, CASE WHEN firm_id NOT IN (SELECT firm_id FROM n) THEN 'keep' WHEN comes AND NOT was THEN 'open' WHEN comes AND NOT is_open THEN 'reopen' WHEN comes THEN 'update' WHEN is_open THEN 'close' ELSE 'keep' END AS change,
CASE WHEN firm_id NOT IN (SELECT firm_id FROM n) THEN is_open ELSE comes END AS is_open FROM j"""
)
def job_diff(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("firm_id"), F.concat(F.lit("Analyst "), (F.col("event_id") % 40).cast("string")).alias("title"), (F.col("event_id") % 40 % 3 != 0).alias("is_open"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("place"))
    cut, none = F.lit("2024-01-16").cast("timestamp"), F.lit(None).cast("string")
    old = e.where(F.col("ts") < cut).select("firm_id", "title", "is_open").distinct().select(F.concat_ws("/", F.col("firm_id").cast("string"), "title").alias("id"), "firm_id", "title", none.alias("location"), "is_open", cut.alias("first_seen_at"), cut.alias("last_seen_at"), F.lit(None).cast("timestamp").alias("closed_at"))
    new = e.where((F.col("ts") >= cut) & (F.col("firm_id") % 10 != 0)).select("firm_id", "place", "title", none.alias("location"))
    known = spark.createDataFrame([], "dedupe_key string")
    return roster.job_diff(old, new, known, F.lit("2024-01-31").cast("timestamp")).state.select("firm_id", "title", F.col("__change").alias("change"), "is_open")


# Pages, streams --------------------------------------------------------------------------------


@_query()
def press_facts(spark, d):
    # Half of the pages get a sentence about a development, which the made-up prose lacks.
    more = F.concat(F.lit("<p>The developer broke ground on a mixed-use project of 240 units on 12.5 acres in Reston, a $120 million development by Comstock Partners.</p>"), F.col("html"))
    p = table(spark, d, "pages").select("url", F.when(F.col("page_id") % 2 == 0, more).otherwise(F.col("html")).alias("html"))
    return html.announcements(p)


@_query()
def team_parse(spark, d):
    one = F.concat(F.lit('<div class="team-member"><h3>Ann Mary'), F.lit(' Lee</h3><p>Vice President, Leasing</p><a href="mailto:a@example.org">mail</a></div>'))
    p = table(spark, d, "pages").select("url", F.concat(one, "html").alias("html"))
    return html.team_members(p)


@_query("SELECT dedupe_key, count(*) AS n FROM (SELECT DISTINCT dedupe_key FROM signals) GROUP BY 1", "signals")
def stream_signal_dedupe(spark, d):
    s = P.signal_columns(streams.parquet_stream(spark, d, "events.parquet"))
    return streams.finished(spark, streams.deduplicated(s).select("dedupe_key")).groupBy("dedupe_key").agg(F.count("*").alias("n"))


@_query("SELECT time_bucket(INTERVAL 5 DAY, occurred_at, TIMESTAMP '1970-01-01') AS start, firm_id, count(*) AS n, round(sum(score), 6) AS score FROM signals GROUP BY ALL", "signals")
def stream_tumbling(spark, d):
    s = P.signal_columns(streams.parquet_stream(spark, d, "events.parquet"))
    r = streams.finished(spark, streams.tumbling(s, "5 days").select(F.col("window.start").alias("start"), "firm_id", "n", "score"), streams.to_snapshot)
    return r.withColumn("score", F.round("score", 6))


@_query("SELECT start, signal_type, count(*) AS n FROM (SELECT signal_type, unnest([time_bucket(INTERVAL 1 DAY, occurred_at, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 DAY, occurred_at, TIMESTAMP '1970-01-01') - INTERVAL 1 DAY]) AS start FROM signals) GROUP BY ALL", "signals")
def stream_sliding(spark, d):
    s = P.signal_columns(streams.parquet_stream(spark, d, "events.parquet"))
    return streams.finished(spark, streams.sliding(s, "2 days", "1 day").select(F.col("window.start").alias("start"), "signal_type", "n"), streams.to_snapshot)


@_query(", g AS (SELECT firm_id, occurred_at, occurred_at - lag(occurred_at) OVER (PARTITION BY firm_id ORDER BY occurred_at) >= INTERVAL 6 HOUR AS new FROM signals), k AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY firm_id ORDER BY occurred_at ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT firm_id, min(occurred_at) AS start, count(*) AS n FROM k GROUP BY firm_id, s", "signals")
def stream_session(spark, d):
    s = P.signal_columns(streams.parquet_stream(spark, d, "events.parquet"))
    return streams.finished(spark, streams.sessions(s, "6 hours").select("firm_id", F.col("session_window.start").alias("start"), "n"), streams.to_snapshot)


@_query("SELECT source AS source_id, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE source IN ('src1', 'src2') GROUP BY source")
def extract_selection(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("text").alias("raw_text"))
    names = docs.select("source_id").distinct()
    kind = F.when(F.col("source_id") == "src1", "news").when(F.col("source_id") == "src2", "press_release").otherwise("careers")
    sources = names.select(F.col("source_id").alias("id"), F.lit(None).cast("string").alias("firm_id"), kind.alias("kind"), F.lit(None).cast("string").alias("scrape_task"))
    return documents.extraction_input(docs, sources, "press_release").groupBy("source_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


# The same queries under the names that they had while they left rows out.
for _name, _whole in (("parcel_owner_enrich", "parcel_owner_enrich_all"), ("page_split_chunks", "page_split_chunks_whole")):
    QUERIES[_name], ORACLE[_name] = QUERIES[_whole], ORACLE[_whole]
