"""More registered queries: feeds, seeds, crawl bookkeeping, selections, upserts of each table, PDF rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import naming
from plinth.functions import text as T
from plinth.operators import alerts, digest, documents, projects, query, roster, trends, upsert
from plinth.plans import proxies as P
from plinth.plans.catalogue import ORACLE, QUERIES, _BASIC, _CANON, _LIST, _NOW, _SOURCES, _T, _names, _query, _sources
from plinth.session import table
from plinth.sources import feeds, pdf, seeds


def _now():
    return F.lit(f"{P.AS_OF_EVENTS} 00:00:00").cast("timestamp")


# Feeds and seeds


@_query(
    "SELECT 'Fairfax' AS locality, CAST(o_orderkey AS VARCHAR) AS permit_number, nullif(trim(o_orderpriority), '') AS permit_type, CASE WHEN o_orderkey % 5 <> 0 THEN concat('Firm ', o_custkey) END AS applicant_name_raw, CASE WHEN o_orderkey % 5 <> 0 THEN 'PROJECT_NAME' END AS mention_field, o_totalprice AS valuation_usd, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS filed_date, 38.5 AS lat FROM orders WHERE o_orderkey % 7 <> 0"
)
def feed_projection(spark, d):
    """Features with milliseconds, blanks and missing numbers, as a layer gives them."""
    k = F.col("o_orderkey")
    millis = F.when(k % 3 == 0, "0").otherwise(F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string"))
    attributes = F.create_map(
        F.lit("RECORDID"), F.when(k % 7 != 0, k.cast("string")), F.lit("APPTYPEALIAS"), F.concat(F.lit(" "), "o_orderpriority"), F.lit("PROJECT_NAME"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" Firm "), F.col("o_custkey").cast("string"))), F.lit("ESTIMATED_COST"), F.col("o_totalprice").cast("string"), F.lit("SUBMITTED_DATE"), millis,
    )
    rows = table(spark, d, "orders").select(attributes.alias("attributes"), F.lit(-77.2).alias("x"), F.lit(38.5).alias("y"))
    got = feeds.get_adapter("arcgis", "Fairfax", {"service_url": "u", "layer_id": 0}).records(rows)
    return got.select("locality", "permit_number", "permit_type", "applicant_name_raw", "mention_field", "valuation_usd", "filed_date", F.col("lat").cast("decimal(3,1)").alias("lat"))


@_query("SELECT CAST(event_id AS VARCHAR) AS permit_number, CASE event_id % 3 WHEN 2 THEN NULL ELSE CAST(ts AS DATE) END AS issued_date, CASE WHEN event_id % 4 <> 0 THEN value END AS valuation_usd FROM events")
def feed_projection_iso(spark, d):
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    day = F.when(k % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(k % 3 == 1, F.date_format(ts, "MM/dd/yyyy")).otherwise(F.lit("soon"))
    rows = table(spark, d, "events").select(F.create_map(F.lit("n"), k.cast("string"), F.lit("d"), day, F.lit("v"), F.when(k % 4 == 0, "n/a").otherwise(F.col("value").cast("string"))).alias("attributes"))
    adapter = feeds.get_adapter("socrata", "x", {"domain": "d", "dataset_id": "i", "field_map": {"n": "permit_number", "d": "issued_date", "v": "valuation_usd"}})
    return adapter.records(rows).select("permit_number", "issued_date", "valuation_usd")


def _seed_rows(spark, d):
    k = F.col("p_partkey")
    empty = F.array().cast("array<string>")
    return _names(spark, d).join(table(spark, d, "part").select(k.alias("id"), "p_size"), "id").select(
        F.col("id").cast("int").alias("place"), "name", F.concat(F.lit("https://h"), F.col("id").cast("string"), F.lit(".example.org/")).alias("website"), F.lit("developer").alias("firm_type"),
        *[F.lit(None).cast("string").alias(c) for c in ("city", "county", "state", "hq_address", "phone", "description")], *[empty.alias(c) for c in ("focus_areas", "asset_classes", "localities")],
        F.lit(None).cast("int").alias("founded_year"), F.when(F.col("p_size") % 2 == 0, "/careers").alias("careers_path"), F.array(F.concat(F.lit("dba "), "name")).alias("aliases"),
    )


@_query("SELECT base_url, kind, cadence_hours FROM (SELECT concat('https://h', p_partkey, '.example.org') AS base_url, 'firm_site' AS kind, 168 AS cadence_hours FROM part UNION ALL SELECT concat('https://h', p_partkey, '.example.org/careers'), 'careers', 72 FROM part WHERE p_size % 2 = 0)")
def firm_sources(spark, d):
    rows = _seed_rows(spark, d).withColumn("slug", naming.slugify(F.col("name")))
    return seeds.firm_sources(rows).select("base_url", "kind", "cadence_hours")


@_query(f"{_T}{_CANON}, sl AS (SELECT id, canonical, left(trim(regexp_replace(replace({_BASIC.format(x='name')}, ' ', '-'), '-+', '-', 'g'), '-'), 160) AS slug FROM canon) SELECT slug, arg_max(canonical, id) AS canonical_name FROM sl GROUP BY slug")
def seed_firms(spark, d):
    none = spark.createDataFrame([], "slug string, id string")
    return seeds.seeded_firms(_seed_rows(spark, d), none, _now()).select("slug", "canonical_name")


@_query(f"{_T}{_CANON}, sl AS (SELECT id, canonical, left(trim(regexp_replace(replace({_BASIC.format(x='name')}, ' ', '-'), '-+', '-', 'g'), '-'), 160) AS slug FROM canon) SELECT DISTINCT slug, 'different names share the slug ' || slug AS fault FROM sl WHERE id % 10 = 0")
def seed_faults(spark, d):
    rows = _seed_rows(spark, d)
    f = seeds.firm_faults(rows.unionByName(rows.where("place % 10 = 0").withColumn("name", F.upper("name"))))
    return f.select(F.regexp_extract("fault", r"(\S+)$", 1).alias("slug"), "fault")


@_query(f"{_T}{_CANON} SELECT count(DISTINCT concat('dba ', canonical)) AS n_aliases FROM canon WHERE canonical <> ''")
def seed_aliases(spark, d):
    rows = _seed_rows(spark, d)
    firms = seeds.seeded_firms(rows, spark.createDataFrame([], "slug string, id string"), _now())
    none = spark.createDataFrame([], "canonical_alias string")
    # The name itself makes no alias, as it is the firm's own key.
    return seeds.seeded_aliases(rows, firms, none).where("canonical_alias LIKE 'dba %'").agg(F.count("*").alias("n_aliases"))


_PROBE = "SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE CASE WHEN id % 5 = 0 THEN 404 ELSE 200 END END AS status, id % 3 = 0 AS moved FROM s"


@_query(f"WITH s AS ({_SOURCES}), p AS ({_PROBE}) SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN status IS NULL OR status >= 400 THEN 'broken' WHEN moved THEN 'moved' ELSE 'ok' END AS verdict FROM p JOIN s USING (id) WHERE is_active) GROUP BY verdict")
def verify_seeds(spark, d):
    url = F.concat(F.lit("u"), F.col("id").cast("string"))
    s = _sources(spark, d).withColumn("base_url", url)
    probes = s.select("base_url", F.when(F.col("id") % 4 != 0, F.when(F.col("id") % 5 == 0, 404).otherwise(200)).alias("status"), F.when(F.col("id") % 3 == 0, "elsewhere").otherwise(F.concat("base_url", F.lit("/"))).alias("final_url"), F.lit(None).cast("string").alias("error"))
    return query.verify_seeds(s, probes).groupBy("verdict").agg(F.count("*").alias("n"))


@_query(f"WITH s AS ({_SOURCES}) SELECT id, CAST(CASE WHEN id % 3 = 0 THEN consecutive_failures + 1 WHEN id % 3 = 1 THEN 0 ELSE consecutive_failures END AS INT) AS consecutive_failures, CASE WHEN id % 3 = 0 THEN 'boom' END AS last_error, CASE WHEN id % 3 = 2 THEN last_crawled_at ELSE {_NOW} END AS last_crawled_at FROM s")
def mark_source_crawled(spark, d):
    s = _sources(spark, d).withColumns({"last_success_at": F.lit(None).cast("timestamp"), "last_error": F.lit(None).cast("string")})
    crawls = s.where("id % 3 <> 2").select(F.col("id").alias("source_id"), F.when(F.col("id") % 3 == 0, "boom").alias("error"))
    return documents.mark_crawled(s, crawls, _now()).select("id", "consecutive_failures", "last_error", "last_crawled_at")


@_query("SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'robots_denied' WHEN page_id % 7 = 0 THEN 'render' WHEN page_id % 5 = 0 THEN 'failed' WHEN page_id % 3 = 0 THEN 'pdf' WHEN length(html) % 400 < 200 THEN 'render' ELSE 'html' END AS action FROM pages")
def fetch_outcome(spark, d):
    k = F.col("page_id")
    p = table(spark, d, "pages").select(
        "page_id", F.when(k % 7 == 0, 403).when(k % 5 == 0, 404).otherwise(200).alias("status"), F.when(k % 3 == 0, "application/PDF").otherwise("text/html").alias("content_type"), F.lit(10).cast("long").alias("n_bytes"),
        F.when(k % 11 == 0, False).alias("robots_allowed"), (F.length("html") % 400).alias("text_chars"),
    )
    return documents.fetch_outcomes(p).select("page_id", "action")


# Selections


@_query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 4 AND doc_id % 4 <> 1")
def pending_embeddings(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select(k.alias("id"), F.when(k % 3 == 0, "failed").when(k % 3 == 1, "pending").otherwise("extracted").alias("extraction_status"), F.col("text").alias("cleaned_text"), (k % 5 - 1).cast("int").alias("extraction_attempts"), F.lit(None).cast("timestamp").alias("fetched_at"))
    done = docs.where("id % 4 = 1").select(F.col("id").alias("document_id"))
    return documents.pending_documents(docs, done).select("id")


@_query(f"SELECT id FROM (SELECT user_id AS id, max(ts) FILTER (event_type = 'signup') AS t FROM events WHERE ts < TIMESTAMP '2024-01-05' OR user_id % 2 = 0 GROUP BY user_id) WHERE id % 3 <> 0 AND (id % 7 = 0 OR t IS NULL OR t < {_NOW} - INTERVAL 20 DAY)")
def stale_firms(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.where((F.col("ts") < F.lit("2024-01-05").cast("timestamp")) | (F.col("user_id") % 2 == 0)).groupBy(F.col("user_id").alias("id")).agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("embedding_updated_at"))
    f = last.withColumns({"is_active": F.col("id") % 3 != 0, "embedding": F.when(F.col("id") % 7 != 0, F.array(F.lit(1.0)))})
    return documents.stale_firms(f, _now(), 20).select("id")


@_query("SELECT id FROM signals WHERE occurred_at >= TIMESTAMP '2024-01-15' AND occurred_at <= TIMESTAMP '2024-01-22' AND score >= 0.5 AND firm_id IS NOT NULL", "signals")
def digest_selection(spark, d):
    return digest.digest_signals(P.signals(spark, d), F.lit("2024-01-21 23:00:00").cast("timestamp")).select("id")


@_query("SELECT id FROM signals WHERE detected_at >= TIMESTAMP '2024-01-19 23:00:00'", "signals")
def recent_signals(spark, d):
    return alerts.recent(P.signals(spark, d), F.lit("2024-01-21 00:00:00").cast("timestamp")).select("id")


@_query("SELECT c_custkey AS id, concat_ws('. ', c_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN replace(lower(c_mktsegment), '_', ' ') END, CASE WHEN c_custkey % 2 = 0 THEN 'data center, office' END, CASE WHEN c_custkey % 3 = 0 THEN 'A, B, C, D, E' END) AS card FROM customer")
def firm_profile_text(spark, d):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "unknown").otherwise(F.lower("c_mktsegment"))
    classes = F.when(k % 2 == 0, F.array(F.lit("data_center"), F.lit("office"))).otherwise(none)
    places = F.when(k % 3 == 0, F.array(*[F.lit(x) for x in "ABCDEFG"])).otherwise(none)
    return table(spark, d, "customer").select(k.alias("id"), T.firm_card(F.col("c_name"), kind, classes, places, none, F.lit(None).cast("string")).alias("card"))


@_query("SELECT doc_id AS id, CASE WHEN length(x) <= 400 THEN x ELSE concat(trim(regexp_extract(concat(x, ' '), '^(.{0,399})\\s', 1)), '…') END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents)")
def excerpts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.shorten(F.col("text")).alias("excerpt"))


# Upserts


@_query(
    """, o AS (SELECT DISTINCT ON (p_name) p_name AS name, p_size AS unit_count FROM part WHERE p_partkey % 2 = 0 ORDER BY p_name, p_partkey),
n AS (SELECT p_name AS name, arg_max(p_size * 2, p_partkey) FILTER (p_partkey % 3 <> 0) AS unit_count FROM part WHERE p_partkey % 2 <> 0 OR p_partkey % 5 = 0 GROUP BY p_name)
SELECT coalesce(o.name, n.name) AS canonical_name, CAST(coalesce(n.unit_count, o.unit_count) AS INT) AS unit_count FROM o FULL JOIN n USING (name)""",
    "firms",
)
def project_upsert_all(spark, d):
    """Every part is a project, an announcement or both."""
    none, k = F.lit(None), F.col("p_partkey")
    part = table(spark, d, "part")
    old = upsert.first_rows(part.where("p_partkey % 2 = 0"), ["p_name"], ["p_partkey"]).select(F.col("p_name").alias("id"), F.col("p_name").alias("name"), F.col("p_name").alias("canonical_name"), none.cast("string").alias("locality"), F.col("p_size").alias("unit_count"), F.lit("proposed").alias("status"))
    ann = part.where("p_partkey % 2 <> 0 OR p_partkey % 5 = 0").select(
        k.alias("ann_id"), F.col("p_name").alias("headline"), F.col("p_name").alias("project_name"), F.array().cast("array<string>").alias("firm_names"), *[none.cast("string").alias(c) for c in ("project_type", "locality", "address", "summary")],
        F.when(k % 3 != 0, F.col("p_size") * 2).alias("unit_count"), none.cast("int").alias("square_feet"), none.cast("double").alias("acreage"), none.cast("double").alias("est_value_usd"), none.cast("date").alias("announced_date"),
    )
    known = spark.createDataFrame([], "dedupe_key string")
    return projects.ingest_announcements(ann, old, known, _now()).projects.select("canonical_name", "unit_count")


@_query("SELECT CASE WHEN p_partkey % 2 = 0 THEN lower(p_name) ELSE p_brand END AS canonical_name, count(*) AS n FROM part GROUP BY 1")
def canonical_backfill(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 != 0, F.col("p_brand")).alias("canonical_name"))
    return upsert.backfill_canonical(p).groupBy("canonical_name").agg(F.count("*").alias("n"))


@_query(f"SELECT id AS firm_id, county AS locality, w.w, CAST(1 + (id % 2 = 0 AND w.w = 0)::INT AS INT) AS runs FROM firms, (SELECT CAST(range AS INT) AS w FROM range(5)) w WHERE {_NOW} IS NOT NULL", "firms")
def trend_window_upsert(spark, d):
    """The same windows twice: the second run updates, and a null locality equals a null locality."""
    f = P.firms(spark, d)
    w = trends.trend_windows(f, P.permits(spark, d).limit(0), P.jobs(spark, d).limit(0), P.signals(spark, d).limit(0), P.no_projects(spark), F.lit(P.AS_OF_PERMITS).cast("date")).drop("asset_class_mix")
    old = w.withColumn("runs", F.lit(1))
    new = w.where("firm_id % 2 = 0 AND w = 0").withColumn("runs", F.lit(2))
    return upsert.upsert(old, new, ["firm_id", "locality", "period_start"]).select("firm_id", "locality", "w", "runs")


@_query("SELECT user_id AS firm_id, count(*) AS open_after FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN event_id % 40 ELSE event_id % 6 END AS t FROM events) GROUP BY user_id HAVING count(*) >= 5")
def careers_surge_all(spark, d):
    """A first crawl of all firms; two thirds of them have fewer roles."""
    none = F.lit(None).cast("string")
    role = F.when(F.col("user_id") % 3 == 0, F.col("event_id") % 40).otherwise(F.col("event_id") % 6)
    e = table(spark, d, "events").select(F.col("user_id").alias("firm_id"), F.col("event_id").alias("place"), F.concat(F.lit("Analyst "), role.cast("string")).alias("title"), none.alias("location"))
    old = spark.createDataFrame([], "id string, firm_id long, title string, location string, is_open boolean, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp")
    got = roster.job_diff(old, e, spark.createDataFrame([], "dedupe_key string"), _now())
    return got.signals.select("firm_id", F.get_json_object("payload", "$.open_after").cast("long").alias("open_after"))


# PDF


@_query(
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS x, CASE WHEN doc_id % 4 = 0 THEN 45 ELSE 1000 END AS w FROM documents),
p AS (SELECT doc_id, x, w, unnest(range(greatest(1, (length(x) + w - 1) // w))) AS k FROM t)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(count(*) AS INT) AS page_count, avg(CASE WHEN length(trim(substr(x, k * w + 1, w))) < 40 THEN 1.0 ELSE 0.0 END) >= 0.8 AS is_scanned FROM p GROUP BY doc_id"""
)
def scanned_documents_all(spark, d):
    """Each document's own text on pages of 1000 characters, or of 45 where it depends on blanks and the last page."""
    w = F.when(F.col("doc_id") % 4 == 0, 45).otherwise(1000)
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("x"), w.alias("w"))
    last = F.greatest(F.lit(1), F.ceil(F.length("x") / F.col("w"))).cast("int")
    pages = t.select(F.col("doc_id").cast("string").alias("doc_id"), "x", "w", F.explode(F.sequence(F.lit(1), last)).alias("page"))
    text = F.substring("x", (F.col("page") - 1) * F.col("w") + 1, F.col("w"))
    pages = pages.select("doc_id", "page", text.alias("text"), text.alias("markdown"))
    return pdf.documents_from_pages(pages).select("doc_id", "page_count", "is_scanned")


@_query(f"SELECT event_id AS id, list_contains({_LIST(('hiring_surge', 'asset_class_pivot', 'geographic_expansion', 'permit_volume_anomaly'))}, CASE event_type WHEN 'click' THEN 'hiring_surge' ELSE 'x' END) AS is_lead, dayname(ts) AS day FROM events")
def lead_types(spark, d):
    r = digest.ranked(P.signals(spark, d))
    return r.select("id", "is_lead", F.date_format("occurred_at", "EEEE").alias("day"))


# The same queries under the names that they had while they left rows out.
for _name in ("project_upsert", "careers_surge", "scanned_documents"):
    QUERIES[_name], ORACLE[_name] = QUERIES[f"{_name}_all"], ORACLE[f"{_name}_all"]
