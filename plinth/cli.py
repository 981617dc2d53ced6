"""``python -m plinth --store DIR COMMAND``: the jobs, over tables in a folder.

Pages, feeds, owners and probes come as files: what fetches them is outside.
"""

from __future__ import annotations

import argparse
import json
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth import session
from plinth.operators import alerts, delivery, digest, documents, permits, projects, query, resolve, roster, trends
from plinth.schemas import LEAD_TYPES
from plinth.sources import feeds, html, pdf, seeds
from plinth.store import Store

KINDS = {"crawl-firms": "firm_site", "careers": "careers", "zoning": "zoning_minutes", "news": "news"}


def _stamp(text: str | None):
    return F.lit(text).cast("timestamp") if text else F.current_timestamp()


def _resolver(s: Store) -> DataFrame:
    return resolve.firm_records(s.read("firms"), s.read("firm_aliases"), s.read("permits"))


def seed(s: Store, a) -> DataFrame:
    firms = seeds.firm_rows(s.spark, seeds.load_yaml(a.firms).get("firms", []))
    seeds.check(seeds.firm_faults(firms))
    listed = None
    if a.sources:
        listed = seeds.source_rows(s.spark, seeds.load_yaml(a.sources).get("sources", []))
        seeds.check(seeds.source_faults(listed))
    s.write("firms", seeds.seeded_firms(firms, s.read("firms"), _stamp(a.now)))
    s.append("firm_aliases", seeds.seeded_aliases(firms, s.read("firms"), s.read("firm_aliases")))
    s.write("sources", seeds.seeded_sources(firms, s.read("firms"), listed, s.read("sources")))
    return status(s, a)


def status(s: Store, a) -> DataFrame:
    return query.table_counts({t: s.read(t) for t in ("firms", "firm_aliases", "sources", "raw_documents", "permits", "signals")})


def failing(s: Store, a) -> DataFrame:
    return query.failing_sources(s.read("sources")).select("name", "base_url", "consecutive_failures", "last_error")


def verify_seeds(s: Store, a) -> DataFrame:
    probes = s.spark.read.schema("base_url string, status int, final_url string, error string").json(a.probes)
    return query.verify_seeds(s.read("sources"), probes).groupBy("verdict").count()


def crawl(s: Store, a) -> DataFrame:
    """Store the pages (url, html, status) of due sources of a kind, and the pages and PDFs that they lead to.

    A source that follows links leads to those on its index page, the stored one if there
    is one. ``--pdfs``: pages of PDFs (doc_id: the address, page, text, markdown).
    """
    due = documents.due_sources(s.read("sources"), _stamp(a.now), KINDS[a.command], a.locality, a.limit)
    pages, known = s.spark.read.parquet(a.pages), s.read("raw_documents")
    fetched = pages.select("url", "html", F.lit(None).cast("boolean").alias("robots_allowed"))
    index = html.index_html(due.select("base_url"), known.select("url", "raw_text", "fetched_at"), fetched).withColumnRenamed("base_url", "url")
    rules = due.select(F.col("base_url").alias("url"), F.coalesce("config.link_pattern", F.lit("")).alias("pattern"), F.when(F.coalesce("config.follow_links", F.lit(False)), F.coalesce("config.max_links", F.lit(html.MOST_LINKS))).otherwise(0).alias("most"))
    targets = html.crawl_targets(index.join(rules, "url"), F.col("pattern"), F.col("most"))
    wanted = due.select(F.col("id").alias("source_id"), "base_url").join(targets, F.col("base_url") == F.col("source_url")).select("source_id", "place", "url")
    rows = wanted.join(pages, "url").select("source_id", "place", "url", F.col("url").alias("final_url"), F.col("html").alias("raw_text"), html.text_of(F.col("html")).alias("cleaned_text"), F.lit("html").alias("content_type"), _stamp(a.now).alias("fetched_at"), F.col("status").alias("http_status"))
    told = documents.persist_outcomes(rows.drop("place"), known, ["url"])
    if a.pdfs:
        docs = pdf.documents_from_pages(s.spark.read.parquet(a.pdfs)).withColumnRenamed("doc_id", "url")
        files = wanted.join(docs, "url").select("source_id", "url", F.col("url").alias("final_url"), F.col("text").alias("raw_text"), F.col("markdown").alias("cleaned_text"), F.lit("pdf").alias("content_type"), _stamp(a.now).alias("fetched_at"), F.lit(200).alias("http_status"), "page_count", "is_scanned")
        told = told.unionByName(documents.pdf_outcomes(files, known.unionByName(documents.stored_documents(told).select("content_hash"), allowMissingColumns=True), ["url"]).drop("is_scanned"), allowMissingColumns=True)
    stats = documents.batch_stats(told, "source_id").collect()
    fresh = documents.new_documents(told, known)
    first = rows.where("place = 0")
    crawled = first.select("source_id", F.when(F.col("http_status") >= 400, F.concat(F.lit("status "), F.col("http_status").cast("string"))).alias("error")).dropDuplicates(["source_id"])
    after = documents.mark_crawled(s.read("sources"), crawled, _stamp(a.now))
    s.append("raw_documents", fresh)
    s.write("sources", after)
    return s.spark.createDataFrame(stats, "source_id string, stored long, duplicate long, failed long, skipped long")


def ingest_feed(s: Store, a) -> DataFrame:
    adapter = feeds.get_adapter(a.adapter, a.locality, json.loads(a.config))
    records = adapter.read(s.spark, a.pages, date.fromisoformat(a.since) if a.since else None, a.limit)
    got = permits.ingest_permits(records, s.read("permits"), _resolver(s), s.read("firm_aliases"), s.read("signals"), s.read("entity_candidates"), _stamp(a.now))
    stats = got.stats.collect()
    signals, aliases, queue = s.read("signals"), s.read("firm_aliases"), s.read("entity_candidates")
    both = [(t, old.unionByName(new.select(*[c for c in new.columns if c in old.columns]), allowMissingColumns=True)) for t, old, new in (("signals", signals, got.signals), ("firm_aliases", aliases, got.aliases), ("entity_candidates", queue, got.queue))]
    for name, df in [*both, ("permits", got.permits)]:
        s.write(name, df)
    return s.spark.createDataFrame(stats, got.stats.schema)


def enrich_permits(s: Store, a) -> DataFrame:
    owners = s.spark.read.schema("parcel_id string, owner_name string").json(a.owners)
    got = permits.enrich_with_owners(s.read("permits"), owners, _resolver(s), s.read("firm_aliases"), s.read("signals"), s.read("entity_candidates"), a.locality)
    stats = got.stats.collect()
    aliases = s.read("firm_aliases").unionByName(got.aliases, allowMissingColumns=True)
    for name, df in (("firm_aliases", aliases), ("signals", got.signals), ("permits", got.permits)):
        s.write(name, df)
    return s.spark.createDataFrame(stats, got.stats.schema)


def extract(s: Store, a) -> DataFrame:
    docs = documents.extraction_input(s.read("raw_documents"), s.read("sources"), a.task, a.limit).select(F.coalesce("final_url", "url").alias("url"), F.col("raw_text").alias("html"), F.col("source_firm_id").alias("firm_id"))
    firm = docs.select("url", "firm_id").dropDuplicates(["url"])
    now = _stamp(a.now)
    if a.task == "press_release":
        found = html.announcements(docs).withColumns({"ann_id": F.col("url"), "address": F.lit(None).cast("string")})
        got = projects.ingest_announcements(found, s.read("property_projects"), s.read("signals"), now, _resolver(s))
        table, state, signals = "property_projects", got.projects, got.signals
    elif a.task == "team":
        found = html.team_members(docs).join(firm, "url").withColumnRenamed("job_title", "title")
        got = roster.roster_diff(s.read("people"), found.select("firm_id", "place", "name", "title", "email", "linkedin_url"), s.read("signals"), now)
        table, state, signals = "people", got.state, got.signals
    else:
        found = html.job_listings(docs).join(firm, F.col("page_url") == firm.url).drop(firm.url).withColumnRenamed("job_title", "title")
        got = roster.job_diff(s.read("job_postings"), found.select("firm_id", "place", "title", "location", "employment_type", "url"), s.read("signals"), now)
        table, state, signals = "job_postings", got.state, got.signals
    merged = s.read("signals").unionByName(signals.select(*[c for c in signals.columns if c in s.read("signals").columns]), allowMissingColumns=True)
    s.write("signals", merged)
    s.write(table, state)
    return query.table_counts({table: s.read(table), "signals": s.read("signals")})


def discover(s: Store, a) -> DataFrame:
    return html.discover_team_pages(s.read("firms"), s.spark.read.parquet(a.pages))


def embed(s: Store, a) -> DataFrame:
    s.append("document_chunks", documents.embed_documents(s.read("raw_documents"), s.read("document_chunks"), s.read("sources")))
    fresh = documents.embed_firms(s.read("firms"), _stamp(a.now)).select("id", F.col("embedding").alias("e"), F.col("embedding_updated_at").alias("t"))
    old = s.read("firms")
    s.write("firms", old.join(fresh, "id", "left").withColumns({"embedding": F.coalesce("e", "embedding"), "embedding_updated_at": F.coalesce("t", "embedding_updated_at")}))
    return query.table_counts({"document_chunks": s.read("document_chunks")})


def run_trends(s: Store, a) -> DataFrame:
    p = s.read("permits").withColumn("valuation_usd", F.col("valuation_usd").cast("double"))
    windows, fresh = trends.run_trend_detection(s.read("firms"), p, s.read("job_postings"), s.read("signals"), s.read("property_projects"), F.lit(a.as_of).cast("date"), a.window_days, s.read("trend_windows").drop("id", "created_at", "updated_at"))
    merged = s.read("signals").unionByName(fresh, allowMissingColumns=True)
    s.write("signals", merged)
    s.write("trend_windows", windows)
    return trends.trend_stats(s.read("signals").where(F.col("is_derived") & F.col("signal_type").isin(*LEAD_TYPES)))


def run_digest(s: Store, a) -> DataFrame:
    new = digest.digest(s.read("signals"), s.read("firms"), _stamp(a.as_of))
    s.write("digests", digest.store_digest(s.read("digests"), new))
    return digest.latest(s.read("digests")).select("title", "signal_count", "firm_count", "markdown")


def deliver(s: Store, a) -> DataFrame:
    """Through the recording sink: what would be sent is what is returned."""
    sink, now = alerts.RecordingSink(), _stamp(a.now)

    def keep(pending: DataFrame) -> DataFrame:
        s.append("alert_deliveries", pending)
        return s.read("alert_deliveries").where("status = 'pending'").select(*pending.columns)

    done = alerts.deliver(s.read("signals"), s.read("alerts"), s.read("alert_deliveries"), now, sink, keep=keep)
    told = done.select("alert_id", "signal_id", F.col("status").alias("s"), F.col("delivered_at").alias("d"))
    after = s.read("alert_deliveries").join(told, ["alert_id", "signal_id"], "left").withColumns({"status": F.coalesce("s", "status"), "delivered_at": F.coalesce("d", "delivered_at")})
    s.write("alert_deliveries", after)
    return s.spark.createDataFrame(sink.sent, "channel string, target string, body string")


def deliver_digest(s: Store, a) -> DataFrame:
    """The latest digest to all active users (id, email, is_active), through the recording sink."""
    users = s.spark.read.schema("id string, email string, is_active boolean").json(a.users)
    return delivery.sent(delivery.digest_messages(s.read("digests"), users), alerts.RecordingSink(), "html")


COMMANDS = {
    "seed": seed, "verify-seeds": verify_seeds, "crawl-firms": crawl, "careers": crawl, "zoning": crawl, "news": crawl, "permits": ingest_feed, "extract": extract,
    "discover-team-pages": discover, "status": status, "failing": failing, "embed": embed, "enrich-permits": enrich_permits, "trends": run_trends, "digest": run_digest, "deliver-digest": deliver_digest, "deliver-alerts": deliver,
}
_OPTIONS = {
    "seed": ("--firms", "--sources?"), "verify-seeds": ("--probes",), "permits": ("--adapter", "--locality", "--pages", "--config?", "--since?", "--limit?"), "extract": ("--task", "--limit?"),
    "discover-team-pages": ("--pages",), "enrich-permits": ("--owners", "--locality"), "trends": ("--as-of", "--window-days?"), "digest": ("--as-of",), "deliver-digest": ("--users",),
} | {k: ("--pages", "--pdfs?", "--locality?", "--limit?") for k in KINDS}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plinth", description=__doc__)
    top.add_argument("--store", required=True)
    top.add_argument("--now", help="timestamp to stamp rows with; default: the current time")
    sub = top.add_subparsers(dest="command", required=True)
    kinds = {"limit": int, "window_days": int}
    defaults = {"config": "{}", "window_days": trends.DAYS}
    for name in COMMANDS:
        p = sub.add_parser(name)
        for option in _OPTIONS.get(name, ()):
            key = option.strip("-?").replace("-", "_")
            p.add_argument(option.rstrip("?"), required=not option.endswith("?"), type=kinds.get(key, str), default=defaults.get(key))
    return top


def main(argv: list[str] | None = None, spark=None) -> DataFrame:
    a = parser().parse_args(argv)
    s = Store(spark or session.build(), a.store)
    return COMMANDS[a.command](s, a)
