"""Documents: gates, dedupe by content, crawl bookkeeping, chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.functions import vectors
from plinth.operators.upsert import first_rows, new_only
from plinth.schemas import row_id

# Limits and the statuses that a refused client gets.
LEAST_CHARS, MOST_BYTES, BLOCKED, ATTEMPTS, STALE_DAYS, ERROR_CHARS = 200, 50 << 20, (401, 403, 429), 3, 30, 2000


def persist_outcomes(docs: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """``docs`` (with cleaned_text) and content_hash, word_count, outcome.

    too_short, bot_challenge, duplicate (of a stored hash, or of an earlier row of the
    batch in ``order``) or stored. ``stored``: content_hash.
    """
    body = T.strip(F.coalesce("cleaned_text", F.lit("")))
    gate = F.when(F.length(body) < LEAST_CHARS, "too_short").when(T.looks_like_challenge(body), "bot_challenge")
    rows = docs.withColumns({"outcome": gate, "content_hash": T.content_hash(body), "word_count": T.word_count(body)})
    open_ = rows.where("outcome IS NULL")
    first = first_rows(open_.select("content_hash", *order), ["content_hash"], order).withColumn("__first", F.lit(True))
    known = stored.select("content_hash").distinct().withColumn("__known", F.lit(True))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("content_hash", *order)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    told = rows.alias("r").join(first.alias("f"), on, "left").select("r.*", "f.__first").join(known, "content_hash", "left")
    outcome = F.coalesce("outcome", F.when(F.col("__known").isNotNull() | F.col("__first").isNull(), "duplicate").otherwise("stored"))
    return told.withColumn("outcome", outcome).drop("__first", "__known")


def pdf_outcomes(docs: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """As :func:`persist_outcomes` for PDF documents (with is_scanned): those without a text layer are scanned_pdf and never stored."""
    told = persist_outcomes(docs.where("NOT is_scanned"), stored, order)
    scanned = docs.where("is_scanned").withColumns({"outcome": F.lit("scanned_pdf"), "content_hash": F.lit(None).cast("string"), "word_count": F.lit(None).cast("int")})
    return told.unionByName(scanned.select(*told.columns))


def stored_documents(outcomes: DataFrame) -> DataFrame:
    """The rows to add to raw_documents."""
    return outcomes.where("outcome = 'stored'").withColumns({"id": row_id(F.col("content_hash")), "cleaned_text": T.strip(F.col("cleaned_text")), "extraction_status": F.lit("pending"), "extraction_attempts": F.lit(0)})


def batch_stats(outcomes: DataFrame, by: str) -> DataFrame:
    """Stored, duplicate, failed and skipped rows of each source."""
    o = F.col("outcome")
    return outcomes.groupBy(by).agg(F.count_if(o == "stored").alias("stored"), F.count_if(o == "duplicate").alias("duplicate"), F.count_if(o == "failed").alias("failed"), F.count_if(~o.isin("stored", "duplicate", "failed")).alias("skipped"))


def fetch_outcomes(pages: DataFrame) -> DataFrame:
    """``pages`` (status, content_type, n_bytes, robots_allowed, text_chars) and action: what a crawler does with each.

    robots_denied, render (a browser is worth a try: refused, or next to no text), failed,
    pdf, or html.
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    action = (
        F.when(F.col("robots_allowed").eqNullSafe(F.lit(False)), "robots_denied")
        .when(F.col("status").isin(*BLOCKED), "render")
        .when(F.col("status").isNull() | (F.col("status") >= 400) | (F.col("n_bytes") > MOST_BYTES), "failed")
        .when(kind.contains("pdf"), "pdf")
        .when(F.col("text_chars") < LEAST_CHARS, "render")
        .otherwise("html")
    )
    return pages.withColumn("action", action)


def mark_crawled(sources: DataFrame, crawls: DataFrame, now: Column) -> DataFrame:
    """Sources after ``crawls`` (source_id, error): success resets failures, an error counts."""
    j = sources.join(crawls.select(F.col("source_id").alias("id"), "error", F.lit(True).alias("__crawled")), "id", "left")
    crawled, failed = F.col("__crawled").isNotNull(), F.col("error").isNotNull()
    return j.withColumns(
        {
            "last_crawled_at": F.when(crawled, now).otherwise(F.col("last_crawled_at")),
            "last_success_at": F.when(crawled & ~failed, now).otherwise(F.col("last_success_at")),
            "consecutive_failures": F.when(crawled & failed, F.col("consecutive_failures") + 1).when(crawled, 0).otherwise(F.col("consecutive_failures")),
            "last_error": F.when(crawled & failed, F.left("error", F.lit(ERROR_CHARS))).when(crawled, F.lit(None)).otherwise(F.col("last_error")),
        }
    ).drop("error", "__crawled")


def is_due(now: Column) -> Column:
    """Over sources: active, not denied, and never crawled or not within its cadence."""
    age = (F.unix_micros(now) - F.unix_micros("last_crawled_at")) / 3.6e9
    return F.col("is_active") & ~F.col("robots_allowed").eqNullSafe(F.lit(False)) & (F.col("last_crawled_at").isNull() | (age >= F.col("cadence_hours")))


def due_sources(sources: DataFrame, now: Column, kind: str | None = None, locality: str | None = None, limit: int | None = None) -> DataFrame:
    out = sources.where(is_due(now))
    out = out.where(F.col("kind") == kind) if kind else out
    out = out.where(F.col("locality") == locality) if locality else out
    return out.orderBy("id").limit(limit) if limit else out


def extraction_input(documents: DataFrame, sources: DataFrame, task: str, limit: int | None = None) -> DataFrame:
    """Documents to parse for a task: team (by the source's task), careers or press_release (by its kind)."""
    rules = {"team": F.col("scrape_task") == "team", "careers": F.col("kind") == "careers", "press_release": F.col("kind").isin("news", "press_release")}
    if task not in rules:
        raise ValueError(f"unknown task {task!r}; there are {', '.join(rules)}")
    s = sources.where(rules[task]).select(F.col("id").alias("source_id"), F.col("firm_id").alias("source_firm_id"), "kind", "scrape_task")
    out = documents.where("raw_text IS NOT NULL").join(s, "source_id")
    return out.orderBy("id").limit(limit) if limit else out


def chunk_text(docs: DataFrame, key: str, text: str, tokens: int = T.CHUNK_TOKENS, overlap: int = T.OVERLAP_TOKENS) -> DataFrame:
    """key, chunk_index, page_number, text, token_count: overlapping word windows, in each page where there are page markers."""
    body = T.strip(F.coalesce(F.col(text), F.lit("")))
    marked = F.regexp_like(body, F.lit(T.PAGE_MARKER))
    rows = docs.select(key, marked.alias("marked"), T.page_sections(body).alias("sections"))
    cut = F.transform("sections", lambda s: F.struct(s["page"].alias("page"), T.chunk_arrays(s["text"], tokens, overlap).alias("chunks")))
    # Numbers run through the document: all chunks of all sections in one array, with the section's page.
    flat = F.flatten(F.transform("cut", lambda s: F.transform(s["chunks"], lambda c: F.struct(s["page"].alias("page"), c.alias("chunk")))))
    each = rows.withColumn("cut", cut).select(key, "marked", F.posexplode(flat).alias("chunk_index", "c"))
    return each.select(key, "chunk_index", F.when(F.col("marked"), F.col("c.page")).alias("page_number"), F.col("c.chunk.text").alias("text"), F.col("c.chunk.token_count").alias("token_count"))


def pending_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents to embed, the first fetched first."""
    open_ = documents.where(F.col("extraction_status").isin("pending", "extracted") & F.col("cleaned_text").isNotNull() & (F.coalesce("extraction_attempts", F.lit(0)) < ATTEMPTS))
    return open_.join(chunks.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti").orderBy(F.asc_nulls_last("fetched_at"), "id")


def embed_documents(documents: DataFrame, chunks: DataFrame, sources: DataFrame, model=vectors.hashing_model) -> DataFrame:
    """New chunk rows, with embeddings and the firm of the document's source."""
    rows = chunk_text(pending_documents(documents, chunks), "id", "cleaned_text").withColumnRenamed("id", "document_id")
    rows = rows.withColumn("embedding", vectors.embedder(model)("text"))
    return backfill_firms(rows.withColumn("firm_id", F.lit(None).cast("string")), documents, sources)


def backfill_firms(chunks: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks without a firm get their document's source's."""
    d = documents.select(F.col("id").alias("document_id"), "source_id")
    s = sources.select(F.col("id").alias("source_id"), F.col("firm_id").cast("string").alias("__firm"))
    return chunks.join(d, "document_id", "left").join(s, "source_id", "left").withColumn("firm_id", F.coalesce("firm_id", "__firm")).drop("source_id", "__firm")


def stale_firms(firms: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """Active firms without an embedding, or with one older than ``days``."""
    return firms.where(F.col("is_active") & (F.col("embedding").isNull() | F.col("embedding_updated_at").isNull() | (F.col("embedding_updated_at") < F.timestamp_add("DAY", F.lit(-days), now))))


def embed_firms(firms: DataFrame, now: Column, model=vectors.hashing_model) -> DataFrame:
    """Stale firms with a fresh embedding of their card."""
    card = T.firm_card(*[F.col(c) for c in ("name", "firm_type", "asset_classes", "localities", "focus_areas", "description")])
    return stale_firms(firms, now).withColumn("embedding", vectors.embedder(model)(card)).withColumn("embedding_updated_at", now)


def new_documents(outcomes: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows that the table doesn't have: running a batch again adds none."""
    return new_only(stored_documents(outcomes), stored, ["content_hash"], ["id"])
