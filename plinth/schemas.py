"""Table schemas, vocabularies and the checks that stand in for constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabularies.
VOCABULARIES = {
    "firm_type": ("developer", "brokerage", "investor", "property_manager", "general_contractor", "unknown"),
    "asset_class": ("multifamily", "industrial", "logistics", "data_center", "office", "retail", "mixed_use", "hospitality", "senior_housing", "land"),
    "project_status": ("rumored", "proposed", "rezoning", "permitted", "under_construction", "delivered", "stalled", "cancelled"),
    "source_kind": ("firm_site", "permit_portal", "zoning_minutes", "news", "careers", "press_release", "open_data_api"),
    "content_type": ("html", "pdf", "json"),
    "extraction_status": ("pending", "extracted", "failed", "skipped_scanned", "skipped_empty"),
    "alias_type": ("dba", "llc_holding", "former_name", "abbreviation", "misspelling"),
    "signal_type": (
        "land_acquisition", "permit_filing", "zoning_change", "key_hire", "departure", "new_project", "joint_venture",
        "hiring_surge", "asset_class_pivot", "geographic_expansion", "permit_volume_anomaly",
    ),
    "relation_type": ("joint_venture", "shared_parcel", "geographic_overlap", "shared_executive", "co_filing"),
    "role_type": ("executive", "broker", "developer", "acquisitions", "construction", "other"),
    "user_tier": ("free", "pro", "enterprise"),
    "alert_channel": ("email", "slack"),
    "delivery_status": ("pending", "sent", "failed"),
    "resolution_method": ("exact", "alias", "fuzzy", "corroborated", "llm", "manual"),
    "resolution_status": ("resolved", "ambiguous", "unmatched", "rejected"),
}
LEAD_TYPES = ("hiring_surge", "asset_class_pivot", "geographic_expansion", "permit_volume_anomaly")

_STAMPS = "id string, created_at timestamp, updated_at timestamp"
#: DDL of each table, without the columns that all have.
COLUMNS = {
    "firms": "slug string, name string, canonical_name string, website string, firm_type string, hq_address string, city string, county string, state string, postal_code string, lat double, lon double, phone string, focus_areas array<string>, asset_classes array<string>, localities array<string>, employee_count int, pipeline_project_count int, founded_year int, description string, embedding array<float>, embedding_updated_at timestamp, first_seen_at timestamp, last_activity_at timestamp, is_active boolean",
    "firm_aliases": "firm_id string, alias string, canonical_alias string, alias_type string, confidence double, resolution_method string, source_document_id string",
    "firm_relationships": "firm_a_id string, firm_b_id string, relation_type string, weight double, evidence_count int, evidence_document_id string, note string, first_detected_at timestamp, last_detected_at timestamp",
    "sources": "name string, kind string, base_url string, firm_id string, locality string, scrape_task string, config struct<follow_links boolean, link_pattern string, max_links int>, cadence_hours int, robots_allowed boolean, robots_checked_at timestamp, last_crawled_at timestamp, last_success_at timestamp, consecutive_failures int, last_error string, is_active boolean, notes string",
    "raw_documents": "source_id string, url string, final_url string, content_hash string, content_type string, http_status int, title string, raw_text string, cleaned_text string, page_count int, word_count int, published_at timestamp, fetched_at timestamp, processed_at timestamp, extraction_status string, extraction_error string, extraction_attempts int",
    "document_chunks": "document_id string, firm_id string, chunk_index int, page_number int, text string, token_count int, embedding array<float>",
    "entity_candidates": "mention string, canonical_mention string, context string, source_document_id string, origin_table string, origin_id string, suggestions array<struct<firm_id string, name string, score double>>, best_score double, status string, resolved_firm_id string, resolved_at timestamp, resolved_by string",
    "people": "firm_id string, name string, canonical_name string, title string, role_type string, email string, linkedin_url string, bio string, start_date date, end_date date, is_current boolean, first_seen_at timestamp, last_seen_at timestamp, source_document_id string",
    "job_postings": "firm_id string, title string, department string, location string, employment_type string, url string, raw_text string, posted_date date, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp, is_open boolean, source_document_id string",
    "property_projects": "firm_id string, name string, canonical_name string, project_type string, status string, locality string, address string, parcel_ids array<string>, lat double, lon double, acreage double, unit_count int, square_feet int, est_value_usd decimal(14,2), announced_date date, expected_completion date, description string, source_document_id string",
    "permits": "project_id string, firm_id string, locality string, permit_number string, permit_type string, description string, applicant_name_raw string, owner_name_raw string, contractor_name_raw string, address string, parcel_id string, lat double, lon double, valuation_usd decimal(14,2), filed_date date, issued_date date, status string, resolution_method string, resolution_confidence double, source_document_id string",
    "signals": "firm_id string, signal_type string, title string, summary string, score double, locality string, asset_class string, occurred_at timestamp, detected_at timestamp, payload string, is_derived boolean, dedupe_key string, source_document_id string",
    "trend_windows": "firm_id string, locality string, period_start timestamp, period_end timestamp, permit_count int, valuation_sum_usd double, open_job_count int, news_mention_count int, new_project_count int, asset_class_mix map<string,double>, anomaly_score double",
    "alerts": "user_id string, name string, filters struct<firm_ids array<string>, signal_types array<string>, localities array<string>, asset_classes array<string>, min_score double>, channel string, channel_target string, is_active boolean, last_fired_at timestamp, fire_count int",
    "alert_deliveries": "alert_id string, signal_id string, channel string, status string, delivered_at timestamp, error string, attempts int",
    "digests": "period_start date, period_end date, title string, markdown string, pdf_path string, signal_count int, firm_count int, signal_ids array<string>, generated_at timestamp",
}
#: What must be unique in each table.
NATURAL_KEYS = {
    "firms": ("slug",), "firm_aliases": ("canonical_alias",), "firm_relationships": ("firm_a_id", "firm_b_id", "relation_type"), "sources": ("base_url",),
    "raw_documents": ("content_hash",), "document_chunks": ("document_id", "chunk_index"), "entity_candidates": ("canonical_mention",),
    "people": ("firm_id", "canonical_name"), "job_postings": ("firm_id", "title", "location"), "property_projects": ("canonical_name", "locality"),
    "permits": ("locality", "permit_number"), "signals": ("dedupe_key",), "trend_windows": ("firm_id", "locality", "period_start"),
    "alert_deliveries": ("alert_id", "signal_id"), "digests": ("period_start", "period_end"),
}
#: Rules for single rows; null passes, as in a database.
CHECKS = {
    "firms": "(lat IS NULL OR lat BETWEEN -90 AND 90) AND (lon IS NULL OR lon BETWEEN -180 AND 180)",
    "firm_aliases": "confidence IS NULL OR confidence BETWEEN 0 AND 1",
    "firm_relationships": "firm_a_id <> firm_b_id AND (weight IS NULL OR weight BETWEEN 0 AND 1)",
    "signals": "score IS NULL OR score BETWEEN 0 AND 1",
}


def ddl(table: str) -> str:
    return f"{_STAMPS}, {COLUMNS[table]}"


def row_id(*parts: Column) -> Column:
    """An id that follows from the natural key, so that a job run again gives the same one."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]).cast("binary"), 256), F.lit(32))


def in_vocabulary(c: Column, name: str) -> Column:
    return c.isin(*VOCABULARIES[name])


def broken_checks(df: DataFrame, table: str) -> DataFrame:
    """Rows that break the table's rule."""
    return df.where(F.expr(f"NOT ({CHECKS[table]})")) if table in CHECKS else df.limit(0)


def repeated_keys(df: DataFrame, table: str) -> DataFrame:
    """Natural keys that occur more than once, and how often."""
    return df.groupBy(*NATURAL_KEYS[table]).count().where("count > 1")


def undirected(edges: DataFrame, a: str = "firm_a_id", b: str = "firm_b_id") -> DataFrame:
    """Edges with their ends in order, loops left out."""
    return edges.withColumns({a: F.least(a, b), b: F.greatest(a, b)}).where(F.col(a) != F.col(b))
