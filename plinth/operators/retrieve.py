"""Retrieval: nearest chunks, cited and cut to a character budget; search for firms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import fuzzy, vectors
from plinth.functions import text as T

# Defaults.
LEAST_SIMILARITY, TOP_K, CONTEXT_CHARS, MOST_DISTANCE, LEAST_TRIGRAM = 0.35, 8, 12_000, 0.5, 0.1


def top_chunks(chunks: DataFrame, query, firm_id=None, k: int = TOP_K, least: float = LEAST_SIMILARITY, key: str = "id") -> DataFrame:
    """The ``k`` chunks nearest to a query vector, with distance; similarity ``least`` or more."""
    rows = chunks.where(F.col("embedding").isNotNull())
    rows = rows.where(F.col("firm_id") == firm_id) if firm_id is not None else rows
    rows = rows.withColumn("distance", vectors.cosine_distance(F.col("embedding"), vectors.literal_vector(query)))
    return rows.where(F.col("distance") <= 1 - least).orderBy("distance", key).limit(k)


def with_sources(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's addresses: joined after the top few are known."""
    return found.join(documents.select(F.col("id").alias("document_id"), "url", "final_url"), "document_id")


def context(found: DataFrame, budget: int = CONTEXT_CHARS, key: str = "id") -> DataFrame:
    """Cited passages in order: rank, url, page_number, excerpt, passage; the one that crosses the budget is the last.

    ``found`` has at most a few rows (the top k), so one window over all of them is right.
    """
    before = Window.orderBy("distance", key).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    rows = found.withColumn("__used", used).withColumn("rank", F.row_number().over(Window.orderBy("distance", key))).where(F.col("__used") < budget)
    page = F.when(F.coalesce("page_number", F.lit(0)) != 0, F.concat(F.lit(" (p. "), F.col("page_number").cast("string"), F.lit(")"))).otherwise("")
    head = F.concat(F.lit("[Source: "), "url", page, F.lit(" | similarity="), F.bround(1 - F.col("distance"), 3).cast("string"), F.lit("]\n"))
    return rows.select("rank", F.coalesce("final_url", "url").alias("url"), "page_number", T.shorten(F.col("text")).alias("excerpt"), F.concat(head, "text").alias("passage"))


def ask(chunks: DataFrame, documents: DataFrame, query, firm_id=None, k: int = TOP_K, least: float = LEAST_SIMILARITY, answer: Callable[[str], str] | None = None) -> DataFrame:
    """One row: answer, citations, passages_found. ``answer`` maps the context to a text; without it the count is told."""
    found = with_sources(top_chunks(chunks, query, firm_id, k, least), documents)
    rows = context(found)
    cited = rows.agg(F.sort_array(F.collect_list(F.struct("rank", "url", "page_number", "excerpt"))).alias("citations"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "passage"))), lambda x: x["passage"]), "\n\n---\n\n").alias("context"))
    out = cited.crossJoin(found.agg(F.count("*").alias("passages_found")))  # one row each
    plain = F.concat(F.lit("No language model is set. Found "), F.col("passages_found").cast("string"), F.lit(" relevant passages."))
    none = F.lit("There is not enough in the corpus to answer that question.")
    said = plain if answer is None else F.udf(answer, "string")("context")
    return out.select(F.when(F.col("passages_found") == 0, none).otherwise(said).alias("answer"), "citations", "passages_found")


def facets(asset_classes=(), localities=()) -> Column:
    """Over firms: active, any of the classes, any of the localities; an empty list asks for nothing."""
    out = F.col("is_active")
    for name, wanted in (("asset_classes", asset_classes), ("localities", localities)):
        if wanted:
            out = out & F.coalesce(F.arrays_overlap(name, F.array(*[F.lit(w) for w in wanted])), F.lit(False))
    return out


def search_semantic(firms: DataFrame, query, limit: int = 20, asset_classes=(), localities=(), most: float = MOST_DISTANCE) -> DataFrame:
    """Firms nearest to a query vector; those without an embedding are left out."""
    rows = firms.where(facets(asset_classes, localities)).withColumn("distance", vectors.cosine_distance(F.col("embedding"), vectors.literal_vector(query)))
    return rows.where(F.col("distance") <= most).orderBy("distance", "id").limit(limit)


def search_trigram(firms: DataFrame, query: str, limit: int = 20, asset_classes=(), localities=(), least: float = LEAST_TRIGRAM) -> DataFrame:
    """Firms whose names are like a query."""
    rows = firms.where(facets(asset_classes, localities)).withColumn("similarity", fuzzy.similarity(F.col("name"), F.lit(query)))
    return rows.where(F.col("similarity") > least).orderBy(F.desc("similarity"), "id").limit(limit)


def search_firms(firms: DataFrame, query: str, limit: int = 20, asset_classes=(), localities=(), model=vectors.hashing_model) -> tuple[DataFrame, bool]:
    """Semantic search if any firm has an embedding, else by trigrams; and which of the two."""
    if firms.where("embedding IS NOT NULL").limit(1).count():
        return search_semantic(firms, model([query])[0].tolist(), limit, asset_classes, localities), True
    return search_trigram(firms, query, limit, asset_classes, localities), False
