"""The weekly digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import day_label
from plinth.operators.upsert import upsert
from plinth.schemas import LEAD_TYPES, row_id
from plinth.session import workers_find_package

# The floor, the days, and how many lines a section has.
SCORE_FLOOR, DAYS, LINES, ERROR_LINES, PROMPT_LINES = 0.5, 7, 10, 5, 20


def week_start(as_of: Column) -> Column:
    """Monday, midnight UTC."""
    return F.date_trunc("week", as_of)


def digest_signals(signals: DataFrame, as_of: Column, least: float = SCORE_FLOOR, days: int = DAYS) -> DataFrame:
    """Signals of firms from Monday on for ``days``, both ends included."""
    start = week_start(as_of)
    return signals.where((F.col("occurred_at") >= start) & (F.col("occurred_at") <= F.timestamp_add("DAY", F.lit(days), start)) & (F.col("score") >= least) & F.col("firm_id").isNotNull())


def ranked(selected: DataFrame) -> DataFrame:
    """With is_lead, line and rank inside the firm: lead types first, then by score, then by id."""
    lead = F.col("signal_type").isin(*LEAD_TYPES)
    line = F.concat(F.when(lead, "★").otherwise("·"), F.lit(" ["), day_label(F.col("occurred_at")), F.lit("] "), "title")
    w = Window.partitionBy("firm_id").orderBy(F.desc("is_lead"), F.desc("score"), "id")
    return selected.withColumn("is_lead", lead).withColumn("line", line).withColumn("rank", F.row_number().over(w))


def sections(signals: DataFrame, firms: DataFrame, as_of: Column, least: float = SCORE_FLOOR, days: int = DAYS, narrate: Callable[[str, str], str] | None = None) -> DataFrame:
    """firm_id, firm_name, max_score, n_signals, signal_ids, narrative of each known firm.

    The narrative is a list of the first ten lines; ``narrate`` (firm name, twenty lines) may write another.
    Where it returns nothing the list stands; where it fails, the list's first five lines.
    """
    chosen = digest_signals(signals, as_of, least, days)
    first = ranked(chosen).where(F.col("rank") <= max(LINES, PROMPT_LINES))
    top = lambda n, mark: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", "line")))), lambda x: F.concat(F.lit(mark), x["line"])), "\n")
    lines = first.groupBy("firm_id").agg(top(LINES, "- ").alias("narrative"), top(PROMPT_LINES, "").alias("prompt"), top(ERROR_LINES, "- ").alias("short"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), lambda x: x["id"])
    g = chosen.groupBy("firm_id").agg(F.max("score").alias("max_score"), F.count("*").alias("n_signals"), ids.alias("signal_ids")).join(lines, "firm_id")
    out = g.join(firms.select(F.col("id").alias("firm_id"), F.col("name").alias("firm_name")), "firm_id")
    if narrate is not None:
        workers_find_package(signals.sparkSession)

        def told(name: str, lines: str) -> tuple[str | None, bool]:
            try:
                return narrate(name, lines), False
            except Exception:  # noqa: BLE001  a model may fail in any way; the digest goes on
                return None, True

        out = out.withColumn("__told", F.udf(told, "text string, failed boolean")("firm_name", "prompt"))
        out = out.withColumn("narrative", F.when(F.col("__told.failed"), F.col("short")).otherwise(F.coalesce("__told.text", "narrative")))
    return out.select("firm_id", "firm_name", "max_score", "n_signals", "signal_ids", "narrative")


def digest(signals: DataFrame, firms: DataFrame, as_of: Column, product: str = "Plinth", **options) -> DataFrame:
    """The digest's row, or none without a section: firms by their best score, then by name.

    One document is one row; sections are ten lines for each firm, so its size follows the firms.
    """
    parts = sections(signals, firms, as_of, **options)
    days = options.get("days", DAYS)
    start, end = week_start(as_of).cast("date"), F.date_add(week_start(as_of).cast("date"), days)
    label = F.concat(F.date_format(start, "MMMM d"), F.lit("–"), F.date_format(end, "MMMM d, yyyy"))
    one = F.struct((-F.col("max_score")).alias("o"), "firm_name", F.concat(F.lit("## "), "firm_name", F.lit("\n\n"), "narrative").alias("text"), "signal_ids")
    g = parts.agg(F.sort_array(F.collect_list(one)).alias("p"), F.sum("n_signals").cast("int").alias("signal_count"), F.count("*").cast("int").alias("firm_count")).where("firm_count > 0")
    body = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n---\n\n")
    return g.select(
        row_id(start, end).alias("id"), start.alias("period_start"), end.alias("period_end"), F.concat(F.lit(f"{product} Weekly — "), label).alias("title"),
        F.concat(F.lit(f"# {product} Weekly Digest — "), label, F.lit("\n\n"), body).alias("markdown"), "signal_count", "firm_count",
        F.transform(F.flatten(F.transform("p", lambda x: x["signal_ids"])), lambda i: i.cast("string")).alias("signal_ids"), as_of.cast("timestamp").alias("generated_at"),
    )


def store_digest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Digests with the new one; a period's stored title stays."""
    return upsert(old, new, ["period_start", "period_end"], overwrite=["markdown", "signal_count", "firm_count", "signal_ids", "generated_at"], keep=["id", "title"])


def latest(digests: DataFrame, by: str = "generated_at") -> DataFrame:
    return digests.orderBy(F.desc_nulls_last(by), "id").limit(1)


def recipients(users: DataFrame) -> DataFrame:
    """Active users with an address, one of each spelling."""
    return users.where("is_active AND email IS NOT NULL").groupBy(F.lower(F.trim("email")).alias("email")).agg(F.min("id").alias("user_id"))
