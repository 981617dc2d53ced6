"""People and jobs: what changed between the stored state and a fresh rendering, and its signals."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import classify, dates, naming
from plinth.operators.upsert import first_rows, new_only
from plinth.schemas import row_id

# Scores and the rule for a surge.
HIRE, DEPARTURE, SURGE_SCORE, SURGE_OPEN, SURGE_RATIO = (0.8, 0.45), (0.7, 0.35), 0.65, 5, 1.5


class Diff(NamedTuple):
    state: DataFrame  # the table's next state, with __change
    signals: DataFrame  # new rows only


def _signal(kind: str, title: Column, summary: Column, score: Column, key: Column, payload: Column, now: Column) -> list[Column]:
    return [
        row_id(key).alias("id"), "firm_id", F.lit(kind).alias("signal_type"), F.left(title, F.lit(400)).alias("title"), summary.alias("summary"), score.alias("score"),
        now.alias("occurred_at"), now.alias("detected_at"), payload.alias("payload"), F.lit(False).alias("is_derived"), F.left(key, F.lit(200)).alias("dedupe_key"),
    ]


def roster_diff(old: DataFrame, rendered: DataFrame, signals: DataFrame, now: Column) -> Diff:
    """``rendered`` (firm_id, place, name, title, email, linkedin_url) against people.

    Firms without any rendered member are left as they are: their page failed. The first
    member of a key counts. A member who comes back is current again, keeps the old end
    date and makes no signal; an absent one who was current has left.
    """
    named = rendered.withColumn("canonical_name", naming.normalize_person(F.col("name"))).where("canonical_name <> ''")
    new = first_rows(named, ["firm_id", "canonical_name"], ["place"]).drop("place")
    seen_firms = rendered.select("firm_id").distinct()
    scope = old.join(seen_firms, "firm_id", "left_semi")
    rest = old.join(seen_firms, "firm_id", "left_anti").withColumn("__change", F.lit("keep"))
    j = scope.withColumn("__o", F.lit(True)).alias("o").join(new.withColumn("__n", F.lit(True)).alias("n"), ["firm_id", "canonical_name"], "full_outer")
    was, comes = F.col("o.__o").isNotNull(), F.col("n.__n").isNotNull()
    left = was & ~comes & F.col("o.is_current")
    title = F.coalesce(F.nullif("n.title", F.lit("")), "o.title")
    change = F.when(comes & ~was, "hire").when(left, "departure").when(comes, "update").otherwise("keep")
    values = {
        "id": F.coalesce("o.id", row_id(F.col("firm_id"), F.col("canonical_name"))),
        "name": F.coalesce("o.name", "n.name"),
        "title": F.when(was & ~comes, F.col("o.title")).when(~was, F.col("n.title")).otherwise(title),
        "role_type": F.when(comes & (~was | (F.coalesce("n.title", F.lit("")) != "")), classify.role(F.col("n.title"))).otherwise(F.col("o.role_type")),
        "email": F.coalesce("o.email", F.when(~was, F.col("n.email"))),
        "linkedin_url": F.coalesce("o.linkedin_url", F.when(~was, F.col("n.linkedin_url"))),
        "end_date": F.when(left, now.cast("date")).otherwise(F.col("o.end_date")),
        "is_current": F.when(comes, True).when(left, False).otherwise(F.col("o.is_current")),
        "first_seen_at": F.when(was, F.col("o.first_seen_at")).otherwise(now),
        "last_seen_at": F.when(comes, now).otherwise(F.col("o.last_seen_at")),
    }
    more = [c for c in old.columns if c not in values and c not in ("firm_id", "canonical_name")]
    state = j.select("firm_id", "canonical_name", *[v.alias(k) for k, v in values.items()], *[F.col(f"o.{c}").alias(c) for c in more], change.alias("__change"))
    senior, who = classify.is_senior(F.col("title")), F.coalesce(F.nullif("title", F.lit("")), F.lit("team member"))
    payload = F.to_json(F.struct("name", "title"))
    stamp = F.concat(F.lit(":"), F.col("firm_id").cast("string"), F.lit(":"), "canonical_name", F.lit(":"), dates.quarter_key(now))
    hires = state.where("__change = 'hire'").select(*_signal("key_hire", F.concat("name", F.lit(" joined as "), who), F.concat("name", F.lit(" now appears on the team page as "), F.coalesce(F.nullif("title", F.lit("")), F.lit("a team member")), F.lit(".")), F.when(senior, HIRE[0]).otherwise(HIRE[1]), F.concat(F.lit("hire"), stamp), payload, now))
    gone = state.where("__change = 'departure'").select(*_signal("departure", F.concat("name", F.lit(" no longer listed as "), who), F.concat("name", F.lit(" has been removed from the firm's team page.")), F.when(senior, DEPARTURE[0]).otherwise(DEPARTURE[1]), F.concat(F.lit("departure"), stamp), payload, now))
    return Diff(state.unionByName(rest, allowMissingColumns=True), new_only(hires.unionByName(gone), signals, ["dedupe_key"], ["id"]))


def job_diff(old: DataFrame, rendered: DataFrame, signals: DataFrame, now: Column) -> Diff:
    """``rendered`` (firm_id, place, title, location, employment_type, url) against job postings.

    Postings are the same if title and location are, in lower case; of stored ones that are
    the same, the one with the least id is diffed and the others stay as they are. Firms
    without any rendered posting are left as they are. Five open roles or more are a surge if there
    were none before, or if there are half as many again.
    """
    key = [F.lower("title").alias("__t"), F.lower(F.coalesce("location", F.lit(""))).alias("__l")]
    new = first_rows(rendered.select("*", *key), ["firm_id", "__t", "__l"], ["place"]).drop("place")
    seen_firms = rendered.select("firm_id").distinct()
    same = Window.partitionBy("firm_id", "__t", "__l").orderBy("id")
    numbered = old.join(seen_firms, "firm_id", "left_semi").select("*", *key).withColumn("__k", F.row_number().over(same))
    scope = numbered.where("__k = 1").drop("__k")
    others = numbered.where("__k > 1").select(*old.columns)
    rest = old.join(seen_firms, "firm_id", "left_anti").select(*old.columns).unionByName(others).withColumn("__change", F.lit("keep"))
    j = scope.withColumn("__o", F.lit(True)).alias("o").join(new.withColumn("__n", F.lit(True)).alias("n"), ["firm_id", "__t", "__l"], "full_outer")
    was, comes = F.col("o.__o").isNotNull(), F.col("n.__n").isNotNull()
    change = F.when(comes & ~was, "open").when(comes & ~F.col("o.is_open"), "reopen").when(comes, "update").when(F.col("o.is_open"), "close").otherwise("keep")
    values = {
        "id": F.coalesce("o.id", row_id(F.col("firm_id"), F.col("__t"), F.col("__l"))),
        "title": F.coalesce("o.title", "n.title"),
        "location": F.when(was, F.col("o.location")).otherwise(F.col("n.location")),
        "is_open": F.when(comes, True).otherwise(False),
        "first_seen_at": F.when(was, F.col("o.first_seen_at")).otherwise(now),
        "last_seen_at": F.when(comes, now).otherwise(F.col("o.last_seen_at")),
        "closed_at": F.when(comes, F.lit(None)).when(F.col("o.is_open"), now).otherwise(F.col("o.closed_at")),
    }
    more = [c for c in old.columns if c not in values and c != "firm_id"]
    state = j.select("firm_id", *[v.alias(k) for k, v in values.items()], *[(F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in rendered.columns else F.col(f"o.{c}")).alias(c) for c in more], change.alias("__change"))
    counts = state.groupBy("firm_id").agg(
        F.count_if(F.col("__change").isin("update", "close")).alias("open_before"),
        F.count_if("is_open").alias("open_after"),
    )
    surge = counts.where((F.col("open_after") >= SURGE_OPEN) & ((F.col("open_before") == 0) | (F.col("open_after") >= F.col("open_before") * SURGE_RATIO)))
    b, a = F.col("open_before").cast("string"), F.col("open_after").cast("string")
    rows = surge.select(
        *_signal(
            "hiring_surge", F.concat(F.lit("Open roles rose from "), b, F.lit(" to "), a),
            F.concat(F.lit("The firm's careers page went from "), b, F.lit(" to "), a, F.lit(" open roles, which often precedes a new project.")), F.lit(SURGE_SCORE),
            dates.window_key(F.lit("hiring_surge"), F.col("firm_id").cast("string"), F.date_format(now, "yyyy-MM-dd")), F.to_json(F.struct("open_before", "open_after")), now,
        )
    )
    return Diff(state.unionByName(rest, allowMissingColumns=True), new_only(rows, signals, ["dedupe_key"], ["id"]))
