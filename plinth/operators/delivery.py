"""Mail: the digest to all active users, and notes of enquiries to those who answer them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import naming
from plinth.operators import outbox
from plinth.operators.digest import latest


def html_escaped(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def digest_messages(digests: DataFrame, users: DataFrame, digest_id=None) -> DataFrame:
    """user_id, email, subject, html: the latest period's digest, or a given one, for each active user.

    The digest is one row, so it is broadcast. A user without an address gets no message.
    """
    one = digests.where(F.col("id") == digest_id) if digest_id is not None else latest(digests, "period_start")
    body = F.concat(F.lit("<pre style='font-family:monospace;white-space:pre-wrap'>"), html_escaped(F.col("markdown")), F.lit("</pre>"))
    shown = one.select(F.coalesce("title", F.concat(F.lit("Plinth Weekly Digest — "), F.col("period_start").cast("string"))).alias("subject"), body.alias("html"))
    to = users.where("is_active AND email IS NOT NULL AND email <> ''").select(F.col("id").alias("user_id"), "email")
    return to.crossJoin(F.broadcast(shown.limit(1)))


def contact_messages(leads: DataFrame, recipients: DataFrame) -> DataFrame:
    """lead_id, email, reply_to, subject, body: each enquiry for each recipient, one of each spelling.

    ``leads``: id, full_name, work_email, company, message. Recipients are the addresses of a setting, any number of them.
    """
    to = recipients.where("email IS NOT NULL AND trim(email) <> ''").groupBy(F.lower(F.trim("email")).alias("key")).agg(F.min(F.trim("email")).alias("email")).select("email")
    name = F.coalesce(naming.blank_to_null(F.col("full_name")), naming.local_part(F.col("work_email")))
    subject = F.concat(F.lit("New enquiry from "), name, F.coalesce(F.concat(F.lit(" ("), naming.blank_to_null(F.col("company")), F.lit(")")), F.lit("")))
    body = F.concat_ws("\n", F.concat(F.lit("Name: "), name), F.concat(F.lit("Email: "), "work_email"), F.concat(F.lit("Company: "), naming.blank_to_null(F.col("company"))), F.lit(""), F.coalesce(naming.blank_to_null(F.col("message")), F.lit("(no message)")))
    rows = leads.select(F.col("id").alias("lead_id"), F.col("work_email").alias("reply_to"), subject.alias("subject"), body.alias("body"))
    return rows.crossJoin(to)  # the output is every enquiry for every recipient


def sent(messages: DataFrame, sink: Any, body: str, folder: str | None = None) -> DataFrame:
    """recipients, sent, errors: one row, after the sink has taken all messages on the executors; a failed one stops none, equal rows go once."""
    id_ = F.sha2(F.to_json(F.struct(*[c for c in messages.columns if c != body])), 256)
    told = outbox.sent(messages.select(id_.alias("message_id"), F.lit("email").alias("channel"), F.col("email").alias("target"), F.col(body).alias("body")), sink, folder)
    n, ok = F.count("*"), F.count_if("ok")
    return told.agg(n.alias("recipients"), ok.alias("sent"), (n - ok).alias("errors"))
