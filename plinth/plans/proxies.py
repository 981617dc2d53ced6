"""The domain's tables, made from the test tables by expression; each has its twin in SQL.

The dates that queries hold against are fixed: permits end in 2001, events in January 2024.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.session import table

AS_OF_PERMITS, AS_OF_EVENTS, EVENT_DAYS = "1998-01-01", "2024-01-31", 5
#: Types of permits by part size, so that each asset class occurs.
PERMIT_TYPES = ("Data Center Site Plan", "Residential Addition", "Industrial Shell", "Warehouse Fit-Out", "Office Interior", "Retail Sign", "Mixed Use Rezoning", "Hospitality New", "Demolition", "Commercial Multifamily")
_TYPE_SQL = "['" + "', '".join(PERMIT_TYPES) + "'][p_size % 10 + 1]"

SQL = {
    "firms": "SELECT c_custkey AS id, c_name AS name, n_name AS county, c_mktsegment AS firm_type, true AS is_active FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "permits": "SELECT o_orderkey AS permit_number, o_custkey AS firm_id, n_name AS locality, CAST(o_orderdate AS DATE) AS filed_date, CAST(o_orderdate AS DATE) AS issued_date, o_totalprice * 150 AS valuation_usd, o_orderpriority AS permit_type, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "filings": f"SELECT o_custkey AS firm_id, n_name AS locality, CAST(l_shipdate AS DATE) AS filed_date, {_TYPE_SQL} AS permit_type, l_extendedprice AS valuation_usd FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    "signals": "SELECT event_id AS id, user_id AS firm_id, CASE event_type WHEN 'signup' THEN 'key_hire' WHEN 'error' THEN 'departure' WHEN 'purchase' THEN 'land_acquisition' WHEN 'click' THEN 'hiring_surge' ELSE 'new_project' END AS signal_type, concat(event_type, ' of ', user_id) AS title, least(1.0, value / 200) AS score, concat('L', user_id % 7) AS locality, CASE WHEN event_id % 3 = 0 THEN 'office' WHEN event_id % 3 = 1 THEN 'retail' END AS asset_class, ts AS occurred_at, ts AS detected_at, event_type = 'click' AS is_derived, props AS payload, concat(event_type, ':', user_id, ':', strftime(ts, '%Y-%m-%d')) AS dedupe_key FROM events",
    "jobs": "SELECT user_id AS firm_id, ts AS first_seen_at, lead(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS closed_at, event_type FROM events",
}
#: A job opens with a sign-up and closes with the user's next error.
SQL["jobs"] = f"SELECT firm_id, first_seen_at, closed_at FROM ({SQL['jobs']}) WHERE event_type = 'signup'"


def with_sql(names: str, body: str) -> str:
    """SQL over the named tables; a body that begins with a comma adds tables of its own."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split()) + "\n" + body


def firms(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    c = table(spark, d, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("county"), F.col("c_mktsegment").alias("firm_type"), F.lit(True).alias("is_active"))


def permits(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    rows = o.select(F.col("o_orderkey").alias("permit_number"), F.col("o_custkey").alias("firm_id"), day.alias("filed_date"), day.alias("issued_date"), (F.col("o_totalprice") * 150).alias("valuation_usd"), F.col("o_orderpriority").alias("permit_type"), F.col("o_orderstatus").alias("status"))
    where = firms(spark, d).select(F.col("id").alias("firm_id"), F.col("county").alias("locality"))
    return rows.join(where, "firm_id")


def permit_type(size: str = "p_size"):
    return F.array(*[F.lit(t) for t in PERMIT_TYPES])[F.col(size) % 10]


def filings(spark: SparkSession, d: str) -> DataFrame:
    """Permits by line item: no key, several localities for each firm."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("filed_date"), F.col("l_extendedprice").alias("valuation_usd"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("firm_id"))
    p = table(spark, d, "part").select("p_partkey", permit_type().alias("permit_type"))
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    where = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("locality"))
    out = line.join(o, line.l_orderkey == o.o_orderkey).join(p, line.l_partkey == p.p_partkey).join(where, line.l_suppkey == where.s_suppkey)
    return out.select("firm_id", "locality", "filed_date", "permit_type", "valuation_usd")


def signals(spark: SparkSession, d: str) -> DataFrame:
    return signal_columns(table(spark, d, "events"))


def signal_columns(events: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as signals."""
    kind = F.when(F.col("event_type") == "signup", "key_hire").when(F.col("event_type") == "error", "departure").when(F.col("event_type") == "purchase", "land_acquisition").when(F.col("event_type") == "click", "hiring_surge").otherwise("new_project")
    user = F.col("user_id").cast("string")
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("firm_id"), kind.alias("signal_type"), F.concat("event_type", F.lit(" of "), user).alias("title"),
        F.least(F.lit(1.0), F.col("value") / 200).alias("score"), F.concat(F.lit("L"), (F.col("user_id") % 7).cast("string")).alias("locality"),
        F.when(F.col("event_id") % 3 == 0, "office").when(F.col("event_id") % 3 == 1, "retail").alias("asset_class"), F.col("ts").cast("timestamp").alias("occurred_at"), F.col("ts").cast("timestamp").alias("detected_at"),
        (F.col("event_type") == "click").alias("is_derived"), F.col("props").alias("payload"), F.concat("event_type", F.lit(":"), user, F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("dedupe_key"),
    )


def jobs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    closed = F.first(F.when(F.col("event_type") == "error", F.col("ts").cast("timestamp")), ignorenulls=True).over(w)
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return e.withColumn("closed_at", closed).where("event_type = 'signup'").select(F.col("user_id").alias("firm_id"), F.col("ts").alias("first_seen_at"), "closed_at")


def no_projects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "firm_id long, locality string, announced_date date")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("text").alias("cleaned_text"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("firm_id"), "embedding")
