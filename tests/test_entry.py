"""The registered queries against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plinth.plans import catalogue, made, more, searches  # noqa: F401  these register their queries
from plinth.plans import proxies as P

SF = "/root/testdata/sf0.001"
#: A tenth of the smallest tables' passages is less than a graph's layers need.
LARGER = {"vector_graph_recall": "/root/testdata/sf0.01"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, tmp_path, name):
    sf = LARGER.get(name, SF)
    catalogue.QUERIES[name](spark, sf).write.parquet(f"{tmp_path}/out")
    if name not in catalogue.ORACLE:
        return
    if sf != SF:
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    duck.execute(f"CREATE OR REPLACE TABLE want AS {catalogue.ORACLE[name]}")
    duck.execute(f"CREATE OR REPLACE VIEW got AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    kinds = [sorted(r[:2] for r in duck.sql(f"DESCRIBE {t}").fetchall()) for t in ("want", "got")]
    assert kinds[0] == kinds[1]
    names = ", ".join(f'"{k}"' for k, _ in kinds[0])
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.sql(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b}").fetchall() == []


def test_page_split_reads_the_whole_text_of_every_document(spark, duck):
    """As many chunks as the words of both halves need; none of a document's words is left out."""
    halves = "unnest([left(text, length(text) // 2), substr(text, length(text) // 2 + 1)])"
    words = duck.sql(f"SELECT doc_id, len(list_filter(regexp_split_to_array(h, '\\s+'), lambda v: v <> '')) AS n FROM (SELECT doc_id, {halves} AS h FROM documents)").fetchall()
    want: dict = {}
    for k, n in words:
        want[k] = want.get(k, 0) + (n > 0) + max(0, -(-(n - 346) // 308))
    got = catalogue.QUERIES["page_split_chunks_whole"](spark, SF).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {k: n for k, n in want.items() if n}


def test_queries_meet_all_rows(spark, duck):
    """As many permits and documents as there are; both kinds of document and of parcel."""
    parcels = catalogue.QUERIES["parcel_owner_enrich_all"](spark, SF).collect()
    assert len(parcels) == P.permits(spark, SF).count() and {r.parcel_id is None for r in parcels} == {True, False}
    scanned = catalogue.QUERIES["scanned_documents_all"](spark, SF).collect()
    assert len(scanned) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert len({r.page_count for r in scanned}) > 3 and {r.is_scanned for r in scanned} == {True, False}
    surges = {r.firm_id % 3 for r in catalogue.QUERIES["careers_surge_all"](spark, SF).collect()}
    assert surges == {0, 1, 2}


def _like_sql(spark, duck_dir, name, tmp_path):
    """A query's rows over the tables of a folder and those of its SQL."""
    c = duckdb.connect()
    for path in sorted(Path(duck_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    catalogue.QUERIES[name](spark, str(duck_dir)).write.parquet(f"{tmp_path}/out-{name}")
    c.execute(f"CREATE TABLE want AS {catalogue.ORACLE[name]}")
    names = ", ".join(f'"{r[0]}"' for r in c.sql("DESCRIBE want").fetchall())
    return [sorted(map(repr, c.sql(f"SELECT {names} FROM {t}").fetchall())) for t in ("want", f"read_parquet('{tmp_path}/out-{name}/*.parquet')")]


def test_headlines_with_references_cut_off(spark, tmp_path):
    """A heading that ends within a reference, or has other references than the ampersand's, is what SQL makes of it."""
    rows = [(1, "https://a.example.org/", "<h1>The&amp;&amp;&amp</h1>"), (2, "https://a.example.org/b", "<h1>x &quot;y&am</h1>"), (3, "https://a.example.org/c", "<h1>a &lt; b & c &amp;amp;</h1>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/in/pages.parquet")
    spark.read.parquet(f"{SF}/part.parquet").limit(8).write.parquet(f"{tmp_path}/in/part.parquet")
    want, got = _like_sql(spark, tmp_path / "in", "page_headlines", tmp_path)
    assert len(got) == 11 and got == want


def test_orders_are_numbered_without_one_task_for_all(spark):
    """Places by key over several runs of keys; no window is over all rows."""
    rows = spark.range(0, 300_000, 7).withColumn("half", F.col("id") % 2).repartition(5)
    got = made._numbered(rows, "id")
    assert got.where(F.col("n") != F.col("id") / 7).count() == 0 and got.count() == rows.count()
    largest = rows.groupBy((F.col("id") / made._RUN).cast("int")).count().agg(F.max("count")).first()[0]
    assert largest < rows.count() / 4
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "row_number() windowspecdefinition(__run" in plan
