import json
from datetime import datetime

import pytest

from plinth import schemas
from plinth.cli import main
from plinth.store import Store

NOW = "2026-04-01 08:00:00"
FIRMS = """
firms:
  - {name: "Stanley Martin Companies, LLC", website: "https://s.example.org", county: Fairfax, careers_path: /careers, aliases: [SM Homes]}
  - {name: "Comstock Holding Companies", website: "https://c.example.org"}
"""
SOURCES = "sources: [{name: News, kind: news, base_url: 'https://n.example.org', verified: true}]\n"
ARTICLE = "<h1>Stanley Martin Companies, LLC breaks ground</h1><p>The developer broke ground on a mixed-use development of 240 units in Reston.</p>" + "<p>More about this construction and its acres.</p>" * 8


def feed(day):
    ms = int(datetime(2026, 3, day).timestamp() * 1000)
    return {"features": [{"attributes": {"RECORDID": f"P{k}", "PROJECT_NAME": "Stanley Martin Comapnies LLC" if k % 2 else "Somebody Else", "APPTYPEALIAS": "Data Center Site Plan", "ESTIMATED_COST": 2e6, "SUBMITTED_DATE": ms, "PARCEL_ID": f"parcel{k}"}} for k in range(4)]}


@pytest.fixture
def run(spark, tmp_path):
    (tmp_path / "firms.yaml").write_text(FIRMS)
    (tmp_path / "sources.yaml").write_text(SOURCES)
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/page-0.json").write_text(json.dumps(feed(2)))
    (tmp_path / "owners.json").write_text(json.dumps({"parcel_id": "parcel0", "owner_name": "SM Homes"}) + "\n")
    (tmp_path / "probes.json").write_text(json.dumps({"base_url": "https://n.example.org", "status": 200, "final_url": "https://n.example.org/"}) + "\n")
    spark.createDataFrame([("https://n.example.org", ARTICLE, 200)], "url string, html string, status int").write.parquet(f"{tmp_path}/pages")
    return lambda *argv: main(["--store", f"file://{tmp_path}/store", "--now", NOW, *[a.replace("@", f"{tmp_path}/") for a in argv]], spark)


def counts(df):
    return {r[0]: r[1] for r in df.collect()}


def test_the_jobs_in_turn(spark, run, tmp_path):
    for _ in range(2):  # seeding again changes nothing
        got = counts(run("seed", "--firms", "@firms.yaml", "--sources", "@sources.yaml"))
        assert (got["firms"], got["firm_aliases"], got["sources"]) == (2, 1, 4)
    assert counts(run("verify-seeds", "--probes", "@probes.json")) == {"ok": 1, "broken": 3}

    config = json.dumps({"service_url": "https://x.example.org", "layer_id": 0})
    feed_args = ("permits", "--adapter", "arcgis", "--locality", "Fairfax", "--pages", "@feed", "--config", config)
    assert tuple(run(*feed_args).first()) == (4, 0, 2, 0, 2, 4)
    assert tuple(run(*feed_args).first()) == (0, 4, 2, 0, 2, 0)
    assert tuple(run("enrich-permits", "--owners", "@owners.json", "--locality", "Fairfax").first()) == (2, 1, 0, 1, 0)
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.read("permits").where("firm_id IS NOT NULL").count() == 3 and s.read("signals").where("firm_id IS NULL").count() == 1

    assert run("news", "--pages", "@pages").first().stored == 1
    assert run("news", "--pages", "@pages").count() == 0  # not due again
    assert counts(run("extract", "--task", "press_release"))["property_projects"] == 1
    assert counts(run("embed"))["document_chunks"] == 1

    got = run("trends", "--as-of", "2026-04-01").first()
    assert (got.pivots, got.expansions, got.anomalies) == (1, 1, 0)
    assert run("trends", "--as-of", "2026-04-01").first().signals_emitted == 2
    assert s.read("trend_windows").count() == 10
    told = run("digest", "--as-of", "2026-03-04 00:00:00").first()
    assert told.firm_count == 1 and "Stanley Martin" in told.markdown

    rows = [("a", "u", "all", (None, ["permit_filing"], None, None, None), "email", "x@example.org", True, None, 0)]
    s.write("alerts", spark.createDataFrame(rows, "id string, user_id string, name string, filters struct<firm_ids array<string>, signal_types array<string>, localities array<string>, asset_classes array<string>, min_score double>, channel string, channel_target string, is_active boolean, last_fired_at timestamp, fire_count int"))
    assert run("deliver-alerts").first().body.count("•") == 4
    assert run("deliver-alerts").count() == 0 and s.read("alert_deliveries").where("status = 'sent'").count() == 4
    assert counts(run("status"))["permits"] == 4 and run("failing").count() == 0
    for name in schemas.NATURAL_KEYS:
        assert schemas.repeated_keys(s.read(name), name).count() == 0, name


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    from pyspark.sql import functions as F

    s = Store(spark, f"file://{tmp_path}/store")
    assert s.read("digests").count() == 0
    s.write("digests", spark.createDataFrame([("t",)], "title string"))
    with pytest.raises(Exception, match="boom"):
        s.write("digests", s.read("digests").withColumn("title", F.raise_error(F.lit("boom")).cast("string")))
    assert (s.version("digests"), s.read("digests").first().title) == (1, "t")
    s.write("digests", s.read("digests").withColumn("title", F.lit("u")))
    s.vacuum("digests")
    assert s.read("digests").first().title == "u"
    with pytest.raises(ValueError, match="unknown table"):
        s.write("nope", s.read("digests"))


def test_crawl_follows_links_and_pdfs(spark, run, tmp_path):
    run("seed", "--firms", "@firms.yaml", "--sources", "@sources.yaml")
    s = Store(spark, f"file://{tmp_path}/store")
    config = "named_struct('follow_links', true, 'link_pattern', 'minutes', 'max_links', 2)"
    s.write("sources", s.read("sources").selectExpr("* EXCEPT (config)", f"IF(kind = 'news', {config}, config) AS config"))
    base = "https://n.example.org"
    index = f'<p>{"index text " * 40}</p><a href="/minutes/1">1</a><a href="/other">o</a><a href="/minutes/2.pdf">2</a><a href="/minutes/3">3</a>'
    spark.createDataFrame([(base, index, 200), (f"{base}/minutes/1", "<p>" + "minutes of the board " * 30 + "</p>", 200), (f"{base}/minutes/3", "<p>" + "too many " * 60 + "</p>", 200)], "url string, html string, status int").write.parquet(f"{tmp_path}/linked")
    spark.createDataFrame([(f"{base}/minutes/2.pdf", 1, "page one " * 40, "## Page one\n" + "page one " * 40), ("elsewhere", 1, "x", "x")], "doc_id string, page int, text string, markdown string").write.parquet(f"{tmp_path}/pdfs")
    assert run("news", "--pages", "@linked", "--pdfs", "@pdfs").first().stored == 3
    got = {r.url: r.content_type for r in s.read("raw_documents").collect()}
    assert got == {base: "html", f"{base}/minutes/1": "html", f"{base}/minutes/2.pdf": "pdf"}


def test_a_crash_between_rows_and_pointer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([("a", "one")], "id string, title string")
    s.write("digests", one)
    put = Store._put_in_force
    monkeypatch.setattr(Store, "_put_in_force", lambda *args: (_ for _ in ()).throw(RuntimeError("killed")))
    for change in (s.write, s.append):
        with pytest.raises(RuntimeError, match="killed"):
            change("digests", one.withColumn("title", one.title))
    assert s.version("digests") == 1 and [r.title for r in s.read("digests").collect()] == ["one"]
    monkeypatch.setattr(Store, "_put_in_force", put)
    s.append("digests", one)
    assert s.version("digests") == 2 and s.read("digests").count() == 2
    # Two writers of one version: the second fails.
    with pytest.raises(RuntimeError, match="another job"):
        s._put_in_force("digests", 2, [])
    s.vacuum("digests")
    assert s.read("digests").count() == 2


def test_deliver_digest(spark, run, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.write("digests", spark.sql("SELECT 'a' AS id, DATE '2026-01-05' AS period_start, 'T' AS title, '# x' AS markdown"))
    (tmp_path / "users.json").write_text("\n".join(json.dumps(u) for u in ({"id": "1", "email": "a@x.org", "is_active": True}, {"id": "2", "email": "b@x.org", "is_active": False}, {"id": "3", "is_active": True})))
    assert tuple(run("deliver-digest", "--users", "@users.json").first()) == (1, 1, 0)
