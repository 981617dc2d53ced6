from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.functions import classify, dates, fuzzy, naming, vectors
from plinth.functions import text as T


@pytest.mark.parametrize(
    ("f", "given_", "want"),
    [
        (naming.basic_normalize, "Smith & Jones", "smith and jones"),
        (naming.basic_normalize, "Société  Générale", "societe generale"),
        (naming.basic_normalize, "ﬁne Straße", "fine straße"),
        (naming.canonicalize, "Comstock Holding Companies, Inc.", "comstock holding"),
        (naming.canonicalize, "Acme L.L.C.", "acme"),
        (naming.canonicalize, "Reston Station Phase III LLC", "reston station"),
        (naming.canonicalize, "LLC", "llc"),
        (naming.canonicalize, "Co LLC", "co"),
        (naming.canonicalize, "Phase IV", "phase iv"),
        (naming.canonicalize, "...", ""),
        (naming.canonicalize, "", ""),
        (naming.normalize_phone, "+1 703 555 0100", "7035550100"),
        (naming.normalize_phone, "(703) 555-0100", "7035550100"),
        (naming.normalize_phone, "555-0100", None),
        (naming.normalize_phone, None, None),
        (naming.normalize_address, "1900 Reston Boulevard, Suite 200", "1900 reston blvd ste 200"),
        (naming.normalize_address, "100 North Main Street", "100 n main st"),
        (naming.normalize_address, "", None),
        (naming.normalize_person, "Robert Smith, CCIM", "robert smith"),
        (naming.normalize_person, "Dr. Jane Doe Jr., MBA", "jane doe"),
        (naming.normalize_person, "MBA", ""),
        (naming.slugify, "Comstock Holding Companies, Inc.", "comstock-holding-companies-inc"),
        (naming.slugify, "...", "firm"),
        (naming.local_part, "jane@example.org", "jane"),
        (naming.blank_to_null, "  ", None),
        (T.shorten, "a  b\nc", "a b c"),
        (T.looks_like_challenge, "Please Verify you are HUMAN", True),
        (classify.asset_class, "A warehouse of 12 acres", "industrial"),
        (classify.asset_class, "Nothing", None),
        (classify.permit_asset_class, "Warehouse Fit-Out", "logistics"),
        (classify.locality, "From Tysons to Reston", "Tysons"),
        (classify.parse_money, "worth $1.5 billion", 1.5e9),
        (classify.parse_money, "worth $120,000,000", 1.2e8),
        (classify.parse_money, "worth nothing", None),
        (classify.units, "its 1,240 apartment units", 1240),
        (classify.square_feet, "310,000-square-foot hall", 310000),
        (classify.acres, "on 12.5 acres", 12.5),
        (classify.role, "Senior Vice President, Leasing", "executive"),
        (classify.role, None, "other"),
        (classify.headline_signal, "Firm purchased a site", "land_acquisition"),
        (dates.epoch_millis_to_date, "1629158400000", date(2021, 8, 17)),
        (dates.epoch_millis_to_date, "-86400000", date(1969, 12, 31)),
        (dates.epoch_millis_to_date, "0", None),
        (dates.epoch_millis_to_date, "junk", None),
        (dates.iso_date, "2026-03-14T00:00:00", date(2026, 3, 14)),
        (dates.iso_date, "03/14/2026", date(2026, 3, 14)),
        (dates.iso_date, "2026-03-14", date(2026, 3, 14)),
        (dates.iso_date, "14.3.2026", None),
        (dates.to_float, "12.5", 12.5),
        (dates.to_float, "n/a", None),
    ],
)
def test_scalar(value, f, given_, want):
    assert value(f, given_) == want


def test_slug_length(value):
    assert len(value(naming.slugify, "a" * 500)) == 160


def test_distinctive_tokens(value):
    assert value(naming.distinctive_tokens, "Comstock Holding Companies") == ["comstock"]
    assert value(naming.distinctive_tokens, "The Property Group") == ["the", "property", "group"]
    assert value(naming.distinctive_tokens, "") == []


def test_distinct_ignoring_case(spark):
    row = spark.createDataFrame([(["A@x ", "a@X", None, "", "b"],)], "v array<string>").select(naming.distinct_ignoring_case(F.col("v")).alias("v")).first()
    assert row.v == ["A@x", "b"]


def test_firm_names(value):
    assert value(classify.firm_names, "With Comstock Partners, and comstock partners. Also JBG Properties,") == ["With Comstock Partners", "Also JBG Properties"]


def test_permit_score(spark):
    rows = spark.createDataFrame([(2e6, "Deck"), (6e7, "Data Center"), (None, None), (1e6, "Commercial")], "v double, t string").select(classify.permit_score(F.col("v"), F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [0.55, 1.0, 0.35, 0.65]


def test_project_score(spark):
    rows = spark.createDataFrame([(1e8, None, None), (None, 200, None), (None, None, 25000), (None, None, None)], "v double, u int, s int").select(classify.project_score(F.col("v"), F.col("u"), F.col("s")).alias("s")).collect()
    assert [r.s for r in rows] == [0.9, 0.75, 0.6, 0.45]


@pytest.mark.parametrize("n", [0, 1, 346, 347, 654, 655, 2000])
def test_chunk_counts(value, n):
    """The loop that chunks stand for, run here."""
    start, want = 0, 0
    while start < n:
        want += 1
        if start + 346 >= n:
            break
        start += 308
    assert len(value(T.chunk_arrays, " ".join(map(str, range(n))))) == want


def test_chunks_overlap(value):
    a, b = (c.text.split() for c in value(T.chunk_arrays, " ".join(map(str, range(400)))))
    assert a[-38:] == b[:38]
    assert b[-1] == "399"


def test_page_sections(value):
    text = "lost <!-- page:2 --> two <!-- page:3 --> <!--page:9-->nine"
    assert [tuple(s) for s in value(T.page_sections, text)] == [(2, "two"), (9, "nine")]
    assert [tuple(s) for s in value(T.page_sections, " plain ")] == [(1, "plain")]
    assert value(T.page_sections, "  ") == []


def test_shorten_cuts_at_words(value):
    got = value(T.shorten, "word " * 200)
    assert len(got) <= 400 and got.endswith("word…")


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_lcs(a, b):
    assert fuzzy.lcs(a, b) == _lcs(a, b)


def test_ratios():
    assert round(fuzzy.token_set_ratio("stanleigh martin", "stanley martin"), 2) == 86.67
    assert fuzzy.token_set_ratio("stanley martin excavating", "stanley martin") == 100
    assert round(fuzzy.token_sort_ratio("stanley martin comapnies", "stanley martin"), 4) == 73.6842
    assert fuzzy.token_set_ratio("", "x") == 0


def test_similarity(value):
    assert value(fuzzy.similarity(F.lit("word"), F.lit("words"))) == pytest.approx(4 / 7)
    assert value(fuzzy.similarity(F.lit(""), F.lit(""))) == 0


def test_vectors(spark, value):
    assert value(vectors.cosine_distance(vectors.literal_vector([1, 0]), vectors.literal_vector([0, 2]))) == 1
    assert value(vectors.cosine_distance(vectors.literal_vector([0, 0]), vectors.literal_vector([0, 2]))) is None
    rows = spark.createDataFrame([("a b",), ("a b",), (None,), ("",)], "t string").select(vectors.embedder()("t").alias("v")).collect()
    assert rows[0].v == rows[1].v and len(rows[0].v) == 384 and rows[2].v is None and not any(rows[3].v)


@pytest.mark.parametrize("days", [1, 89, 90, 91, 180, 181, 450, 451, -3, 0])
def test_window_number(value, days):
    """Day d belongs to the window [as_of - 90 (w + 1), as_of - 90 w)."""
    w = value(dates.window_number(F.date_sub(F.lit("2026-01-01").cast("date"), days), F.lit("2026-01-01").cast("date"), 90))
    assert -90 * (w + 1) <= -days < -90 * w


def test_keys(value):
    a = value(dates.window_key(F.lit("hiring_surge"), F.lit("f"), F.lit("2026-01-01")))
    assert len(a) == 40 and a != value(dates.window_key(F.lit("other"), F.lit("f"), F.lit("2026-01-01")))
    assert value(dates.quarter_key(F.lit("2026-05-01").cast("timestamp"))) == "2026:Q2"


def test_embedder_holds_batches_small(spark):
    """Batches have few bytes, and a model may give doubles."""
    import numpy as np


    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64MB")
        embed = vectors.embedder(lambda texts: np.array([[len(t), 0.5] for t in texts], np.float64))
        assert spark.conf.get(key) == f"{4 << 20}b"
        rows = spark.createDataFrame([("abc",), (None,), ("",)], "t string").coalesce(1).select(embed("t").alias("v")).collect()
        assert [r.v for r in rows] == [[3.0, 0.5], None, [0.0, 0.5]]
    finally:
        spark.conf.set(key, before)
