import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.functions import fuzzy, naming
from plinth.operators import resolve as R
from plinth.plans import catalogue

SF = "/root/testdata/sf0.001"

FIRMS = [
    ("quay", "Quayside Orchard Holdings, Inc.", ["QOH Group", "Quay & Orchard"], "12 Ferry Lane, Dunmore, VA", "(555) 010-2030", []),
    ("vtl", "VTL Umber Properties", [], "9 Tannery Row, Dunmore, VA", "555.010.4411", []),
    ("larkspur", "Larkspur Whitlock Companies, LLC", [], "77 Old Quarry Drive, Ashby, VA", None, ["lot-5"]),
    ("mid_capital", "Middlemarch Capital", [], None, None, []),
    ("mid_partners", "Middlemarch Partners", [], None, None, []),
]
#: Applicants as they might be filed, and whose they are: keys, aliases, slips of the pen, names too general or too long, nobody's.
LABELLED = [
    ("Quayside Orchard Holdings, Inc.", "quay"), ("quayside orchard holdings", "quay"), ("QUAYSIDE   ORCHARD HOLDINGS L.L.C.", "quay"), ("QOH Group", "quay"), ("Quay and Orchard", "quay"),
    ("Quayside Orchrad Holdings", "quay"), ("VTL Umber Properties LP", "vtl"), ("VTL UMBER", "vtl"), ("Larkspur Whitlock Companies", "larkspur"), ("Larkspur Whitlock Homes", "larkspur"), ("Larkspur Whitlcok Companies LLC", "larkspur"),
    ("MIDDLEMARCH CAPITAL LLC", "mid_capital"), ("Middlemarch Partners, LP", "mid_partners"), ("Middlemarch Holdings LLC", None), ("Umber Residence", None), ("Northgate Roofing", None),
    ("Larkspur Whitlock Paving Subcontractors of the Lower Valley LLC", None), ("Whitlock Larkspur Heating, Plumbing and Drainage", None), ("City of Dunmore", None), ("", None), ("***", None),
]


@pytest.fixture
def firms(spark):
    df = spark.createDataFrame(FIRMS, "id string, name string, aliases array<string>, address string, phone string, parcel_ids array<string>")
    return df.withColumn("canonical_name", naming.canonicalize(F.col("name")))


def mentions(spark, rows):
    return spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r, None, None, None))) for k, r in enumerate(rows)], "mention_id int, text string, address string, phone string, parcel_id string")


def test_labelled_applicants(spark, firms):
    told = R.resolve(mentions(spark, [t for t, _ in LABELLED]), firms).cache()
    got = {r.mention_id: r for r in told.collect()}
    assert {k: r.firm_id for k, r in got.items()} == {k: f for k, (_, f) in enumerate(LABELLED)}
    want = spark.createDataFrame([(k, f) for k, (_, f) in enumerate(LABELLED)], "mention_id int, expected_id string")
    score = R.accuracy(told, want).first()
    assert (score.n, score.wrong, score.share) == (len(LABELLED), 0, 1.0)
    assert got[0].method == "exact" and got[3].method == "alias" and got[10].method == "fuzzy" and got[19].reason == "mention normalized to empty"


def test_corroboration_lifts_a_doubtful_score(spark, firms):
    rows = [("Larkspeer Whitlock", None, None, None), ("Larkspeer Whitlock", "77 Old Quarry Dr, Ashby VA", None, None), ("Larkspeer Whitlock", None, None, "lot-5")]
    got = R.resolve(mentions(spark, rows), firms).orderBy("mention_id").collect()
    assert [r.status for r in got] == ["ambiguous", "resolved", "resolved"]
    assert got[1].method == "corroborated" and list(got[1].candidates[0].corroboration) == ["address"]
    assert list(got[2].candidates[0].corroboration) == ["parcel"]


def test_adjudicator_is_asked_only_in_doubt(spark, firms):
    asked = []

    def choose(df):
        asked.extend(r.text for r in df.collect())
        return df.select("mention_id", F.get("candidates", F.lit(0))["firm_id"].alias("chosen_id"), F.lit(0.9).alias("certainty"), F.lit("looks right").alias("rationale"))

    got = R.resolve(mentions(spark, ["Larkspeer Whitlock", "QOH Group"]), firms, adjudicator=choose).orderBy("mention_id").collect()
    assert asked == ["Larkspeer Whitlock"]
    assert (got[0].method, got[0].firm_id, got[0].confidence) == ("llm", "larkspur", 0.9) and got[1].method == "alias"


def test_ties_are_ambiguous(spark):
    rows = [("a", "Dunmore Alpha Homes"), ("b", "Dunmore Alpha Realty")]
    firms = spark.createDataFrame([(i, n, [], None, None, []) for i, n in rows], "id string, name string, aliases array<string>, address string, phone string, parcel_ids array<string>").withColumn("canonical_name", naming.canonicalize(F.col("name")))
    got = R.resolve(mentions(spark, ["Dunmore Alpha"]), firms).first()
    assert got.status == "ambiguous" and got.reason == "top candidates too close to separate" and len(got.candidates) == 2


def test_alias_memory_and_queue(spark, firms):
    rows = ["Larkspeer Whitlock", ("Larkspeer Whitlock", "77 Old Quarry Dr, Ashby, VA", None, None), "Larkspeer Whitlock", "Larkspeer Whitlock"]
    told = R.resolve(mentions(spark, rows), firms)
    got = R.with_alias_memory(told).orderBy("mention_id").collect()
    assert [r.method for r in got] == [None, "corroborated", "alias", "alias"]
    none = spark.createDataFrame([], "canonical_alias string")
    learned = R.learned_aliases(told, none).collect()
    assert [(a.canonical_alias, a.firm_id, a.alias_type) for a in learned] == [("larkspeer whitlock", "larkspur", "llc_holding")]
    known = spark.createDataFrame([("larkspeer whitlock",)], "canonical_alias string")
    assert R.learned_aliases(told, known).count() == 0
    queue = R.review_queue(told.withColumn("origin_id", F.col("mention_id").cast("string")), spark.createDataFrame([], "canonical_mention string"), "permits").collect()
    assert len(queue) == 1 and queue[0].origin_id == "0" and queue[0].suggestions[0].firm_id == "larkspur" and queue[0].suggestions[0].score == 91.4


def test_trigram_candidates(spark, firms):
    m = spark.createDataFrame([(1, "quayside orchard holdng")], "mention_id int, canonical string")
    got = R.trigram_candidates(m, firms).collect()
    assert got[0].firm_id == "quay" and got[0].similarity > 0.5


def test_firm_records(spark):
    firms = spark.createDataFrame([(1, "A", "a", None, None), (2, "B", "b", None, None)], "id long, name string, canonical_name string, hq_address string, phone string")
    aliases = spark.createDataFrame([(1, "x"), (1, "w")], "firm_id long, alias string")
    permits = spark.createDataFrame([(1, "p1"), (1, "p1"), (2, None)], "firm_id long, parcel_id string")
    got = {r.id: r for r in R.firm_records(firms, aliases, permits).collect()}
    assert got[1].aliases == ["w", "x"] and got[1].parcel_ids == ["p1"] and got[2].aliases == [] and got[2].parcel_ids == []


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain_ratio(a, b):
    return 200.0 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_set_ratio(a, b):
    left, right = set(a.split()), set(b.split())
    both, one, two = " ".join(sorted(left & right)), " ".join(sorted(left)), " ".join(sorted(right))
    if not left or not right:
        return 0.0
    if both and not (left - right and right - left):
        return 100.0
    joined = [" ".join(x for x in (both, " ".join(sorted(s))) if x) for s in (left - right, right - left)]
    del one, two
    return max(plain_ratio(*joined), *([plain_ratio(both, j) for j in joined] if both else [0.0]))


def test_resolve_full_against_brute_force(spark):
    """Every mention against every firm, word by word; whole names, ties and corroboration."""
    m, f = catalogue.resolver_case(spark, SF)
    firms = f.withColumns({"words": naming.distinctive_tokens(F.col("name")), "p": naming.normalize_phone(F.col("phone")), "a": naming.normalize_address(F.col("address"))}).orderBy("id").collect()
    mentions = m.withColumns({"c": naming.canonicalize(F.col("text")), "words": naming.distinctive_tokens(F.col("text")), "p": naming.normalize_phone(F.col("phone")), "a": naming.normalize_address(F.col("address"))}).orderBy("mention_id").collect()
    want, memory = {}, {}
    for x in mentions:
        exact = [y.id for y in firms if y.canonical_name == x.c]
        if exact:
            want[x.mention_id] = ("resolved", str(min(exact)), "exact")
            continue
        if x.c in memory:
            want[x.mention_id] = ("resolved", memory[x.c], "alias")
            continue
        scored = [(plain_set_ratio(x.c, y.canonical_name), y) for y in firms if set(x.words) & set(y.words)]
        scored = sorted(((s, y) for s, y in scored if s >= 80), key=lambda t: (-t[0], t[1].id))[:25]
        scored = [(s, y) for s, y in scored if plain_ratio(" ".join(sorted(x.c.split())), " ".join(sorted(y.canonical_name.split()))) >= 60]
        told = []
        for s, y in scored:
            sure = (x.p and x.p == y.p) or (x.a and x.a == y.a) or (x.parcel_id and x.parcel_id in y.parcel_ids)
            told.append((min(100.0, s + (12 if sure else 0)), str(y.id), bool(sure)))
        told.sort(key=lambda t: (-t[0], t[1]))
        tie = len(told) > 1 and abs(told[0][0] - told[1][0]) < 2
        if not told:
            want[x.mention_id] = ("unmatched", None, None)
        elif told[0][0] >= 92 and not tie:
            want[x.mention_id] = ("resolved", told[0][1], "corroborated" if told[0][2] else "fuzzy")
            memory[x.c] = told[0][1]
        else:
            want[x.mention_id] = ("ambiguous", None, None)
    got = {r.mention_id: (r.status, r.firm_id, r.method) for r in catalogue.resolve_full(spark, SF).collect()}
    assert got == want
    assert {"resolved", "unmatched"} <= {s for s, _, _ in want.values()} and {"exact", "corroborated", "fuzzy"} <= {k for *_, k in want.values()}


def test_token_ratios_against_brute_force(spark):
    other = "red widget of the small bolt"
    rows = catalogue.token_ratios(spark, SF).collect()
    for r in rows:
        assert r.set_ratio == pytest.approx(plain_set_ratio(r.p_name, other), abs=1e-5)
        assert r.sort_ratio == pytest.approx(plain_ratio(" ".join(sorted(r.p_name.split())), " ".join(sorted(other.split()))), abs=1e-5)


def test_lcs_batch_against_plain():
    """Ties of length, empty texts, texts over 64 characters, and alphabets too large for a table."""
    rng = random.Random(5)
    texts = ["", "a", "abc", "é漢字", "x" * 64, "ab" * 32, "ab" * 40, *("".join(rng.choice("abcd e") for _ in range(rng.randint(0, 80))) for _ in range(60))]
    for more in ([], ["".join(map(chr, range(200, 900)))]):
        a, b = rng.choices([*texts, *more], k=250), rng.choices([*texts, *more], k=250)
        want = [plain_lcs(x, y) for x, y in zip(a, b, strict=True)]
        assert fuzzy.lcs_batch(a, b).tolist() == want
        need = np.array([rng.randint(0, 40) for _ in a])
        got = fuzzy.lcs_batch(a, b, need)
        both = [sum((Counter(x) & Counter(y)).values()) for x, y in zip(a, b, strict=True)]
        assert got.tolist() == [w if c >= n else -1 for w, c, n in zip(want, both, need.tolist(), strict=True)]
    assert fuzzy.lcs_batch([], []).tolist() == []


def met_pairs(spark, sf):
    m, f = catalogue.resolver_case(spark, sf)
    keyed = m.withColumn("canonical", naming.canonicalize(F.col("text")))
    return R.met_pairs(R.exact_and_alias(keyed, f).where("canonical <> '' AND exact_id IS NULL AND alias_id IS NULL"), f)


def test_few_pairs_are_scored(spark):
    """Of the pairs that meet on sf0.1, under 5 % need a subsequence (1.4 %)."""
    met = met_pairs(spark, "/root/testdata/sf0.1").cache()
    n = met.count()
    assert n > 1_500_000
    assert R.subsequences(R.open_pairs(met, 80.0)).count() < 0.05 * n
    met.unpersist()


def test_no_pair_that_scores_the_floor_is_left_out(spark):
    met = met_pairs(spark, "/root/testdata/sf0.01").cache()
    assert met.select("canonical", "canonical_name").distinct().count() == met.count()
    got = {(r.canonical, r.canonical_name): r.score for r in R.scored_pairs(met, 80.0).collect()}
    for r in met.select("canonical", "canonical_name").orderBy(F.xxhash64("canonical", "canonical_name")).limit(4000).collect():
        score = plain_set_ratio(r.canonical, r.canonical_name)
        assert (score >= 80.0) == ((r.canonical, r.canonical_name) in got)
        if score >= 80.0:
            assert got[r.canonical, r.canonical_name] == pytest.approx(score)


def test_hot_words_and_names_are_split(spark, monkeypatch):
    """Salts and shares change no row."""
    m, f = catalogue.resolver_case(spark, SF)
    keyed = m.withColumn("canonical", naming.canonicalize(F.col("text")))
    whole = sorted(map(str, R.scored_candidates(keyed, f).collect()))
    monkeypatch.setattr(R, "SPLIT", 3)
    monkeypatch.setattr(R, "SHARES", 2)
    assert sorted(map(str, R.scored_candidates(keyed, f).collect())) == whole


def test_trigram_join_against_brute_force(spark, monkeypatch):
    """Best of each mention over all firms; copies of keys, ties, keys without trigrams; pairs that bounds rule out aren't made."""
    words = ["alder", "birch", "cedar", "dogwood", "elder", "fir", "holdings", "homes", "group"]
    rng = random.Random(7)
    name = lambda: " ".join(rng.sample(words, rng.randint(1, 3)))
    firms = [(i, name()) for i in range(200)] + [(200, "")]
    asked = [(i, (name() + rng.choice(["", "s", "x"])) if i else "--") for i in range(60)]
    grams = {r.x: set(r.g) for r in spark.createDataFrame([(x,) for x in {n for _, n in firms + asked}], "x string").select("x", fuzzy.trigrams(F.col("x")).alias("g")).collect()}
    like = lambda a, b: len(grams[a] & grams[b]) / max(1, len(grams[a] | grams[b]))
    want = set()
    for k, a in asked:
        scored = sorted(((-like(a, b), i) for i, b in firms if like(a, b) > 0.1))[:5]
        want |= {(k, i, round(-s, 9)) for s, i in scored}
    f = spark.createDataFrame(firms, "id long, canonical_name string")
    m = spark.createDataFrame(asked, "mention_id long, canonical string")
    run = lambda: {(r.mention_id, r.firm_id, round(r.similarity, 9)) for r in R.trigram_candidates(m, f, most=5).collect()}
    assert run() == want
    monkeypatch.setattr(R, "SPLIT", 2)
    assert run() == want


def test_pairs_that_bounds_rule_out_are_not_made(spark):
    x, y = ["aaa", "bbb", "ccc", "ddd"], ["ddd", "eee", "fff", "ggg"]
    m = spark.createDataFrame([("m", x, 0, 0.5, 3)], "canonical string, __x array<string>, __unknown int, __least double, __upto int")
    f = spark.createDataFrame([("same", x), ("late", y), ("long", x + [f"z{i}z" for i in range(9)])], "canonical_name string, __y array<string>")
    got = R.gram_pairs(m, f).collect()
    assert [(r.canonical_name, r.similarity) for r in got] == [("same", 1.0)]


def test_a_small_file_of_mentions_is_many_tasks_work(spark, monkeypatch):
    """Mentions and firms are dealt by number and stored before their keys are compared; no later step goes back to the file."""
    stored = {}
    real = R.kept
    monkeypatch.setattr(R, "kept", lambda df, name: stored.setdefault(name, df) and real(df, name))
    m = spark.createDataFrame([(1, "Acme LLC", None, None, None), (2, "Else", None, None, None)], "mention_id long, text string, address string, phone string, parcel_id string").coalesce(1)
    f = spark.createDataFrame([("7", "Acme", "acme", [], None, None, [])], "id string, name string, canonical_name string, aliases array<string>, address string, phone string, parcel_ids array<string>").coalesce(1)
    out = R.resolve(m, f)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert all("REPARTITION_BY_NUM" in plan(stored[name]) for name in ("mentions", "firms"))
    assert "ExistingRDD" not in plan(out) and "LocalTableScan" not in plan(out)
    assert {r.mention_id: r.firm_id for r in out.collect()} == {1: "7", 2: None}


def test_only_the_first_names_of_a_key_meet_their_firms(spark):
    # Forty names of three firms each, all with one score but one: every name's firms can't be among the best four.
    firms = spark.range(120).select("id", F.concat(F.lit("n"), (F.col("id") % 40).cast("string")).alias("canonical_name"))
    scored = spark.range(40).select(F.lit("m").alias("canonical"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("canonical_name"), F.when(F.col("id") == 39, 95.0).otherwise(90.0).alias("score"))
    got = R.best_firms(scored, firms, 4)
    assert sorted((-r.score, r.firm_id) for r in got.collect()) == [(-95.0, 39), (-95.0, 79), (-95.0, 119), (-90.0, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join") < plan.rindex("Window", 0, plan.rindex("Join"))  # ranked, met with all firms, ranked
