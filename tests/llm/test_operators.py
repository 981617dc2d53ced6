"""The operators and their queries on awkward rows, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from plinth.llm import byte_bpe, chat, components, decontaminate, entry, exact_dedup, lm, quality, sharding, simhash, suffix_dedup, warc
from plinth.session import shared_dir, table

from .conftest import CLASHES, ROWS, SHARED

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def text_of(row):
    return (row[1] or "").encode()


# Every operator: empty tables, clashing columns, all rows


def run_all(docs, spark):
    items = spark.createDataFrame([(1, "the same text"), (2, None), (3, "nowhere to be found at all")], "item_id int, text string")
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    yield "sharding", sharding.external_shuffle(docs, 3), ["doc_id", "text", "lang", "shard", "slot"]
    yield "quality", quality.classify(docs, quality.fit(docs)), ["doc_id", "text", "lang"]
    yield "lm", lm.lm_scores(docs), ["doc_id", "score"]
    yield "decontaminate", decontaminate.mark_contamination(docs, items), ["doc_id", "text", "lang", "n_words", "runs", "items"]
    yield "simhash", simhash.simhash_components(docs), ["doc_id", "fingerprint", "component_id"]
    yield "exact", exact_dedup.exact_dedup(docs), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    yield "suffix", suffix_dedup.remove_repeats(docs), ["doc_id", "n_bytes", "kept"]
    yield "bpe", byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks), ["doc_id", "text", "lang", "ids", "decoded"]


def test_all_rows_stay(spark, stored_docs):
    for name, df, columns in run_all(stored_docs, spark):
        assert set(columns) <= set(df.columns), name
        assert df.count() == len(ROWS), name


def test_clashing_columns(spark, clashing_docs, stored_docs):
    want = {name: plain(df.select(*columns)) for name, df, columns in run_all(stored_docs, spark)}
    for name, df, columns in run_all(clashing_docs, spark):
        assert len(df.columns) == len({c.lower() for c in df.columns}), name
        if name not in ("sharding", "lm"):  # these depend on how the rows lie in files
            assert plain(df.select(*columns)) == want[name], name
        assert df.count() == len(ROWS), name
    for stage in (exact_dedup.drop_copies(clashing_docs), simhash.drop_near_copies(clashing_docs), quality.keep_good(clashing_docs)):
        assert stage.columns == clashing_docs.columns and set(CLASHES) <= set(stage.columns)
        assert stage.limit(1).collect()[0]["keep_id"] == "own"


def test_empty_tables(spark, no_docs):
    for name, df, _ in run_all(no_docs, spark):
        assert df.count() == 0, name
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages)).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0


# Sharding


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards_are_even_and_gapless(stored_docs, shards):
    got = sharding.external_shuffle(stored_docs, shards, bucket_bytes=50_000)
    assert Counter(r.text for r in got.collect()) == Counter(r[1] for r in ROWS)
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shuffle_follows_its_seed(spark):
    docs = table(spark, SF, "documents")
    order = lambda seed: [r.doc_id for r in sharding.external_shuffle(docs, 4, seed, bucket_bytes=100_000).orderBy("shard", "slot").select("doc_id").collect()]
    a = order(1)
    assert a == order(1) and a != order(2) and sorted(a) == list(range(200)) and a != sorted(a)


def test_repeated_rows_spread(spark, tmp_path):
    spark.createDataFrame([(1, "same")] * 400, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    got = sharding.external_shuffle(spark.read.parquet(f"{tmp_path}/d"), 4, bucket_bytes=4_000)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [100] * 4


def test_op1(spark):
    got = entry.op1_sharding(spark, SF).collect()
    want = dict(duckdb.connect().sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert len(got) == 200
    for r in got:
        data = want[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


# Quality


def test_held_out_accuracy(spark):
    """Labels of quality aren't used in fitting; those of toxicity only of even documents here."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.classify(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), model).select("quality", "toxic", "__score", "__toxic", "__kept").toPandas()
    assert ((got["__score"] >= 0.5) == (got.quality == 1)).mean() > 0.98
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert clean["__kept"].mean() > 0.99
    assert got[got.quality == 0]["__kept"].mean() < 0.1 and got[got.toxic == 1]["__kept"].mean() < 0.25


def test_without_labels(spark, stored_docs):
    got = quality.quality_scores(stored_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.count() == len(ROWS) and got.where("toxicity > 0").count() == 0


def test_sample_bound(spark):
    rows = table(spark, SF, "documents").select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("__in"), F.lit(0.0).alias("target"))
    assert len(quality._sample(quality.picked(rows, 200, 40), 40, False)[1]) == 40
    assert len(quality._sample(quality.picked(rows, 200, 400), 400, False)[1]) == 200


def test_a_share_of_any_number_of_rows():
    """Hashes below the bound are the share that is asked for, of 2 * 10**10 documents and more."""
    for n in (30_000, 2 * 10**10, 5 * 10**12, 10**18):
        bound = quality.below(n, 20_000)
        assert 20_000 <= bound * n / 2**63 <= 21_000 and bound < 2**63
    assert quality.below(100, 20_000) == quality.below(0, 20_000) == 2**63


def test_rows_without_keys_are_sampled(spark):
    docs = spark.createDataFrame([(None, f"some words of document {k} here") for k in range(300)], "doc_id long, text string")
    assert quality.quality_scores(docs, sample=20).count() == 300


def plain_accuracies(patterns):
    """Expectation-maximisation a document at a time."""
    k = len(quality.LABELLERS)
    good, right_good, right_bad = 0.8, [0.95] * k, [0.4] * k

    def posterior(p):
        up, down = math.log(good), math.log(1 - good)
        for j, vote in enumerate(p):
            if vote == "g":
                up, down = up + math.log(right_good[j]), down + math.log(1 - right_bad[j])
            elif vote == "b":
                up, down = up + math.log(1 - right_good[j]), down + math.log(right_bad[j])
        return 1 / (1 + math.exp(max(-700, min(700, down - up))))

    for _ in range(100):
        told = [posterior(p) for p in patterns]
        before, good = good, min(1 - 1e-6, max(1e-6, (sum(told) + 1) / (len(told) + 2)))
        for j in range(k):
            of = [(p[j], t) for p, t in zip(patterns, told, strict=True) if p[j] != "-"]
            right_good[j] = (sum(t for v, t in of if v == "g") + 0.95) / (sum(t for _, t in of) + 1)
            right_bad[j] = (sum(1 - t for v, t in of if v == "b") + 0.4) / (sum(1 - t for _, t in of) + 1)
            right_good[j], right_bad[j] = (min(1 - 1e-4, max(1e-4, x)) for x in (right_good[j], right_bad[j]))
        if abs(good - before) < 1e-9:
            break
    return [posterior(p) for p in patterns]


def plain_scorer(rows, targets, passes, rate, l1, least_docs):
    """Logistic regression by AdaGrad, a feature at a time; the order of documents is the operator's."""
    seen = Counter(f for r in rows for f in r)
    rows = [[f for f in r if seen[f] >= least_docs] + ["bias"] for r in rows]
    w, g2 = Counter(), {}
    rng = quality.np.random.default_rng(3)
    for _ in range(passes):
        for i in rng.permutation(len(rows)).tolist():
            g = targets[i] - 1 / (1 + math.exp(-max(-30, min(30, sum(w[f] for f in rows[i])))))
            for f in rows[i]:
                g2[f] = g2.get(f, 1e-2) + g * g
                step = rate / math.sqrt(g2[f])
                moved = w[f] + step * g
                w[f] = math.copysign(max(0.0, abs(moved) - step * l1), moved) if l1 else moved
    return w


def test_op2(spark):
    """The whole query against a plain classifier, fitted document by document."""
    duck = duckdb.connect()
    docs = duck.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()
    toxic = dict(duck.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    data = {k: t.encode() for k, t in docs}
    found = {k: quality.measure(d) for k, d in data.items()}
    votes = {k: quality.votes(m) for k, m in found.items()}
    shown = {k: quality.features(data[k], m) for k, m in found.items()}
    words = {k: quality.features(data[k], None) for k in toxic}
    posterior = dict(zip(votes, plain_accuracies(list(votes.values())), strict=True))
    order = sorted(shown, key=lambda k: shown[k].tobytes())
    w = plain_scorer([shown[k].tolist() for k in order], [posterior[k] for k in order], 4, 0.05, 0.0, quality.LEAST_DOCS)
    order = sorted(words, key=lambda k: words[k].tobytes())
    t = plain_scorer([words[k].tolist() for k in order], [toxic[k] for k in order], 6, 0.1, quality.LASSO, quality.LEAST_DOCS)
    apply = lambda w, f: 1 / (1 + math.exp(-max(-30, min(30, sum(w[x] for x in f.tolist()) + w["bias"]))))
    got = {r.doc_id: r for r in entry.op2_quality(spark, SF).collect()}
    assert set(got) == set(data) and len(docs) == len(data)
    for k, r in got.items():
        score, bad = apply(w, shown[k]), apply(t, quality.features(data[k], None))
        assert r.votes == votes[k] and r.posterior == pytest.approx(posterior[k], abs=1e-6)
        assert r.score == pytest.approx(score, abs=1e-4) and r.toxicity == pytest.approx(bad, abs=1e-4)
        assert r.kept == (r.score >= 0.5 and r.toxicity <= quality.MOST_TOXIC)


# LM


def plain_scores(rows):
    tokens = [(k, [*text.lower().split(), None]) for k, text in rows]
    counts = Counter(t for k, ts in tokens if zlib.crc32(str(k).encode()) % 7 != 2 for t in ts)
    n = sum(counts.values())
    v = len(counts)
    return [(k, zlib.crc32(str(k).encode()) % 7 == 2, len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 6)) for k, ts in tokens]


def test_op3(spark):
    got = entry.op3_lm(spark, SF)
    docs = duckdb.connect().sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert plain(got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6))) == sorted(plain_scores([(k, t.encode()) for k, t in docs]), key=str)
    held = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_lm_on_awkward_rows(stored_docs, monkeypatch):
    want = plain_scores([("" if r[0] is None else r[0], text_of(r)) for r in ROWS])
    want = sorted(((None if k == "" else k), *rest) for k, *rest in want) if all(k != "" for k, *_ in want) else sorted([((None if k == "" else k), *rest) for k, *rest in want], key=str)
    got = plain(lm.lm_scores(stored_docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)))
    assert got == want


def test_lm_without_training_texts(spark, tmp_path):
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2]
    spark.createDataFrame([(k, "some words") for k in held], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    got = lm.lm_scores(spark.read.parquet(f"{tmp_path}/d")).first()
    assert (got.n_known, got.train_tokens, got.base_score) == (0, 0, 0.0) and got.score <= 1e-6


# Decontamination


def plain_hits(docs, items, window=10):
    out = []
    for k, text in docs:
        words = decontaminate.words_of(text)
        hit, ids = set(), set()
        for i, item in items:
            for w in decontaminate.windows_of(decontaminate.words_of(item), window):
                for s in range(len(words) - len(w) + 1):
                    if tuple(words[s : s + len(w)]) == w:
                        hit.update(range(s, s + len(w)))
                        ids.add(str(i))
        out.append((k, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontamination(spark, tmp_path, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, item), (2, item), (3, "short item"), (4, None), (5, "..."), (6, "the " * 15), (None, "no id here")]
    docs = [(1, f"x {item} y ONE, two-three four five six seven eight nine ten z"), (2, "a short ITEM and " + "the " * 40), (3, None), (4, ""), (5, item[:40]), (6, "nine ten eleven twelve one two no id here"), (7, "short item " * 500)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = plain_hits([(k, (t or "").encode()) for k, t in docs], [("null" if i is None else i, (t or "").encode()) for i, t in items])
    assert plain(entry.op4_decontaminate(spark, str(tmp_path))) == want
    marked = decontaminate.mark_contamination(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert marked.where("doc_id = 1").first().runs == [[1, 13], [14, 24]]
    left = decontaminate.drop_contaminated(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert plain(left.select("doc_id")) == [(3,), (4,), (5,)]


def test_decontamination_beyond_a_block_keeps_rows_and_columns(spark, clashing_docs, monkeypatch):
    items = spark.createDataFrame([(1, "the same text"), (2, None), (3, SHARED), (4, "word " * 12), (5, "x" * 120_000)], "item_id int, text string")
    want = plain(decontaminate.mark_contamination(clashing_docs, items).select("doc_id", "lang", "shard", "kept", "n_words", "runs", "items"))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 0)
    got = decontaminate.mark_contamination(clashing_docs, items)
    assert plain(got.select("doc_id", "lang", "shard", "kept", "n_words", "runs", "items")) == want and set(got.columns) == set(clashing_docs.columns)
    assert decontaminate.drop_contaminated(clashing_docs, items).columns == clashing_docs.columns


# SimHash


def plain_components(docs, budget=4):
    prints = [simhash.fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        r = find(i)
        least[r] = k if r not in least or least[r] is None else least[r] if k is None else min(least[r], k)
    return sorted([(k, f"{prints[i]:016x}", least[find(i)]) for i, (k, _) in enumerate(docs)], key=str)


def test_simhash_on_awkward_rows(stored_docs):
    assert plain(simhash.simhash_components(stored_docs).select("doc_id", "fingerprint", "component_id")) == plain_components([(r[0], text_of(r)) for r in ROWS])


def test_op5(spark):
    docs = duckdb.connect().sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert plain(entry.op5_simhash(spark, SF)) == plain_components([(k, t.encode()) for k, t in docs])


def test_one_of_each_component_stays(stored_docs):
    found = plain_components([(r[0], text_of(r)) for r in ROWS])
    kept = simhash.drop_near_copies(stored_docs).collect()
    assert len(kept) == len({(c, "" if c is not None else p) for _, p, c in found})
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for _, _, c in found if c is not None})


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (103, 100), (7, 7), (200, 200)] + [(300, k) for k in range(301, 330)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == got[103] == 100 and all(got[k] == 300 for k in range(301, 330)) and 200 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# WARC


def test_archives(spark, tmp_path, monkeypatch):
    rows = [(1, "http://h.org/a b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 50_000), (6, "http://h.org/\r\nEvil: 1", "<p>x</p>"), (None, "u", "nothing"), (6, "u", "<p>x</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    read = warc.read_archives(warc.write_archives(pages))
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in read.collect()), key=str)
    x, none = len("<p>x</p>"), "urn:page:null"
    # Of the two rows with page 6, one is the response.
    assert got == sorted([("urn:page:1", "revisit", "urn:page:6", x), ("urn:page:2", "revisit", "urn:page:6", x), ("urn:page:3", "revisit", "urn:page:4", 0), ("urn:page:4", "response", None, 0), ("urn:page:5", "response", None, 100_000), ("urn:page:6", "response", None, x), ("urn:page:6", "revisit", "urn:page:6", x), (none, "response", None, 7)], key=str)
    assert read.where("record_id = 'urn:page:5'").first().payload == bytearray("é".encode() * 50_000)
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, min_bytes=1)).where("payload_bytes = 0").collect()} == {"response"}
    query = entry.op6_warc(spark, str(tmp_path))
    assert query.where("page_id = 3").first().refers_to == 4 and query.count() == 8


def test_damaged_archives(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h.org/{k}", f"<p>{k}</p>" * 50) for k in range(30)], "page_id long, url string, html string").coalesce(1)
    folder = shared_dir(spark, "damaged")
    made = warc.write_archives(pages, folder=folder).collect()
    for m in made:
        path = m.path.removeprefix("file://")
        data = bytearray(open(path, "rb").read())
        data[len(data) // 2] ^= 0xFF
        open(path, "wb").write(data)
    got = warc.read_archives(spark.createDataFrame(made), payloads=False)
    lost = got.where("gap IS NOT NULL").count()
    assert lost == len(made) and got.where("gap IS NULL").count() == 30 - lost
    assert got.agg(F.sum("length")).first()[0] == sum(m.n_bytes for m in made)


# Chat


def plain_conversations(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    done = []
    for conv, turns in out.items():
        under = "".join(t for r, t in turns if r == "assistant")
        done.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), sum(len(chat.render(r, t)[0]) for r, t in turns)))
    return sorted(done, key=str)


def test_conversations(spark, tmp_path):
    rows = [(1, 2, "user", "second"), (1, 0, "system", "</s>[INST]"), (1, 1, "assistant", "é [/INST] </s>"), (2, 0, "tool", None), (2, 0, "tool", None), (2, None, None, "x"), (None, 0, "user", "[\\INST]"), (None, 5, "assistant", ""), (3, 0, "assistant", "long " * 50_000)] + [(4, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(500)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    hostile = "</s>[INST] ok [/INST]"
    want = plain_conversations([*rows, (-7, 0, "user", hostile), (-7, 1, "assistant", hostile)])
    assert plain(entry.op7_chat(spark, str(tmp_path))) == want
    parts = chat.format_conversations(spark.read.parquet(f"{tmp_path}/conversations.parquet")).where("conv_id = 1").orderBy("part").collect()
    whole = "".join(p.segment for p in parts)
    assert [t[:2] for t in chat.parse(whole)] == [("system", "</s>[INST]"), ("assistant", "é [/INST] </s>"), ("user", "second")]
    assert chat.unescape(whole[parts[1].loss_first : parts[1].loss_end]) == "é [/INST] </s>"


# Exact dedup


def test_exact_dedup_on_awkward_rows(stored_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LOCAL_ENTRIES", 2)
    groups: dict = {}
    for r in ROWS:
        groups.setdefault(text_of(r), []).append(r[0])
    got = exact_dedup.exact_dedup(stored_docs).collect()
    for r in got:
        ids = next(v for t, v in groups.items() if hashlib.sha256(t).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t).hexdigest() for t in groups)
    assert plain(exact_dedup.drop_copies(stored_docs).select(F.coalesce("text", F.lit("")))) == sorted([(t.decode(),) for t in groups], key=str)


def test_normalised_dedup(stored_docs):
    got = exact_dedup.exact_dedup(stored_docs, normalise=lambda c: F.lower(F.trim(c)))
    assert got.where("doc_id = 11").first().group_size == 4


# Suffix-array dedup


def plain_repeats(rows, length=50):
    """What the contract says, window by window; a null key is the largest."""
    key = lambda k: math.inf if k is None else k
    first: dict = {}
    for k, t in rows:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            first[w] = min(first.get(w, math.inf), key(k))
    out = []
    for k, t in rows:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < key(k):
                cover[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        spans = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out.append((k, len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("held", [8 << 20, 500])
def test_repeats_on_awkward_rows(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 700)
    rows = [(k, None if t is None else t[:3000]) for k, t, _ in ROWS]
    rows += [(20, f"{SHARED} {SHARED}"), (21, f"{SHARED}{SHARED[:30]}"), (22, "ab" * 200), (23, "xx" + "ab" * 60), (24, SHARED[:49]), (25, SHARED[:50]), (19, "q" * 60 + SHARED[5:70])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/d")
    got = suffix_dedup.remove_repeats(spark.read.parquet(f"{tmp_path}/d"), held=held)
    assert plain(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == plain_repeats([(k, (t or "").encode()) for k, t in rows])
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got.collect())


def files_of(folder):
    return [f for f in Path(folder.removeprefix("file://")).rglob("*.parquet") if not f.name.startswith(".")]


@pytest.fixture
def kept_folders(monkeypatch):
    """Folders that an operator would remove, by the beginnings of their names."""
    kept = {}

    def keep(spark, path):
        kept[path.rpartition("/")[2].partition("-")[0]] = path

    for module in (suffix_dedup, lm):
        monkeypatch.setattr(module, "forget", keep)
    return kept


@pytest.mark.parametrize("parts", [4, 8])
def test_answers_are_a_file_for_each_partition(spark, tmp_path, monkeypatch, kept_folders, parts):
    """However many buckets, shards and blocks answer."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 500)
    rows = [(k, f"{k} {SHARED} and {k % 7} times something else that is repeated now and then {k % 5}") for k in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.parquet(f"{tmp_path}/d")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 20))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(2 * parts))
    try:
        docs = spark.read.parquet(f"{tmp_path}/d")
        n = docs.rdd.getNumPartitions()
        assert n == parts
        got = suffix_dedup.remove_repeats(docs)
        assert plain(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == plain_repeats([(k, t.encode()) for k, t in rows])
        lm.lm_scores(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("anchors", "strings"):
        assert 0 < len(files_of(kept_folders[name])) <= n
    # The notes of the buckets and the totals lie beside the parts'.
    assert 0 < len(files_of(kept_folders["counts"])) <= 3 * n


def test_a_shard_beyond_its_memory_spills_and_recurses(spark, tmp_path, monkeypatch):
    """One hot anchor with many contexts: tuples go to shared storage and names down the recursion."""
    spilled = []

    def watched(folder):
        path = Path(folder.removeprefix("file://"))
        path.mkdir(parents=True, exist_ok=True)
        real = spill_to(folder)

        def spill(data):
            (path / f"seen-{len(list(path.iterdir()))}-{len(data)}").touch()
            return real(data)

        return spill

    spill_to = suffix_dedup._spill_to
    monkeypatch.setattr(suffix_dedup, "_spill_to", watched)
    monkeypatch.setattr(suffix_dedup, "forget", lambda spark, path: spilled.append(path) if "/runs-" in path else None)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 9)))
    rows = [(k, f"{word()} {word()} {SHARED} {word()} {word()} {word()}") for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/d")
    got = suffix_dedup.remove_repeats(spark.read.parquet(f"{tmp_path}/d"), held=500)
    assert plain(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == plain_repeats([(k, t.encode()) for k, t in rows])
    folder = Path(spilled[0].removeprefix("file://"))
    seen = [f.name for f in folder.iterdir()]
    assert any(name.startswith("seen-") for name in seen) and all(name.startswith("seen-") for name in seen)  # each run is removed once read


def test_op9(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1 << 16)
    docs = duckdb.connect().sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert plain(entry.op9_suffix_dedup(spark, SF)) == plain_repeats([(k, t.encode()) for k, t in docs])


# Byte-level BPE


def test_round_trip(stored_docs):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    small = stored_docs.where("text IS NULL OR length(text) < 100000")  # the peer is quadratic in long words
    tokens = byte_bpe.encode(small, path, public_tokenizers.PATTERN)
    for r in tokens.collect():
        assert r.ids == peer.encode_ordinary(r.text or "")
    back = byte_bpe.decode(byte_bpe.encode(stored_docs, path, public_tokenizers.PATTERN), path)
    assert back.where(F.col("decoded") != F.coalesce(F.col("text").cast("binary"), F.lit(b""))).count() == 0
    assert byte_bpe.decode(stored_docs.select(F.lit(None).cast("array<int>").alias("ids")), path).first().decoded == b""


# Registered SQL and the pipeline


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_query(spark, tmp_path, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    entry.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    duck.execute(f"CREATE TABLE want AS {entry.ORACLE_SQL[name]}")
    duck.execute(f"CREATE VIEW got AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    kinds = [sorted(r[:2] for r in duck.sql(f"DESCRIBE {t}").fetchall()) for t in ("want", "got")]
    assert kinds[0] == kinds[1]
    names = ", ".join(k for k, _ in kinds[0])
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.sql(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b}").fetchall() == []


def test_pipeline(spark):
    """Each stage against brute force on what it was given."""
    docs, seen = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        seen.append((name, before, docs.collect()))
    assert [n for n, _, _ in seen] == ["quality", "exact_dedup", "simhash", "decontaminate", "byte_bpe"]
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    for name, before, after in seen:
        ids = {r.doc_id for r in after}
        texts = [(r.doc_id, r.text.encode()) for r in before]
        if name != "byte_bpe":
            assert set(after) <= set(before)
        if name == "quality":
            clean = [r.doc_id for r in before if r.doc_id in labels and labels[r.doc_id].quality and not labels[r.doc_id].toxic]
            junk = [r.doc_id for r in before if r.doc_id in labels and not labels[r.doc_id].quality]
            assert len(ids & set(clean)) >= 0.95 * len(clean) and len(ids & set(junk)) <= 0.4 * len(junk)
        elif name == "exact_dedup":
            last: dict = {}
            for k, t in texts:
                last[t] = max(k, last.get(t, -1))
            assert ids == set(last.values())
        elif name == "simhash":
            assert ids == {c for _, _, c in plain_components(texts)}
        elif name == "decontaminate":
            items = [(r.item_id, r.text.encode()) for r in table(spark, SF, "benchmark").collect()]
            assert ids == {k for k, _, n, *_ in plain_hits(texts, items) if not n}
        else:
            assert ids == {k for k, _ in texts} and all(r.round_trip and r.n_tokens == len(r.ids) for r in after)


def sf_of(spark, tmp_path, docs):
    """A folder of tables with these documents, few labels and a small benchmark."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, SHARED), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_on_awkward_rows(spark, tmp_path, clashing_docs):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns through every stage."""
    sf = sf_of(spark, tmp_path, clashing_docs)
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        if name == "byte_bpe":
            assert docs.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and docs.count() == before.count() and docs.where("NOT round_trip").count() == 0
        else:
            assert docs.columns == before.columns and docs.exceptAll(before).count() == 0
        if name == "exact_dedup":
            texts = [r.text or "" for r in before.collect()]
            assert sorted(r.text or "" for r in docs.collect()) == sorted(set(texts))
        if name == "decontaminate":
            assert docs.where(F.contains("text", F.lit(SHARED))).count() == 0
    # The stages that the classifier would keep rows from, on all rows.
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, table(spark, sf, "documents"), sf)
        assert got.count() <= len(ROWS), name


def test_pipeline_on_an_empty_table(spark, tmp_path, no_docs):
    sf = sf_of(spark, tmp_path, no_docs)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and got.count() == 0


def test_hash_of_shingles_is_the_public_one():
    assert xxhash.xxh64_intdigest(b"a b c d", 42) == int.from_bytes(xxhash.xxh64(b"a b c d", 42).digest(), "big")
