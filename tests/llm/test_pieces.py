"""The parts that need no Spark, against brute force."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import byte_bpe, chat, decontaminate, exact_dedup, induced, lm, quality, sharding, simhash, suffix_dedup, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return [r[0] for r in duckdb.connect().sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]


# Cuckoo index


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=300))
def test_cuckoo_index_is_a_map(steps):
    index, model = exact_dedup.CuckooIndex(2), {}
    for add, n in steps:
        key = hashlib.sha256(bytes([n])).digest()
        if add and key not in model:
            index.insert(key, n)
            model[key] = n
        elif not add:
            assert index.delete(key) == (model.pop(key, None) is not None)
        assert index.get(key) == model.get(key)
    assert dict(index.items()) == model and len(index) == len(model)


def test_cuckoo_index_tells_fingerprints_apart():
    """Keys that share buckets and fingerprints overflow them; all stay, verified by their full digests."""
    index = exact_dedup.CuckooIndex(4)
    keys = [b"\0" * 8 + b"ab" + bytes([i]) * 22 for i in range(8)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert [index.get(k) for k in keys] == list(range(8)) and index.get(b"\0" * 8 + b"ab" + b"z" * 22) is None


# Byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.Encoder(ranks), regex.compile(public_tokenizers.PATTERN).findall, peer.encode_ordinary


def test_bpe_on_documents(bpe, texts):
    encoder, split, peer = bpe
    for text in texts:
        assert encoder.encode(text, split) == peer(text)


def test_bpe_on_hostile_texts(bpe):
    encoder, split, peer = bpe
    rng = random.Random(4)
    tokens = [t.decode("utf-8", "ignore") for t in encoder.bytes]
    cases = ["", " ", "\n\n  x", "<|endoftext|>", "ab" * 500, "a" * 999, "🎉" * 50, "́e​"]
    cases += ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 10))) for _ in range(3000)]
    cases += ["".join(chr(rng.randint(32, 0x24F)) for _ in range(rng.randint(1, 40))) for _ in range(1000)]
    for text in cases:
        assert encoder.encode(text, split) == peer(text), text


def test_bpe_memos_start_anew(bpe, texts, monkeypatch):
    encoder, split, peer = bpe
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    for text in texts[:20]:
        assert encoder.encode(text, split) == peer(text)


def test_bpe_needs_whole_ranks():
    with pytest.raises(ValueError, match="every single byte"):
        byte_bpe.Encoder({b"a": 0})


# SimHash


def plain_fingerprint(text, words=4):
    found = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts):
    for text in [*texts[:60], "", " \t", "one", "one two", "a b c d", "A b c d e", "É é x y z"]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def brute_links(values, budget, free):
    root = np.arange(len(values))
    for i in range(len(values)):
        for j in range(i):
            if int(values[i] ^ values[j]).bit_count() <= budget and (not free or int(values[i]) >> (64 - free) == int(values[j]) >> (64 - free)):
                a, b = root[i], root[j]
                root[root == max(a, b)] = min(a, b)
    return root


@pytest.mark.parametrize("free", [0, 3, 13])
@pytest.mark.parametrize("frontier", [8, 1 << 20])
def test_trie_links(free, frontier, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = np.random.default_rng(free)
    for _ in range(6):
        values = []
        for base in rng.integers(0, 2**63, rng.integers(1, 8), dtype=np.uint64).tolist():
            for _ in range(rng.integers(1, 25)):
                x = base
                for bit in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                    x ^= 1 << bit
                values.append(x)
        values = np.unique(np.array(values, np.uint64))
        assert np.array_equal(simhash.trie_links(values, 4, free), brute_links(values, 4, free))


def test_trie_links_of_none():
    assert len(simhash.trie_links(np.zeros(0, np.uint64), 4)) == 0


# Induced sorting


def naive(text):
    data = text.tolist()
    return sorted(range(len(data)), key=lambda i: data[i:])


def disk():
    runs = []

    def spill(data):
        runs.append(data)
        return lambda at, size, k=len(runs) - 1: runs[k][at : at + size]

    return spill, runs


@pytest.mark.parametrize("held", [induced.HELD, 7])
def test_suffix_array(held):
    rng = np.random.default_rng(1)
    spill, runs = disk()
    for _ in range(150):
        text = np.append(rng.integers(1, rng.integers(2, 8), rng.integers(1, 90)), 0).astype(np.int32)
        assert induced.suffix_array(text, spill, held).tolist() == naive(text)
    assert bool(runs) == (held == 7)


@pytest.mark.parametrize("base", [0, 40])
def test_recursion_of_several_levels(monkeypatch, base):
    """Names beyond the base case go down further levels, all of whose queues spill."""
    monkeypatch.setattr(induced, "BASE", base)
    levels, sort = [], induced.suffix_array
    monkeypatch.setattr(induced, "suffix_array", lambda text, *rest: levels.append(len(text)) or sort(text, *rest))
    rng = np.random.default_rng(4)
    spill, runs = disk()
    text = np.append(np.tile(rng.integers(1, 4, 300), 4), 0).astype(np.int32)
    assert induced.suffix_array(text, spill, 50).tolist() == naive(text)
    assert len(levels) >= 3 and levels == sorted(levels, reverse=True) and runs


def shared_prefix(data, a, b):
    k = 0
    while max(a, b) + k < len(data) and data[a + k] == data[b + k]:
        k += 1
    return k


@pytest.mark.parametrize("held", [induced.HELD, 9])
def test_common_prefixes(held):
    rng = np.random.default_rng(2)
    for _ in range(150):
        m = int(rng.integers(1, 8))
        data = [x for i in range(m) for x in [*(rng.integers(0, rng.integers(1, 5), rng.integers(1, 25)) + m).tolist(), m - 1 - i]]
        text = np.array(data, np.int32)
        common = lambda a, b: np.array([shared_prefix(data, int(x), int(y)) for x, y in zip(a, b, strict=True)], np.int32)  # noqa: B023, E731
        parts = list(induced.suffixes_with_prefixes(text, m, common, disk()[0], held))
        order = np.concatenate([a for a, _ in parts]).tolist()
        assert order == naive(text)[::-1]
        assert np.concatenate([s for _, s in parts]).tolist() == [0, *(shared_prefix(data, a, b) for a, b in zip(order[1:], order, strict=False))]


@pytest.mark.parametrize("length", [32, 50])
def test_least_owners(length):
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 100, 300).tolist())
    strings = list({base[a : a + int(rng.integers(length, 90))] for a in rng.integers(0, 200, 60).tolist()})
    docs = rng.permutation(len(strings)) * 10
    want = [min(d for s, d in zip(strings, docs.tolist(), strict=True) if x[i : i + length] in s) for x in strings for i in range(len(x) - length + 1)]
    assert suffix_dedup.least_owners(strings, docs, length).tolist() == want


def test_runs_cover_every_window():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 101, int(n)).tolist()) for n in (0, 10, 49, 50, 51, 200, 1000)] + [b"a" * 300, b"ab" * 200]
    runs = suffix_dedup.Runs(texts, 50)
    got = sorted((int(d), int(f - runs.start[d] + k)) for d, f, n in zip(runs.doc, runs.first, runs.count, strict=True) for k in range(n))
    assert got == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 49)]
    # Equal windows have equal anchors.
    marks: dict = {}
    for d, f, n, mark in zip(runs.doc, runs.first, runs.count, runs.mark, strict=True):
        for k in range(n):
            at = int(f + k)
            assert marks.setdefault(runs.data[at : at + 50].tobytes(), mark) == mark


# WARC


def records(n=6):
    return [warc.compose("response", f"urn:page:{i}", "2024-01-01T00:00:00Z", f"<p>page {i}</p>".encode() * (i + 1), f"http://h.org/{i} ü") for i in range(n)]


def read(data):
    return list(warc.Salvage(io.BytesIO(data)))


@pytest.mark.parametrize("pack", [warc.member, lambda r: r])
def test_whole_archives(pack):
    got = read(b"".join(map(pack, records())))
    assert [r.record_id for r in got] == [f"urn:page:{i}" for i in range(6)] and got[2].payload == b"<p>page 2</p>" * 3
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1(got[1].payload).digest()).decode()
    assert gzip.decompress(warc.member(records()[0])) == records()[0]


@pytest.mark.parametrize("pack", [warc.member, lambda r: r])
@pytest.mark.parametrize("damage", ["flip", "cut", "insert", "tail", "head"])
def test_salvage(pack, damage):
    parts = list(map(pack, records()))
    bad = bytearray(parts[2])
    if damage == "flip":
        bad[-10] ^= 0x41
    elif damage == "cut":
        del bad[len(bad) // 2 :]
    elif damage == "insert":
        bad = bytearray(b"\x1f\x8b\x08 junk WARC/1.1 more junk" + bytes(300)) + bad
    elif damage == "tail":
        parts[5] = parts[5][:-20]  # more than a member's trailer, so that the record itself is hurt
    else:
        parts[0] = parts[0][5:]
    parts[2] = bytes(bad)
    data = b"".join(parts)
    got = read(data)
    lost = {"flip": {2}, "cut": {2}, "insert": set(), "tail": {5}, "head": {0}}[damage]
    whole = [r for r in got if isinstance(r, warc.Record)]
    assert [r.record_id for r in whole] == [f"urn:page:{i}" for i in range(6) if i not in lost]
    gaps = [g for g in got if isinstance(g, warc.Gap)]
    assert len(gaps) == 1 and gaps[0].reason
    # Records and gaps cover the file without overlap.
    at = 0
    for x in got:
        assert x.offset == at
        at += x.length
    assert at == len(data)


@pytest.mark.parametrize("cut", [8, 9])
def test_a_record_without_its_trailer_stays_if_it_unpacks(cut):
    """The trailer is 8 bytes; whether a byte more hurts the record depends on where deflate's last block ends."""
    parts = list(map(warc.member, records()))
    rest = parts[5][:-cut]
    unpacks = zlib.decompressobj(31).decompress(rest) == records()[5]
    got = read(b"".join([*parts[:5], rest]))
    assert unpacks or cut > 8
    assert [r.record_id for r in got if isinstance(r, warc.Record)] == [f"urn:page:{i}" for i in range(6 if unpacks else 5)]
    assert sum(isinstance(g, warc.Gap) for g in got) == 1


def mixed(n=5, digests=True):
    """Records of one member, as packed bytes, and where each begins in it."""
    parts = [r if digests else re.sub(rb"WARC-(Block|Payload)-Digest: [^\r]*\r\n", b"", r) for r in records(n)]
    return parts, warc.member(b"".join(parts))


def ids(got):
    return [int(r.record_id.rpartition(":")[2]) for r in got if isinstance(r, warc.Record)]


def test_a_bad_record_leaves_the_others_of_its_member():
    parts, _ = mixed()
    parts[3] = parts[3].replace(b"page 3", b"page x", 1)
    got = read(warc.member(b"".join(parts)))
    assert ids(got) == [0, 1, 2, 4]
    gap = next(x for x in got if isinstance(x, warc.Gap))
    assert (gap.inner, gap.inner_length) == (sum(map(len, parts[:3])), len(parts[3])) and "digest" in gap.reason
    assert sum(x.length for x in got) == len(warc.member(b"".join(parts)))


def test_a_member_without_its_last_bytes_keeps_what_unpacks():
    _, data = mixed()
    got = read(data[:-8])
    assert ids(got) == [0, 1, 2, 3, 4] and [x.reason for x in got if isinstance(x, warc.Gap)] == ["the member is cut short"]
    # Without digests of their own only the member's CRC could vouch for them.
    _, data = mixed(digests=False)
    assert ids(read(data)) == [0, 1, 2, 3, 4]
    assert ids(read(data[:-8])) == []


def test_damage_inside_a_member_keeps_the_records_before_it():
    rng = np.random.default_rng(1)
    parts = [warc.compose("response", f"urn:page:{i}", "2024-01-01T00:00:00Z", rng.integers(0, 256, 40_000).astype(np.uint8).tobytes(), "u") for i in range(5)]
    data = bytearray(warc.member(b"".join(parts)))
    data[len(data) * 7 // 10] ^= 0xFF
    got = read(bytes(data) + warc.member(records(7)[6]))
    assert ids(got)[:3] == [0, 1, 2] and ids(got)[-1] == 6 and any(isinstance(x, warc.Gap) for x in got)


def test_a_member_larger_than_what_the_reader_holds():
    parts = [warc.compose("response", f"urn:page:{i}", "2024-01-01T00:00:00Z", bytes([65 + i]) * (1 << 20), "u") for i in range(40)]
    parts[20] = parts[20].replace(b"UUUU", b"uuuu", 1)
    salvage = warc.Salvage(io.BytesIO(warc.member(b"".join(parts)) + warc.member(parts[1])), payloads=False)
    got = list(salvage)
    assert ids(got) == [*range(20), *range(21, 40), 1] and sum(isinstance(x, warc.Gap) for x in got) == 1


def test_a_long_header_and_a_wrong_length():
    long = warc.compose("response", "urn:page:1", "2024-01-01T00:00:00Z", b"x", "http://h.org/" + "a" * (3 << 20))
    assert ids(read(warc.member(long))) == [1] and ids(read(long)) == [1]
    bad = records(2)[0].replace(b"Content-Length: 1", b"Content-Length: 999999999999", 1)
    assert ids(read(warc.member(bad + records(2)[1]))) == [1] and ids(read(bad + records(2)[1])) == [1]


def test_empty_archives():
    assert read(b"") == [] and read(warc.member(b"")) == []
    assert [type(x) for x in read(b"nothing at all")] == [warc.Gap]


def test_revisits_have_the_full_payloads_size():
    r = read(warc.member(warc.compose("revisit", "urn:page:1", "2024-01-01T00:00:00Z", b"xyz", "u", "urn:page:2")))[0]
    assert (r.kind, r.payload, r.payload_bytes, r.refers_to, r.payload_digest) == ("revisit", None, 3, "urn:page:2", warc.digest32(b"xyz"))


# Chat grammar

HOSTILE = ["", " ", "[INST]", "</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST] <\\s>", "x [/INST", "[/INST] [/SYS] <s>", "[ROLE:a] b", "\\", "[", "a </s> b", "[/ROLE]\n"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "a]b[ROLE:%", "User"])
def test_turns_come_back(role):
    for text in HOSTILE:
        out, first, end = chat.render(role, text)
        assert [t[:2] for t in chat.parse(out)] == [(role, text)] and chat.unescape(out[first:end]) == text
    joined = "".join(chat.render(role, t)[0] for t in HOSTILE)
    assert [t[1] for t in chat.parse(joined)] == HOSTILE


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("[]<>/\\sINSTROLEYx :")), max_size=25), st.sampled_from(["user", "assistant", "odd role"]))
def test_any_text_comes_back(text, role):
    assert [t[:2] for t in chat.parse(chat.render(role, text)[0])] == [(role, text)]


@pytest.mark.parametrize("bad", ["x", "[INST] no end", "[INST] [SYS] x [/INST]", "<s> a [/INST]"])
def test_off_the_grammar(bad):
    with pytest.raises(ValueError, match="turn"):
        chat.parse(bad)


# Decontamination


def test_words_and_windows():
    assert [w.decode() for w in decontaminate.words_of("A-b C3 é x".encode())] == ["a", "b", "c3", "é x"]
    assert decontaminate.windows_of([], 10) == [] and decontaminate.windows_of([b"a"], 10) == [(b"a",)]
    assert len(decontaminate.windows_of([b"a"] * 12, 10)) == 3


# Sharding


def test_fisher_yates_is_even():
    counts = np.zeros((4, 4), int)
    for seed in range(4000):
        order = sharding.fisher_yates(4, np.random.default_rng(seed))
        counts[np.arange(4), order] += 1
    assert abs(counts - 1000).max() < 150


# Quality


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(6)
    n, k = 20_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.8
    accuracy = np.linspace(0.75, 0.97, k)
    right = rng.random((n, k)) < accuracy
    vote = np.where(right, good[:, None], ~good[:, None])
    voted = rng.random((n, k)) < 0.8
    letters = np.where(voted, np.where(vote, "g", "b"), "-")
    counts: dict = {}
    for row in letters:
        p = "".join(row)
        counts[p] = counts.get(p, 0) + 1
    model = quality.expectation_maximisation(counts)
    assert abs(model.good - 0.8) < 0.02 and abs(model.right_good - accuracy).max() < 0.03 and abs(model.right_bad - accuracy).max() < 0.05
    told = np.array([model.of("".join(row)) > 0.5 for row in letters])
    assert (told == good).mean() > 0.97


def test_no_documents_no_labels():
    model = quality.expectation_maximisation({})
    assert 0 < model.of("-" * len(quality.LABELLERS)) < 1


def test_measures_of_odd_texts():
    for text in (b"", b" \n", b"|", "é".encode() * 50, b"\xff\xfe", b"a" * 100_000):
        m = quality.measure(text)
        assert all(np.isfinite(m)) and len(quality.votes(m)) == len(quality.LABELLERS)


def vote_of(name, text):
    return quality.votes(quality.measure(text))[[n for n, *_ in quality.LABELLERS].index(name)]


def test_every_document_is_packed():
    """Distinct words may pack badly; a text that packs well never counts as hard to pack."""
    varied = " ".join(f"Kundennummer{k:020d}" for k in range(1000)).encode()
    assert quality.measure(varied).packed < 0.22 and vote_of("hard_to_pack", varied) == "b"
    assert vote_of("hard_to_pack", b"x" * 10_000) == "-"


def test_symbol_runs_count_where_symbols_are_few():
    text = " ".join(f"reasonable{k}" + ("!!!" if k % 8 == 0 else "") for k in range(400)).encode()
    m = quality.measure(text)
    assert m.symbols < 0.04 and m.symbol_runs == 0.125 and vote_of("no_symbol_runs", text) == "b"


def test_only_letters_beyond_ascii_are_letters():
    assert quality.measure("é漢ß".encode()).letters == 1
    assert quality.measure("é。🎉٣".encode()).letters == 0.25
    assert vote_of("mostly_letters", " ".join(["🎉🎉🎉"] * 20).encode()) == "b"


def test_a_fifth_of_repeated_pairs_is_no_good_vote():
    words = [f"w{k}" for k in range(80)]
    text = " ".join(words + words[:21]).encode()
    assert 0.15 < quality.measure(text).repeated_pairs < 0.3 and vote_of("pairs_differ", text) == "-"


# LM


def test_log_probabilities_sum_to_one():
    shape = lm.Shape(outputs=5, endings=4, size=3)
    v = lm.Vocabulary([b"a", b"b"], np.array([5, 3]), 24, 9, 2, np.array([4, 0, 10, 0]), np.array([1, 0, 5, 0]))
    model = lm._fresh(v, shape)
    n = len(v.unigram())
    for near in range(7):
        y = np.arange(n)
        p = np.exp(model.log_p(y, np.full(n, near), np.full(n, 6 - near)))
        assert p.sum() == pytest.approx(1, abs=1e-5)
    # A class of other words, shared among those that are known and one that isn't.
    whole = v.other_tokens[2] + v.other_types[2] + 1
    assert sum((c + 1) / whole for c in [2, 2, 2, 2, 2]) + 1 / whole == pytest.approx(1)


def test_training_helps():
    """Words that alternate: the word before tells the next."""
    shape = lm.Shape(outputs=2, endings=2, size=4, batch=64)
    v = lm.Vocabulary([b"a", b"b"], np.array([500, 500]), 1010, 3, 10, np.zeros(2, np.int64), np.zeros(2, np.int64))
    y = np.tile([3, 4], 500).astype(np.int32)
    near = np.roll(y, 1)
    near[0] = 0
    far = np.roll(y, 2)
    model = lm._fresh(v, shape)
    before = model.log_p(y, near.astype(np.int64), far.astype(np.int64)).mean()
    noise = v.unigram() / v.unigram().sum()
    for k in range(5):
        model.train(y, near, far, noise, np.random.default_rng(k))
    assert model.log_p(y, near.astype(np.int64), far.astype(np.int64)).mean() > before + 0.4
    again = lm._fresh(v, shape).load(model.pack())
    assert np.array_equal(again.out, model.out) and np.array_equal(again.bias, model.bias)


def test_least_owners_of_many_strings():
    """Bulks of suffixes follow one another while prefixes are still compared."""
    rng = np.random.default_rng(3)
    for _ in range(120):
        base = bytes(rng.integers(97, 97 + int(rng.integers(2, 5)), 400).tolist()) + "é".encode() * 30
        strings = sorted({base[a : a + int(rng.integers(50, 90))] for a in rng.integers(0, 380, int(rng.integers(2, 80))).tolist()})
        docs = rng.permutation(len(strings)).tolist()
        least: dict = {}
        for x, d in zip(strings, docs, strict=True):
            for i in range(len(x) - 49):
                least[x[i : i + 50]] = min(d, least.get(x[i : i + 50], d))
        want = [least[x[i : i + 50]] for x in strings for i in range(len(x) - 49)]
        assert suffix_dedup.least_owners(strings, np.array(docs), 50).tolist() == want
