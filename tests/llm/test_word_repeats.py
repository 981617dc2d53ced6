"""Substring dedup by words against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from plinth.llm import superkmer

from .conftest import ROWS


def brute(rows, length):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    at = lambda i, s: (2**63 - 1 if rows[i][0] is None else rows[i][0], s)
    first = {}
    for i, w in enumerate(words):
        for s in range(len(w) - length + 1):
            x = tuple(w[s : s + length])
            first[x] = min(first.get(x, (2**63, 0)), at(i, s))
    out = []
    for i, w in enumerate(words):
        gone = {p for s in range(len(w) - length + 1) if first[tuple(w[s : s + length])] < at(i, s) for p in range(s, s + length)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((rows[i][0], len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def plain(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, bytes(r.kept)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(2)
    base = [rng.choice(["a", "b", "c", "é", "漢"]) for _ in range(400)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 380)
            parts += base[a : a + rng.randint(1, 60)] + [rng.choice("xy") for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([i, i, None, 7]), rng.choice([" ", "\n", "  \t"]).join(parts)))
    return [*rows, (1, None), (2, ""), (3, "  "), (4, "a " * 3000), (4, "a " * 3000), (5, "w" * 50_000), *[rows[0]] * 3]


# Never hot; some minimisers hot; every one; a minimiser as long as the window.
@pytest.mark.parametrize("hot, mark", [(10**6, 8), (3, 4), (0, 1), (5, 20)])
def test_against_all_windows(spark, tmp_path, repeats, hot, mark):
    spark.createDataFrame(repeats, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    assert plain(superkmer.remove_repeats(spark.read.parquet(str(tmp_path / "d")), mark=mark, hot=hot)) == brute(repeats, 20)


def test_awkward_rows(spark, stored_docs, clashing_docs, no_docs):
    want = brute([r[:2] for r in ROWS], 20)
    assert plain(superkmer.remove_repeats(stored_docs)) == want
    assert plain(superkmer.remove_repeats(clashing_docs)) == want
    assert superkmer.remove_repeats(no_docs).count() == 0


def test_super_kmers_hold_every_window_once():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)).encode() for n in (0, 5, 19, 20, 21, 200)] + [b" x" * 60]
    words = superkmer.Words(texts)
    runs = superkmer.SuperKmers(words, 20, 8)
    got = [int(f) + k for f, n in zip(runs.first, runs.count, strict=True) for k in range(n)]
    assert got == [int(words.first[d]) + s for d, t in enumerate(texts) for s in range(len(t.split()) - 19)]
    strings = superkmer._strings(words, runs.first, runs.count, 20)
    seen: dict = {}  # equal windows have equal minimisers
    for s, n, m in zip(strings, runs.count, runs.mark, strict=True):
        x = s.split()
        assert len(x) == n + 19
        for k in range(n):
            assert seen.setdefault(tuple(x[k : k + 20]), m) == m


def test_windows_with_one_hash_are_compared(monkeypatch):
    """With all hashes the same, the words themselves decide."""
    strings = [b"a b c d ", b"b c d e ", b"x a b c "]
    own, place = np.array([5, 3, 9]), np.array([0, 7, 1])
    want = superkmer.repeated(strings, own, place, 3)
    monkeypatch.setattr(superkmer, "_MIX", np.uint64(0))
    got = superkmer.repeated(strings, own, place, 3)
    assert [x.tolist() for x in got] == [x.tolist() for x in want] == [[5, 3, 3, 3, 9, 5], [0, 7, 7, 8, 1, 0], [2, 2, 2]]
