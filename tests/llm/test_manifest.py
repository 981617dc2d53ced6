"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import string
import zlib

import pytest
from pyspark.sql import functions as F

from plinth.llm import merkle

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
KIND = "doc_id long, source string, lang string, n_chars long, text string"


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    parts = [b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode() for v in values]
    return hashlib.sha256(b"".join(parts)).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def steps(tree, i):
    for nodes in tree[:-1]:
        a = i // 16 * 16
        yield nodes[a:i], nodes[i + 1 : a + 16]
        i //= 16


def brute(rows):
    names = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    trees = {s: levels([leaf(r) for r in groups[s]]) for s in names}
    upper = levels([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*steps(trees[s], i), *steps(upper, j)]
            swap = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            now = leaf((*r[:4], r[4].translate(LOWER))) if swap else trees[s][0][i]
            for a, b in path:
                now = joined(*a, now, *b)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], upper[-1][0], joined(*(x for a, b in path for x in a + b)), now, now == upper[-1][0]))
    return sorted(out, key=str)


def made(spark, tmp_path, rows, name="m", kind=KIND):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def run(df, **options):
    got = merkle.manifest(df, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, **options)
    return sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("cell", [65_536, 12])
def test_manifest_against_a_tree(spark, tmp_path, cell):
    """Nulls, ties, repeats, far-apart and negative keys, a group of over 256 rows, over 16 groups; small cells rank by the next keys."""
    rng = random.Random(1)
    rows = [(rng.choice([i, i, None, 7, -5, 2**40 + i]), rng.choice(["a", "a", None, "", "é", f"s{i % 20}"]), rng.choice(["en", None]), i, rng.choice([None, "", f"Ab{i}", "ÄBC"])) for i in range(500)]
    rows += [rows[3]] * 30
    assert run(made(spark, tmp_path, rows), cell=cell) == brute(rows)


def test_one_row_and_none(spark, tmp_path):
    one = [(4, None, None, None, None)]
    assert run(made(spark, tmp_path, one)) == brute(one)
    assert run(made(spark, tmp_path, [], "none")) == []


def test_other_columns_stay_out(spark, tmp_path):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(40)]
    df = made(spark, tmp_path, rows)
    clash = df.select("*", *[F.lit("own").alias(c) for c in ("rank", "leaf", "root", "subroot", "group_size")])
    assert run(clash) == run(df) == brute(rows)


def test_ranks_are_exact_and_gapless(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(-(2**62), 2**62) if i % 3 else i, f"s{i % 3}", "en", 1, "x") for i in range(400)]
    got = merkle.manifest(made(spark, tmp_path, rows)).select("source", "doc_id", "rank", "group_size").collect()
    for s in ("s0", "s1", "s2"):
        mine = sorted((r.doc_id, r.rank) for r in got if r.source == s)
        assert [k for _, k in mine] == list(range(len(mine))) and {r.group_size for r in got if r.source == s} == {len(mine)}


def test_a_changed_text_is_found(spark, tmp_path):
    rows = [(i, "s", "en", i, f"Text {i}" if i % 2 else "no capitals") for i in range(60)]
    got = merkle.manifest(made(spark, tmp_path, rows), tampered=F.col("doc_id") < 10).collect()
    assert all(r.verified == (r.doc_id >= 10 or r.doc_id % 2 == 0) for r in got)
