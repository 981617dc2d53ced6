"""The alignment of two tokenizers against their libraries and plain Python."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plinth.llm import alignment

from .conftest import ROWS

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [
    (20, "Hello world <|endoftext|> </s><s>"),
    (21, "漢字 and 🎉 emoji é ﬁ ①"),
    (22, "two  blanks\n\nand\tmore ▁ it"),
    (23, "\x00 nul"),
    (24, "<0x41> and <unk>"),
    (24, "<0x41> and <unk>"),
]


def brute(rows):
    first, of = Tokenizer.from_file(FILES[0]), alignment.byte_characters()
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    docs = []
    for key, text in rows:
        a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or "")
        x = [bytes(of[c] for c in first.id_to_token(i)) for i in a]
        y = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(second.id_to_piece, b), strict=True)]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            docs.append((key, [], [], [], []))
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (x, y)]
        groups, links, before = [], [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[i for i, e in zip(side, at, strict=True) if before < e <= cut] for side, at in zip((a, b), ends, strict=True)])
            links.append((a[ends[0].index(cut)], b[ends[1].index(cut)]))
            before = cut
        docs.append((key, a, b, groups, links))
    count = Counter(link for d in docs for link in d[4])
    best: dict = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    text_of = lambda groups: ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return sorted(((k, len(a), len(b), len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(text_of(g).encode()).hexdigest() if a else "") for k, a, b, g, x in docs), key=str)


def plain(rows):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows), key=str)


def align(df, **options):
    return alignment.align(df, *FILES, public_tokenizers.PATTERN, **options)


def test_against_the_libraries(spark, tmp_path):
    rows = [*[(k, t[:5000] if t else t) for k, t, _ in ROWS], *AWKWARD]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = align(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert plain(got) == brute(rows)
    for r in got:
        assert len(r.a_ids) == r.n_a and len(r.b_ids) == r.n_b and len(r.a_ends) == len(r.b_ends) == r.n_groups
        assert (r.a_ends or [0])[-1] == r.n_a and (r.b_ends or [0])[-1] == r.n_b


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert plain(align(df, details=False).collect()) == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_awkward_tables(spark, stored_docs, clashing_docs, no_docs):
    assert plain(align(clashing_docs).collect()) == plain(align(stored_docs).collect())
    assert align(no_docs).count() == 0


@pytest.mark.parametrize("size", [1, 63, 64, 65, 500])
def test_bits(size):
    rng = np.random.default_rng(size)
    places = np.flatnonzero(rng.random(size) < 0.3)
    bits = alignment.Bits.at(places, size)
    assert bits.select().tolist() == places.tolist()
    assert bits.rank(np.arange(size + 1)).tolist() == [int((places < p).sum()) for p in range(size + 1)]


def test_ranks_of_the_file_are_the_public_ranks():
    from plinth.llm.byte_bpe import read_ranks

    with open(FILES[0], "rb") as file:
        assert alignment.byte_level_ranks(file.read()) == read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
