"""Cross-tokenizer alignment: where two tokenizers cut the same bytes.

1. Bitsets. Both tokenizers encode a block of documents; a bit for each byte marks where
   a token of the one, or of the other, ends. Their AND has the shared cuts.
2. Rank and select. Set bits of the AND are selected as byte cuts; counts of set bits up
   to a cut (a prefix sum over words and a popcount inside one) turn it into the tokens of
   either side, so a group of tokens between two cuts is two ranges.
3. Links. Each cut links the two tokens that end there. A block counts its distinct pairs
   of ids; the counts are summed over the corpus by pair, and the highest of each id of
   the second tokenizer is found. Pairs leave a block once, however often they occur.
4. Back. A block's pairs come back with their counts and meet its documents, which were
   stored as numbers of pairs, so no text is encoded twice.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import blocks, column, grouped, map_arrow, stored, utf8

BLOCK_BYTES, FILE_BYTES = 4 << 20, 64 << 20


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes are their own characters, the others, in order, follow at 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_ranks(data: bytes) -> dict[bytes, int]:
    """The tokens' bytes and ids in a tokenizers file of a byte-level BPE whose ids ascend as its merges do. Added tokens are left out."""
    file, of = json.loads(data), byte_characters()
    added = {t["content"] for t in file.get("added_tokens", [])}
    vocabulary = {t: i for t, i in file["model"]["vocab"].items() if t not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    ids = [vocabulary["".join(m)] for m in merges]
    if ids != sorted(ids) or len(vocabulary) != 256 + len(set(ids)) or (ids and ids[0] < 256):
        raise ValueError("the ids must ascend as the merges do")
    return {bytes(of[c] for c in t): i for t, i in vocabulary.items()}


class Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, pa.array(tokens, pa.binary())
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The ids of all texts, how many each has, and the bytes that they join to."""
        lists = [np.asarray(ids, np.int32) for ids in self.encode(texts)]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        joined = self.tokens.take(pa.array(ids))
        data = bytes(joined.buffers()[2] or b"") if len(ids) else b""
        ends = np.append(0, np.cumsum(self.size[ids]))[np.append(0, np.cumsum(count))].tolist()
        return ids, count, [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def byte_level(data: bytes, pattern: str) -> Side:
    """Byte-level BPE of a space and the text, without special tokens."""
    import tiktoken

    ranks = byte_level_ranks(data)
    encode = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return Side(lambda texts: (encode(" " + t) for t in texts), tokens)


def pieces(model: bytes) -> Side:
    """A sentencepiece model, which adds the space itself."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    tokens = [bytes([int(t[3:5], 16)]) if p.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(map(p.id_to_piece, range(p.vocab_size())))]
    return Side(lambda texts: (ids for k in range(0, len(texts), 64) for ids in p.encode(texts[k : k + 64], num_threads=1)), tokens)


class Bits:
    """A bitset in 64-bit words with counts before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // 64) * 64, bool)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        word = np.minimum(word, max(0, len(self.words) - 1))  # the end of the last word counts all
        inside = np.where(places >> 6 > word, ~np.uint64(0), (np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(self.words[word] & inside)


class Aligned:
    """Documents encoded by both sides, one after another in the bytes."""

    def __init__(self, texts: list[str], a: Side, b: Side):
        distinct = list(dict.fromkeys(texts))
        number = {t: i for i, t in enumerate(distinct)}
        a_ids, a_count, a_bytes = a.of(distinct)
        b_ids, b_count, b_bytes = b.of(distinct)
        size = np.zeros(len(distinct), np.int64)
        for i, (t, x, y) in enumerate(zip(distinct, a_bytes, b_bytes, strict=True)):
            if t and x == y == b" " + t.encode():
                size[i] = len(x)
        good = size > 0
        self.a, self.b = a_ids[np.repeat(good, a_count)], b_ids[np.repeat(good, b_count)]
        a_count, b_count = np.where(good, a_count, 0), np.where(good, b_count, 0)
        a_end, b_end = np.cumsum(a.size[self.a]), np.cumsum(b.size[self.b])
        total = int(size.sum())
        bits_a, bits_b = Bits.at(a_end - 1, total), Bits.at(b_end - 1, total)
        shared = bits_a & bits_b
        self.cuts = shared.select() + 1
        # Tokens of either side before each cut: the ranges of group g are [upto[g], upto[g + 1]).
        self.a_upto, self.b_upto = (np.append(0, x.rank(self.cuts)) for x in (bits_a, bits_b))
        bound = np.append(0, np.cumsum(size))
        self.group = np.append(0, shared.rank(bound[1:])) if total else np.zeros(len(bound), np.int64)
        self.a_group, self.b_group = shared.rank(a_end - 1) if total else a_end, shared.rank(b_end - 1) if total else b_end
        self.a_first, self.b_first = np.append(0, np.cumsum(a_count)), np.append(0, np.cumsum(b_count))
        self.pairs = self.a[self.a_upto[1:] - 1] << 32 | self.b[self.b_upto[1:] - 1]  # a link at each cut
        self.which = np.fromiter((number[t] for t in texts), np.int64, len(texts))

    def digests(self, texts: Texts) -> list[str]:
        """For each distinct text the digest of its groups as text; '' without tokens."""
        n = len(self.a) + len(self.b)
        spot_a = np.arange(len(self.a)) + self.b_upto[self.a_group]
        spot_b = np.arange(len(self.b)) + self.a_upto[self.b_group + 1]
        code = np.empty(n, np.int64)
        last_a = np.zeros(len(self.a), bool)
        last_a[self.a_upto[1:] - 1] = True
        last_b, end = np.zeros(len(self.b), np.int64), self.b_first[1:][np.diff(self.b_first) > 0] - 1
        last_b[self.b_upto[1:] - 1] = 2
        last_b[end] = 3
        code[spot_a] = 4 * self.a + last_a
        code[spot_b] = 4 * self.b + last_b
        text = texts.all.take(pa.array(code))
        data = bytes(text.buffers()[2] or b"") if n else b""
        at = np.append(0, np.cumsum(texts.size[code]))[self.a_first + self.b_first].tolist()
        return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(at, at[1:], strict=False)]


class Texts:
    """Each id as text with what may follow it: a comma, a bar (the first side ends), a semicolon (a group ends) or nothing."""

    def __init__(self, n: int):
        every = [f"{i}{after}".encode() for i in range(n) for after in (",", "|", ";", "")]
        self.all, self.size = pa.array(every, pa.binary()), np.fromiter(map(len, every), np.int64, len(every))


_HELD: dict[tuple, tuple] = {}


def _sides(key: tuple, a, b, pattern: str) -> tuple[Side, Side, Texts]:
    if key not in _HELD:
        _HELD.clear()
        sides = byte_level(a.value, pattern), pieces(b.value)
        _HELD[key] = (*sides, Texts(max(len(s.tokens) for s in sides)))
    return _HELD[key]


_DOC = "block long, row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, pairs array<long>, times array<long>"
_ARROW = pa.schema(
    [("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary())]
    + [(c, pa.list_(pa.int32())) for c in ("a_ids", "b_ids", "a_ends", "b_ends")]
    + [(c, pa.list_(pa.int64())) for c in ("pairs", "times")]
)
_ROWS = 2048


def _align(a, b, pattern: str, key: tuple, details: bool):
    def run(batches):
        first, second, texts_of = _sides(key, a, b, pattern)
        for block, rows in blocks(batches, "text", BLOCK_BYTES):
            got = Aligned([t.decode("utf-8", "replace") for t in rows.column("text").to_pylist()], first, second)
            digests = got.digests(texts_of)
            # Pairs of the block and how often they occur: a text counts as often as the block has it.
            pair, link = np.unique(got.pairs, return_inverse=True)
            copies = np.bincount(got.which, minlength=len(got.group) - 1)
            times = np.bincount(link, weights=np.repeat(copies, np.diff(got.group)), minlength=len(pair)).astype(np.int64)
            link = link.astype(np.uint32)
            groups, n_a, n_b = np.diff(got.group), np.diff(got.a_first), np.diff(got.b_first)
            row, doc = rows.column("row").to_pylist(), rows.column("doc_id").to_pylist()
            for at in range(0, len(row), _ROWS):
                out = []
                for i, w in enumerate(got.which[at : at + _ROWS].tolist(), at):
                    cut = slice(got.group[w], got.group[w + 1])
                    one = {"block": block, "row": row[i], "doc_id": doc[i], "n_a": n_a[w], "n_b": n_b[w], "n_groups": groups[w], "groups_sha256": digests[w], "links": link[cut].tobytes()}
                    if details:
                        x, y = got.a_first[w], got.b_first[w]
                        ends = slice(got.group[w] + 1, got.group[w + 1] + 1)
                        one |= {"a_ids": got.a[x : got.a_first[w + 1]], "b_ids": got.b[y : got.b_first[w + 1]], "a_ends": got.a_upto[ends] - x, "b_ends": got.b_upto[ends] - y}
                    out.append(one)
                yield pa.RecordBatch.from_pylist(out, _ARROW)
            yield pa.RecordBatch.from_pylist([{"block": block, "pairs": pair, "times": times}], _ARROW)

    return run


_KEPT = ("doc_id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "a_ids", "b_ids", "a_ends", "b_ends")


def _count(batches):
    for _, rows in grouped(batches, "block"):
        told = rows.filter(pa.compute.is_valid(rows.column("place")))
        total = told.column("total").to_numpy()
        best = total == told.column("best").to_numpy()
        docs = rows.filter(pa.compute.is_null(rows.column("place")))
        links = [np.frombuffer(x, np.uint32) for x in docs.column("links").to_pylist()]
        size = np.fromiter(map(len, links), np.int64, len(links))
        bound = np.append(0, np.cumsum(size))
        every = np.concatenate(links) if links else np.zeros(0, np.uint32)
        summed = lambda v: np.diff(np.append(0, np.cumsum(v))[bound])  # noqa: E731, B023
        made = [pa.array(size), pa.array(summed(best[every].astype(np.int64))), pa.array(summed(total[every]))]
        yield from pa.Table.from_arrays([*(docs.column(c) for c in _KEPT), *made], names=[*_KEPT, "n_links", "n_best", "count_sum"]).to_batches()


def align(docs: DataFrame, first: str, second: str, pattern: str, key: str = "doc_id", text: str = "text", details: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with ``details`` a_ids, b_ids, a_ends, b_ends.

    ``first`` is a tokenizers file of a byte-level BPE, split by ``pattern``, which encodes
    a space and the text; ``second`` a sentencepiece model, which adds the space itself.
    Special tokens' strings are plain text. Bytes at which tokens of both end cut them
    into groups; a_ends and b_ends are the tokens up to each cut. A link is a pair of
    tokens that end together, one for each cut; n_best counts the links whose pair of ids
    is linked as often in the corpus as any pair with the same second id (ties included),
    count_sum sums the counts of their pairs. groups_sha256 digests ``a1,a2|b1;a3|b2,b3``.

    A text that is null or empty, or that a tokenizer doesn't give back byte for byte
    (normalised blanks, say), has no tokens: zeros, an empty digest, empty lists. Texts of
    any length count whole; rows that repeat are each a row and count each. Null keys
    stay. An empty table gives no rows; other columns are not read. The files, 64 MB at
    most each, are read on the driver and broadcast.
    """
    import os

    if any(os.path.getsize(p) > FILE_BYTES for p in (first, second)):
        raise ValueError("a tokenizer's file is larger than 64 MB")
    context = docs.sparkSession.sparkContext
    sides = []
    for path in (first, second):
        with open(path, "rb") as file:
            sides.append(context.broadcast(file.read()))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), utf8(text).alias("text"))
    aligned = stored(map_arrow(rows, _align(*sides, pattern, (first, second, pattern), details), _DOC), "aligned")

    asked = aligned.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "it")).select("block", "place", F.col("it.pairs").alias("pair"), F.col("it.times").alias("n"))
    totals = stored(asked.groupBy("pair").agg(F.sum("n").alias("total")), "pairs")
    # A row for each id of the second tokenizer: no more than its vocabulary has.
    other = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = totals.groupBy(other.alias("second")).agg(F.max("total").alias("best"))
    told = asked.join(totals.withColumn("second", other).join(F.broadcast(best), "second"), "pair").select("block", "place", "total", "best")
    met = aligned.where("pairs IS NULL").drop("pairs", "times").unionByName(told, allowMissingColumns=True)
    met = met.repartition("block").sortWithinPartitions("block", F.asc_nulls_last("place"), "row")
    lists = "a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
    out = map_arrow(met, _count, f"doc_id long, row long, n_a long, n_b long, n_groups long, groups_sha256 string, {lists}, n_links long, n_best long, count_sum long")
    empty = F.array().cast("array<int>")
    extra = [F.coalesce(c, empty).alias(c) for c in ("a_ids", "b_ids", "a_ends", "b_ends")] if details else []
    return out.select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *extra)
