"""Byte-level BPE by backtracking over longest matches.

A text's bytes become Latin-1 characters, one for each byte, so that one
Aho-Corasick automaton over the vocabulary finds the longest token at every place in
a single pass. Encoding takes the longest token that can follow the one before it; a
pair can stand side by side exactly if undoing merges on both sides of the seam finds
no merge across it that would have come first. Where no token fits, the encoder steps
back and marks the place, so each place is left at most once and the work is linear.
Pairs and whole pieces are memoised.
"""

from __future__ import annotations

import base64

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import column, columns_of, map_arrow, small, utf8

#: Entries that a worker's memo of pieces or of pairs may hold before it starts anew.
MEMO = 200_000
#: Characters of a piece that is worth remembering, at most.
MEMO_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes pieces of bytes as merging by rank would. Ranks must be 0 to n-1 and hold all bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        n = len(ranks)
        if sorted(ranks.values()) != list(range(n)) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks must be 0 to n-1 and hold every single byte")
        self.bytes: list[bytes] = [b""] * n
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.length = [len(t) for t in self.bytes]
        self.shorter = [self._longest_proper_prefix(t.decode("latin-1")) for t in self.bytes]
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.ids.items():
            self.found.add_word(token, rank)
        self.found.make_automaton()
        self.n, self.pairs = n, {}
        self.merged: dict[int, int] = {}
        self.left, self.right = list(range(n)), list(range(n))
        for rank in range(n):
            self._learn_split(rank)
        self.pieces: dict[str, list[int]] = {}

    def _longest_proper_prefix(self, token: str) -> int:
        return next((self.ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ids), -1)

    def _learn_split(self, rank: int) -> None:
        """The two tokens that merge into ``rank``; a token that no merge reaches stays whole."""
        token, a = self.bytes[rank].decode("latin-1"), self.shorter[rank]
        while a >= 0:
            b = self.ids.get(token[self.length[a] :], rank)
            if a < rank and b < rank and self._stands(a, b):
                self.merged[a * self.n + b] = rank
                self.left[rank], self.right[rank] = a, b
                return
            a = self.shorter[a]

    def _stands(self, a: int, b: int) -> bool:
        """True if ``a`` then ``b`` stay two tokens when their bytes are merged by rank."""
        merged, left, right, n = self.merged, self.left, self.right, self.n
        bound = n
        while True:
            if merged.get(a * n + b, n) < bound:
                return False
            # Undo the later of the two merges beside the seam; only earlier ones may still cross it.
            if a > b:
                if right[a] != a:
                    bound, a = a, right[a]
                elif left[b] != b:
                    bound, b = b + 1, left[b]
                else:
                    return True
            elif left[b] != b:
                bound, b = b + 1, left[b]
            elif right[a] != a:
                bound, a = a, right[a]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        key = a * self.n + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self._stands(a, b)
        return known

    def piece(self, s: str) -> list[int]:
        """The tokens of one piece, given as Latin-1 characters."""
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        n, length, shorter, fits = len(s), self.length, self.shorter, self.fits
        longest = [0] * n
        for end, token in self.found.iter(s):
            longest[end - length[token] + 1] = token  # ends rise, so the longest comes last
        open_, out, at = bytearray(b"\1") * (n + 1), [], 0
        token = longest[0]
        while at < n:
            before = out[-1] if out else -1
            while token >= 0 and not (open_[at + length[token]] and (before < 0 or fits(before, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str, split) -> list[int]:
        """The tokens of a text, each match of ``split`` encoded by itself."""
        out: list[int] = []
        pieces = self.pieces
        for s in split(text):
            got = pieces.get(s)
            if got is None:
                got = self.piece(s if s.isascii() else s.encode().decode("latin-1"))
                if len(s) <= MEMO_CHARS:  # long pieces hardly come again and would fill the worker
                    if len(pieces) >= MEMO:
                        pieces.clear()
                    pieces[s] = got
            out += got
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(key: tuple, ranks: dict[bytes, int]) -> Encoder:
    """One encoder for each vocabulary that a worker meets."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), kind))


def _with(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"{q} {f.dataType.simpleString()}" for q, f in zip(columns_of(df), df.schema.fields, strict=True) if f.name not in (name, "__in")), f"`{name}` {kind}"])


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [f for f in batch.schema.names if f not in (name, "__in")]
    return pa.RecordBatch.from_arrays([*(column(batch, f) for f in kept), values], names=[*kept, name])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column ``ids`` (array<int>): the tokens of the whole ``text``.

    Without special tokens: their strings are ordinary text. Null and empty texts have
    no tokens. All other columns stay; one named as ``ids`` is replaced. Rows keep
    their number and order. ``ranks_path`` is read on the driver and broadcast (a
    vocabulary file; more than 64 MB is refused).
    """
    import os

    if os.path.getsize(ranks_path) > 64 << 20:
        raise ValueError("the vocabulary is larger than 64 MB")
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = (ranks_path, len(ranks.value))

    def run(batches):
        encoder, split = _encoder(key, ranks.value), regex.compile(pattern).findall
        for batch in small(batches, "__in"):
            texts = column(batch, "__in").to_pylist()
            yield _replaced(batch, ids, _lists([np.array(encoder.encode(t.decode("utf-8", "replace"), split), np.int32) for t in texts], pa.int32()))

    rows = df.withColumn("__in", utf8(text))
    return map_arrow(rows, run, _with(rows, ids, "array<int>"))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``df`` with a binary column ``data``: the bytes that its tokens stand for, joined.

    Null is no tokens. An unknown token number fails. All other columns stay; one named as
    ``data`` is replaced. Rows that repeat are each a row; an empty table gives none.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        words = pa.array(sorted(ranks.value, key=ranks.value.get), pa.binary())
        for batch in small(batches, "__in", 1 << 20):
            lists = column(batch, "__in")
            joined = words.take(lists.flatten())  # the tokens' bytes lie one after another
            ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield _replaced(batch, data, pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends[cuts]), joined.buffers()[2] or pa.py_buffer(b"")]))

    rows = df.withColumn("__in", F.coalesce(F.col(ids), F.array().cast("array<int>")))
    return map_arrow(rows, run, _with(rows, data, "binary"))
