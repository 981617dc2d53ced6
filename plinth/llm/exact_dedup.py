"""Exact dedup: a cuckoo filter over live digests, with the digests it holds beside it.

The index keeps one live row for each distinct text. Its cuckoo filter answers
"surely new" from 16-bit fingerprints; a hit is verified against the full SHA-256
digest stored in the same bucket. A row that outranks the live one deletes that one
and is inserted in its place. When an insertion finds no slot, the index doubles and
is filled again from the stored keys.

Work is spread in two rounds. Each input task runs an index over its own rows, so a
text that fills a third of the table leaves a task as one row. These rows meet by
digest, in content buckets (the digest's first two bytes) that pass one by one, so
the second index holds one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import column, columns_of, map_arrow

SLOTS = 4
MAX_KICKS = 200
#: A task passes on what its index holds at this many live digests, and starts anew.
LOCAL_ENTRIES = 1_000_000


class CuckooIndex:
    """digest -> value, for digests of at least 16 bytes that are evenly spread."""

    def __init__(self, buckets: int = 256):
        self._make(buckets)

    def _make(self, buckets: int) -> None:
        self.mask, self.size = buckets - 1, 0
        self.prints = bytearray(2 * SLOTS * buckets)
        self.keys: list = [None] * (SLOTS * buckets)
        self.values: list = [None] * (SLOTS * buckets)

    def __len__(self) -> int:
        return self.size

    def _places(self, key: bytes) -> tuple[bytes, int, int]:
        mark = key[8:10] if key[8:10] != b"\0\0" else b"\0\1"
        first = int.from_bytes(key[:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: bytes) -> int:
        return bucket ^ (int.from_bytes(mark, "little") * 0x5BD1E995 & self.mask)

    def _find(self, key: bytes) -> int:
        """The slot of a live key, -1 if there is none."""
        mark, a, b = self._places(key)
        prints, keys = self.prints, self.keys
        for bucket in (a, b) if a != b else (a,):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if prints[2 * slot : 2 * slot + 2] == mark and keys[slot] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        slot = self._find(key)
        return None if slot < 0 else self.values[slot]

    def delete(self, key: bytes) -> bool:
        slot = self._find(key)
        if slot < 0:
            return False
        self.prints[2 * slot : 2 * slot + 2] = b"\0\0"
        self.keys[slot] = self.values[slot] = None
        self.size -= 1
        return True

    def insert(self, key: bytes, value) -> None:
        """Add a key that is not live."""
        mark, bucket, other = self._places(key)
        if self._put(bucket, mark, key, value) or self._put(other, mark, key, value):
            return
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            old = bytes(self.prints[2 * slot : 2 * slot + 2]), self.keys[slot], self.values[slot]
            self.prints[2 * slot : 2 * slot + 2], self.keys[slot], self.values[slot] = mark, key, value
            mark, key, value = old
            bucket = self._other(bucket, mark)
            self.size -= 1
            if self._put(bucket, mark, key, value):
                self.size += 1
                return
            self.size += 1
        self._resize(key, value)

    def _put(self, bucket: int, mark: bytes, key: bytes, value) -> bool:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.keys[slot] is None:
                self.prints[2 * slot : 2 * slot + 2], self.keys[slot], self.values[slot] = mark, key, value
                self.size += 1
                return True
        return False

    def _resize(self, key: bytes, value) -> None:
        held = [*self.items(), (key, value)]
        self._make(2 * (self.mask + 1))
        for k, v in held:
            self.insert(k, v)

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def offer(index: CuckooIndex, digest: bytes, rank: tuple, count: int) -> None:
    """Put a row into the index: the highest rank of a digest is the live one."""
    live = index.get(digest)
    if live is None:
        index.insert(digest, (rank, count))
    elif rank > live[0]:
        index.delete(digest)
        index.insert(digest, (rank, count + live[1]))
    else:
        index.delete(digest)
        index.insert(digest, (live[0], count + live[1]))


LIVE = "digest binary, keep_id long, keep_row long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_NO_ID = -(2**63)


def _rows(index: CuckooIndex) -> pa.RecordBatch:
    found = list(index.items())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in found], pa.binary()),
            pa.array([None if v[0][0] == _NO_ID else v[0][0] for _, v in found], pa.int64()),
            pa.array([v[0][1] for _, v in found], pa.int64()),
            pa.array([v[1] for _, v in found], pa.int64()),
        ],
        schema=_ARROW,
    )


def _local(batches):
    index = CuckooIndex()
    for batch in batches:
        for doc, row, text in zip(column(batch, "doc").to_pylist(), column(batch, "row").to_pylist(), column(batch, "digest").to_pylist(), strict=True):
            offer(index, text, (_NO_ID if doc is None else doc, row), 1)
        if len(index) >= LOCAL_ENTRIES:
            yield _rows(index)
            index = CuckooIndex()
    if len(index):
        yield _rows(index)


def _merge(batches):
    index, at = CuckooIndex(), None
    for batch in batches:
        for digest, doc, row, n in zip(*(column(batch, c).to_pylist() for c in ("digest", "keep_id", "keep_row", "group_size")), strict=True):
            if digest[:2] != at:
                if len(index):
                    yield _rows(index)
                index, at = CuckooIndex(16), digest[:2]
            offer(index, digest, (_NO_ID if doc is None else doc, row), n)
    if len(index):
        yield _rows(index)


def with_digests(docs: DataFrame, key: str, text: str, normalise: Callable | None = None) -> DataFrame:
    """``docs`` with __row (a number of the row) and __digest (SHA-256 of its normalised text)."""
    c = F.coalesce(F.col(text), F.lit(""))
    c = normalise(c) if normalise else c
    return docs.withColumns({"__row": F.monotonically_increasing_id(), "__digest": F.unhex(F.sha2(c.cast("binary"), 256))})


def live_rows(rows: DataFrame, key: str) -> DataFrame:
    """One row for each distinct digest: digest, keep_id, keep_row, group_size."""
    local = map_arrow(rows.select(F.col(key).cast("long").alias("doc"), F.col("__row").alias("row"), F.col("__digest").alias("digest")), _local, LIVE)
    met = local.withColumn("bucket", F.substring("digest", 1, 2)).repartition("bucket").sortWithinPartitions("bucket").drop("bucket")
    return map_arrow(met, _merge, LIVE)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: Callable | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows whose normalised texts are the same bytes form a group (told by their SHA-256,
    which the index holds as its keys: a hit of the filter is verified against the whole
    digest in its bucket, not against the text itself); the one with the largest ``key``
    stays. Keys must be whole numbers, or cast to them: others fail under ANSI rules. A null text is an empty one; a null key ranks lowest. Of
    rows that share text and key, the one read last stays, so that every group keeps
    exactly one row. An empty table gives no rows. Other columns are not read.
    ``normalise`` maps a text column to a text column. ``docs`` must be a stored
    table (or a checkpoint), so that a row keeps its number when it is read again.
    """
    rows = with_digests(docs, key, text, normalise)
    live = live_rows(rows, key)
    per_row = rows.select(F.col(key).alias("doc_id"), F.col("__row").alias("row"), F.col("__digest").alias("digest"))
    return per_row.join(live, "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: Callable | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns."""
    rows = with_digests(docs, key, text, normalise)
    keep = live_rows(rows, key).select(F.col("keep_row").alias("__row"))
    return rows.join(keep, "__row", "left_semi").select(*columns_of(docs))
