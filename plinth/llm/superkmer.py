"""Substring dedup by words: super-k-mers meet in the bucket of their minimiser.

Of each window of ``length`` words the ``mark`` words with the smallest hash are its
minimiser. Consecutive windows with the same one make a super-k-mer: one packed string
of words that stands for all its windows. Equal windows have equal minimisers, so they
meet in one bucket.

1. Minimisers. Each block of documents tells how many distinct super-k-mers it has at
   each minimiser. What comes back is whether it is alone (none of its windows can occur
   twice), shared, or hot (more super-k-mers than a bucket should hold).
2. Super-k-mers. Each distinct string of a block goes once, with its first place, to the
   bucket of its minimiser. A hot minimiser's windows go one by one to the buckets of
   their own hashes instead, each distinct one once, so no bucket holds all of them.
3. Windows. A bucket numbers the words, sorts the windows of its strings by a hash of the
   numbers, and compares neighbours word by word; the first place of each window decides
   which ones have occurred before.
4. Removal. Each block covers the words of the windows that it is told of.

The texts are read three times in the same partitions and never shuffled. Copies cost
one string for each block that has them.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import Answers, blocks, column, forget, grouped, map_arrow, parts_of, shared_dir, stored, utf8, write_answers
from plinth.llm.suffix_dedup import _least, _table, _tables

#: Words of a minimiser; text in a block; text for each bucket of minimisers and of strings.
MARK, BLOCK_BYTES, BUCKET_BYTES, SHARD_BYTES = 8, 8 << 20, 48 << 20, 8 << 20
#: Super-k-mers that may meet at one minimiser; windows of hotter ones go one by one.
HOT = 32_768
_ALONE, _SHARED, _HOT = 0, 1, 2
_LAST = 2**63 - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of texts, joined by one space and each followed by one."""

    def __init__(self, texts: list[bytes]):
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        ends = blank.copy()  # the blank right after a word
        ends[:1] = False
        ends[1:] &= ~blank[:-1]
        keep = ~blank | ends
        data = raw[keep]
        data[ends[keep]] = 32
        self.data = data
        self.stop = np.flatnonzero(ends[keep])  # of each word, its space
        self.start = np.append(0, self.stop[:-1] + 1) if len(self.stop) else np.zeros(0, np.int64)
        bound = np.append(0, np.cumsum(ends, dtype=np.int64))
        cuts = np.append(0, np.cumsum(size))
        self.first = bound[cuts]  # the first word of each text, and the end
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.stop)

    def hashes(self) -> np.ndarray:
        """A hash of each word: a polynomial of its bytes."""
        if not len(self):
            return np.zeros(0, np.uint64)
        out, part = np.empty(len(self), np.uint64), np.append(np.flatnonzero(np.diff(self.start // _CHUNK, prepend=-1)), len(self))
        for a, b in zip(part[:-1].tolist(), part[1:].tolist(), strict=True):  # about a chunk of bytes at a time
            start = self.start[a:b] - self.start[a]
            data = self.data[self.start[a] : self.stop[b - 1] + 1] + np.uint64(1)
            at = np.arange(len(data)) - np.repeat(start, self.stop[a:b] - self.start[a:b] + 1)
            powers = np.cumprod(np.full(int(at.max()) + 1, 0x100000001B3, np.uint64))
            out[a:b] = np.add.reduceat(data * powers[at], start)
        return _mixed(out)


class SuperKmers:
    """Runs of windows with one minimiser: first word, windows, minimiser's hash."""

    def __init__(self, words: Words, length: int, mark: int):
        h = words.hashes()
        n = len(h) - mark + 1
        first, count, marks = [], [], []
        if n > 0:
            g = np.zeros(n, np.uint64)
            for k in range(mark):
                g = (g + h[k : k + n]) * _MIX
                g ^= g >> np.uint64(29)
            g, width = _mixed(g), length - mark + 1
            low, places = np.uint64((1 << 21) - 1), np.arange(_CHUNK + width, dtype=np.uint64)
            for at in range(0, len(h) - length + 1, _CHUNK):
                part = g[at : at + _CHUNK + width - 1]
                best = _least((part & ~low) | places[: len(part)], width)
                place = (best & low).astype(np.int64)
                doc = words.doc[at : at + len(place)]
                own = doc == words.doc[at + length - 1 : at + length - 1 + len(place)]
                change = np.ones(len(place), bool)
                change[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])
                new = np.flatnonzero(change)
                many = np.diff(np.append(new, len(place)))
                new, many = new[own[new]], many[own[new]]
                first.append(new + at)
                count.append(many)
                marks.append(part[place[new]])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.first, self.count, self.mark = join(first, np.int64), join(count, np.int64), join(marks, np.uint64)


def _strings(words: Words, first: np.ndarray, count: np.ndarray, length: int) -> list[bytes]:
    data = words.data.tobytes()
    return [data[a:b] for a, b in zip(words.start[first].tolist(), (words.stop[first + count + length - 2] + 1).tolist(), strict=True)]


class _Distinct:
    """The distinct strings among runs that are in the order of their places: the first place of each one."""

    def __init__(self, strings: list[bytes]):
        number: dict[bytes, int] = {}
        self.which = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
        self.strings = list(number)
        self.first = np.unique(self.which, return_index=True)[1]


def _split(words: Words, runs: SuperKmers, ids: np.ndarray, hot: np.ndarray, chosen: np.ndarray, length: int):
    """Runs that are sent, by (id, place): first word, windows, the hash that deals them. Hot ones fall apart into windows."""
    whole = chosen & ~hot
    first, count, mark = runs.first[whole], runs.count[whole], runs.mark[whole]
    if hot.any():
        n = runs.count[hot]
        each = np.repeat(runs.first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        h = words.hashes()
        g = np.zeros(len(each), np.uint64)
        for k in range(length):
            g = (g + h[each + k]) * _MIX
            g ^= g >> np.uint64(29)
        first, count, mark = np.concatenate([first, each]), np.concatenate([count, np.ones(len(each), np.int64)]), np.concatenate([mark, _mixed(g)])
    doc = words.doc[first]
    order = np.lexsort((first - words.first[doc], ids[doc]))
    return first[order], count[order], mark[order]


_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("marks", pa.binary()), ("docs", pa.binary()), ("also", pa.binary())])
_ASK_KIND = "bucket int, block long, marks binary, docs binary, also binary"
_TOLD = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
_TOLD_KIND = "part int, block long, bucket int, data binary"


def _marks(words: Words, runs: SuperKmers, length: int, n_buckets: int):
    """Distinct minimisers by bucket and hash, with how many distinct super-k-mers each has (a repeat within the block counts as a second one)."""
    mark, back = np.unique(runs.mark, return_inverse=True)
    times = np.bincount(back, minlength=len(mark))
    several = times[back] > 1
    if several.any():  # only these can have equal strings
        at = np.flatnonzero(several)
        distinct = _Distinct(_strings(words, runs.first[at], runs.count[at], length))
        held = np.bincount(back[at[distinct.first]], minlength=len(mark))
        times = np.where(times > 1, np.maximum(held, 2), 1)
    bucket = (mark % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], mark[order], times[order].astype(np.uint32)


def _ask_marks(length: int, mark: int, n_buckets: int):
    def run(batches):
        for block, rows in blocks(batches, "text", BLOCK_BYTES):
            words = Words(rows.column("text").to_pylist())
            bucket, marks, times = _marks(words, SuperKmers(words, length, mark), length, n_buckets)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            yield from _tables(
                ({"bucket": int(bucket[a]), "block": block, "marks": marks[a:b].tobytes(), "docs": times[a:b].tobytes(), "also": b""} for a, b in zip(cuts, [*cuts, len(bucket)][1:], strict=True)),
                _ASK,
            )

    return run


def _answer_marks(hot: int):
    def run(batches):
        for bucket, rows in grouped(batches, "bucket"):
            asked = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("marks")]
            times = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows.column("docs")]).astype(np.int64)
            _, back = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.bincount(back, weights=times)[back]
            code = np.where(total > hot, _HOT, np.where(total > 1, _SHARED, _ALONE)).astype(np.uint8)
            ends = np.cumsum([len(m) for m in asked]).tolist()
            yield from _tables(({"part": block >> 24, "block": block, "bucket": bucket, "data": code[end - len(m) : end].tobytes()} for block, m, end in zip(rows.column("block").to_pylist(), asked, ends, strict=True)), _TOLD)

    return run


def _cut(told: str, length: int, mark: int, n_buckets: int, n_shards: int):
    """For each shard a block's distinct strings with their first places. Shard -1: where each run is, and the string that it is."""

    def run(batches):
        got = Answers(told, ["block", "bucket", "data"])
        for block, rows in blocks(batches, "text", BLOCK_BYTES):
            words, ids = Words(rows.column("text").to_pylist()), rows.column("id").to_numpy()
            runs = SuperKmers(words, length, mark)
            marks, back = np.unique(runs.mark, return_inverse=True)
            answers = got.of(block)[1]
            code = np.frombuffer(b"".join(answers), np.uint8)
            if len(code) != len(marks):
                raise RuntimeError("the blocks differ from those of the first pass: dedup a stored table")
            by_mark = np.empty(len(marks), np.uint8)
            by_mark[np.argsort(marks % np.uint64(n_buckets), kind="stable")] = code
            state = by_mark[back]
            first, count, deal = _split(words, runs, ids, state == _HOT, state != _ALONE, length)
            if not len(first):
                continue
            distinct = _Distinct(_strings(words, first, count, length))
            strings, head = distinct.strings, distinct.first
            shard = ((deal[head] >> np.uint64(20)) % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            doc = words.doc[first]
            own, place = ids[doc], first - words.first[doc]
            cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist()

            def sent(block=block, strings=strings, shard=shard, order=order, own=own[head], place=place[head], cuts=cuts):
                for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    pick = order[a:b]
                    sizes = np.fromiter((len(strings[i]) for i in pick.tolist()), np.int64, len(pick))
                    yield {"bucket": int(shard[pick[0]]), "block": block, "marks": b"".join([strings[i] for i in pick.tolist()]), "docs": np.concatenate([own[pick], place[pick]]).tobytes(), "also": sizes.tobytes()}

            yield from _tables(sent(), _ASK)
            at = np.empty(len(order), np.int64)
            at[order] = np.arange(len(order))
            # A later place of a string that the block has: all its windows have occurred before.
            later = (own != own[head][distinct.which]) | (place != place[head][distinct.which])
            note = np.concatenate([first, count, at[distinct.which], later]).astype(np.int32)
            yield _table([{"bucket": -1, "block": block, "marks": note.tobytes(), "docs": b"", "also": b""}], _ASK)

    return run


def repeated(strings: list[bytes], own: np.ndarray, place: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string of words the first (own, place) of each of its windows: two arrays, all windows one after another.

    ``own`` and ``place`` say where each string has its first word.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    stop = np.flatnonzero(data == 32).astype(np.int32) + 1
    word = pa.Array.from_buffers(pa.binary(), len(stop), [None, pa.py_buffer(np.append(np.int32(0), stop)), pa.py_buffer(data)])
    number = word.dictionary_encode().indices.to_numpy().astype(np.uint64)
    size = np.fromiter((s.count(b" ") for s in strings), np.int64, len(strings))
    n = size - length + 1  # windows
    begin = np.cumsum(n) - n
    offset = np.arange(n.sum()) - np.repeat(begin, n)
    at = np.repeat(np.cumsum(size) - size, n) + offset
    owner, where = np.repeat(own, n), np.repeat(place, n) + offset
    h = np.zeros(len(at), np.uint64)
    for k in range(length):
        h = (h + number[at + k] + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
    order = np.lexsort((where, owner, h))
    same = h[order[1:]] == h[order[:-1]]
    differ = np.zeros(len(same), bool)
    pairs = np.flatnonzero(same)
    for k in range(length):
        differ[pairs] |= number[at[order[pairs + 1]] + k] != number[at[order[pairs]] + k]
    if differ.any():  # different windows with one hash: sort by the words themselves
        order = np.lexsort((where, owner, *[number[at + k] for k in range(length - 1, -1, -1)]))
        same = np.ones(len(order) - 1, bool)
        for k in range(length):
            same &= number[at[order[1:]] + k] == number[at[order[:-1]] + k]
    head = np.append(True, ~same)
    lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    first = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    first[0][order], first[1][order] = owner[lead], where[lead]
    return [*first, n]


def _answer_strings(length: int):
    def run(batches):
        batches = iter(batches)
        for batch in batches:  # notes of shard -1 come first and go on as they are
            mine = pa.compute.less(column(batch, "bucket"), 0)
            notes, rest = batch.filter(mine), batch.filter(pa.compute.invert(mine))
            for block, data in zip(column(notes, "block").to_pylist(), column(notes, "marks").to_pylist(), strict=True):
                yield _table([{"part": block >> 24, "block": block, "bucket": -1, "data": data}], _TOLD)
            if rest.num_rows:
                batches = chain([rest], batches)
                break
        else:
            return
        for shard, rows in grouped(batches, "bucket"):
            number: dict[bytes, int] = {}
            which, places = [], []
            for data, docs, sizes in zip(rows.column("marks").to_pylist(), rows.column("docs").to_pylist(), rows.column("also").to_pylist(), strict=True):
                ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
                which.append(np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)), np.int64, len(ends)))
                places.append(np.frombuffer(docs, np.int64).reshape(2, -1))
            every, place = np.concatenate(which), np.concatenate(places, axis=1)
            order = np.lexsort((place[1], place[0], every))
            head = order[np.flatnonzero(np.diff(every[order], prepend=-1))]  # each string's first place
            own, at, n = repeated(list(number), place[0][head], place[1][head], length)
            begin = np.cumsum(n) - n

            def told(shard=shard, rows=rows, which=which, places=places, own=own, at=at, n=n, begin=begin):
                for block, strings, (doc, first) in zip(rows.column("block").to_pylist(), which, places, strict=True):
                    many = n[strings]
                    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    i = np.repeat(begin[strings], many) + offset
                    doc, first = np.repeat(doc, many), np.repeat(first, many) + offset
                    hit = (own[i] < doc) | ((own[i] == doc) & (at[i] < first))
                    yield {"part": block >> 24, "block": block, "bucket": shard, "data": np.packbits(hit).tobytes() + many.astype(np.int32).tobytes() + len(many).to_bytes(8, "little")}

            yield from _tables(told(), _TOLD)

    return run


def _covered(words: Words, answers: list[bytes], length: int) -> np.ndarray:
    """The words that are removed; the first answer is the block's own note."""
    change = np.zeros(len(words) + 1, np.int32)
    if answers:
        first, count, at, later = np.frombuffer(answers[0], np.int32).reshape(4, -1).astype(np.int64)
        hits, windows = [], []
        for data in answers[1:]:
            n = int.from_bytes(data[-8:], "little")
            windows.append(np.frombuffer(data, np.int32, n, len(data) - 8 - 4 * n).astype(np.int64))
            hits.append(np.unpackbits(np.frombuffer(data, np.uint8, len(data) - 8 - 4 * n), count=int(windows[-1].sum())))
        hit, windows = np.concatenate(hits).astype(bool), np.concatenate(windows)
        begin = (np.cumsum(windows) - windows)[at]
        for k in range(0, len(first), 1 << 14):
            part = slice(k, k + (1 << 14))
            n = count[part]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gone = hit[np.repeat(begin[part], n) + offset] | np.repeat(later[part] > 0, n)
            start = (np.repeat(first[part], n) + offset)[gone]
            np.add.at(change, start, 1)
            np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def _remove(told: str, length: int, texts: bool):
    def run(batches):
        got = Answers(told, ["block", "bucket", "data"])
        for block, rows in blocks(batches, "text", BLOCK_BYTES):
            words = Words(rows.column("text").to_pylist())
            gone = _covered(words, got.of(block)[1], length)
            size = words.stop - words.start + 1
            data = words.data[np.repeat(~gone, size)].tobytes() if gone.any() else words.data.tobytes()
            before = np.append(0, np.cumsum(np.where(gone, 0, size)))[words.first]
            removed = np.diff(np.append(0, np.cumsum(gone))[words.first])
            kept = [data[a : max(a, b - 1)] for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
            yield from pa.Table.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("row"),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                    pa.array(kept if texts else [None] * len(kept), pa.binary()),
                ],
                names=["doc_id", "row", "n_words", "n_removed", "kept_sha256", "kept"],
            ).to_batches()

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 20, mark: int = MARK, hot: int = HOT, shard_bytes: int = SHARD_BYTES, texts: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row, n_words, n_removed, kept_sha256, kept (UTF-8 bytes; null without ``texts``).

    Words are runs of bytes other than ASCII blanks, compared as they are. A word goes if
    a window of ``length`` words covers it whose words also start earlier: in a row with
    a smaller ``key``, or further left in one with the same key. Windows overlap, are
    judged on the input and never cross rows; what is kept is joined by single spaces.

    A null text is an empty one; texts of fewer words stay. Rows that repeat with their
    key are at the same places and don't remove from each other. A null key counts as
    larger than any other. An empty table gives no rows; other columns are not read.
    ``docs`` must be a stored table of integer keys: it is read three times in the same
    partitions. ``hot`` bounds the super-k-mers that meet at one minimiser, ``shard_bytes``
    is text for each bucket of strings; neither changes the result.
    """
    if not 0 < mark <= length:
        raise ValueError("a minimiser has 1 to length words")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.monotonically_increasing_id().alias("row"), utf8(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_buckets, n_shards = max(least, int(size // BUCKET_BYTES) + 1), max(least, int(size // shard_bytes) + 1)
    parts, scan = parts_of(rows), rows.select("id", "text")

    asked = map_arrow(scan, _ask_marks(length, mark, n_buckets), _ASK_KIND).repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket")
    told = shared_dir(spark, "minimisers")
    write_answers(map_arrow(asked, _answer_marks(hot), _TOLD_KIND), told, parts)

    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("block"), F.lit(n_shards))).otherwise(F.col("bucket")).cast("int")
    sent = map_arrow(scan, _cut(told, length, mark, n_buckets, n_shards), _ASK_KIND).repartitionById(n_shards, spread).sortWithinPartitions("bucket")
    found = shared_dir(spark, "windows")
    write_answers(map_arrow(sent, _answer_strings(length), _TOLD_KIND), found, parts)

    kind = "doc_id long, row long, n_words long, n_removed long, kept_sha256 string, kept binary"
    out = stored(map_arrow(rows, _remove(found, length, texts), kind), "kept-words")
    for path in (told, found):
        forget(spark, path)
    return out
