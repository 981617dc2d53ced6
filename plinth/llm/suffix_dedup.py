"""Suffix-array dedup: removes byte strings that earlier documents hold already.

1. Copies. A document whose whole text a smaller doc_id has is removed without sorting.
2. Anchors. In each window of ``length`` bytes the substring of 24 bytes with the
   smallest hash is its anchor, so equal windows have equal anchors. Tasks send each
   distinct anchor of a block of documents once, packed by hash; what comes back is
   whether documents with another id hold it too.
3. Strings. Runs of windows with one such anchor are cut out. Each distinct string of
   a block goes once, with its smallest doc_id, to the shard of its anchor, so all
   windows that can be equal meet in one shard, and a passage that a third of the
   documents share comes once from each block.
4. Suffixes. A shard sorts the suffixes of its distinct strings (but those that are
   alone at their anchor, which share no window with another) by external induced
   sorting (``induced.py``). Neighbours with a common prefix of at least ``length``
   bytes hold the same window; the smallest doc_id among them goes back to the blocks.
5. Removal. Each block covers the windows for which that doc_id is smaller than the
   document's own.

Texts are read three times in the same partitions and never shuffled; only anchors,
strings and answers are.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import Answers, blocks, column, forget, grouped, map_arrow, parts_of, shared_dir, stored, utf8, write_answers
from plinth.llm.induced import HELD, suffixes_with_prefixes

#: Bytes of an anchor (three words of 8: fewer are often shared by chance); text in a block; text for each bucket of anchors.
ANCHOR, BLOCK_BYTES, BUCKET_BYTES = 24, 8 << 20, 48 << 20
_CHUNK, _RUNS = 1 << 20, 1 << 14
_LAST = 2**63 - 1


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as numbers."""
    out = np.empty(max(0, len(data) - 7), np.uint64)
    for k in range(8):
        part = np.frombuffer(data, np.uint64, (len(data) - k) // 8, k) if len(data) - k >= 8 else np.zeros(0, np.uint64)
        out[k::8] = part
    return out


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on."""
    w = _words(data)
    n = len(data) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at in range(8, ANCHOR, 8):
        h ^= h >> np.uint64(32)
        h += w[at : at + n]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


class Runs:
    """The windows of a block's documents, as runs with one anchor: document, place of the first window, windows, anchor's hash."""

    def __init__(self, texts: list[bytes], length: int):
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.data = data
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(size) - size
        width = length - ANCHOR + 1
        owners = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        ends = (self.start + size - length).astype(np.int32)
        doc, first, count, mark = [], [], [], []
        low, places = np.uint64((1 << 21) - 1), np.arange(_CHUNK + length, dtype=np.uint64)
        for at in range(0, len(data) - length + 1, _CHUNK):
            h = _hashes(data[at : at + _CHUNK + length - 1])
            best = _least((h & ~low) | places[: len(h)], width)  # equal hashes: the first place
            place = (best & low).astype(np.int32)
            owner = owners[at : at + len(place)]
            own = np.arange(at, at + len(place), dtype=np.int32) <= ends[owner]
            change = np.ones(len(place), bool)
            change[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (own[1:] != own[:-1])
            new = np.flatnonzero(change)
            many = np.diff(np.append(new, len(place)))
            new, many = new[own[new]], many[own[new]]
            doc.append(owner[new].astype(np.int64))
            first.append(new + at)
            count.append(many)
            mark.append(h[place[new]])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.doc, self.first, self.count, self.mark = join(doc, np.int64), join(first, np.int64), join(count, np.int64), join(mark, np.uint64)


def _anchors(runs: Runs, ids: np.ndarray, n_buckets: int):
    """Distinct anchors by bucket and hash: bucket, hash, least and greatest doc_id."""
    order = np.argsort(runs.mark)
    mark, own = runs.mark[order], ids[runs.doc[order]]
    cuts = np.flatnonzero(np.diff(mark, prepend=mark[:1] + np.uint64(1))) if len(mark) else np.zeros(0, np.int64)
    mark, least, most = mark[cuts], np.minimum.reduceat(own, cuts) if len(cuts) else own, np.maximum.reduceat(own, cuts) if len(cuts) else own
    bucket = (mark % np.uint64(n_buckets)).astype(np.uint16 if n_buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket.astype(np.int64)
    return bucket[order], mark[order], least[order], most[order]


def _table(rows: list[dict], schema: pa.Schema):
    return pa.RecordBatch.from_pylist(rows, schema)


#: Rows in a batch that leaves a task: a block has a row for each bucket that it meets.
_ROWS = 512


def _tables(rows, schema: pa.Schema):
    """The rows in batches, so that a row costs little where there are many buckets."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, bytes))
        if len(held) >= _ROWS or size >= BLOCK_BYTES // 2:
            yield _table(held, schema)
            held, size = [], 0
    if held:
        yield _table(held, schema)


class _Block:
    """A block of rows with those left out that are copies of a smaller doc_id's text."""

    def __init__(self, rows: pa.Table, copies: np.ndarray):
        self.ids = rows.column("id").to_numpy()
        self.texts = rows.column("text").to_pylist()
        self.copy = np.isin(rows.column("row").to_numpy(), copies)
        self.live = np.flatnonzero(~self.copy)

    def runs(self, length: int) -> tuple[Runs, np.ndarray]:
        return Runs([self.texts[i] for i in self.live], length), self.ids[self.live]


def _copies(path: str) -> np.ndarray:
    """The rows of this task's partition that are copies, all of which its file lists."""
    rows = Answers(path, ["block", "rows"]).of(0)[0]
    return np.concatenate([np.frombuffer(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)


def _pack_copies(batches):
    for part, rows in grouped(batches, "part"):
        for batch in rows.to_batches(max_chunksize=1 << 16):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([0], pa.int64()), "bucket": pa.array([0], pa.int32()), "rows": pa.array([column(batch, "row").to_numpy().tobytes()], pa.binary())})


_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("marks", pa.binary()), ("docs", pa.binary()), ("also", pa.binary())])


def _ask_anchors(copies: str, length: int, n_buckets: int):
    def run(batches):
        gone = _copies(copies)
        for block, rows in blocks(batches, "text", BLOCK_BYTES):
            runs, ids = _Block(rows, gone).runs(length)
            bucket, mark, least, most = _anchors(runs, ids, n_buckets)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()

            def asked(block=block, bucket=bucket, mark=mark, least=least, most=most, cuts=cuts):
                for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                    kind, number = np.unique(least[a:b], return_inverse=True)
                    yield {"bucket": int(bucket[a]), "block": block, "marks": mark[a:b].tobytes(), "docs": kind.tobytes() + number.astype(np.uint32).tobytes(), "also": np.packbits(most[a:b] != least[a:b]).tobytes()}

            yield from _tables(asked(), _ASK)

    return run


_TOLD = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("lengths", pa.binary())])
_TOLD_KIND = "part int, block long, bucket int, data binary, lengths binary"


def _answer_anchors(batches):
    for bucket, rows in grouped(batches, "bucket"):
        marks = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("marks")]
        least, more = [], []
        for m, docs, also in zip(marks, rows.column("docs"), rows.column("also"), strict=True):
            docs = docs.as_py()
            n = (len(docs) - 4 * len(m)) // 8
            least.append(np.frombuffer(docs, np.int64, n)[np.frombuffer(docs, np.uint32, len(m), 8 * n)])
            more.append(np.unpackbits(np.frombuffer(also.as_py(), np.uint8), count=len(m)).astype(bool))
        mark, low, more = np.concatenate(marks), np.concatenate(least), np.concatenate(more)
        order = np.argsort(mark)
        cuts = np.flatnonzero(np.diff(mark[order], prepend=mark[order[:1]] + np.uint64(1)))
        by = low[order]
        met = (np.minimum.reduceat(by, cuts) != np.maximum.reduceat(by, cuts)) | np.logical_or.reduceat(more[order], cuts)
        shared = np.empty(len(mark), bool)
        shared[order] = np.repeat(met, np.diff(np.append(cuts, len(mark))))
        ends = np.cumsum([len(m) for m in marks]).tolist()
        yield from _tables(
            (
                {"part": block >> 24, "block": block, "bucket": bucket, "data": np.packbits(shared[end - len(m) : end]).tobytes(), "lengths": len(m).to_bytes(8, "little")}
                for block, m, end in zip(rows.column("block").to_pylist(), marks, ends, strict=True)
            ),
            _TOLD,
        )


_COLUMNS = ["block", "bucket", "data", "lengths"]


def _cut_strings(copies: str, told: str, length: int, n_buckets: int, n_shards: int):
    """For each shard: a block's distinct strings and their least doc_ids. Shard -1: which string each run is."""

    def run(batches):
        gone, got = _copies(copies), Answers(told, _COLUMNS)
        for block, rows in blocks(batches, "text", BLOCK_BYTES):
            part = _Block(rows, gone)
            runs, ids = part.runs(length)
            _, mark, _, _ = _anchors(runs, ids, n_buckets)
            bits = [np.unpackbits(np.frombuffer(d, np.uint8), count=int.from_bytes(n, "little")) for _, d, n in zip(*got.of(block), strict=True)]
            shared = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
            if len(shared) != len(mark):
                raise RuntimeError("the blocks differ from those of the first pass: dedup a stored table")
            # The smallest id of a string comes first.
            pick = np.flatnonzero(np.isin(runs.mark, mark[shared]))
            pick = pick[np.argsort(ids[runs.doc[pick]], kind="stable")]
            if not len(pick):
                continue
            data = runs.data.tobytes()
            number: dict[bytes, int] = {}
            which = np.empty(len(pick), np.int64)
            first = []
            ends = (runs.first[pick] + runs.count[pick] + length - 1).tolist()
            for k, (a, b) in enumerate(zip(runs.first[pick].tolist(), ends, strict=True)):
                n = which[k] = number.setdefault(data[a:b], len(number))
                if n == len(first):
                    first.append(k)
            first = pick[first]
            strings = list(number)
            shard = ((runs.mark[first] >> np.uint64(20)) % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            owner = ids[runs.doc[first]]
            cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist()

            def sent(block=block, strings=strings, shard=shard, order=order, owner=owner, cuts=cuts):
                for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    own = order[a:b]
                    yield {"bucket": int(shard[own[0]]), "block": block, "marks": b"".join([strings[i] for i in own.tolist()]), "docs": owner[own].tobytes(), "also": np.array([len(strings[i]) for i in own.tolist()], np.int32).tobytes()}

            yield from _tables(sent(), _ASK)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            where = runs.first[pick] - runs.start[runs.doc[pick]]
            yield _table([{"bucket": -1, "block": block, "marks": np.concatenate([part.live[runs.doc[pick]], where, place[which]]).astype(np.int32).tobytes(), "docs": b"", "also": b""}], _ASK)

    return run


def least_owners(strings: list[bytes], docs: np.ndarray, length: int, spill=None, held: int = HELD) -> np.ndarray:
    """For each window of each string, in order, the least of ``docs`` among the strings that hold it."""
    m = len(strings)
    size = np.fromiter(map(len, strings), np.int64, m)
    end = np.cumsum(size + 1) - 1
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int32)
    raw = np.append(text.astype(np.uint8), np.zeros(8, np.uint8))
    text += m
    text[end] = np.arange(m - 1, -1, -1)  # each string ends in a symbol of its own, the last in the smallest
    left = np.repeat(end.astype(np.int32), size + 1) - np.arange(len(text), dtype=np.int32)
    eights = np.lib.stride_tricks.sliding_window_view(raw, 8)
    top = len(eights) - 1

    def words(at: np.ndarray) -> np.ndarray:
        return eights[np.minimum(at, top)].view(np.uint64)[:, 0]

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.minimum(left[a], left[b])
        live = np.arange(len(a))
        k = 0
        while len(live):
            differ = words(a[live] + k) ^ words(b[live] + k)
            hit = differ != 0
            low = (np.bitwise_count((differ[hit] & (~differ[hit] + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            out[live[hit]] = np.minimum(out[live[hit]], k + low)
            live = live[~hit]
            k += 8
            live = live[out[live] > k]
        return out.astype(np.int32)

    names, rank = np.unique(np.asarray(docs, np.int64), return_inverse=True)
    owner = np.repeat(rank.astype(np.int32), size + 1)
    out = np.empty(len(text), np.int32)
    held_at, held_own = [], []  # the last group, which may go on in the next bulk

    def close(at: np.ndarray, own: np.ndarray, cuts: np.ndarray) -> None:
        out[at] = np.repeat(np.minimum.reduceat(own, cuts), np.diff(np.append(cuts, len(at))))

    for at, near in suffixes_with_prefixes(text, m, common, spill, held):
        own = owner[at]
        cuts = np.flatnonzero(near < length)
        if not len(cuts):
            held_at.append(at)
            held_own.append(own)
            continue
        if held_at or cuts[0]:
            a, o = np.concatenate([*held_at, at[: cuts[0]]]), np.concatenate([*held_own, own[: cuts[0]]])
            close(a, o, np.zeros(1, np.int64))
        last = cuts[-1]
        if len(cuts) > 1:
            close(at[cuts[0] : last], own[cuts[0] : last], cuts[:-1] - cuts[0])
        held_at, held_own = [at[last:]], [own[last:]]
    close(np.concatenate(held_at), np.concatenate(held_own), np.zeros(1, np.int64))
    return names[out[left >= length]]


def _spill_to(folder: str):
    """Keeps runs of queues in shared storage."""

    def spill(data: bytes):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name = f"{root}/{uuid.uuid4().hex}"
        with store.open_output_stream(name, compression=None) as out:
            out.write(data)

        def back(at: int, size: int) -> bytes:
            if not size:
                store.delete_file(name)
                return b""
            with store.open_input_file(name) as source:
                return source.read_at(size, at)

        return back

    return spill


def _alone(strings: list[bytes], length: int) -> np.ndarray:
    """True for strings whose anchor no other one has: equal windows have equal anchors, so they share no window with another string."""
    runs = Runs(strings, length)
    mark = runs.mark[np.flatnonzero(np.diff(runs.doc, prepend=-1))]  # of each string's first window; all have the same
    _, back, times = np.unique(mark, return_inverse=True, return_counts=True)
    return times[back] == 1


def _answer_strings(length: int, folder: str, held: int):
    def run(batches):
        for shard, rows in grouped(batches, "bucket"):
            number: dict[bytes, int] = {}
            docs: list[int] = []
            asked = []
            for data, own, sizes in zip(rows.column("marks").to_pylist(), rows.column("docs").to_pylist(), rows.column("also").to_pylist(), strict=True):
                ends = np.cumsum(np.frombuffer(sizes, np.int32))
                which = []
                a = 0
                for b, doc in zip(ends.tolist(), np.frombuffer(own, np.int64).tolist(), strict=True):
                    n = number.setdefault(data[a:b], len(number))
                    if n == len(docs):
                        docs.append(doc)
                    elif doc < docs[n]:
                        docs[n] = doc
                    which.append(n)
                    a = b
                asked.append(np.array(which, np.int64))
            strings = list(number)
            owner = np.array(docs, np.int64)
            windows = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
            start = np.cumsum(windows) - windows
            least = np.repeat(owner, windows)
            met = np.flatnonzero(~_alone(strings, length))
            if len(met):
                n = windows[met]
                places = np.repeat(start[met] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                least[places] = least_owners([strings[i] for i in met.tolist()], owner[met], length, _spill_to(folder), held)

            def told(shard=shard, rows=rows, asked=asked, windows=windows, start=start, least=least):
                for block, which in zip(rows.column("block").to_pylist(), asked, strict=True):
                    n = windows[which]
                    flat = least[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]  # a block's windows in this shard
                    cuts = np.flatnonzero(np.diff(flat, prepend=flat[0] ^ 1))
                    yield {"part": block >> 24, "block": block, "bucket": shard, "data": flat[cuts].tobytes(), "lengths": np.concatenate([np.diff(np.append(cuts, len(flat))), n]).astype(np.int32).tobytes() + len(cuts).to_bytes(8, "little")}

            yield from _tables(told(), _TOLD)

    return run


def _with_runs(answer):
    """Answers of shards; the rows of shard -1, which come first, go on as they are."""

    def run(batches):
        batches = iter(batches)
        for batch in batches:
            own = pa.compute.less(column(batch, "bucket"), 0)
            mine, rest = batch.filter(own), batch.filter(pa.compute.invert(own))
            for block, data in zip(column(mine, "block").to_pylist(), column(mine, "marks").to_pylist(), strict=True):
                yield _table([{"part": block >> 24, "block": block, "bucket": -1, "data": data, "lengths": b""}], _TOLD)
            if rest.num_rows:
                yield from answer(chain([rest], batches))

    return run


def _remove(copies: str, told: str, length: int, texts: bool):
    def run(batches):
        gone, got = _copies(copies), Answers(told, _COLUMNS)
        for block, rows in blocks(batches, "text", BLOCK_BYTES):
            part = _Block(rows, gone)
            size = np.fromiter(map(len, part.texts), np.int64, len(part.texts))
            start = np.cumsum(size) - size
            change = np.zeros(int(size.sum()) + 1, np.int32)
            answers = list(zip(*got.of(block), strict=True))
            if answers:
                doc, where, place = np.frombuffer(answers[0][1], np.int32).reshape(3, -1)
                least, windows = [], []
                for _, data, lengths in answers[1:]:
                    n = int.from_bytes(lengths[-8:], "little")
                    counts = np.frombuffer(lengths[:-8], np.int32)
                    least.append(np.repeat(np.frombuffer(data, np.int64), counts[:n]))
                    windows.append(counts[n:])
                least, windows = np.concatenate(least), np.concatenate(windows).astype(np.int64)
                first = np.cumsum(windows) - windows
                for k in range(0, len(place), _RUNS):
                    d, p = doc[k : k + _RUNS], place[k : k + _RUNS]
                    n = windows[p]
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    hit = least[np.repeat(first[p], n) + inner] < np.repeat(part.ids[d], n)
                    at = (np.repeat(start[d] + where[k : k + _RUNS], n) + inner)[hit]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + length, -1)
            covered = np.cumsum(change[:-1], dtype=np.int32) > 0
            out = []
            for i, text in enumerate(part.texts):
                mask = covered[start[i] : start[i] + size[i]]
                if part.copy[i] and size[i] >= length:
                    mask = np.ones(size[i], bool)
                removed = int(mask.sum())
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if removed else text
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0
                out.append((int(size[i]), removed, spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            n_bytes, n_removed, n_spans, digest, kept = zip(*out, strict=True)
            yield from pa.Table.from_arrays(
                [rows.column("doc_id"), rows.column("row"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest), pa.array(kept, pa.binary())],
                names=["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            ).to_batches()

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, shard_bytes: int = 6 << 20, held: int = HELD, texts: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null without ``texts``).

    Removes each byte that a string of ``length`` bytes covers which also starts in a
    document with a smaller ``key``. Strings overlap and are judged on the input; none
    crosses documents. A null text is an empty one; shorter texts than ``length`` stay.
    Rows with the same key don't remove from each other; a null key counts as larger than
    any other. An empty table gives no rows; other columns are not read. The bytes that
    are kept may cut a character. ``docs`` must be a stored table of integer keys: it is
    read four times in the same partitions. ``shard_bytes`` is text for each shard of
    strings, ``held`` the queue entries that a shard holds in memory; more go to shared
    storage.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"length must be at least {ANCHOR + 8}")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.monotonically_increasing_id().alias("row"), utf8(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_buckets, n_shards = max(least, int(size // BUCKET_BYTES) + 1), max(least, int(size // shard_bytes) + 1)

    same = rows.select("id", "row", F.unhex(F.sha2("text", 256)).alias("digest"))
    first = same.groupBy("digest").agg(F.min("id").alias("first"))
    copies = shared_dir(spark, "copies")
    parts = parts_of(rows)
    found = same.join(first, "digest").where("id > first").select("row", F.shiftright("row", 33).cast("int").alias("part"))
    write_answers(map_arrow(found.repartitionById(parts, "part").sortWithinPartitions("part"), _pack_copies, "part int, block long, bucket int, rows binary"), copies, parts)

    scan = rows.select("id", "row", "text")
    ask = "bucket int, block long, marks binary, docs binary, also binary"
    asked = map_arrow(scan, _ask_anchors(copies, length, n_buckets), ask).repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket")
    anchors = shared_dir(spark, "anchors")
    write_answers(map_arrow(asked, _answer_anchors, _TOLD_KIND), anchors, parts)

    cut = map_arrow(scan, _cut_strings(copies, anchors, length, n_buckets, n_shards), ask).repartitionById(n_shards, F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("block"), F.lit(n_shards))).otherwise(F.col("bucket")).cast("int")).sortWithinPartitions("bucket")
    strings, spilled = shared_dir(spark, "strings"), shared_dir(spark, "runs")
    write_answers(map_arrow(cut, _with_runs(_answer_strings(length, spilled, held)), _TOLD_KIND), strings, parts)

    kind = "doc_id long, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    # Stored, so that the blocks are those of this plan, whatever is made of the result.
    out = stored(map_arrow(rows, _remove(copies, strings, length, texts), kind), "kept")
    for path in (copies, anchors, strings, spilled):
        forget(spark, path)
    return out
