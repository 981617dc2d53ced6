"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``window`` consecutive words of an item. Its set is its shingles of a few
words, ordered by rarity over all documents. Exact containment needs every shingle,
so the necessary prefix is the one rarest: a document is joined with a window only
where it holds that shingle. The shingle's place in the window fixes where the window
would begin (positional bound), which must leave room for all its words (length
bound); then the words themselves are compared.

If the items' text is small (BLOCK_BYTES), its windows are sent to all tasks, and a
document row passes through one stage without a shuffle. Beyond that nothing is sent:
shingles of documents meet those of items in shuffle joins, first to be counted, all in
one pass, then as postings that meet the windows' prefixes; the candidates go to their
documents in order, where the words are compared.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.byte_bpe import _replaced, _with
from plinth.llm.common import column, columns_of, map_arrow, small, stored, utf8

#: Words are runs of 0-9, a-z (after lower-casing A-Z) and anything beyond ASCII.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of item text that are sent to all tasks, at most: about 75,000 windows, some 50 MB of dictionary in the driver and each worker.
BLOCK_BYTES = 512 << 10


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """All windows of an item; an item of fewer words, but not none, is one window."""
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def _shingles(window: tuple[bytes, ...], size: int) -> list[bytes]:
    return [b" ".join(window[i : i + size]) for i in range(max(1, len(window) - size + 1))]


def _probe(words: list[bytes], starts: set[bytes], sizes: list[int], table: dict):
    """(place, entry) for each place of ``words`` that begins a shingle in ``table``."""
    for i, word in enumerate(words):
        if word in starts:
            for size in sizes:
                entry = table.get(b" ".join(words[i : i + size]))
                if entry is not None and i + size <= len(words):
                    yield i, entry


def _count(docs: DataFrame, shingles: list[bytes]) -> np.ndarray:
    """How often each shingle occurs in all documents (column __in)."""
    sent = docs.sparkSession.sparkContext.broadcast(shingles)

    def run(batches):
        numbers = {s: k for k, s in enumerate(sent.value)}
        starts, sizes = {s.split(b" ", 1)[0] for s in numbers}, sorted({s.count(b" ") + 1 for s in numbers})
        seen: Counter = Counter()
        for batch in small(batches, "__in"):
            for text in column(batch, "__in").to_pylist():
                seen.update(k for _, k in _probe(words_of(text), starts, sizes, numbers))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["k", "n"])

    total = np.zeros(len(shingles), np.int64)
    for k, n in map_arrow(docs.select("__in"), run, "k int, n long").groupBy("k").agg(F.sum("n")).toLocalIterator():
        total[k] = n
    return total


def _mark(found: dict[bytes, list], runs: str, items: str, count: str):
    """Add a block's hits to the columns ``runs`` and ``items``; ``found`` has windows by prefix shingle."""

    def mark(batches):
        table = found.value
        starts, sizes = {s.split(b" ", 1)[0] for s in table}, sorted({s.count(b" ") + 1 for s in table})
        for batch in small(batches, "__in"):
            n_words, all_runs, all_items = [], [], []
            for text, old_runs, old_items in zip(*(column(batch, c).to_pylist() for c in ("__in", runs, items)), strict=True):
                words = words_of(text)
                hit, ids = None, set(old_items)
                for place, windows in _probe(words, starts, sizes, table):
                    for offset, window, owners in windows:
                        begin = place - offset
                        if begin >= 0 and begin + len(window) <= len(words) and tuple(words[begin : begin + len(window)]) == window:
                            if hit is None:
                                hit = np.zeros(len(words) + 2, np.int8)
                                for a, b in old_runs:
                                    hit[a + 1 : b + 1] = 1
                            hit[begin + 1 : begin + 1 + len(window)] = 1
                            ids.update(owners)
                n_words.append(len(words))
                if hit is None:
                    all_runs.append([list(r) for r in old_runs])
                else:
                    edges = np.flatnonzero(np.diff(hit))
                    all_runs.append(edges.reshape(-1, 2).tolist())
                all_items.append(sorted(ids))
            out = _replaced(batch.drop_columns([c for c in (runs, items) if c in batch.schema.names]), count, pa.array(n_words, pa.int64()))
            out = out.append_column(runs, pa.array(all_runs, pa.list_(pa.list_(pa.int32()))))
            out = out.append_column(items, pa.array(all_items, pa.list_(pa.string())))
            yield out.append_column("__in", column(batch, "__in"))

    return mark


def mark_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 3,
    n_words: str = "n_words",
    runs: str = "runs",
    item_ids: str = "items",
) -> DataFrame:
    """``docs`` with n_words, runs (array of [first, end) word ranges that are hit) and items.

    ``items`` holds the sorted ids, as strings, of the items with a window in the
    document. A null or empty text has no words and no hit; an item without words has
    no window, and a null item id counts as the string "null". Equal items are all
    listed. The three columns replace ones of the same name; all others stay, and every
    row stays. ``items`` may be of any size (see above); beyond BLOCK_BYTES of text
    ``docs`` must be a stored table, as its rows are numbered in several passes.
    """
    rows = docs.withColumn("__in", utf8(text)).withColumns({runs: F.array().cast("array<array<int>>"), item_ids: F.array().cast("array<string>"), n_words: F.lit(0).cast("long")})
    asked = items.select(F.coalesce(F.col(item_key).cast("string"), F.lit("null")).alias("id"), utf8(item_text).alias("words"))
    size = asked.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if size > BLOCK_BYTES:
        return _shuffled(docs, asked, text, window, shingle, n_words, runs, item_ids)
    kind = _with(rows.drop(runs, item_ids), n_words, "bigint") + f", `{runs}` array<array<int>>, `{item_ids}` array<string>, `__in` binary"
    owners: dict[tuple, list[str]] = defaultdict(list)
    for id_, words in asked.toLocalIterator():
        for w in dict.fromkeys(windows_of(words_of(bytes(words)), window)):
            owners[w].append(id_)
    shingles = sorted({s for w in owners for s in _shingles(w, shingle)})
    seen = dict(zip(shingles, _count(rows, shingles).tolist(), strict=True)) if shingles else {}
    found: dict[bytes, list] = defaultdict(list)
    for w, ids in owners.items():
        ordered = sorted((seen[s], s, i) for i, s in enumerate(_shingles(w, shingle)))
        found[ordered[0][1]].append((ordered[0][2], w, ids))
    return map_arrow(rows, _mark(docs.sparkSession.sparkContext.broadcast(dict(found)), runs, item_ids, n_words), kind).drop("__in")


def _hash(shingle: bytes) -> int:
    return xxhash.xxh3_64_intdigest(shingle) - (1 << 63)


def _item_windows(window: int):
    """Each window of each item once: its key, its words and the item's id."""

    def run(batches):
        for batch in small(batches, "words"):
            for id_, words in zip(column(batch, "id").to_pylist(), column(batch, "words").to_pylist(), strict=True):
                found = [b" ".join(w) for w in dict.fromkeys(windows_of(words_of(words), window))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(w).digest() for w in found]), pa.array(found, pa.binary()), pa.array([id_] * len(found))], names=["win", "words", "id"])

    return run


def _window_shingles(shingle: int):
    def run(batches):
        for batch in batches:
            out = [(k, _hash(s), s.count(b" ") + 1, i) for k, w in zip(column(batch, "win").to_pylist(), column(batch, "words").to_pylist(), strict=True) for i, s in enumerate(_shingles(tuple(w.split(b" ")), shingle))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["win", "h", "size", "place"])

    return run


def _places(sizes: list[int], counted: bool):
    """The shingles of documents: (h, n) by batch, or (row, place, h)."""

    def run(batches):
        for batch in small(batches, "__in"):
            rows, places, hashes = [], [], []
            for row, text in zip(column(batch, "__row").to_pylist(), column(batch, "__in").to_pylist(), strict=True):
                words = words_of(text)
                for size in sizes:
                    n = len(words) - size + 1
                    if n > 0:
                        hashes.append(np.fromiter((_hash(b" ".join(words[i : i + size])) for i in range(n)), np.int64, n))
                        places.append(np.arange(n, dtype=np.int32))
                        rows.append(np.full(n, row, np.int64))
            if not hashes:
                continue
            h = np.concatenate(hashes)
            if counted:
                kinds, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], names=["h", "n"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(places)), pa.array(h)], names=["__row", "place", "h"])

    return run


def _verify(batches):
    """Documents, each before its candidates: row, runs and the keys of its windows, where there are any."""
    schema = pa.schema([("__row", pa.int64()), ("runs", pa.list_(pa.list_(pa.int32()))), ("wins", pa.list_(pa.binary()))])

    def done():
        edges = np.flatnonzero(np.diff(hit)).reshape(-1, 2).tolist()
        return pa.RecordBatch.from_pylist([{"__row": row, "runs": edges, "wins": sorted(wins)}], schema)

    row, words, hit, wins = None, [], None, set()
    for batch in batches:
        for r, text, begin, win, key in zip(*(column(batch, c).to_pylist() for c in ("__row", "__in", "begin", "words", "win")), strict=True):
            if text is not None:
                if wins:
                    yield done()
                row, words, wins = r, words_of(text), set()
                hit = np.zeros(len(words) + 2, np.int8)
                continue
            want = win.split(b" ")
            if words[begin : begin + len(want)] == want:
                hit[begin + 1 : begin + 1 + len(want)] = 1
                wins.add(key)
    if wins:
        yield done()


def _shuffled(docs: DataFrame, asked: DataFrame, text: str, window: int, shingle: int, n_words: str, runs: str, item_ids: str) -> DataFrame:
    """As :func:`mark_contamination` for items of any size: nothing of them is sent to all tasks."""
    rows = docs.withColumns({"__row": F.monotonically_increasing_id(), "__in": utf8(text)})
    texts = rows.select("__row", "__in")
    windows = map_arrow(asked, _item_windows(window), "win binary, words binary, id string")
    distinct = windows.groupBy("win").agg(F.first("words").alias("words"))
    parts = stored(map_arrow(distinct, _window_shingles(shingle), "win binary, h long, size int, place int"), "shingles")
    sizes = sorted(r.size_ for r in parts.select(F.col("size").alias("size_")).distinct().collect())  # 1 to ``shingle``
    counts = map_arrow(texts, _places(sizes, True), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).join(parts.select("h").distinct(), "h", "left_semi")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place"))
    prefix = parts.join(counts, "h", "left").groupBy("win").agg(rarest.alias("p")).select("win", "p.h", F.col("p.place").alias("offset")).join(distinct, "win")
    postings = map_arrow(texts, _places(sizes, False), "__row long, place int, h long")
    begin = F.col("place") - F.col("offset")
    candidates = postings.join(prefix, "h").where(begin >= 0).select("__row", F.lit(None).cast("binary").alias("__in"), begin.alias("begin"), "words", "win")
    own = texts.join(candidates.select("__row").distinct(), "__row", "left_semi").select("__row", "__in", F.lit(-1).alias("begin"), F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("win"))
    met = own.union(candidates).repartition("__row").sortWithinPartitions("__row", "begin")
    found = stored(map_arrow(met, _verify, "__row long, runs array<array<int>>, wins array<binary>"), "hits")
    ids = found.select("__row", F.explode("wins").alias("win")).join(windows.select("win", "id"), "win").groupBy("__row").agg(F.sort_array(F.collect_set("id")).alias("__ids"))
    told = found.select("__row", F.col("runs").alias("__runs")).join(ids, "__row")
    kept = [c for c in docs.columns if c not in (runs, item_ids, n_words)]
    kind = ", ".join([*(f"{q} {docs.schema[c].dataType.simpleString()}" for c, q in zip(kept, columns_of(docs.select(*kept)), strict=True)), "`__row` bigint", f"`{n_words}` bigint"])

    def count(batches):
        for batch in small(batches, "__in"):
            n = pa.array([len(words_of(t)) for t in column(batch, "__in").to_pylist()], pa.int64())
            yield _replaced(batch, n_words, n)

    whole = map_arrow(rows.select(*columns_of(docs.select(*kept)), "__row", "__in"), count, kind).join(told, "__row", "left").drop("__row")
    empty = F.array().cast("array<array<int>>"), F.array().cast("array<string>")
    return whole.withColumns({runs: F.coalesce("__runs", empty[0]), item_ids: F.coalesce("__ids", empty[1])}).drop("__runs", "__ids")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns."""
    marked = mark_contamination(docs, items, text, window=window, n_words="__words", runs="__runs", item_ids="__items")
    return marked.where(F.size("__runs") == 0).select(*columns_of(docs))
