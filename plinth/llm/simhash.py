"""SimHash near-dedup by a binary-trie self-join.

Fingerprints are sorted, so a node of their binary trie is a range of the sorted
array. The join walks pairs of nodes of equal depth together, level by level, adds
one to a pair's error where the two take different bits, and drops a pair as soon as
its error passes the budget. Small pairs of nodes end in a direct comparison.

Spread: two fingerprints that differ in at most ``budget`` bits agree on one of
``budget + 1`` bands of the 64 bits. Each band rotates its bits to the front, so that
the first levels of its tries have no error budget at all: a subtree below them is a
unit of work, and one task walks all its subtrees at once. Subtrees that are wholly
linked already are not compared with each other again, so a group of near copies
costs its links, not its square, and each subtree hands on a spanning star in place
of its links. Components of these stars are those of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import column, columns_of, map_arrow, small, stored, utf8
from plinth.llm.components import components

BITS = 64
#: Pairs of trie nodes that the walk holds at once; more are walked in turns.
FRONTIER = 1 << 20
#: A pair of nodes with at most so many pairs of leaves is compared directly.
LEAF_PAIRS = 32
#: Fingerprints that a task of the walk holds, about.
TASK_PRINTS = 2_000_000


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles; 0 for a text without words."""
    found = text.lower().split()  # bytes: lowers A-Z and splits at 09-0D and 20 only
    if not found:
        return 0
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64)
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) >> 14)):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _roots(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Join the components in ``root`` along links a-b: the smallest member is the root."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def trie_links(values: np.ndarray, budget: int, free: int = 0) -> np.ndarray:
    """Self-join of sorted distinct uint64 values: for each, the index of its component's first.

    Links join values that differ in at most ``budget`` bits and agree in the first
    ``free`` ones. Budgets rise from 1, and a pair of subtrees in one component is
    passed over.
    """
    n = len(values)
    root = np.arange(n)
    if n < 2:
        return root
    top = values >> np.uint64(BITS - free) if free else np.zeros(n, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    ends = np.append(starts[1:], n)
    many = ends - starts > 1
    if not many.any():
        return root
    starts, ends = starts[many], ends[many]
    for allowed in range(1, budget + 1):
        run = np.cumsum(np.concatenate([[0], root[1:] != root[:-1]]))
        stack = [(free, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
        while stack:
            depth, al, ah, bl, bh, err = stack.pop()
            if len(al) > FRONTIER:
                half = len(al) // 2
                stack += [(depth, *(x[half:] for x in (al, ah, bl, bh, err))), (depth, *(x[:half] for x in (al, ah, bl, bh, err)))]
                continue
            one = (run[al] == run[ah - 1]) & (run[bl] == run[bh - 1]) & (root[al] == root[bl])
            al, ah, bl, bh, err = (x[~one] for x in (al, ah, bl, bh, err))
            small = ((ah - al) * (bh - bl) <= LEAF_PAIRS) if depth < BITS else np.ones(len(al), bool)
            if small.any():
                sa, ha, sb, hb = al[small], ah[small], bl[small], bh[small]
                wide = hb - sb
                size = (ha - sa) * wide
                which = np.repeat(np.arange(len(sa)), size)
                k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                i, j = sa[which] + k // wide[which], sb[which] + k % wide[which]
                near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= allowed)
                if near.any():
                    root = _roots(i[near], j[near], root)
                    run = np.cumsum(np.concatenate([[0], root[1:] != root[:-1]]))
                al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
            if not len(al):
                continue
            set_ = np.concatenate([[0], np.cumsum((values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int64)])
            am, bm = ah - (set_[ah] - set_[al]), bh - (set_[bh] - set_[bl])
            same = (al == bl) & (ah == bh)
            kids = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
            other = ~same
            kids.append(tuple(x[other] for x in (am, ah, bl, bm, err + 1)))
            parts = [np.concatenate(x) for x in zip(*kids, strict=True)]
            live = (parts[0] < parts[1]) & (parts[2] < parts[3]) & (parts[4] <= allowed)
            live &= ~((parts[0] == parts[2]) & (parts[1] - parts[0] < 2) & (parts[3] == parts[1]))
            if live.any():
                stack.append((depth + 1, *(x[live] for x in parts)))
    return root


def _fingerprints(words: int, seed: int):
    def run(batches):
        for batch in small(batches, "text"):
            prints = np.array([fingerprint(t, words, seed) for t in column(batch, "text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "row"), pa.array(prints.view(np.int64))], names=["doc_id", "row", "print"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, row, print) for each row of ``docs``: the fingerprint as a signed long. Keys must be whole numbers, or cast to them: others fail under ANSI rules."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), utf8(text).alias("text"))
    return map_arrow(rows, _fingerprints(words, seed), "doc_id long, row long, print long")


#: Shares that the members of one component are cut into.
SALTS = 16


def _bands(budget: int) -> list[tuple[int, int]]:
    """(start, width) of budget + 1 bands of the 64 bits."""
    cuts = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _walk(budget: int, bands: list[tuple[int, int]]):
    def run(batches):
        held: list[list[np.ndarray]] = [[] for _ in bands]
        for batch in batches:
            band, value = column(batch, "band").to_numpy(), column(batch, "print").to_numpy().view(np.uint64)
            for k in np.unique(band).tolist():
                held[k].append(value[band == k])
        for k, (start, width) in enumerate(bands):
            if not held[k]:
                continue
            value = np.concatenate(held[k])
            held[k] = []
            turned = (value << np.uint64(start)) | (value >> np.uint64(BITS - start)) if start else value
            turned = np.unique(turned)
            root = trie_links(turned, budget, width)
            linked = np.flatnonzero(root != np.arange(len(root)))
            back = (turned >> np.uint64(start)) | (turned << np.uint64(BITS - start)) if start else turned
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(back[linked].view(np.int64)), pa.array(back[root[linked]].view(np.int64))], names=["a", "b"])

    return run


def links(prints: DataFrame, budget: int = 4) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints ``print``."""
    bands = _bands(budget)
    turned = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("print", BITS - a - w).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for k, (a, w) in enumerate(bands)]
    rows = prints.select("print").distinct().select("print", F.explode(F.array(*turned)).alias("at")).select("print", "at.band", "at.value")
    # A task holds the fingerprints of its subtrees: eight bytes each, twice while they are sorted.
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.count() * len(bands) // TASK_PRINTS + 1)
    return map_arrow(rows.repartition(n, "band", "value").select("band", "print"), _walk(budget, bands), "a long, b long")


def classes(prints: DataFrame, budget: int = 4) -> DataFrame:
    """(print, component_id): for each distinct fingerprint the smallest doc_id that its component holds."""
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    member = least.join(components(links(prints, budget)), F.col("print") == F.col("node"), "left").select("print", "least", "root")
    alone = member.where("root IS NULL").select("print", F.col("least").alias("component_id"))
    # Members of a large component share its root: they meet its smallest doc_id over salts.
    linked = member.where("root IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(SALTS)).cast("int"))
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return alone.union(linked.join(whole, ["root", "salt"]).select("print", "component_id"))


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, budget: int = 4, seed: int = 42) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row, fingerprint (16 hex digits), component_id.

    Texts are lower-cased in A-Z and split into words at ASCII white space. A text of
    fewer than ``words`` words is one shingle; null, empty and blank texts have the
    fingerprint 0, which links like any other. Rows with one fingerprint are one class;
    the result keeps every row. component_id is the smallest key reachable over links of
    at most ``budget`` differing bits; null keys are passed over, and a component of null
    keys only has a null id. An empty table gives no rows; other columns are not read.
    """
    prints = stored(fingerprints(docs, key, text, words, seed), "simhash")
    return prints.join(classes(prints, budget), "print").select("doc_id", "row", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, budget: int = 4, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest key, with all columns.

    Of rows that share this key, the one read first stays; where all keys are null, the first row.
    ``docs`` must be a stored table, so that a row keeps its number when it is read again.
    """
    found = simhash_components(docs, key, text, words, budget, seed)
    # The root's fingerprint isn't in the result, so components of null keys fall back to their fingerprint.
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    keep = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"))
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    return rows.join(keep.select(F.col("first.row").alias("__row")), "__row", "left_semi").select(*columns_of(docs))
