"""Merkle manifest of a corpus: a radix-ranked trie with a proof for every row.

1. Leaves. One pass over the texts digests each row; what follows moves digests only.
2. Ranks. A row's place in its group, in the order of doc_id, comes from histograms of
   the doc_id's digits (base 256): rows are counted by group and all digits but the last,
   these counts are rolled up digit by digit, and a prefix sum among the at most 256
   siblings of a digit tells how many rows come before each. The sum over the digits and
   the place among the at most 256 numbers that share all but the last digit is the exact
   rank. No group meets in one task and nothing is sorted as a whole. A cell that holds
   more rows than ``CELL`` has repeated numbers; its rows are ranked in the same way by
   the next key: the digest's first bytes, then a number of the row.
3. Trie. A node's key is its group and the rank's digits in base ``fanout`` without the
   last ones. Nodes with the longest keys are reduced first, each run of at most
   ``fanout`` to its parent's digest, one digit a step. Groups are ranked by their names
   with the same histograms (7 bytes of the name are a digit string) and make the upper trie.
4. Proofs. Siblings go down the trie: a run's path is its parent's with one step more, so
   paths are built for each run, and only the last step for each row.

Everything is columns and SQL functions: joins, groups of bounded size and aggregates with
map-side partial sums. The driver loops over digits and levels and sees counts only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import stored

#: Rows that one cell of the histogram may hold before the next key ranks them.
CELL = 65_536


def field(column: Column) -> Column:
    """A value as bytes that can't be mistaken: ``-`` for null, else its UTF-8 length, a colon and the value."""
    data = column.cast("string").cast("binary")
    return F.coalesce(F.concat(F.octet_length(data).cast("string").cast("binary"), F.lit(b":"), data), F.lit(b"-"))


def digest(data: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def over_hex(data: Column) -> Column:
    """SHA-256, as 32 bytes, of digests given as bytes and taken as lowercase hex text."""
    return digest(F.lower(F.hex(data)).cast("binary"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def radix_ranks(rows: DataFrame, by: list[str], key: Callable[[int], Column], order: list[Column], cell: int = CELL, at: int = 0) -> DataFrame:
    """``rows`` with __rank (0, 1, … in each group of ``by``) and __size (rows in the group).

    ``key(0)``, ``key(1)``, … are whole numbers by which rows ascend (null first), the
    next one telling apart rows with the same of all before; ``order`` is the same order
    as columns to sort by. ``by`` has no nulls. ``rows`` must be stored: it is read for
    the counts and again.
    """
    own, flag, digits, n = key(at), f"__f{at}", "__digits", "__n"
    number = F.coalesce(own, F.lit(0))
    keyed = rows.withColumns({flag: own.isNotNull().cast("int"), digits: F.shiftright(number, 8)})
    # The histograms, from all digits but the last to none: a level's parents drop one digit more.
    ends = keyed.agg(F.min(digits), F.max(digits)).first()
    level = stored(keyed.groupBy(*by, flag, digits).agg(F.count(F.lit(1)).alias(n)), "histogram")
    levels = [level]
    shift = 0
    while ends[0] is not None and ends[0] >> shift != ends[1] >> shift and shift < 48:  # 7 digits; the first one has a sign
        shift += 8
        level = level.withColumn(digits, F.shiftright(digits, 8)).groupBy(*by, flag, digits).agg(F.sum(n).alias(n))
        level = stored(level, "histogram")
        levels.append(level)
    top = levels[-1].groupBy(*by, flag).agg(F.sum(n).alias(n))
    # From the top: null or not (two siblings), then digit by digit (at most 256 siblings).
    earlier = lambda group, by_what: F.coalesce(F.sum(n).over(Window.partitionBy(*group).orderBy(by_what).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = top.select(*by, flag, earlier(by, flag).alias("__before"), F.sum(n).over(Window.partitionBy(*by)).alias("__size"))
    for k, nodes in reversed(list(enumerate(levels))):
        if k == len(levels) - 1:
            parents, on = before, [*by, flag]
            nodes = nodes.withColumn("__parent", F.lit(0).cast("long"))
        else:
            parents, on = before.withColumnRenamed(digits, "__parent"), [*by, flag, "__parent"]
            nodes = nodes.withColumn("__parent", F.shiftright(digits, 8))
        nodes = nodes.withColumn("__among", earlier([*by, flag, "__parent"], digits))
        before = nodes.join(parents, on).select(*by, flag, digits, (F.col("__before") + F.col("__among")).alias("__before"), "__size", *([n] if k == 0 else []))
        before = stored(before, "cells")
    cells = before
    low, columns = [*by, flag, digits], [*rows.columns, "__rank", "__size"]

    def placed(met: DataFrame) -> DataFrame:
        return met.withColumn("__rank", F.col("__before") + F.row_number().over(Window.partitionBy(*low).orderBy(*order)) - 1).select(*columns)

    if not cells.where(F.col(n) > cell).limit(1).count():
        return placed(keyed.join(cells, low))
    few = placed(keyed.join(cells.where(F.col(n) <= cell), low))
    # Cells with repeated numbers: what comes before a number inside its cell, then ranks among its rows by the next key.
    same = f"__k{at}"
    many = stored(keyed.join(cells.where(F.col(n) > cell), low).withColumn(same, number), "repeated")
    each = many.groupBy(*low, same).agg(F.count(F.lit(1)).alias(n)).select(*low, same, earlier(low, same).alias("__among"))
    many = many.join(each, [*low, same]).withColumns({f"__base{at}": F.col("__before") + F.col("__among"), f"__whole{at}": F.col("__size")})
    many = stored(many.drop(digits, n, "__before", "__among", "__size"), "repeated")
    finer = radix_ranks(many, [*by, flag, same], key, order, cell, at + 1)
    finer = finer.withColumns({"__rank": F.col(f"__base{at}") + F.col("__rank"), "__size": F.col(f"__whole{at}")})
    return few.unionByName(finer.select(*columns))


def _joined(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(b""), lambda a, x: F.concat(a, x["__node"]))


def _step(run: Column, at: Column) -> Column:
    """The digests left and right of place ``at`` in a run, each side joined."""
    return F.struct(_joined(F.slice(run, F.lit(1), at)).alias("left"), _joined(F.slice(run, at + 2, F.size(run))).alias("right"))


def _levels(size: int, fanout: int) -> int:
    n = 0
    while fanout**n < size:
        n += 1
    return n


class Trie:
    """Nodes reduced by their longest keys first. ``runs[k]``: the runs of level k; ``tops``: by, __node and what else a group's one remaining node has."""

    def __init__(self, nodes: DataFrame, by: list[str], fanout: int):
        """``nodes``: stored rows of by, __rank, __size, __node and other columns, which stay with the nodes of level 0."""
        self.by, self.fanout, self.nodes = by, fanout, nodes
        self.levels = _levels(nodes.agg(F.max("__size")).first()[0] or 0, fanout)
        # A group of up to fanout^d nodes is one node after d levels.
        depth = sum((F.when(F.col("__size") > fanout**k, 1).otherwise(0) for k in range(self.levels)), F.lit(0))
        level = nodes.select(*[c for c in nodes.columns if c not in ("__rank", "__size")], F.col("__rank").alias("__key"), "__size", depth.alias("__depth"))
        self.runs, tops = [], [level.where("__depth = 0").select(*by, "__node")]
        for k in range(self.levels):
            held = [c for c in level.columns if c not in (*by, "__key", "__size", "__depth")]
            run = F.sort_array(F.collect_list(F.struct(F.col("__key").alias("__at"), *held))).alias("__run")
            up = F.expr(f"__key div {fanout}").alias("__up")
            self.runs.append(stored(level.where(F.col("__depth") > k).groupBy(*by, up, "__size", "__depth").agg(run), f"runs-{k}"))
            level = self.runs[k].select(*by, F.col("__up").alias("__key"), over_hex(_joined(F.col("__run"))).alias("__node"), "__size", "__depth")
            tops.append(level.where(F.col("__depth") == k + 1).select(*by, "__node"))
        self.tops = stored(reduce(DataFrame.unionByName, tops), "tops")

    def proofs(self, above: DataFrame) -> DataFrame:
        """The nodes of level 0 with __rank, __size and __path, the steps from them upwards. ``above``: by and the __path of each group's top."""
        others = [c for c in self.nodes.columns if c not in self.by]
        out = [self.nodes.where("__size = 1").join(above, self.by).select(*self.by, *others, "__path")]
        known = None  # by, __up, __path of the nodes one level up
        for k in range(self.levels - 1, -1, -1):
            found = self.runs[k].where(F.col("__depth") == k + 1).join(above, self.by)
            if known is not None:
                found = found.unionByName(self.runs[k].where(F.col("__depth") > k + 1).join(known, [*self.by, "__up"]), allowMissingColumns=False)
            one = found.select(*self.by, "__run", "__path", "__size", F.posexplode("__run").alias("__place", "__it"))
            path = F.concat(F.array(_step(F.col("__run"), F.col("__place"))), "__path").alias("__path")
            if k:
                known = stored(one.select(*self.by, F.col("__it.__at").alias("__up"), path), f"paths-{k}")
            else:
                it = {"__rank": F.col("__it.__at"), "__size": F.col("__size")}
                out.append(one.select(*self.by, *[it.get(c, F.col(f"__it.{c}")).alias(c) for c in others], path))
        return reduce(DataFrame.unionByName, out)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text", fanout: int = 16, tampered: Column | None = None, cell: int = CELL) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, rank, group_size, leaf, subroot, root, proof_sha256, folded_root, verified; digests as lowercase hex.

    A leaf digests the ``fields``; leaves of a ``group`` ascend by ``key`` and reduce, each
    ``fanout`` neighbours to one, until one remains, and the groups' tops, ascending by
    name, likewise. proof_sha256 digests a row's siblings from the leaf upwards, left to
    right. ``tampered`` marks rows whose ``text`` is lower-cased (A-Z) before the root is
    folded again from leaf and siblings; ``verified`` is whether that gives the root.

    A null key or group comes first; a null group is a group of its own and not the empty
    one. Rows with the same group and key ascend by leaf; rows that are the same in all
    fields are a leaf each, and which of them has which place can't be told from the
    result. Values of any length count whole. An empty table gives no rows. Other columns
    are not read. ``key`` must be a whole number; groups are cast to text.
    """
    marked = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    bytes_of = lambda swap: F.concat(*[field(ascii_lower(F.col(f)) if swap and f == text else F.col(f)) for f in fields])
    # Groups as text without nulls: the null group is shortest, so it comes first.
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("__group"),
        F.col(key).cast("long").alias("__id"),
        digest(bytes_of(False)).alias("__node"),
        F.when(marked, digest(bytes_of(True))).alias("__swap"),
        F.monotonically_increasing_id().alias("__row"),
    )
    leaves = stored(leaves, "leaves")
    # doc_id; of equal ones 7 bytes of the digest at a time; of equal rows the row's number.
    piece = lambda c, k: F.conv(F.rpad(F.hex(F.substring(c, 1 + 7 * k, 7)), 14, "0"), 16, 10).cast("long")
    keys = [F.col("__id"), *[piece(F.col("__node"), k) for k in range(5)], F.col("__row")]
    ranked = radix_ranks(leaves, ["__group"], lambda k: keys[k], [F.asc_nulls_first("__id"), F.asc("__node"), F.asc("__row")], cell)
    trie = Trie(stored(ranked.drop("__row"), "ranked"), ["__group"], fanout)

    name = F.col("__group").cast("binary")
    groups = trie.tops.withColumn("__all", F.lit(0))
    upper = Trie(stored(radix_ranks(groups, ["__all"], lambda k: piece(name, k), [name], cell), "groups"), ["__all"], fanout)
    nothing = F.array().cast("array<struct<left:binary,right:binary>>").alias("__path")
    top = upper.tops.select("__all", F.col("__node").alias("__root"))
    above = stored(upper.proofs(upper.tops.select("__all", nothing)).join(F.broadcast(top), "__all").select("__group", "__path", F.col("__node").alias("__subroot"), "__root"), "above")

    rows = trie.proofs(above.select("__group", "__path")).join(above.drop("__path"), "__group")
    siblings = F.aggregate("__path", F.lit(b""), lambda a, s: F.concat(a, s["left"], s["right"]))
    folded = F.aggregate("__path", F.coalesce("__swap", "__node"), lambda a, s: over_hex(F.concat(s["left"], a, s["right"])))
    text_of = lambda c: F.lower(F.hex(c))
    out = rows.select(
        F.col("__id").alias("doc_id"),
        F.when(F.col("__group") != "", F.substring("__group", 2, 2**31 - 1)).alias("source"),
        F.col("__rank").alias("rank"),
        F.col("__size").alias("group_size"),
        text_of("__node").alias("leaf"),
        text_of("__subroot").alias("subroot"),
        text_of("__root").alias("root"),
        text_of(over_hex(siblings)).alias("proof_sha256"),
        text_of(folded).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
