"""Insert-if-absent and upserts as joins: old rows and new ones in, the table's next state out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Iterable[str], order: Iterable) -> DataFrame:
    """Of rows with one key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _same(a: str, b: str, keys: Iterable[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def new_only(new: DataFrame, old: DataFrame, keys: list[str], order: Iterable | None = None) -> DataFrame:
    """The new rows whose key the old ones don't have; null equals null. With ``order``, one of each key."""
    fresh = new.alias("n").join(old.select(*keys).distinct().alias("o"), _same("n", "o", keys), "left_anti")
    return first_rows(fresh, keys, order) if order is not None else fresh


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: Iterable) -> DataFrame:
    """The old rows and, of each key they lack, the first new row."""
    return old.unionByName(new_only(new, old, keys, order), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: Iterable[str] = (), fill: Iterable[str] = (), keep: Iterable[str] = ()) -> DataFrame:
    """The old rows changed by new ones of the same key, and the new rows of other keys.

    Columns in ``overwrite`` take the new value even if it is null; those in ``fill`` only
    where the old one is null; those in ``keep`` never change; all others take the new
    value unless it is null. A column that only one side has is kept as it is there.
    ``new`` must have one row for each key. Null keys equal each other. The result has
    __change: "insert", "update" or "keep".
    """
    overwrite, fill, keep = set(overwrite), set(fill), set(keep)
    o, n = old.withColumn("__old", F.lit(True)), new.withColumn("__new", F.lit(True))
    joined = o.alias("o").join(n.alias("n"), _same("o", "n", keys), "full_outer")
    was, comes = F.col("o.__old").isNotNull(), F.col("n.__new").isNotNull()
    out = []
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c not in new.columns:
            value = F.col(f"o.{c}")
        elif c not in old.columns:
            value = F.col(f"n.{c}")
        elif c in keys:
            value = F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        elif c in overwrite:
            value = F.when(comes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        elif c in keep:
            value = F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        elif c in fill:
            value = F.coalesce(f"o.{c}", f"n.{c}")
        else:
            value = F.coalesce(f"n.{c}", f"o.{c}")
        out.append(value.alias(c))
    change = F.when(was & comes, "update").when(comes, "insert").otherwise("keep")
    return joined.select(*out, change.alias("__change"))


def delete_cascade(children: DataFrame, gone: DataFrame, foreign_key: str, key: str = "id") -> DataFrame:
    """The children whose parent isn't gone."""
    return children.join(gone.select(F.col(key).alias(foreign_key)), foreign_key, "left_anti")


def delete_set_null(children: DataFrame, gone: DataFrame, foreign_key: str, key: str = "id") -> DataFrame:
    """All children, without the foreign key where their parent is gone."""
    lost = gone.select(F.col(key).alias("__gone")).distinct()
    return children.join(lost, children[foreign_key] == F.col("__gone"), "left").withColumn(foreign_key, F.when(F.col("__gone").isNull(), F.col(foreign_key))).drop("__gone")


def backfill_canonical(projects: DataFrame) -> DataFrame:
    """Projects from before there were canonical names get their name in lower case."""
    return projects.withColumn("canonical_name", F.coalesce("canonical_name", F.lower("name")))
