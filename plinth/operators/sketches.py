"""Mergeable sketches beside exact roll-ups: distinct counts and quantiles of any level from those of the finest.

Facts are read once, into a sketch for each finest group; a coarser level merges sketches,
which are small whatever they stand for, and a new day's facts are sketched alone and
merged into what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^LG registers of a distinct count (a standard error of 1.04 / sqrt(2^LG), 1.6 %); K of a quantile sketch (a rank is off by 1.65 % at most, 99 times of 100).
LG, K = 12, 200


def sketched(facts: DataFrame, keys: list[str], distinct: str, value: str) -> DataFrame:
    """keys, n, distinct_sketch, value_sketch of each group: of the values of ``distinct``, and of the numbers in ``value``. Nulls count in n only."""
    return facts.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, LG).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("value_sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups, as if made of all their facts; also of a stored table and a batch's sketches together."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch", K).alias("value_sketch"))


def estimates(sketches: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """The groups with n, n_distinct and a column for each of ``ranks`` (name to rank, 0.5 for the median); null where a group has no value."""
    keys = [c for c in sketches.columns if c not in ("n", "distinct_sketch", "value_sketch")]
    some = F.kll_sketch_get_n_double("value_sketch") > 0
    return sketches.select(*keys, "n", F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), *[F.when(some, F.kll_sketch_get_quantile_double("value_sketch", F.lit(r))).alias(k) for k, r in ranks.items()])
