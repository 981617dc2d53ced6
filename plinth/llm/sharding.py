"""Sharding by a two-pass external shuffle.

Pass one scatters the rows by seeded hashes, evenly, into buckets that fit in memory.
Pass two takes a bucket at a time, puts it in an order that doesn't depend on how it
arrived, shuffles it (Fisher-Yates, seeded by the bucket's number) and writes it. The
buckets, one after another, are one random order of all rows, which the shards cut
into runs of equal length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import columns_of, grouped, map_arrow, stored

BUCKET_BYTES = 16 << 20


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A random order of n places. Generator.shuffle is a Fisher-Yates shuffle in place."""
    order = np.arange(n)
    rng.shuffle(order)
    return order


def _shuffle(seed: int):
    def run(batches):
        for bucket, rows in grouped(batches, "__bucket"):
            rows = rows.take(fisher_yates(len(rows), np.random.default_rng([seed, bucket]))).drop_columns(["__at"])
            yield from rows.append_column("__place", pa.array(np.arange(len(rows)))).to_batches(max_chunksize=2048)

    return run


def external_shuffle(docs: DataFrame, n_shards: int = 16, seed: int = 17, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` in random order over ``n_shards`` shards: all columns, then shard (int) and slot (long).

    Shards differ by at most one row; slots run from 0 without gaps. Every row is dealt
    out, repeated ones and those with null key or text too; the row's number takes part
    in the hash, so repeated rows spread like others. The result is written to shared
    storage by bucket. The same seed, rows and partitions of a stored input give the same
    order. An empty table gives no rows; columns named shard or slot are replaced. A
    row larger than ``bucket_bytes`` makes its bucket larger.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64))).first()[0] or 0
    n_buckets = int(size // bucket_bytes) + 1
    at = F.xxhash64(F.lit(seed), F.col(key), F.monotonically_increasing_id())
    scattered = docs.withColumn("__at", at).withColumn("__bucket", F.pmod(F.col("__at"), F.lit(n_buckets)).cast("int"))
    met = scattered.repartitionById(n_buckets, F.col("__bucket")).sortWithinPartitions("__bucket", "__at")
    kind = ", ".join([*(f"{q} {f.dataType.simpleString()}" for q, f in zip(columns_of(docs), docs.schema.fields, strict=True)), "__bucket int", "__place long"])
    written = stored(map_arrow(met, _shuffle(seed), kind), "shuffled")
    counts = written.groupBy("__bucket").count().toArrow().sort_by("__bucket")  # two numbers for each 16 MB of input
    n = counts.column("count").to_numpy()
    total = int(n.sum())
    before = spark.createDataFrame(pa.table({"__bucket": counts.column("__bucket"), "__first": pa.array(np.cumsum(n) - n, pa.int64())}))
    out = written.join(before, "__bucket").withColumn("__place", F.col("__first") + F.col("__place"))
    out = out.withColumn("shard", F.expr(f"CAST((__place * {n_shards}L) DIV {max(total, 1)}L AS INT)"))
    start = F.expr(f"(CAST(shard AS BIGINT) * {max(total, 1)}L + {n_shards - 1}L) DIV {n_shards}L")
    return out.withColumn("slot", F.col("__place") - start).drop("__bucket", "__place", "__first")
