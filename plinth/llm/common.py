"""What the training-data operators share: shared storage, Arrow maps, block numbering.

Shared storage is the folder in ``spark.checkpoint.dir``; every executor and the
driver see it (``plinth.session.shared_dir``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.session import shared_dir, workers_find_package


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to shared storage (to ``path``, or a new folder) and read back: cuts the lineage."""
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder of shared storage that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def utf8(column: str | Column) -> Column:
    """A text column as its UTF-8 bytes; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit(b""))


#: Bytes in a batch that goes to or from a Python worker: texts can be long, and a task holds several batches.
BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package importable on the workers, and the session's batches held small."""
    spark = df.sparkSession
    workers_find_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != f"{BATCH_BYTES}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df.mapInArrow(function, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def columns_of(df: DataFrame) -> list[str]:
    """The columns' names, quoted. Names that begin with two underscores are the operators' own."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def small(batches: Iterable[pa.RecordBatch], name: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into ones of about ``limit`` bytes (or list items) in column ``name``, so that a worker holds little."""
    import numpy as np

    for batch in batches:
        values = column(batch, name)
        size = pa.compute.list_value_length(values) if pa.types.is_list(values.type) else pa.compute.binary_length(values)
        part = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[int, pa.Table]]:
    """Cut a task's rows, in order, into blocks of about ``limit`` bytes of text.

    Block numbers hold the task's partition in the upper bits. The same stored
    input read in the same partitions gives the same blocks, so a second pass can
    meet what the first one left for each block.
    """
    from pyspark import TaskContext

    base, n, held, size = TaskContext.get().partitionId() << 24, 0, [], 0
    for batch in batches:
        lengths = pa.compute.binary_length(column(batch, text)).to_numpy(zero_copy_only=False)
        start = 0
        for i, length in enumerate(lengths.tolist()):
            size += length
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield base + n, pa.Table.from_batches(held)
                n, start, held, size = n + 1, i + 1, [], 0
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield base + n, pa.Table.from_batches(held)


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The runs of equal integer ``key`` in a task's rows, which must be sorted by it."""
    import numpy as np

    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = column(batch, key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and at != keys[a]:
                yield int(at), pa.Table.from_batches(held)
                held = []
            at = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(at), pa.Table.from_batches(held)


def write_answers(answers: DataFrame, path: str, parts: int) -> None:
    """Write rows (part, block, bucket, …) so that each part, a partition of the passes over a table, finds its own in one file, sorted by block and bucket.

    The rows are shuffled by part first: a file for each part, however many buckets
    answered. Negative parts are notes that no pass reads by part; they are spread by bucket.
    """
    to = F.when(F.col("part") < 0, F.pmod("bucket", F.lit(parts))).otherwise(F.pmod("part", F.lit(parts)))
    met = answers.repartitionById(parts, to.cast("int")).sortWithinPartitions("part", "block", "bucket")
    met.write.partitionBy("part").parquet(path)


class Answers:
    """On an executor: the answers for this task's blocks, read on as the blocks come."""

    def __init__(self, path: str, names: list[str], rows: int = 256):
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext

        folder = f"{path}/part={TaskContext.get().partitionId()}"
        store, at = fs.FileSystem.from_uri(folder)
        found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        files = [f.path for f in found if f.path.endswith(".parquet")]
        if len(files) > 1:
            raise RuntimeError(f"more than one file of answers in {folder}")
        self.batches = iter(pq.ParquetFile(store.open_input_file(files[0])).iter_batches(rows, columns=names)) if files else iter(())
        self.names, self.held = names, None

    def of(self, block: int) -> list[list]:
        """The columns of a block's rows, without the block's number; blocks are asked for in ascending order."""
        found = []
        while True:
            if self.held is None:
                self.held = next(self.batches, None)
                if self.held is None:
                    break
            numbers = column(self.held, "block").to_numpy()
            a, b = (int(x) for x in numbers.searchsorted([block, block + 1]))
            if b > a:
                found.append(self.held.slice(a, b - a))
            if b < len(numbers):
                self.held = self.held.slice(b)
                break
            self.held = None
        return [[v for part in found for v in column(part, name).to_pylist()] for name in self.names if name != "block"]


def parts_of(df: DataFrame) -> int:
    """How many partitions a pass over ``df``, a stored table, has."""
    return df.rdd.getNumPartitions()
