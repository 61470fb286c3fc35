"""Helpers every operator of this subpackage shares: scratch tables, batches and the held-out rule."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts run to hundreds of kilobytes, so the default of 10,000 rows is too many.
BATCH_ROWS = 256
#: Bytes of text that one vectorised step works on.
BLOCK_BYTES = 2 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: spark.checkpoint.dir, or a new one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/tallymark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, lineage cut, safe against lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most for what is run inside; then the setting is as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freed(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete settled tables that are read no more, and let Spark clean the shuffle files of what nothing refers to any longer."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    for _ in range(1 if spark.sparkContext.master.startswith("local[") else 2):  # what the first round lets go of may hold more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4. A null id counts as empty text and is never held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not use yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def gathered(batches, column: str, limit: int = 2 * BLOCK_BYTES):
    """A task's batches joined to blocks of about `limit` bytes of text, as the tokenizer's memo works best on large ones.

    After each, Arrow gives free memory back: a worker that waits for its next task would hold it for all stages to come.
    """
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= limit:
            yield from _joined(held, column, limit)
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield from _joined(held, column, limit)
    pa.default_memory_pool().release_unused()


def _joined(held: list[pa.RecordBatch], column: str, limit: int):
    for b in pa.Table.from_batches(held).combine_chunks().to_batches():
        yield from blocks(b, column, 2 * limit)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES):
    """Slices of a batch that hold about `limit` bytes of text each; a longer single text makes a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < len(sizes):
        base = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


#: Rows from which on a key may count as hot, however few partitions there are.
FEW_ROWS = 1000


def hot_keys(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Keys with more than a quarter of a partition's share of all rows: at most four for each partition."""
    limit = max(rows.count() // (4 * partitions(rows.sparkSession)), FEW_ROWS)
    return settle(rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > limit).select(key), f"{name}_hot")


def looked_up(rows: DataFrame, key: str, table: DataFrame, name: str, hot: DataFrame | None = None) -> DataFrame:
    """rows left-joined with `table`, whose keys are unique and whose other columns rows does not have.

    Hot keys are broadcast with what the table has of them; rows of other keys meet the table by a shuffle; rows
    without a key are not moved. `rows` is read several times: settle it before.
    """
    keyed, loose = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    hot = hot_keys(rows, key, name) if hot is None else hot
    if hot.isEmpty():
        found = keyed.join(table, key, "left")
    else:
        known = settle(hot.join(table, key, "left"), f"{name}_known")
        found = keyed.join(F.broadcast(known), key).unionByName(keyed.join(F.broadcast(hot), key, "left_anti").join(table, key, "left"))
    return found.unionByName(loose, allowMissingColumns=True)
