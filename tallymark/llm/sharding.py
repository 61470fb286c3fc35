"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

1. Count the rows of each partition.
2. Draw how many rows each partition sends to each shard: row by row of a multivariate
   hypergeometric matrix whose margins are the partition sizes and the exact shard sizes.
3. Each partition deals its rows to shards by a seeded local permutation of those counts, and
   each row to one of its shard's bins at random.
4. Exchange by bin, then permute again: sort each bin by random keys and number its rows from
   the bin's first slot. Bins keep tasks small; numbering them in turn makes a shard's order uniform.

The draws depend on the seed, the partition's number and its row count only, so a task that is
run again on a lost executor deals alike, and bin sizes are summed without reading documents again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import free_name, partitions, small_batches

SHARDS = 16


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Exact sizes, at most one apart."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def draw_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of each partition for each shard; both margins are exact."""
    left = shard_sizes(sum(counts), shards).astype(np.int64)
    out = np.zeros((len(counts), shards), np.int64)
    rng = np.random.default_rng([seed, 0])
    for p, n in enumerate(counts):
        free, need = int(left.sum()), n
        for s in range(shards):  # one shard after another: a chain of hypergeometric draws
            free -= int(left[s])
            take = need if free == 0 else _hypergeometric(rng, int(left[s]), free, need)
            out[p, s] = take
            need -= take
        left -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """An exact draw at any size: numpy's sampler up to its limit of 10**9, inversion of the same law beyond."""
    if draws == 0 or good == 0:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    return invert_hypergeometric(rng.random(), good, bad, draws)


def invert_hypergeometric(u: float, good: int, bad: int, draws: int) -> int:
    """The smallest x with P(X <= x) > u. Probabilities come from the ratios of neighbours, around the mode as far as they are above 1e-30 of it."""
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    share = good / (good + bad)
    reach = 40 + int(12 * math.sqrt(draws * share * (1 - share)))
    first, last = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(first + 1, last + 1, dtype=np.float64)  # P(x) / P(x - 1)
    ratio = np.log((good - x + 1) * (draws - x + 1)) - np.log(x * (bad - draws + x))
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    total = np.cumsum(np.exp(weight - weight.max()))
    return first + int(np.searchsorted(total, u * total[-1], side="right"))


def deal(counts: np.ndarray, bins: int, seed: int, partition: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a partition in turn: its bin (shard * bins + k) and its random sort key."""
    rng = np.random.default_rng([seed, 1, partition])
    shard = rng.permutation(np.repeat(np.arange(len(counts), dtype=np.int64), counts))
    return shard * bins + rng.integers(0, bins, len(shard)), rng.integers(0, 1 << 62, len(shard))


def _deal_task(matrix, bins: int, seed: int, names: tuple[str, str]) -> Callable:
    """matrix: broadcast numbers of partitions, ascending, and what each sends to each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        order, drawn = matrix.value
        at = int(np.searchsorted(order, p))
        own, keys = deal(drawn[at] if at < len(order) and order[at] == p else np.zeros(1, np.int64), bins, seed, p)
        at = 0
        for b in batches:
            n = b.num_rows
            if at + n > len(own):
                raise RuntimeError("a partition has other rows than were counted; write the documents to a table first")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own[at : at + n].astype(np.int32)), pa.array(keys[at : at + n])], [*b.schema.names, *names])
            at += n
        if at != len(own):
            raise RuntimeError("a partition has fewer rows than were counted; write the documents to a table first")

    return run


def _count_task(bins: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, counts in zip(b.column("partition").to_pylist(), b.column("counts").to_pylist()):
                bin_, n = np.unique(deal(np.array(counts), bins, seed, p)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bin_.astype(np.int32)), pa.array(n)], ["bin", "n"])

    return run


def _number_task(first: dict[int, int], name: str, slot: str) -> Callable:
    """Rows of a partition, sorted by bin and key -> their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            bin_ = b.column(name).to_numpy()
            at = np.empty(len(bin_), np.int64)
            for v in np.unique(bin_).tolist():
                own = bin_ == v
                n, had = int(own.sum()), seen.get(v, 0)
                at[own] = first[v] + had + np.arange(n)
                seen[v] = had + n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, slot])

    return run


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """docs with a shard (int) and a slot (long, gapless from 0 in each shard) on each row, dealt out by shard and slot.

    Row counts of shards differ by at most one, for any table: empty ones, too. Nulls, repeated
    rows, empty texts and further columns are rows like all others; where docs has a column named
    shard or slot already, the new one gets an underscore. docs must give the same rows in the
    same partitions when read twice (a table does, and so do sorted, grouped and repartitioned ones);
    otherwise the job fails rather than miscounts. The driver draws one number for each partition and
    shard, and sends 8 bytes for each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = dict(docs.groupBy(F.spark_partition_id().alias("p")).count().collect())  # one row per partition
    order = sorted(found)
    drawn = draw_matrix([found[p] for p in order], shards, seed)
    matrix = spark.sparkContext.broadcast((np.array(order, np.int64), drawn))  # 8 bytes for each partition and shard
    bins = max(1, -(-partitions(spark) // shards))
    counted = spark.createDataFrame([(p, drawn[k].tolist()) for k, p in enumerate(order)], "partition int, counts array<long>").repartition(max(1, min(len(order), partitions(spark))))
    sizes = dict(counted.mapInArrow(_count_task(bins, seed), "bin int, n long").groupBy("bin").agg(F.sum("n")).collect())  # shards * bins rows
    first: dict[int, int] = {}
    for s in range(shards):
        at = 0
        for b in range(s * bins, (s + 1) * bins):
            first[b] = at
            at += sizes.get(b, 0)
    bin_, key = free_name(docs, "bin"), free_name(docs, "sort_key")
    shard_, slot_ = free_name(docs, "shard"), free_name(docs, "slot")
    extra = StructType([*docs.schema.fields, StructField(bin_, IntegerType()), StructField(key, LongType())])
    dealt = docs.mapInArrow(_deal_task(matrix, bins, seed, (bin_, key)), extra)
    moved = dealt.repartitionById(shards * bins, F.col(bin_)).sortWithinPartitions(bin_, key)
    numbered = moved.mapInArrow(_number_task(first, bin_, slot_), StructType([*extra.fields, StructField(slot_, LongType())]))
    return numbered.select(*docs.columns, F.floor(F.col(bin_) / bins).cast("int").alias(shard_), slot_)


def shard_digest(docs: DataFrame) -> DataFrame:
    """Shards of all documents, with each text's size and checksum in place of the text."""
    rows = shard(docs.select("doc_id", "text"))
    body = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
