"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes, an external sort places equal texts
adjacent, and each row is compared in full with its neighbour. The sort key is (first bytes,
SHA-256, whole text, doc_id): splitters are drawn from the bounded parts only, so sampling never
ships whole texts to the driver, and doc_id lets a group of copies of any size lie over many
partitions. Only runs that touch a partition's edge are stitched, from two narrow rows per
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, settle, small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the text that lead the sort key.
PREFIX_BYTES = 24


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, all else untouched."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition -> doc_id, digest, run's size and largest id, last of its run, run touches an edge.

    Holds the ids of the open run and one text only.
    """
    names = ["doc_id", "digest", "local_size", "local_max", "last", "edge"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    ids: list[int | None] = []
    text = digest = None
    first = True

    def closed(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal first
        most = max((i for i in ids if i is not None), default=None)
        edge = first or final
        first = False
        for k in range(0, len(ids), 20_000):
            part = ids[k : k + 20_000]
            n = len(part)
            tail = [False] * n
            tail[-1] = k + n == len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((part, [digest] * n, [len(ids)] * n, [most] * n, tail, [edge] * n), kinds)], names)

    small: list[pa.RecordBatch] = []
    for b in batches:
        for i, t, d in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist(), b.column("digest").to_pylist()):
            if ids and t == text:
                ids.append(i)
                continue
            if ids:
                small += closed(False)
            ids, text, digest = [i], t, d
        if len(small) > 500:
            yield from pa.Table.from_batches(small).combine_chunks().to_batches()
            small = []
    if ids:
        small += closed(True)
    if small:
        yield from pa.Table.from_batches(small).combine_chunks().to_batches()


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z. The row with the largest doc_id of each
    group stays. A null text counts as empty (all null and empty texts are one group). Null ids
    sort below every id; a group of null ids only keeps one row, with keep_id null. Of repeated
    rows with the largest id exactly one is kept. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = normalised(F.col(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.cast("binary").alias("body"))
    rows = rows.select("doc_id", "body", F.unhex(F.sha2("body", 256)).alias("digest"), F.substring("body", 1, PREFIX_BYTES).alias("head"))
    dealt = rows.repartitionByRange("head", "digest", F.col("doc_id").asc_nulls_first())
    ordered = dealt.sortWithinPartitions("head", "digest", "body", F.col("doc_id").asc_nulls_first())
    runs = ordered.select("doc_id", "body", "digest").mapInArrow(_runs, "doc_id long, digest binary, local_size long, local_max long, last boolean, edge boolean")
    runs = settle(runs, "runs")
    # two runs per partition at most touch an edge: bounded by the number of partitions
    stitched = runs.where("edge and last").groupBy(F.col("digest").alias("edge_digest")).agg(F.sum("local_size").alias("size"), F.max("local_max").alias("most"))
    joined = runs.join(F.broadcast(stitched), F.col("edge") & (F.col("digest") == F.col("edge_digest")), "left")
    most = F.when(F.col("edge"), F.col("most")).otherwise(F.col("local_max"))
    size = F.when(F.col("edge"), F.col("size")).otherwise(F.col("local_size"))
    whole = joined.select("doc_id", most.alias("keep_id"), size.alias("group_size"), "last", "edge", "digest")
    kept = F.col("last") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return whole.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns: one of each group, also of rows repeated in full."""
    key, digest = free_name(docs, "id_key"), free_name(docs, "text_digest")
    as_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    kept = exact_duplicates(docs).where("kept").select(as_key.alias(key), F.unhex("text_sha256").alias(digest))
    keyed = docs.withColumns({key: as_key, digest: F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))})
    return keyed.join(kept, [key, digest], "left_semi").dropDuplicates([key, digest]).select(*docs.columns)


#: The same as one query for DuckDB.
SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id is not distinct from max(doc_id) over w
         and row_number() over (partition by h, doc_id) = 1 as kept,
       h as text_sha256
from d window w as (partition by h)
"""
