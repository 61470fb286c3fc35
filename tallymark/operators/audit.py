"""Audit trail: query, summary, retention, hash chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def iso_moment(text: str) -> str:
    """An ISO date or moment in UTC without a zone; a day is its first moment. Anything else is a ValueError."""
    try:
        moment = datetime.fromisoformat(text)
    except (TypeError, ValueError):
        raise ValueError(f"{text!r} is no ISO date such as 2024-01-15 or 2024-01-15T18:00:00Z") from None
    return (moment.astimezone(UTC).replace(tzinfo=None) if moment.tzinfo else moment).isoformat(" ")


def matching(log: DataFrame, start: str | None = None, end: str | None = None, operations: list[str] | None = None, key: str | None = None, user: str | None = None) -> DataFrame:
    """Entries in [start, end] with one of the operations, of a record key and a user."""
    tests = [F.lit(True)]
    tests += [F.col("ts") >= F.lit(iso_moment(start)).cast("timestamp_ntz")] if start else []
    tests += [F.col("ts") <= F.lit(iso_moment(end)).cast("timestamp_ntz")] if end else []
    tests += [F.col("operation").isin(operations)] if operations else []
    tests += [F.col("record_key") == key] if key is not None else []
    tests += [F.col("user") == user] if user is not None else []
    return log.where(reduce(lambda a, b: a & b, tests))


def page(entries: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first; entries of one moment by id."""
    return entries.orderBy(F.col("ts").desc(), "id").offset(offset).limit(limit)


def summary(entries: DataFrame) -> DataFrame:
    return entries.agg(*(F.count_if(F.col("operation") == k).alias(f"n_{k}") for k in ("create", "update", "delete")), F.count("*").alias("total"))


def retained(log: DataFrame, cutoff: str) -> DataFrame:
    """Entries of the cutoff day and later."""
    return log.where(F.to_date("ts") >= F.lit(cutoff).cast("date"))


def by_connector(log: DataFrame) -> DataFrame:
    """Rows connector, n."""
    return log.groupBy("connector").agg(F.count("*").alias("n"))


def append(log: DataFrame, path: str) -> None:
    """JSON lines in one folder per connector and day, so that queries of a range read its days only."""
    log.withColumn("date", F.to_date("ts")).write.partitionBy("connector", "date").mode("append").json(path)


def read(spark: SparkSession, path: str, fields: str, connector: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Entries that append() wrote, of a connector and in [start, end]; only the days in between are read.

    `fields` is the schema of a line, which has ts; lines that are no such JSON, or have no ts, are left out.
    """
    lines = spark.read.schema(f"{fields}, connector string, date date, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    lines = lines.where(F.col("connector") == connector) if connector is not None else lines
    lines = lines.where(F.col("date") >= F.lit(iso_moment(start)[:10]).cast("date")) if start else lines
    lines = lines.where(F.col("date") <= F.lit(iso_moment(end)[:10]).cast("date")) if end else lines
    return matching(lines.where(F.col("_bad").isNull() & F.col("ts").isNotNull()).drop("_bad", "date"), start, end)


def _days(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(day, folder) of all days of all connectors; only names are read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/connector=*/date=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted((s.getPath().getName().removeprefix("date="), s.getPath().toString()) for s in found)


def drop_before(spark: SparkSession, path: str, cutoff: str) -> list[str]:
    """Delete the folders of days before an ISO date, without reading any; returns the days. Folders whose day is no date stay."""
    limit, gone = iso_moment(cutoff)[:10], []
    for day, folder in _days(spark, path):
        try:
            early = iso_moment(day)[:10] < limit
        except ValueError:
            continue
        if early:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            gone.append(day)
    return sorted(set(gone))


def compact(spark: SparkSession, path: str, before: str, file_bytes: int = 128 << 20) -> int:
    """Write the many small files of each connector's day before an ISO date anew as few of about file_bytes; returns how many days that were.

    Lines are copied as they are, broken ones too. The new files are complete in a folder beside the day before they take its place.
    """
    done, limit = 0, iso_moment(before)[:10]
    for day, folder in _days(spark, path):
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        sizes = [s.getLen() for s in fs.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        wanted = max(1, -(-sum(sizes) // file_bytes))
        if day >= limit or len(sizes) <= wanted:
            continue
        parent, name = folder.rsplit("/", 1)
        fresh, old = f"{parent}/_compact-{name}", f"{parent}/_old-{name}"
        spark.read.text(folder).repartition(wanted).write.mode("overwrite").text(fresh)
        paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, old)]
        if not (fs.rename(at, paths[1]) and fs.rename(paths[0], at)):
            raise OSError(f"{folder} could not be replaced; its lines are in {old}")
        fs.delete(paths[1], True)
        done += 1
    return done


def _link_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of whole chains, each in order -> the same with previous_hash and hash. Only the last hash is carried; null content makes all later hashes null."""
    at, last = "", ()
    for batch in batches:
        before, after = [], []
        for name, body in zip(batch.column("_chain").to_pylist(), batch.column("_body").to_pylist()):
            if (name,) != last:
                at, last = "", (name,)
            before.append(at)
            at = None if at is None or body is None else hashlib.sha256(f"{at}\n{body}".encode()).hexdigest()
            after.append(at)
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_order"), batch.column("_body"), pa.array(before, pa.string()), pa.array(after, pa.string())], ["_key", "_order", "_body", "previous_hash", "hash"])


def _chain_name(entries: DataFrame, chain: str) -> Column:
    """Text that tells chains apart."""
    return F.to_json(F.struct(chain)) if dict(entries.dtypes)[chain].startswith("struct") else F.col(chain).cast("string")


def linked(entries: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """chain, order, body, previous_hash, hash with hash = sha256(previous_hash + newline + body), from the empty text on.

    A chain is one sequence, so one task hashes it; it is sorted on disk if need be and read in batches, whatever its length.
    """
    key = entries.select(F.col(chain).alias("_key"), F.col(order).alias("_order"), F.col(body).cast("string").alias("_body"), _chain_name(entries, chain).alias("_chain"))
    ready = key.repartition("_key").sortWithinPartitions("_key", "_order", "_body")
    kinds = StructType([f for f in key.schema.fields if f.name != "_chain"] + [StructField("previous_hash", StringType()), StructField("hash", StringType())])
    return ready.mapInArrow(_link_task, kinds).select(F.col("_key").alias(chain), F.col("_order").alias(order), F.col("_body").alias(body), "previous_hash", "hash")


def breaks(stored: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """Stored entries whose previous_hash is not their predecessor's hash, or whose hash is not that of their content."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(chain).orderBy(order)), F.lit(""))
    own = F.sha2(F.concat(F.col("previous_hash"), F.lit("\n"), F.col(body)).cast("binary"), 256)
    return stored.withColumn("_before", before).where(~F.col("previous_hash").eqNullSafe(F.col("_before")) | ~F.col("hash").eqNullSafe(own)).drop("_before")


def segmented(entries: DataFrame, chain: str, segment: str, order: str, body: str) -> DataFrame:
    """chain, segment, order, body, previous_hash, hash: like linked(), but each segment (a day, say) of a chain begins anew.

    So segments are hashed by as many tasks as there are; heads() ties them together. Segments are in the order of their values.
    """
    part = F.struct(F.col(chain).alias("chain"), F.col(segment).alias("segment"))
    out = linked(entries.select(part.alias("part"), order, body), "part", order, body)
    return out.select(F.col("part.chain").alias(chain), F.col("part.segment").alias(segment), order, body, "previous_hash", "hash")


def _digests(stored: DataFrame, chain: str, segment: str, order: str) -> DataFrame:
    """One row per segment: how many entries it has, and the hash of its last one."""
    last = stored.groupBy(chain, segment).agg(F.count("*").alias("n"), F.max_by("hash", order).alias("last_hash"))
    return last.withColumn("digest", F.concat_ws(":", F.col("n").cast("string"), F.coalesce("last_hash", F.lit(""))))


def heads(stored: DataFrame, chain: str, segment: str, order: str) -> DataFrame:
    """chain, segment, n, last_hash, previous_hash, hash: one row per segment, chained by count and last hash. Keep it apart from the entries."""
    own = _digests(stored, chain, segment, order)
    tied = linked(own, chain, segment, "digest")
    return tied.join(own.select(chain, segment, "n", "last_hash"), [chain, segment]).select(chain, segment, "n", "last_hash", "previous_hash", "hash")


def segment_breaks(stored: DataFrame, kept: DataFrame, chain: str, segment: str, order: str, body: str) -> DataFrame:
    """chain, segment, order, what: faults of stored segments, given the heads kept apart.

    `entry`: an entry does not follow its predecessor or has other content; a window over one segment finds it, so one hot chain is
    checked by as many tasks as it has segments. `segment`: a segment is missing, unknown, or its count or last hash is not the kept one (an
    end cut off, above all). `head`: the kept heads do not follow each other.
    """
    part = stored.withColumn("part", F.struct(chain, segment))
    entry = breaks(part, "part", order, body).select(chain, segment, F.col(order).cast("string").alias(order), F.lit("entry").alias("what"))
    now = _digests(stored, chain, segment, order).select(F.col(chain).alias("c"), F.col(segment).alias("s"), F.col("digest").alias("now"))
    then = kept.withColumn("digest", F.concat_ws(":", F.col("n").cast("string"), F.coalesce("last_hash", F.lit(""))))
    both = then.join(now, then[chain].eqNullSafe(now["c"]) & then[segment].eqNullSafe(now["s"]), "full_outer").where(~F.col("digest").eqNullSafe(F.col("now")))
    none = F.lit(None).cast("string").alias(order)
    cut = both.select(F.coalesce(chain, "c").alias(chain), F.coalesce(segment, "s").alias(segment), none, F.lit("segment").alias("what"))
    loose = breaks(then, chain, segment, "digest").select(chain, segment, none, F.lit("head").alias("what"))
    return entry.unionByName(cut).unionByName(loose)
