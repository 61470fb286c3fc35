"""JDBC tables: scans in partitions, and keyed writes by way of a stage table in one transaction."""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import named, qualified
from .files import _folded

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


def _checked(table: str) -> str:
    if not NAME.fullmatch(table):
        raise ValueError(f"{table!r} is not a table name")
    return table


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def scan(spark: SparkSession, url: str, table: str, partition: str | None = None, partitions: int | None = None, **options: str) -> DataFrame:
    """A table; filters, columns, limits and aggregates are pushed to the database by Spark.

    With a numeric, date or timestamp column the scan is cut into as many ranges of it as there are `partitions`, between its least and largest value, which one
    query asks for; rows where it is null are in the first range. Without one a single task reads all rows.
    """
    reader = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more).load()
    if partition is None:
        return reader(dbtable=_checked(table))
    c = _quoted(partition)
    least, most = reader(query=f"select min({c}) as lo, max({c}) as hi from {_checked(table)}").first()
    if least is None:
        return reader(dbtable=table)
    least, most = (x if isinstance(x, (date, datetime)) else ends(x) for x, ends in ((least, math.floor), (most, math.ceil)))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return reader(dbtable=table, partitionColumn=partition, lowerBound=str(least), upperBound=str(most), numPartitions=str(n))


@dataclass
class Written:
    """How many rows were inserted and updated; errors: key, error of the rows that were not written."""

    inserted: int
    updated: int
    errors: DataFrame


def _transaction(spark: SparkSession, url: str, driver: str | None, statements: list[str]) -> list[int]:
    """All statements or none; their row counts."""
    if driver:
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        counts = [statement.executeUpdate(s) for s in statements]
        connection.commit()
        return counts
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def write(rows: DataFrame, url: str, table: str, how: str, key: str, order: str, errors_path: str, driver: str | None = None, batch: int = 1000) -> Written:
    """Insert, update or upsert rows by a key. Rows of one key are merged before: of each field the last value that is there, in `order`.

    Tasks write a stage table in batches; then statements in the database move it in one transaction, so a failed write leaves the table as it
    was. A null field keeps what the table has. Rows without a key, keys that an insert finds and keys that an update does not find are
    written to `errors_path` (Parquet) instead.
    """
    if how not in ("insert", "update", "upsert"):
        raise ValueError(f"unknown way to write: {how}")
    spark, stage = rows.sparkSession, f"{_checked(table)}_stage_{uuid.uuid4().hex[:12]}"
    options = {"driver": driver} if driver else {}
    there = scan(spark, url, table, **options).select(named(key))
    new = _folded(rows.where(named(key).isNotNull()), key, order)
    own = [c for c in new.columns if c != key]
    wrong = rows.where(named(key).isNull()).select(F.lit(None).cast("string").alias("key"), F.lit("no key").alias("error"))
    if how != "upsert":
        found = new.alias("n").join(there.alias("t"), qualified("n", key) == qualified("t", key), "left_semi" if how == "insert" else "left_anti")
        wrong = wrong.union(found.select(named(key).cast("string"), F.lit("exists" if how == "insert" else "not found")))
    wrong.write.parquet(errors_path)
    new.write.format("jdbc").options(url=url, dbtable=stage, batchsize=str(batch), **options).save()
    k, names = _quoted(key), ", ".join(map(_quoted, [key, *own]))
    same = f"(select s.{{}} from {stage} s where s.{k} = {table}.{k})"
    update = f"update {table} set {', '.join(f'{_quoted(c)} = coalesce({same.format(_quoted(c))}, {_quoted(c)})' for c in own)} where exists {same.format(k)}"
    insert = f"insert into {table} ({names}) select {names} from {stage} s where not exists (select 1 from {table} t where t.{k} = s.{k})"
    steps = [s for s, ways in ((update if own else None, ("update", "upsert")), (insert, ("insert", "upsert"))) if s and how in ways]
    try:
        counts = dict(zip(steps, _transaction(spark, url, driver, steps)))
    finally:
        _transaction(spark, url, driver, [f"drop table {stage}"])
    return Written(counts.get(insert, 0), counts.get(update, 0), spark.read.parquet(errors_path))
