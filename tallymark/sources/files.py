"""CSV, JSON, Parquet and JDBC sources, and keyed writes to tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import named, qualified
from ..operators.govern import guard_formulas
from ..operators.request import UNSAFE


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, quote: str = '"', multiline: bool = True) -> DataFrame:
    """Text columns; those whose values all are numbers become doubles. Dates stay text.

    Quotes are doubled inside quotes, and quoted texts may have line breaks; files without such breaks can be split if `multiline` is
    off. Without a header the widest row counts; trailing columns without any value are left out then.
    """
    options = {"sep": delimiter, "header": header, "quote": quote, "escape": quote, "multiLine": multiline, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    if header:
        df = spark.read.csv(path, **options)
    else:
        width = spark.read.text(path).agg(F.max(F.size(F.split("value", re.escape(delimiter))))).first()[0] or 0
        df = spark.read.schema(", ".join(f"Column{i + 1} string" for i in range(width))).csv(path, **options) if width else spark.read.text(path).drop("value")
    if unsafe := [c for c in df.columns if c in UNSAFE]:
        raise ValueError(f"unsafe header names: {', '.join(unsafe)}")
    if not df.columns:
        return df
    counts = df.agg(*(F.count_if(test).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k, test in (("bad", named(c).isNotNull() & (named(c) != "") & named(c).try_cast("double").isNull()), ("full", named(c).isNotNull())))).first()
    last = max((i for i in range(len(df.columns)) if header or counts[f"full{i}"]), default=-1)
    return df.select(*((named(c).try_cast("double").alias(c) if counts[f"bad{i}"] == 0 else named(c)) for i, c in enumerate(df.columns) if i <= last))


def read_json(spark: SparkSession, path: str, records_path: str | None = None) -> DataFrame:
    """A root array, or the array at a dot path."""
    df = spark.read.json(path, multiLine=True)
    if not records_path:
        return df
    parts = records_path.split(".")
    if any(not p or p in UNSAFE for p in parts):
        raise ValueError("the records path has an unsafe or empty part")
    return df.select(F.explode(records_path).alias("r")).select("r.*")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """One table; filters, columns, limit and offset are pushed to the database by Spark."""
    if not all(part.replace("_", "a").isalnum() and not part[0].isdigit() for part in table.split(".")):
        raise ValueError("not a table name")
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    guard_formulas(df).write.mode(mode).csv(path, header=True, escape='"')


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def _folded(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: of each field its last value that is there, in the given order."""
    return rows.groupBy(named(key)).agg(*(F.max_by(named(c), F.when(named(c).isNotNull(), named(order))).alias(c) for c in rows.columns if c not in (key, order)))


def _absent(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.alias("n").join(table.select(named(key)).alias("t"), qualified("n", key) == qualified("t", key), "left_anti")


def updated(table: DataFrame, rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(table with fields of matching rows merged, rows that match nothing)."""
    new = _folded(rows, key, order)
    own = [c for c in new.columns if c != key]
    joined = table.alias("t").join(new.alias("n"), qualified("t", key) == qualified("n", key), "left")
    merged = joined.select(*((F.coalesce(qualified("n", c), qualified("t", c)).alias(c) if c in own else qualified("t", c)) for c in table.columns))
    return merged, _absent(rows, table, key)


def upserted(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Matching rows merged, others added; rows without a key are added."""
    keyed, loose = rows.where(named(key).isNotNull()), rows.where(named(key).isNull()).drop(order)
    merged, _ = updated(table, keyed, key, order)
    fresh = _absent(_folded(keyed, key, order), table, key)
    return merged.unionByName(fresh, allowMissingColumns=True).unionByName(loose, allowMissingColumns=True)


def write_json(df: DataFrame, path: str, records_path: str | None = None, mode: str = "errorifexists") -> None:
    """One JSON object per line; with a dot path each line holds a record under that path, so read_json of the path finds them again."""
    body = F.struct("*")
    parts = records_path.split(".") if records_path else []
    if any(not p or p in UNSAFE for p in parts):
        raise ValueError("the records path has an unsafe or empty part")
    if not parts:
        df.write.mode(mode).json(path)
        return
    nested = F.array(body)
    for p in reversed(parts[1:]):
        nested = F.struct(nested.alias(p))
    df.select(nested.alias(parts[0])).write.mode(mode).json(path)
