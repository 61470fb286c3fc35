"""Change detection against a snapshot or a time."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import as_text, comparable, family, free_name, named, qualified
from ..functions.values import moment as moment_of
from . import request
from .audit import iso_moment
from .compare import last_of_each


def against_snapshot(old: DataFrame, new: DataFrame, key: str, track: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows key, change (added, modified, deleted), changed (names, comma-joined) of keys that differ.

    Fields are those of either side, or the tracked ones; a field that a side does not have is null there. Of rows with one key the last counts, in the given order or as the table is read.
    """
    fields = track or [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    fields = [f for f in fields if f in old.columns or f in new.columns]
    text, there = free_name("key_text", old, new), free_name("there", old, new)

    def side(df: DataFrame) -> DataFrame:
        out = df.withColumn(text, F.coalesce(as_text(named(key), dict(df.dtypes)[key]), F.lit("null")))
        return last_of_each(out, [text], order).select(text, *((comparable(named(f), dict(df.dtypes)[f]) if f in df.columns else F.lit(None)).alias(f) for f in fields), F.lit(True).alias(there))

    def same(f: str) -> Column:
        """Equality never crosses type families."""
        kinds = [dict(df.dtypes).get(f) for df in (old, new)]
        x, y = qualified("a", f), qualified("b", f)
        return x.eqNullSafe(y) if None in kinds or family(kinds[0]) == family(kinds[1]) else x.isNull() & y.isNull()

    a, b = side(old).alias("a"), side(new).alias("b")
    joined = a.join(b, F.col(f"a.{text}") == F.col(f"b.{text}"), "full_outer")
    changed = F.array_compact(F.array(*(F.when(~same(f), F.lit(f)) for f in fields)))
    change = F.when(F.col(f"a.{there}").isNull(), "added").when(F.col(f"b.{there}").isNull(), "deleted").when(F.size(changed) > 0, "modified")
    names = F.when(change == "modified", F.array_join(changed, ","))
    return joined.select(F.coalesce(F.col(f"a.{text}"), F.col(f"b.{text}")).alias("key"), change.alias("change"), names.alias("changed")).where("change is not null")


def after(df: DataFrame, field: str, when: str) -> Column:
    """True for rows whose field is later than an ISO date or moment; one without a zone is UTC, as are times and texts without one. Numbers are milliseconds, or are compared with a number."""
    kind, c = dict(df.dtypes)[field], named(field)
    if family(kind) == "number" and re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", when):
        return c > F.lit(when).cast("decimal(38,6)" if "." in when else "bigint")
    at = iso_moment(when)
    if kind in ("timestamp_ntz", "date"):
        return c.cast("timestamp_ntz") > F.lit(at).cast("timestamp_ntz")
    if family(kind) == "number":
        return moment_of(c, kind) > F.unix_micros(F.lit(f"{at}+00:00").cast("timestamp"))
    if kind == "string":
        c = F.try_to_timestamp(F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$") & c.contains(":"), c).otherwise(F.concat(c, F.when(c.contains(":"), "Z").otherwise(" 00:00:00Z"))))
    return c > F.lit(f"{at}+00:00").cast("timestamp")


def since(df: DataFrame, field: str, moment: str, key: str, track: list[str]) -> DataFrame:
    """Rows changed after a moment, all as modified; changed lists the tracked fields that are there. A moment that is no ISO date is a ValueError."""
    present = F.array_compact(F.array(*(F.when(named(f).isNotNull(), F.lit(f)) for f in track if f in df.columns)))
    return df.where(after(df, field, moment)).select(named(key).cast("string").alias("key"), F.lit("modified").alias("change"), F.array_join(present, ",").alias("changed"))


def summary(changes: DataFrame) -> DataFrame:
    kinds = ("added", "modified", "deleted")
    return changes.agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds), F.count("*").alias("total"))


class Snapshots:
    """Immutable snapshots as Parquet folders below a root that Spark can reach, each with a row of facts about it.

    The facts (name, connector, created, records, key) are written last: a snapshot without them was never finished.
    """

    FACTS = "name string, connector string, created timestamp, records long, key string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/" + reduce(lambda a, c: a + (c if c.isalnum() and c.isascii() or c in "_-" else "_"), name, "")

    def save(self, name: str, df: DataFrame, only: request.Request | None = None, connector: str | None = None, key: str | None = None) -> None:
        """All rows, or those of a request. Fails if the snapshot exists; what a failed write left is replaced."""
        if self.exists(name):
            raise ValueError(f"the snapshot {name} exists")
        self.delete(name)
        (request.run(df, only) if only else df).write.parquet(f"{self._path(name)}/rows")
        facts = self.load_rows(name).agg(F.count("*").alias("records")).select(F.lit(name).alias("name"), F.lit(connector).cast("string").alias("connector"), F.current_timestamp().alias("created"), "records", F.lit(key).cast("string").alias("key"))
        facts.coalesce(1).write.json(f"{self._path(name)}/facts")

    def load_rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._path(name)}/rows")

    def load(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise ValueError(f"no snapshot {name}")
        return self.load_rows(name)

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        at, fs = self._folder(f"{self._path(name)}/facts/_SUCCESS")
        return fs.exists(at)

    def facts(self, connector: str | None = None) -> DataFrame:
        """The facts of all finished snapshots, or of a connector's, newest first."""
        at, fs = self._folder(self.root)
        found = [f"{s.getPath()}/facts" for s in fs.listStatus(at)] if fs.exists(at) else []
        done = [f for f in found if fs.exists(self._folder(f"{f}/_SUCCESS")[0])]
        rows = self.spark.read.schema(self.FACTS).json(done) if done else self.spark.createDataFrame([], self.FACTS)
        return rows.where(F.col("connector") == connector if connector is not None else F.lit(True)).orderBy(F.desc("created"), "name")

    def names(self, connector: str | None = None) -> list[str]:
        """Finished snapshots, newest first."""
        return [r.name for r in self.facts(connector).collect()]

    def delete(self, name: str) -> bool:
        """False if there was none."""
        at, fs = self._folder(self._path(name))
        return fs.delete(at, True)


def detect(df: DataFrame, key: str, track: list[str] | None = None, field: str | None = None, moment: str | None = None, snapshots: Snapshots | None = None, name: str | None = None) -> DataFrame:
    """Changes after a moment if both field and moment are given, else against the named snapshot."""
    if field and moment:
        return since(df, field, moment, key, track if track is not None else [c for c in df.columns if c != key])
    if snapshots and name:
        return against_snapshot(snapshots.load(name), df, key, track)
    raise ValueError("give a field and a moment, or a snapshot")
