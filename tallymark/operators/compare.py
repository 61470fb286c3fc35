"""Keyed comparison of two tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import TRANSFORMS, as_number, as_text, comparable, family, free_name, named, qualified, trim

Comparator = Callable[[Column, Column], Column]

#: Comparators by name; register() adds to them. Unknown names compare exactly.
COMPARATORS: dict[str, Comparator] = {
    "caseInsensitive": lambda a, b: F.lower(a.cast("string")) == F.lower(b.cast("string")),
    "numericTolerance": lambda a, b: F.abs(as_number(a) - as_number(b)) < 0.001,
    "dateOnly": lambda a, b: F.to_date(F.try_to_timestamp(a.cast("string"))) == F.to_date(F.try_to_timestamp(b.cast("string"))),  # text that is no date equals nothing
    "trimmedString": lambda a, b: trim(a.cast("string")) == trim(b.cast("string")),
}


def register(name: str, comparator: Comparator) -> None:
    COMPARATORS[name] = comparator


@dataclass
class FieldPair:
    source: str
    target: str
    comparator: str = "exact"
    transform: str | None = None


@dataclass
class Comparison:
    """rows: key, status, differences; differences: key, field, difference, source_value, target_value."""

    rows: DataFrame
    differences: DataFrame

    def summary(self) -> DataFrame:
        count = lambda s: F.count_if(F.col("status") == s)
        both = count("match") + count("difference")
        rate = F.when(both + count("source_only") == 0, 100.0).otherwise(count("match") * 100.0 / (both + count("source_only")))
        return self.rows.agg(
            F.count_if(F.col("status") != "target_only").alias("source_records"), count("match").alias("matched"), count("difference").alias("different"),
            count("source_only").alias("source_only"), count("target_only").alias("target_only"), (F.floor(rate * 100 + 0.5) / 100).alias("rate"),
        )

    def by_field(self) -> DataFrame:
        return self.differences.groupBy("field").agg(F.count("*").alias("n"))

    def top_fields(self, n: int = 5) -> DataFrame:
        """The fields that differ most often; ties by name."""
        return self.by_field().orderBy(F.desc("n"), "field").limit(n)


def last_of_each(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The last row of each key in the given order, or in the order in which the table is read: repeated keys overwrite.

    Rows are reduced before they are shuffled.
    """
    turn = free_name("turn", df)
    if not order:
        df = df.withColumn(turn, F.monotonically_increasing_id())
    rows = F.struct(*(named(c) for c in df.columns))
    last = df.groupBy(*(named(k) for k in keys)).agg(F.max_by(rows, F.struct(*(named(c) for c in order or [turn]))).alias(turn + "_row"))
    return last.select(f"`{turn}_row`.*").drop(turn)


DIFFERENCES = "array<struct<field:string,difference:string,source_value:string,target_value:string>>"


def _field(p: FieldPair, kinds: tuple[dict, dict]) -> Column:
    """The difference of one field pair, or null."""
    ka, kb = kinds[0][p.source], kinds[1][p.target]
    a, b = comparable(qualified("s", p.source), ka), comparable(qualified("t", p.target), kb)
    x = TRANSFORMS[p.transform](a) if p.transform else a
    if p.transform:
        ka = {"parseDate": "timestamp", "parseNumber": "double"}.get(p.transform, "string")
    same_type = family(ka) == family(kb)
    test = COMPARATORS.get(p.comparator)
    equal = F.coalesce(test(x, b), F.lit(False)) if test else (F.coalesce(x == b, F.lit(False)) if same_type else F.lit(False))
    kind = (
        F.when(a.isNull() & b.isNull(), None).when(a.isNull(), "missing_in_source").when(b.isNull(), "missing_in_target")
        .when(equal, None).otherwise("value_mismatch" if same_type else "type_mismatch")
    )
    return F.when(kind.isNotNull(), F.struct(F.lit(p.source).alias("field"), kind.alias("difference"), as_text(a, kinds[0][p.source]).alias("source_value"), as_text(b, kinds[1][p.target]).alias("target_value")))


def compare(source: DataFrame, target: DataFrame, keys: list[tuple[str, str]], fields: list[FieldPair], target_order: list[str] | None = None) -> Comparison:
    """Match rows by the text of their keys and compare field pairs.

    Every source row is compared, also with a key that others have; of target rows with one key the
    last in target_order counts, without an order the last as the table is read. A single key that is null counts
    as empty; among several, null and empty differ. Reported keys join their parts with |, a null part is \\N, and a
    | or \\ within a part is escaped.
    """
    kinds = dict(source.dtypes), dict(target.dtypes)
    names = [free_name(f"key{i}", source, target) for i in range(len(keys))]
    in_s, in_t = free_name("in_source", source, target), free_name("in_target", source, target)

    def text(side: int, name: str) -> Column:
        plain = as_text(named(name), kinds[side][name])
        return F.coalesce(plain, F.lit("")) if len(keys) == 1 else F.coalesce(F.regexp_replace(plain, r"([|\\])", r"\\$1"), F.lit("\\N"))

    s = source.withColumns({n: text(0, a) for n, (a, _) in zip(names, keys)} | {in_s: F.lit(1)})
    t = last_of_each(target.withColumns({n: text(1, b) for n, (_, b) in zip(names, keys)}), names, target_order).withColumn(in_t, F.lit(1))
    joined = s.alias("s").join(t.alias("t"), [F.col(f"s.{k}") == F.col(f"t.{k}") for k in names], "full_outer")
    found = F.array_compact(F.array(*(_field(p, kinds) for p in fields))) if fields else F.from_json(F.lit("[]"), DIFFERENCES)
    status = F.when(F.col(f"t.{in_t}").isNull(), "source_only").when(F.col(f"s.{in_s}").isNull(), "target_only").when(F.size(found) == 0, "match").otherwise("difference")
    key = F.concat_ws("|", *(F.coalesce(F.col(f"s.{k}"), F.col(f"t.{k}")) for k in names))
    rows = joined.select(key.alias("key"), status.alias("status"), F.when(status == "difference", found).alias("differences"))
    differences = rows.where("status = 'difference'").select("key", F.inline("differences"))
    return Comparison(rows.select("key", "status", F.coalesce(F.size("differences"), F.lit(0)).alias("n_differences")), differences)


def mapped(df: DataFrame, pairs: list[FieldPair], strict: bool = False) -> DataFrame:
    """Fields renamed to their targets with their transforms; others stay unless strict."""
    made = {p.source: (TRANSFORMS[p.transform](named(p.source)) if p.transform else named(p.source)).alias(p.target) for p in pairs}
    return df.select(*(made.get(c, named(c)) for c in df.columns if c in made or not strict))
