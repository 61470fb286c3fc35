"""Schema inference by majority, and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import family, named

#: Fixed patterns of the types that text can have, in the order in which they are tried.
PATTERNS = (
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("datetime", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"),
    ("integer", r"^-?\d+$"),
    ("number", r"^-?\d+\.?\d*$"),
)


def value_type(c: Column) -> Column:
    out = F.lit("string")
    for name, pattern in reversed(PATTERNS):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def typed(c: Column, kind: str) -> Column:
    """The type of a value of a Spark type: the patterns are for text only, and a whole number of any type is an integer."""
    if kind == "string":
        return value_type(c)
    if kind.startswith(("double", "float", "decimal")):
        return F.when(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), "number").when(c == F.rint(c.cast("double")), "integer").otherwise("number")
    names = (("boolean", "boolean"), ("timestamp", "datetime"), ("date", "datetime"), ("array", "array"), ("struct", "object"), ("map", "object"))
    return F.lit(next((name for start, name in names if kind.startswith(start)), "integer" if family(kind) == "number" else "string"))


def infer(df: DataFrame, order: list[str]) -> DataFrame:
    """field, type, required, n_values: the most frequent type of the values that are not null or empty text; ties go to the type seen first.

    One pass: each row's fields are laid out as (field, type) and counted.
    """
    empty = lambda c, k: F.col(c).isNull() | (F.col(c) == "") if k == "string" else F.col(c).isNull()
    found = F.array(*(F.struct(F.lit(c).alias("field"), F.when(~empty(f"`{c}`", k), typed(named(c), k)).alias("type")) for c, k in df.dtypes))
    turn = F.struct(*(named(c) for c in order))
    cells = df.select(turn.alias("turn"), F.inline(found)).where("type is not null")
    counts = cells.groupBy("field", "type").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), "first"))
    total = F.sum("n").over(Window.partitionBy("field"))
    rows = df.agg(F.count("*").alias("rows"))
    best = counts.withColumns({"rank": rank, "n_values": total}).where("rank = 1")
    return best.crossJoin(F.broadcast(rows)).select("field", "type", (F.col("n_values") == F.col("rows")).alias("required"), "n_values")


def validate(df: DataFrame, required: list[str]) -> DataFrame:
    """df with errors (names of required fields that are null or empty, comma-joined) and valid."""
    missing = F.array_compact(F.array(*(F.when(named(c).isNull() | (named(c).cast("string") == ""), F.lit(c)) for c in required)))
    return df.withColumns({"errors": F.array_join(missing, ","), "valid": F.size(missing) == 0})


def summary(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count("*").alias("total"), F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))


def unknown_fields(columns: list[str], known: list[str]) -> list[str]:
    return [c for c in columns if c not in known]


def gate(df: DataFrame, required: list[str]) -> DataFrame:
    """df if all its rows are valid; else an error that names up to 20 of the faults."""
    checked = validate(df, required)
    bad = checked.where(~F.col("valid")).select("errors").limit(20).collect()
    if bad:
        raise ValueError("invalid records: " + "; ".join(r[0] for r in bad))
    return df
