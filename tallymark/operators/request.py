"""The request language: where, order, page, project."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import as_text, family, free_name, named

OPERATORS = ("eq", "neq", "gt", "lt", "gte", "lte", "contains", "in")
#: Names that no field may have.
UNSAFE = ("__proto__", "prototype", "constructor")


@dataclass
class Request:
    where: list[tuple[str, str, object]] = field(default_factory=list)
    select: list[str] | None = None
    order_by: list[tuple[str, str]] = field(default_factory=list)
    offset: int | None = None
    limit: int | None = None
    #: A collation such as UNICODE or de, by which texts are ordered; without one by code points.
    locale: str | None = None


def _value_family(v: object) -> str:
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "other"


def _equal(c: Column, kind: str, v: object) -> Column:
    if v is None:
        return c.isNull()
    return c.eqNullSafe(F.lit(v)) if _value_family(v) == family(kind) else F.lit(False)


def condition(df: DataFrame, name: str, op: str, v: object) -> Column:
    """One condition. Equality never crosses types; order compares numbers, else text forms; null fails all but neq and eq null."""
    if name in UNSAFE:
        raise ValueError(f"{name} is not a field")
    if name not in df.columns:
        return F.lit(op == "neq" and v is not None or op == "eq" and v is None)
    c, kind = named(name), dict(df.dtypes)[name]
    if op == "eq":
        return _equal(c, kind, v)
    if op == "neq":
        return ~_equal(c, kind, v)
    if op == "in":
        return reduce(lambda a, b: a | b, (_equal(c, kind, x) for x in v), F.lit(False)) if isinstance(v, (list, tuple)) else F.lit(False)
    if op == "contains":
        return F.coalesce(F.contains(F.lower(as_text(c, kind)), F.lower(F.lit(str(v)))), F.lit(False))
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    typed = _value_family(v) == family(kind) == "number" or family(kind) == "time"
    x, y = (c, F.lit(v)) if typed else (as_text(c, kind), F.lit(str(v)))
    return F.coalesce({"gt": x > y, "lt": x < y, "gte": x >= y, "lte": x <= y}[op], F.lit(False))


def matching(df: DataFrame, where: list[tuple[str, str, object]]) -> DataFrame:
    """Rows that meet all conditions."""
    return df.where(reduce(lambda a, b: a & b, (condition(df, *w) for w in where), F.lit(True)))


def run(df: DataFrame, request: Request) -> DataFrame:
    """where, then order, then page, then project, so that order may use a field that is not selected.

    Rows that order alike stay as the table is read, so pages of one request neither overlap nor leave a gap.
    """
    out = matching(df, request.where)
    if request.order_by:
        kinds = dict(df.dtypes)
        keys = []
        for name, way in request.order_by:
            if name not in kinds:
                continue  # no row has the field, so it orders nothing
            c = F.coalesce(named(name), F.lit("")) if kinds[name] == "string" else named(name)
            c = F.collate(c, request.locale) if request.locale and kinds[name] == "string" else c
            keys.append(c.desc() if way == "desc" else c.asc())
        turn = free_name("turn", out)
        out = out.withColumn(turn, F.monotonically_increasing_id()).orderBy(*keys, turn).drop(turn) if keys else out
    if request.offset:
        out = out.offset(request.offset)
    if request.limit is not None:
        out = out.limit(request.limit)
    return out.select(*(named(c) for c in request.select if c in df.columns)) if request.select is not None else out


def total(df: DataFrame, request: Request) -> DataFrame:
    """One row: how many rows match, and whether more follow the page."""
    end = (request.offset or 0) + (request.limit or 0)
    more = F.count("*") > end if request.limit is not None else F.lit(False)
    return matching(df, request.where).agg(F.count("*").alias("total"), more.alias("has_more"))
