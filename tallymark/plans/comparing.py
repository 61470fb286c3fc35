"""Comparison and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, govern
from ..operators.compare import FieldPair, compare, last_of_each, mapped
from .reading import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None, f) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


#: The changed copy of customer: 10 % dropped, some added, names, balances and segments altered.
_TARGET = """
select c_custkey, case when c_custkey % 7 = 0 then upper(c_name) else c_name end as c_name,
  case when c_custkey % 13 = 0 then c_acctbal + 1 when c_custkey % 11 = 0 then c_acctbal + 0.0005::double else c_acctbal end as c_acctbal,
  case when c_custkey % 17 = 0 then null when c_custkey % 19 = 0 then '  ' || c_mktsegment || ' ' else c_mktsegment end as c_mktsegment
from customer where c_custkey % 10 <> 0
union all select c_custkey + 1000000, c_name, c_acctbal, c_mktsegment from customer where c_custkey % 25 = 0"""


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _target(spark: SparkSession, d: str) -> DataFrame:
    c, k = _customers(spark, d), F.col("c_custkey")
    changed = c.where(k % 10 != 0).select(
        "c_custkey", F.when(k % 7 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 13 == 0, F.col("c_acctbal") + 1).when(k % 11 == 0, F.col("c_acctbal") + 0.0005).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 17 == 0, None).when(k % 19 == 0, F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return changed.unionByName(c.where(k % 25 == 0).withColumn("c_custkey", k + 1_000_000))


def _compared(fields: list[FieldPair]):
    return lambda spark, d: compare(_customers(spark, d), _target(spark, d), [("c_custkey", "c_custkey")], fields)


def _status_sql(tests: dict[str, str]) -> str:
    n = " + ".join(f"case when {t} then 0 else 1 end" for t in tests.values()) or "0"
    return f"""with t as ({_TARGET}), j as (select coalesce(s.c_custkey, t.c_custkey)::varchar as key, s.c_custkey as sk, t.c_custkey as tk, {n} as n
 from customer s full join t on s.c_custkey = t.c_custkey)
 select key, case when tk is null then 'source_only' when sk is null then 'target_only' when n = 0 then 'match' else 'difference' end as status,
 (case when tk is null or sk is null then 0 else n end)::int as n_differences from j"""


_EXACT = {"c_name": "s.c_name is not distinct from t.c_name", "c_acctbal": "s.c_acctbal is not distinct from t.c_acctbal", "c_mktsegment": "s.c_mktsegment is not distinct from t.c_mktsegment"}
_FIELDS = [FieldPair(c, c) for c in _EXACT]
_STATUS = _status_sql(_EXACT)
_DIFFS = f"with t as ({_TARGET}) " + " union all ".join(
    f"select s.c_custkey::varchar as key, '{c}' as field, case when s.{c} is null then 'missing_in_source' when t.{c} is null then 'missing_in_target' else 'value_mismatch' end as difference from customer s join t on s.c_custkey = t.c_custkey where not ({t})"
    for c, t in _EXACT.items()
)
query("c_status", _STATUS, lambda spark, d: _compared(_FIELDS)(spark, d).rows)
query("c_source_only", f"select key from ({_STATUS}) where status = 'source_only'", lambda spark, d: _compared(_FIELDS)(spark, d).rows.where("status = 'source_only'").select("key"))
query("c_target_only", f"select key from ({_STATUS}) where status = 'target_only'", lambda spark, d: _compared(_FIELDS)(spark, d).rows.where("status = 'target_only'").select("key"))
query(
    "c_summary",
    f"""select count(*) filter (status <> 'target_only') as source_records, count(*) filter (status = 'match') as matched, count(*) filter (status = 'difference') as different,
 count(*) filter (status = 'source_only') as source_only, count(*) filter (status = 'target_only') as target_only,
 floor(count(*) filter (status = 'match') * 100.0::double / count(*) filter (status <> 'target_only') * 100 + 0.5) / 100 as rate from ({_STATUS})""",
    lambda spark, d: _compared(_FIELDS)(spark, d).summary(),
)
query("c_diffs", _DIFFS, lambda spark, d: _compared(_FIELDS)(spark, d).differences.select("key", "field", "difference"))
query("c_diff_by_field", f"select field, count(*) as n from ({_DIFFS}) group by field", lambda spark, d: _compared(_FIELDS)(spark, d).by_field())
query("c_top_fields", f"select field, count(*) as n from ({_DIFFS}) group by field order by n desc, field limit 2", lambda spark, d: _compared(_FIELDS)(spark, d).top_fields(2))
for _name, _pair, _test in (
    ("c_cmp_case", FieldPair("c_name", "c_name", "caseInsensitive"), "lower(s.c_name) = lower(t.c_name)"),
    ("c_cmp_tol", FieldPair("c_acctbal", "c_acctbal", "numericTolerance"), "abs(s.c_acctbal - t.c_acctbal) < 0.001"),
    ("c_cmp_trim", FieldPair("c_mktsegment", "c_mktsegment", "trimmedString"), "coalesce(trim(s.c_mktsegment) = trim(t.c_mktsegment), false)"),
    ("c_tr_lower", FieldPair("c_name", "c_name", transform="lowercase"), "lower(s.c_name) = t.c_name"),
    ("c_tr_upper", FieldPair("c_name", "c_name", transform="uppercase"), "upper(s.c_name) = t.c_name"),
    ("c_tr_ws", FieldPair("c_mktsegment", "c_mktsegment", transform="normalizeWhitespace"), "coalesce(s.c_mktsegment = t.c_mktsegment, false)"),
    ("c_type_mismatch", FieldPair("c_name", "c_acctbal"), "false"),
):
    query(_name, _status_sql({"x": _test}), lambda spark, d, p=_pair: _compared([p])(spark, d).rows)
query("c_cmp_dateonly", """select o_orderkey::varchar as key, case when o_orderkey % 3 = 0 then 'difference' else 'match' end as status, (case when o_orderkey % 3 = 0 then 1 else 0 end)::int as n_differences from orders""",
      lambda spark, d: (lambda o: compare(o, o.withColumn("o_orderdate", F.date_trunc("day", "o_orderdate") + F.when(F.col("o_orderkey") % 3 == 0, F.expr("interval 25 hours")).otherwise(F.expr("interval 23 hours"))), [("o_orderkey", "o_orderkey")], [FieldPair("o_orderdate", "o_orderdate", "dateOnly")]).rows)(table(spark, d, "orders").select("o_orderkey", "o_orderdate")))
query("c_map_fields", "select c_custkey as id, upper(c_name) as name, c_acctbal from customer", lambda spark, d: mapped(_customers(spark, d).drop("c_mktsegment"), [FieldPair("c_custkey", "id"), FieldPair("c_name", "name", transform="uppercase")]))
_LAST = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc, l_shipdate desc, l_extendedprice desc) as k from lineitem) where k = 1"
_LINE_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
query("c_dup_last_wins", _LAST, lambda spark, d: last_of_each(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
query(
    "c_composite_key",
    f"""with t as ({_LAST}), j as (select s.l_orderkey::varchar || '|' || s.l_linenumber::varchar as key, s.l_partkey = t.l_partkey and s.l_suppkey = t.l_suppkey as same from lineitem s join t on s.l_orderkey = t.l_orderkey and s.l_linenumber = t.l_linenumber)
 select key, case when same then 'match' else 'difference' end as status, count(*) as n from j group by all""",
    lambda spark, d: compare(
        table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_LINE_ORDER),
        [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")], [FieldPair("l_partkey", "l_partkey"), FieldPair("l_suppkey", "l_suppkey")], _LINE_ORDER,
    ).rows.groupBy("key", "status").agg(F.count("*").alias("n")),
)
query("g_mask_diffs", f"select key, field, case when field = 'c_name' then '[REDACTED]' else null end as source_value from ({_DIFFS}) where field = 'c_name'",
      lambda spark, d: govern.mask_differences(_compared(_FIELDS)(spark, d).differences, ["C_NAME"]).where("field = 'c_name'").select("key", "field", "source_value"))

_OLD = """select o_orderkey, case when o_orderkey % 8 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice from orders where o_orderkey % 9 <> 0
 union all select o_orderkey + 10000000, o_orderstatus, o_totalprice from orders where o_orderkey % 50 = 0"""


def _old_orders(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    changed = o.where(k % 9 != 0).withColumn("o_orderstatus", F.when(k % 8 == 0, "X").otherwise(F.col("o_orderstatus")))
    return changed.unionByName(o.where(k % 50 == 0).withColumn("o_orderkey", k + 10_000_000))


def _changes(track):
    return lambda spark, d: changes.against_snapshot(_old_orders(spark, d), table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", track)


_SNAP = f"""with a as ({_OLD}) select coalesce(a.o_orderkey, b.o_orderkey)::varchar as key,
 case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'deleted' else 'modified' end as change,
 case when a.o_orderkey is not null and b.o_orderkey is not null then 'o_orderstatus' end as changed
 from a full join orders b on a.o_orderkey = b.o_orderkey
 where a.o_orderkey is null or b.o_orderkey is null or a.o_orderstatus is distinct from b.o_orderstatus"""
query("h_snap_changes", _SNAP, _changes(None))
query("h_track_fields", f"select * from ({_SNAP}) where change <> 'modified'", _changes(["o_totalprice"]))
query("h_changed_fields", f"select changed, count(*) as n from ({_SNAP}) where change = 'modified' group by changed", lambda spark, d: _changes(None)(spark, d).where("change = 'modified'").groupBy("changed").agg(F.count("*").alias("n")))
query("h_snap_summary", f"select count(*) filter (change = 'added') as added, count(*) filter (change = 'modified') as modified, count(*) filter (change = 'deleted') as deleted, count(*) as total from ({_SNAP})", lambda spark, d: changes.summary(_changes(None)(spark, d)))
_SINCE = "select event_id::varchar as key, 'modified' as change, 'value,props' as changed from events where ts > '2024-01-15'"
query("h_ts", _SINCE, lambda spark, d: changes.since(table(spark, d, "events"), "ts", "2024-01-15 00:00:00", "event_id", ["value", "props"]))
query("h_ts_summary", f"select 0::bigint as added, count(*) as modified, 0::bigint as deleted, count(*) as total from ({_SINCE})", lambda spark, d: changes.summary(changes.since(table(spark, d, "events"), "ts", "2024-01-15 00:00:00", "event_id", ["value", "props"])))


def _decimal_keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Keys beyond what a double holds, and the same table with every third one moved by one."""
    key = (F.lit("12345678901234567890").cast("decimal(20,0)") + F.col("o_orderkey")).cast("decimal(20,0)")
    o = table(spark, d, "orders").select(key.alias("k"), "o_orderstatus", (F.col("o_orderkey") % 3 == 0).alias("moved"))
    return o.select("k", "o_orderstatus"), o.select(F.when(F.col("moved"), F.col("k") + F.lit("500000000").cast("decimal(10,0)")).otherwise(F.col("k")).cast("decimal(20,0)").alias("k"), "o_orderstatus")


query("c_decimal_key", "select case when o_orderkey % 3 = 0 then 'source_only' else 'match' end as status, count(*) as n from orders group by 1 union all select 'target_only', count(*) from orders where o_orderkey % 3 = 0",
      lambda spark, d: compare(*_decimal_keys(spark, d), [("k", "k")], [FieldPair("o_orderstatus", "o_orderstatus")]).rows.groupBy("status").agg(F.count("*").alias("n")))
query("c_dup_no_order", "select c_custkey::varchar as key, case when c_custkey % 4 = 0 then 'difference' else 'match' end as status, (case when c_custkey % 4 = 0 then 1 else 0 end)::int as n_differences from customer",
      lambda spark, d: (lambda c: compare(c, c.withColumn("c_name", F.lit("older")).coalesce(1).union(c.withColumn("c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).otherwise(F.lit("newer"))).coalesce(1)), [("c_custkey", "c_custkey")], [FieldPair("c_name", "c_name")]).rows)(table(spark, d, "customer").select("c_custkey", "c_name")))
query("c_null_key", "select case when c_custkey % 2 = 0 then 'source_only' else 'match' end as status, count(*) as n from customer group by 1 union all select 'target_only', count(*) from customer where c_custkey % 2 = 0",
      lambda spark, d: (lambda c: compare(c.withColumn("part", F.when(F.col("c_custkey") % 2 != 0, F.lit("a"))), c.withColumn("part", F.when(F.col("c_custkey") % 2 != 0, F.lit("a")).otherwise(F.lit(""))), [("c_custkey", "c_custkey"), ("part", "part")], []).rows.groupBy("status").agg(F.count("*").alias("n")))(table(spark, d, "customer").select("c_custkey")))
