"""Requests, validation, audit, governance and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import money, redacted
from ..operators import audit, govern, request, validate
from ..operators.request import Request
from ..sources import files
from ..streaming.audit import operation_counts

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _request(name: str, source: str, req: Request, sql: str) -> None:
    query(name, sql)(lambda spark, d: request.run(table(spark, d, source), req))


O = ["o_orderkey", "o_orderstatus", "o_totalprice"]
_o = "select o_orderkey, o_orderstatus, o_totalprice from orders where "
_request("f_eq", "orders", Request([("o_orderstatus", "eq", "F")], O), _o + "o_orderstatus = 'F'")
_request("f_eq_other_type", "orders", Request([("o_orderkey", "eq", "1")], O), _o + "false")
_request("f_neq", "orders", Request([("o_orderstatus", "neq", "F")], O), _o + "o_orderstatus is distinct from 'F'")
_request("f_gt", "orders", Request([("o_totalprice", "gt", 200000)], O), _o + "o_totalprice > 200000")
_request("f_lt", "orders", Request([("o_totalprice", "lt", 50000)], O), _o + "o_totalprice < 50000")
_request("f_gte", "orders", Request([("o_orderkey", "gte", 5000)], O), _o + "o_orderkey >= 5000")
_request("f_lte", "orders", Request([("o_orderkey", "lte", 500)], O), _o + "o_orderkey <= 500")
_request("f_lexical_gt", "orders", Request([("o_orderkey", "gt", "9")], O), _o + "o_orderkey::varchar > '9'")
_request("f_contains", "customer", Request([("c_name", "contains", "MER#0000000")], ["c_custkey", "c_name"]), "select c_custkey, c_name from customer where contains(lower(c_name), 'mer#0000000')")
_request("f_in", "customer", Request([("c_mktsegment", "in", ["BUILDING", "MACHINERY", 3])], ["c_custkey"]), "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
_request("f_and", "orders", Request([("o_orderstatus", "eq", "O"), ("o_totalprice", "gt", 100000), ("o_orderkey", "lt", 9000)], O), _o + "o_orderstatus = 'O' and o_totalprice > 100000 and o_orderkey < 9000")
_request("f_select", "part", Request([], ["p_partkey", "no_such_field", "p_brand"]), "select p_partkey, p_brand from part")
_request("f_order_multi", "customer", Request([], ["c_custkey"], [("c_mktsegment", "asc"), ("c_acctbal", "desc"), ("c_custkey", "asc")], None, 50), "select c_custkey from customer order by c_mktsegment, c_acctbal desc, c_custkey limit 50")
_request("f_offset_limit", "orders", Request([], O, [("o_orderkey", "asc")], 100, 25), "select o_orderkey, o_orderstatus, o_totalprice from orders order by o_orderkey limit 25 offset 100")
query("f_count", "select count(*) as total, count(*) > 30 as has_more from orders where o_orderstatus = 'F'")(
    lambda spark, d: request.total(table(spark, d, "orders"), Request([("o_orderstatus", "eq", "F")], offset=10, limit=20))
)

_TEXTS = "select event_id::varchar event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ts, event_type, case when event_id % 5 = 0 then null else value::decimal(18,2)::varchar end as amount from events"


def _event_texts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    amount = F.when(F.col("event_id") % 5 != 0, F.col("value").cast("decimal(18,2)").cast("string"))
    return e.select(F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type", amount.alias("amount"))


@query("v_infer_types", f"""
with e as ({_TEXTS}),
c as (select 'event_id' field, event_id v from e union all select 'ts', ts from e union all select 'event_type', event_type from e union all select 'amount', amount from e),
t as (select field, case when regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then 'date' when regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}') then 'datetime'
  when regexp_matches(v, '^-?\\d+$') then 'integer' when regexp_matches(v, '^-?\\d+\\.?\\d*$') then 'number' else 'string' end as type from c where v is not null and v <> ''),
n as (select field, type, count(*) n from t group by all)
select field, arg_max(type, n) as type, sum(n) = (select count(*) from e) as required, sum(n)::bigint as n_values from n group by field""")
def v_infer_types(spark, d):
    return validate.infer(_event_texts(spark, d), ["event_id"])


@query("v_validate", f"select event_id, case when amount is null then 'amount' else '' end as errors, amount is not null as valid from ({_TEXTS})")
def v_validate(spark, d):
    return validate.validate(_event_texts(spark, d), ["event_id", "amount"]).select("event_id", "errors", "valid")


@query("v_validate_summary", f"select count(*) as total, count(amount) as n_valid, count(*) - count(amount) as n_invalid from ({_TEXTS})")
def v_validate_summary(spark, d):
    return validate.summary(validate.validate(_event_texts(spark, d), ["event_id", "amount"]))


_LOG = """select event_id as id, ts, 'events' as connector, case event_type when 'signup' then 'create' when 'error' then 'delete' else 'update' end as operation,
  user_id::varchar as record_key, 'u' || (user_id % 5)::varchar as "user" from events"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    operation = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), "ts", F.lit("events").alias("connector"), operation.alias("operation"),
        F.col("user_id").cast("string").alias("record_key"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("user"),
    )


query("u_query", f"select id, operation, record_key from ({_LOG}) where operation in ('create', 'delete') order by ts desc, id limit 100")(
    lambda spark, d: audit.page(audit.matching(_log(spark, d), operations=["create", "delete"])).select("id", "operation", "record_key")
)
query("u_by_user", f"""select id, operation from ({_LOG}) where "user" = 'u3'""")(lambda spark, d: audit.matching(_log(spark, d), user="u3").select("id", "operation"))
query("u_by_key", f"select id, operation from ({_LOG}) where record_key = '7'")(lambda spark, d: audit.matching(_log(spark, d), key="7").select("id", "operation"))
query("u_range", f"select id from ({_LOG}) where ts between '2024-01-05' and '2024-01-12 12:00:00'")(lambda spark, d: audit.matching(_log(spark, d), "2024-01-05 00:00:00", "2024-01-12 12:00:00").select("id"))
query("u_summary", f"select count(*) filter (operation = 'create') as n_create, count(*) filter (operation = 'update') as n_update, count(*) filter (operation = 'delete') as n_delete, count(*) as total from ({_LOG}) where ts >= '2024-01-10'")(
    lambda spark, d: audit.summary(audit.matching(_log(spark, d), "2024-01-10 00:00:00"))
)
query("u_retention", f"select id from ({_LOG}) where ts::date >= '2024-01-20'")(lambda spark, d: audit.retained(_log(spark, d), "2024-01-20").select("id"))
query("u_connectors", "select event_type as connector, count(*) as n from events group by event_type")(lambda spark, d: audit.by_connector(table(spark, d, "events").withColumnRenamed("event_type", "connector")))
query("u_windows", f"select time_bucket(interval '1 hour', ts) as window_start, operation, count(*) as n from ({_LOG}) group by all")(
    lambda spark, d: operation_counts(_log(spark, d)).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "operation", "n")
)


@query("w_hash_chain", f"""select record_key, count(*) as n, list_reduce(list_prepend('', list(operation order by id)), lambda a, b: sha256(a || chr(10) || b)) as head from ({_LOG}) group by record_key""")
def w_hash_chain(spark, d):
    chained = audit.linked(_log(spark, d), "record_key", "id", "operation")
    return chained.groupBy("record_key").agg(F.count("*").alias("n"), F.max_by("hash", "id").alias("head"))


@query("w_chain_breaks", f"select id, record_key from (select *, row_number() over (partition by record_key order by id) as k from ({_LOG})) where k = 2")
def w_chain_breaks(spark, d):
    chained = audit.linked(_log(spark, d), "record_key", "id", "operation")
    from pyspark.sql import Window

    second = F.row_number().over(Window.partitionBy("record_key").orderBy("id")) == 2
    tampered = chained.withColumn("bad", second).withColumn("operation", F.when(F.col("bad"), "forged").otherwise(F.col("operation"))).drop("bad")
    return audit.breaks(tampered, "record_key", "id", "operation").select("id", "record_key")


_DIGEST = "count(*)::varchar || ':' || list_reduce(list_prepend('', list(operation order by id)), lambda a, b: sha256(a || chr(10) || b))"


@query("w_segment_heads", f"""select record_key, count(*) as n, list_reduce(list_prepend('', list(digest order by day)), lambda a, b: sha256(a || chr(10) || b)) as head
from (select record_key, ts::date as day, {_DIGEST} as digest from ({_LOG}) group by all) group by record_key""")
def w_segment_heads(spark, d):
    log = _log(spark, d).withColumn("day", F.to_date("ts"))
    heads = audit.heads(audit.segmented(log, "record_key", "day", "id", "operation"), "record_key", "day", "id")
    return heads.groupBy("record_key").agg(F.count("*").alias("n"), F.max_by("hash", "day").alias("head"))


query("g_mask", "select c_custkey, '[REDACTED]' as c_name, c_nationkey, '[REDACTED]' as c_acctbal, c_mktsegment from customer")(lambda spark, d: govern.mask(table(spark, d, "customer"), [" C_Name", "c_acctbal"]))


@query("g_csv_guard", """select c_custkey, case when regexp_matches(t, '^[\\t\\r\\n ]*[=+@-]') then '''' || t else t end as t from
 (select c_custkey, case c_custkey % 5 when 0 then '=' when 1 then ' @' when 2 then '-' when 3 then '''=' else 'a=' end || c_name as t from customer)""")
def g_csv_guard(spark, d):
    lead = F.element_at(F.array(*(F.lit(x) for x in ("=", " @", "-", "'=", "a="))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return govern.guard_formulas(table(spark, d, "customer").select("c_custkey", F.concat(lead, "c_name").alias("t")))


@query("n_redact", """select event_id, case event_id % 6 when 0 then case when length('abc.' || event_id::varchar) >= 8 then 'Bearer [REDACTED]' else 'Bearer abc.' || event_id::varchar end
  when 1 then 'http://u:[REDACTED]@host/x' when 2 then 'see Bearer [REDACTED], ok' when 3 then 'bearer abcdefghij' when 4 then 'http://user@host' else props end as t,
 case event_id % 3 when 0 then '[REDACTED]' when 1 then 'x' end as password_value, '[REDACTED]' as "accessToken" from events""")
def n_redact(spark, d):
    i = F.col("event_id").cast("string")
    texts = F.array(F.concat(F.lit("Bearer abc."), i), F.concat(F.lit("http://u:p"), i, F.lit("@host/x")), F.lit("see Bearer abcdefgh.x-1, ok"), F.lit("bearer abcdefghij"), F.lit("http://user@host"), F.col("props"))
    k = F.col("event_id") % 3
    secrets = F.when(k == 0, F.create_map(F.lit("Password"), i)).when(k == 1, F.create_map(F.lit("plain"), F.lit("x")))
    e = table(spark, d, "events").select("event_id", F.element_at(texts, (F.col("event_id") % 6 + 1).cast("int")).alias("t"), F.struct(secrets.alias("inside")).alias("s"), F.lit("v").alias("accessToken"))
    return redacted(e).select("event_id", "t", F.map_values("s.inside")[0].alias("password_value"), "accessToken")


query("g_metrics", "select event_type, count(*) as calls, floor(sum(value) * 100 + 0.5) / 100 as seconds from events group by event_type")(
    lambda spark, d: table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), (F.floor(F.sum("value") * 100 + 0.5) / 100).alias("seconds"))
)


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey % 10 = 0")
    key = F.when(F.col("o_orderkey") % 20 == 0, F.col("o_orderkey") + 10_000_000).otherwise(F.col("o_orderkey"))
    return o.select(key.alias("o_orderkey"), F.lit("U").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 30 != 0, F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("turn"))


_IN = "select case when o_orderkey % 20 = 0 then o_orderkey + 10000000 else o_orderkey end as o_orderkey, 'U' as o_orderstatus, case when o_orderkey % 30 <> 0 then o_totalprice + 1 end as o_totalprice from orders where o_orderkey % 10 = 0"
_MERGED = f"select t.o_orderkey, coalesce(n.o_orderstatus, t.o_orderstatus) as o_orderstatus, coalesce(n.o_totalprice, t.o_totalprice) as o_totalprice from orders t left join ({_IN}) n using (o_orderkey)"
query("w_insert", f"select o_orderkey, o_orderstatus, o_totalprice from orders union all {_IN}")(lambda spark, d: files.inserted(table(spark, d, "orders").select(*O), _incoming(spark, d).drop("turn")))
query("w_update", _MERGED)(lambda spark, d: files.updated(table(spark, d, "orders").select(*O), _incoming(spark, d), "o_orderkey", "turn")[0])
query("w_update_errors", f"select o_orderkey from ({_IN}) where o_orderkey >= 10000000")(lambda spark, d: files.updated(table(spark, d, "orders").select(*O), _incoming(spark, d), "o_orderkey", "turn")[1].select("o_orderkey"))
query("w_upsert", f"{_MERGED} union all select * from ({_IN}) where o_orderkey >= 10000000")(lambda spark, d: files.upserted(table(spark, d, "orders").select(*O), _incoming(spark, d), "o_orderkey", "turn"))


def _money_parsed(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    thousands = F.concat(F.floor(i / 1000).cast("string"), F.lit("."), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit(",50"))
    t = F.when(i % 3 == 0, F.concat(F.lit("EUR "), i.cast("string"), F.lit(",50"))).when(i % 3 == 1, thousands).otherwise(F.concat(i.cast("string"), F.lit(".25 USD")))
    return table(spark, d, "orders").select("o_orderkey", money(t).alias("amount"))


query("r_money_parse", "select o_orderkey, case o_orderkey % 3 when 0 then o_orderkey + 0.5 when 1 then o_orderkey / 1000.0::double else o_orderkey + 0.25 end::double as amount from orders")(_money_parsed)


@query("v_infer_typed", """select * from (values ('event_id', 'integer'), ('ts', 'datetime'), ('flag', 'boolean'), ('whole', 'integer'), ('large', 'integer'), ('value', 'number'), ('list', 'array'), ('dot', 'number')) t(field, type)""")
def v_infer_typed(spark, d):
    e = table(spark, d, "events")
    made = e.select("event_id", "ts", (F.col("event_id") % 2 == 0).alias("flag"), F.floor("value").cast("double").alias("whole"), F.lit(1e20).alias("large"), (F.floor("value") + 0.5).alias("value"), F.array("user_id").alias("list"), F.concat(F.col("user_id").cast("string"), F.lit(".")).alias("dot"))
    return validate.infer(made, ["event_id"]).select("field", "type")
