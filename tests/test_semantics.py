"""Behaviour that the queries over the test tables do not show."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallymark.functions import similarity as sim
from tallymark.functions.values import as_text, redacted
from tallymark.operators import changes, govern, matching, validate
from tallymark.operators.compare import FieldPair, compare, last_of_each
from tallymark.operators.matching import Rule
from tallymark.operators.request import Request, run
from tallymark.sources import files
from tallymark.streaming.audit import operation_counts


def test_the_last_of_equal_target_keys_counts(spark):
    s = spark.createDataFrame([(1, "b"), (2, "x")], "id long, v string")
    t = spark.createDataFrame([(1, "a"), (2, "x"), (1, "b")], "id long, v string").coalesce(1)
    assert sorted((r.key, r.status) for r in compare(s, t, [("id", "id")], [FieldPair("v", "v")]).rows.collect()) == [("1", "match"), ("2", "match")]
    assert sorted((r.key, r.change) for r in changes.against_snapshot(t, s, "id").collect()) == []


def test_composite_keys_keep_parts_apart(spark):
    s = spark.createDataFrame([("a|b", "c"), ("x", None), ("x", "")], "p string, q string")
    t = spark.createDataFrame([("a", "b|c"), ("x", "")], "p string, q string")
    found = {r.key: r.status for r in compare(s, t, [("p", "p"), ("q", "q")], []).rows.collect()}
    assert found == {"a\\|b|c": "source_only", "a|b\\|c": "target_only", "x|\\N": "source_only", "x|": "match"}


def test_decimals_are_exact_and_helper_names_are_free(spark):
    df = spark.sql("select * from values (12345678901234567891bd, 1.500bd, 0.00bd) t(a, b, c)")
    kinds = dict(df.dtypes)
    assert tuple(df.select(*(as_text(F.col(c), kinds[c]) for c in "abc")).first()) == ("12345678901234567891", "1.5", "0")
    df = spark.createDataFrame([(1, 5, "k", 7)], "key0 long, turn long, in_source string, block long")
    assert last_of_each(df, ["key0"]).collect() == df.collect()
    assert compare(df, df, [("key0", "key0")], [FieldPair("turn", "turn"), FieldPair("in_source", "in_source")]).rows.first().status == "match"


def test_dates_that_are_none_fail_their_pair_only(spark):
    s = spark.createDataFrame([("a", "2024-01-01"), ("b", "soon"), ("c", None)], "id string, d string")
    t = spark.createDataFrame([("a", 1704067200000), ("b", 1704067200000), ("c", 0)], "id string, d long")
    rules = [Rule("id", "id", "id", "equals", 50, True), Rule("d", "d", "d", "date_range", 50, options={"days": 1})]
    assert {r.s_id: r.confidence for r in matching.scored(s, t, rules, 0).collect()} == {"a": 100, "b": 50, "c": 50}
    u = t.select("id", F.lit("2024-01-01 05:00:00").alias("d"))
    assert {r.key: r.status for r in compare(s, u, [("id", "id")], [FieldPair("d", "d", "dateOnly")]).rows.collect()} == {"a": "match", "b": "difference", "c": "difference"}


def test_german_names(spark):
    df = spark.createDataFrame([("Müller", "Mueller"), ("Meier", "Mayer"), ("Schmidt", "Schmied"), ("Müller", "Möbel")], "a string, b string")
    got = df.select(sim.cologne_similarity(F.col("a"), F.col("b")).alias("s"), sim.sounds_alike(F.col("a"), F.col("b")).alias("m")).collect()
    assert [(round(r.s, 4), r.m) for r in got] == [(1, True), (1, True), (1, True), (round((0.6 + 0.4) / 3, 4), False)]
    assert spark.range(1).select(sim.spellings(F.lit("Schmidt"))).first()[0] == ["schmidt", "schmitt", "schmid"]
    assert spark.range(1).select(sim.spellings(F.lit("Bäumer"))).first()[0] == ["bäumer", "baeumer"]
    s, t = df.select("a"), df.select("b")
    rule = Rule("n", "a", "b", "similarity", 100, True, {"algorithm": "cologne_phonetic", "threshold": 1})
    assert matching.scored(s, t, [rule], 0).count() == 4
    with pytest.raises(ValueError):
        Rule("n", "a", "b", "similarity", 100, True, {"algorithm": "none"})


def test_blocks_meet_across_types(spark):
    s, t = spark.createDataFrame([(1, "a")], "k long, x string"), spark.createDataFrame([(1.0, "a"), (2.0, "b")], "k double, x string")
    assert matching.candidates(s, t, [Rule("x", "x", "x", "contains")], ("k", "k", "exact")).count() == 1


def test_redaction_of_records(spark):
    df = spark.createDataFrame([("Bearer abcdefgh9", "http://me:pw@h/x", {"Password": "p", "note": "Bearer short"}, ("k", "plain"))], "a string, uri string, m map<string,string>, s struct<apiKey:string,b:string>")
    r = redacted(df).first()
    assert (r.a, r.uri, r.m, r.s.apiKey, r.s.b) == ("Bearer [REDACTED]", "[REDACTED]", {"Password": "[REDACTED]", "note": "Bearer short"}, "[REDACTED]", "plain")


def test_names_with_dots_and_unknown_order(spark):
    df = spark.createDataFrame([("=1", 2)], "`a.b` string, n long")
    assert govern.guard_formulas(df).first()[0] == "'=1" and govern.mask(df, ["A.B"]).first()[0] == "[REDACTED]"
    assert [f.type for f in validate.infer(df, ["n"]).orderBy("field").collect()] == ["string", "integer"]
    assert run(df, Request(order_by=[("zz", "asc")])).count() == 1


def test_snapshots_are_listed_and_deleted(spark, tmp_path):
    store = changes.Snapshots(spark, str(tmp_path / "s"))
    assert store.names() == [] and not store.exists("b")
    for name in ("b", "a"):
        store.save(name, spark.range(2))
    assert store.names() == ["a", "b"] and store.delete("b") and store.names() == ["a"] and not store.exists("b")


def test_json_under_a_path(spark, tmp_path):
    files.write_json(spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string"), str(tmp_path / "j"), "data.items")
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "j")).select(F.explode("data.items").alias("r")).select("r.*").collect()) == [1, 2]
    with pytest.raises(ValueError):
        files.write_json(spark.range(1), str(tmp_path / "k"), "a.__proto__")


def test_reports(spark):
    s, t = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(2,), (9,)], "id long")
    matches = spark.createDataFrame([(2, 2, 80.0)], "s long, t long, confidence double")
    assert tuple(matching.summary(s, "id", t, "id", matches, ("s", "t")).first()) == (1, 2, 1, 33.33, 80.0)


def test_streamed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"ts": f"2024-01-01T0{h}:10:00", "operation": "create"} for h in (1, 1, 2, 5)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("ts timestamp, operation string").json(str(tmp_path / "in"))
    query = operation_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.window_start, r.n) for r in spark.table("counts").collect()) == [(datetime(2024, 1, 1, 1), 2), (datetime(2024, 1, 1, 2), 1), (datetime(2024, 1, 1, 5), 1)]
