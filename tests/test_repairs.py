"""Files, snapshots, moments, policies, names and numbers as the readers of dynamically typed records expect them."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions.values import as_text
from tallymark.operators import audit, changes, govern, request, validate
from tallymark.operators.compare import FieldPair, compare
from tallymark.operators.govern import Policy, PolicyRule
from tallymark.operators.request import Request
from tallymark.sources import files


def test_csv_quotes_breaks_and_names(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b.c,d\n"say ""hi"", x",2,1\n7,"x\ny",9\n, 3 ,\n')
    df = files.read_csv(spark, str(tmp_path / "q.csv"))
    assert [tuple(r) for r in df.collect()] == [('say "hi", x', "2", 1.0), ("7", "x\ny", 9.0), (None, "3", None)]
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(str, files.read_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "n.csv").write_text("1\n2,b\n3,c,d\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "n.csv"), header=False).collect()] == [(1.0, None, None), (2.0, "b", None), (3.0, "c", "d")]
    (tmp_path / "u.csv").write_text("__proto__,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "u.csv"))


def diff(old, new, **options):
    return sorted((r.key, r.change, r.changed) for r in changes.against_snapshot(old, new, "id", **options).collect())


def test_snapshots_of_other_columns(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(1, "a", "new"), (2, "b", None)], "id long, v string, w string")
    assert diff(old, new) == [("1", "modified", "w")] and diff(new, old) == [("1", "modified", "w")]
    typed = spark.createDataFrame([(1, 5)], "id long, v long")
    assert diff(old.where("id = 1"), typed) == [("1", "modified", "v")]
    maps = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "x"})], "id long, m map<string,string>")
    assert diff(maps, maps.withColumn("m", F.when(F.col("id") == 1, F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).otherwise(F.create_map(F.lit("a"), F.lit("y"))))) == [("2", "modified", "m")]


def test_moments_with_zones(spark):
    df = spark.sql("select 1 as id, timestamp_ntz'2024-01-15 17:00:00' as t union all select 2, timestamp_ntz'2024-01-15 15:00:00'")
    ids = lambda frame, when: [int(r.key) for r in changes.since(frame, "t", when, "id", ["t", "zz"]).orderBy("key").collect()]
    assert ids(df, "2024-01-15T18:00:00+02:00") == [1] and ids(df, "2024-01-15") == [1, 2] and ids(df, "2024-01-15T17:00:00Z") == []
    texts = spark.createDataFrame([(1, "2024-01-15T19:00:00+02:00"), (2, "2024-01-15"), (3, "no date"), (4, "2024-01-15 18:00:00"), (5, None)], "id long, t string")
    assert ids(texts, "2024-01-15T16:30:00Z") == [1, 4]
    assert ids(df.select("id", F.unix_millis(F.col("t").cast("timestamp")).alias("t")), "2024-01-15T16:00:00") == [1]
    with pytest.raises(ValueError):
        ids(df, "15.01.2024")


def test_policies(spark):
    p = Policy(allow_tools=["read", "write_*"], allow_connectors=["crm", "erp*"])
    assert p.decide("read", ["crm", "erp1"]) and not p.decide("read", ["crm", "hr"]) and not p.decide("drop", "crm") and p.decide("write_records", "erp2")
    assert not Policy(default=False).decide("read") and not Policy(deny_connectors=["hr"]).decide("read", "hr") and Policy(deny_tools=["hr"]).decide("read", "hr")
    rules = [
        PolicyRule(False, tool=["read"], select_any=["salary"], reason="no salaries"), PolicyRule(False, connectors_all=["a*"], roles_any=["guest"]),
        PolicyRule(True, connectors_any=["crm"], mask=["email"]), PolicyRule(False, write_mode="upsert"), PolicyRule(False, tenant=["x"], scopes_any=["s"]), PolicyRule(False, where_any=["ssn"], subject=["bob"]),
    ]
    p = Policy(rules=rules, mask=["phone"], mask_per_connector={"crm": ["Name "]}, writes=False)
    assert p.decide("read", "erp", select=["salary"]).reason == "no salaries" and p.decide("list", "erp", select=["salary"])
    assert not p.decide("read", ["a1", "a2"], roles=["guest"]) and p.decide("read", ["a1", "b"], roles=["guest"]) and p.decide("read", [], roles=["guest"])
    assert not p.decide("w", "erp", write_mode="upsert") and p.decide("w", "erp") and not p.decide("w", "erp", write=True)
    assert not p.decide("r", "erp", tenant="x", scopes=["t", "s"]) and p.decide("r", "erp", tenant="x") and not p.decide("r", where=["ssn"], subject="bob") and p.decide("r", where=["ssn"])
    df = spark.createDataFrame([("n", "e", "p", "k")], "name string, email string, phone string, kept string")
    hidden = "[REDACTED]"
    assert tuple(p.masked(df, "crm", p.decide("read", "crm")).first()) == (hidden, hidden, hidden, "k") and tuple(p.masked(df, "erp").first()) == ("n", "e", hidden, "k")


def test_snapshot_facts(spark, tmp_path):
    store = changes.Snapshots(spark, str(tmp_path))
    assert store.names() == []
    for name, connector in (("first", "crm"), ("second", "erp"), ("third", "crm")):
        store.save(name, spark.range(3), connector=connector, key="id")
    assert store.names() == ["third", "second", "first"] and store.names("crm") == ["third", "first"]
    assert [(r.records, r.key) for r in store.facts("erp").collect()] == [(3, "id")]
    spark.range(9).write.parquet(f"{tmp_path}/broken/rows")  # a save that did not end
    assert not store.exists("broken") and "broken" not in store.names()
    store.save("broken", spark.range(2))
    assert store.load("broken").count() == 2 and store.delete("first") and not store.delete("first") and store.names("crm") == ["third"]
    with pytest.raises(ValueError):
        store.load("first")


def test_retention_and_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"2024-01-{d:02d} 10:00:0{k}", c, f"{c}{d}{k}") for d in (1, 2, 3) for c in ("crm", "erp") for k in range(4)]
    log = spark.createDataFrame(rows, "t string, connector string, id string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "connector", "id")
    audit.append(log.repartition(8), path)
    held = lambda: sorted(r.id for r in audit.read(spark, path, "ts timestamp_ntz, id string").collect())
    before = held()
    (tmp_path / "log/connector=crm/date=2024-01-01/part-broken.json").write_text("no json\n")
    assert audit.compact(spark, path, "2024-01-03") == 4 and held() == before
    assert len(list((tmp_path / "log/connector=crm/date=2024-01-02").glob("part-*"))) == 1 and "no json" in next((tmp_path / "log/connector=crm/date=2024-01-01").glob("part-*")).read_text()
    for f in (tmp_path / "log/connector=erp/date=2024-01-01").glob("part-*"):
        f.write_bytes(b"\xff\xfe never read")
    assert audit.drop_before(spark, path, "2024-01-02T00:00:00Z") == ["2024-01-01"]
    assert held() == [i for i in before if i[3] != "1"] and audit.drop_before(spark, path, "2024-01-02") == []


def test_numbers_as_text(spark):
    texts = {1.5e15: "1500000000000000", 1e20: "100000000000000000000", 1e21: "1e+21", 1.5e21: "1.5e+21", 1e-7: "1e-7", 1.5e-7: "1.5e-7", 0.0001: "0.0001", 12345678.5: "12345678.5", 2.0: "2", -3.5: "-3.5", -2e15: "-2000000000000000"}
    df = spark.createDataFrame([(float(x),) for x in texts], "x double")
    assert [r[0] for r in df.select(as_text(F.col("x"), "double")).collect()] == list(texts.values())
    s, t = spark.createDataFrame([(1.5e15, 1)], "k double, v long"), spark.createDataFrame([(1_500_000_000_000_000, 1)], "k long, v long")
    assert [r.status for r in compare(s, t, [("k", "k")], [FieldPair("v", "v")]).rows.collect()] == ["match"]


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "x", {"a": "1"}), (2, None, None)], "`i.d` long, `a.b` string, m map<string,string>")
    assert [r["i.d"] for r in request.run(df, Request([("a.b", "eq", "x")], ["i.d"], [("a.b", "desc")])).collect()] == [1]
    assert [r.errors for r in validate.validate(df, ["a.b"]).orderBy("`i.d`").collect()] == ["", "a.b"]
    assert sorted(r.status for r in compare(df, df, [("i.d", "i.d")], [FieldPair("a.b", "a.b"), FieldPair("m", "m")]).rows.collect()) == ["match", "match"]
    rows = spark.createDataFrame([(2, "y", 1), (3, "z", 2)], "`i.d` long, `a.b` string, turn int")
    assert sorted((r["i.d"], r["a.b"]) for r in files.upserted(df, rows, "i.d", "turn").collect()) == [(1, "x"), (2, "y"), (3, "z")]
    assert govern.mask(df, ["A.B"]).first()["a.b"] == "[REDACTED]"


def test_order_by_locale_and_stable_ties(spark, tmp_path):
    """Ties stay as the table is read, over all pages; texts follow a collation if asked."""
    rows = [(k, k % 3, None if k % 7 == 0 else "x") for k in range(200)]
    spark.createDataFrame(rows, "id long, g long, t string").repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    read = [tuple(r) for r in df.collect()]
    want = sorted(sorted(read, key=lambda r: r[2] or ""), key=lambda r: -r[1])
    pages = [tuple(r) for k in range(0, 200, 30) for r in request.run(df, Request(order_by=[("g", "desc"), ("t", "asc")], offset=k, limit=30)).collect()]
    assert pages == want
    words = spark.createDataFrame([(w,) for w in ("Zug", "b", "ä", "a", "zug", "z", "A")], "w string")
    assert [r.w for r in request.run(words, Request(order_by=[("w", "asc")], locale="de")).collect()] == ["a", "A", "ä", "b", "z", "zug", "Zug"]
    assert [r.w for r in request.run(words, Request(order_by=[("w", "asc")])).collect()] == ["A", "Zug", "a", "b", "z", "zug", "ä"]
