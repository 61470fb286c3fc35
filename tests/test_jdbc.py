"""Scans and keyed writes on the Derby that comes with Spark."""

import pytest

from tallymark.sources import jdbc

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture
def shop(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/shop;create=true"
    made = spark.createDataFrame([(k, f"n{k}", float(k)) for k in range(1, 41)] + [(99, None, None)], "id long, name string, amount double")
    made.write.format("jdbc").options(url=url, dbtable="items", driver=DRIVER).save()
    return url


def rows(spark, url):
    return sorted((r.id, r.name, r.amount) for r in jdbc.scan(spark, url, "items", driver=DRIVER).collect())


def test_scan_in_partitions_with_pushdown(spark, shop):
    df = jdbc.scan(spark, shop, "items", "id", 4, driver=DRIVER)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 41
    plan = df.where("amount > 30").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(amount,30.0)" in plan and "name" in plan.split("ReadSchema:")[1] and "id" not in plan.split("ReadSchema:")[1].split("struct<")[1].split(":")[0]
    assert df.where("amount > 30").count() == 10
    assert jdbc.scan(spark, shop, "items", "amount", 3, driver=DRIVER).count() == 41  # a null amount is read once
    with pytest.raises(ValueError):
        jdbc.scan(spark, shop, "items; drop table items")


def test_writes(spark, shop, tmp_path):
    schema = "id long, name string, amount double, turn int"
    new = spark.createDataFrame([(1, "one", None, 1), (1, None, 5.0, 2), (50, "fifty", 50.0, 3), (None, "x", 1.0, 4)], schema)
    before = rows(spark, shop)
    done = jdbc.write(new, shop, "items", "update", "id", "turn", str(tmp_path / "e1"), DRIVER)
    assert (done.updated, done.inserted) == (1, 0) and sorted(map(tuple, done.errors.collect()), key=str) == [("50", "not found"), (None, "no key")]
    assert rows(spark, shop) == sorted([r for r in before if r[0] != 1] + [(1, "one", 5.0)], key=lambda r: r[0])
    done = jdbc.write(new, shop, "items", "insert", "id", "turn", str(tmp_path / "e2"), DRIVER)
    assert (done.updated, done.inserted) == (0, 1) and ("1", "exists") in [tuple(r) for r in done.errors.collect()]
    done = jdbc.write(spark.createDataFrame([(50, None, 51.0, 1), (60, "sixty", None, 1)], schema), shop, "items", "upsert", "id", "turn", str(tmp_path / "e3"), DRIVER)
    assert (done.updated, done.inserted, done.errors.count()) == (1, 1, 0)
    assert [r for r in rows(spark, shop) if r[0] in (50, 60)] == [(50, "fifty", 51.0), (60, "sixty", None)]


def test_a_failed_write_changes_nothing(spark, shop, tmp_path):
    jdbc._transaction(spark, shop, DRIVER, ['alter table items add constraint few check ("amount" < 100)'])
    before = rows(spark, shop)
    with pytest.raises(Exception, match="FEW|check|constraint"):
        jdbc.write(spark.createDataFrame([(1, 7.0, 1), (70, 700.0, 1)], "id long, amount double, turn int"), shop, "items", "upsert", "id", "turn", str(tmp_path / "e"), DRIVER)
    assert rows(spark, shop) == before
    with pytest.raises(ValueError):
        jdbc.write(spark.createDataFrame([(1, 1)], "id long, turn int"), shop, "items", "merge", "id", "turn", str(tmp_path / "f"), DRIVER)
