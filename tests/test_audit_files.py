import datetime as dt
import re

import pytest

from tallymark.operators import audit, changes, govern
from tallymark.operators.request import Request


def test_days_are_pruned_and_bad_lines_skipped(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i, 12), "a" if i % 2 else "b", "create") for i in range(6)]
    log = spark.createDataFrame(rows, "id long, ts timestamp_ntz, connector string, operation string")
    path = str(tmp_path / "log")
    audit.append(log, path)
    for line in ("{broken", '{"id": 9}', ""):
        with open(next((tmp_path / "log" / "connector=a" / "date=2024-01-04").glob("*.json")), "a") as out:
            out.write(line + "\n")
    for crc in (tmp_path / "log").rglob(".*.crc"):
        crc.unlink()
    fields = "id long, ts timestamp_ntz, operation string"
    assert sorted(r.id for r in audit.read(spark, path, fields).collect()) == [0, 1, 2, 3, 4, 5]
    some = audit.read(spark, path, fields, "a", "2024-01-02T12:00:00Z", "2024-01-04 12:00:00")
    assert sorted(r.id for r in some.collect()) == [1, 3] and some.count() == 2
    scan = some._jdf.queryExecution().executedPlan().toString()
    filters = scan.partition("PartitionFilters: [")[2].partition("PushedFilters")[0]
    assert "connector" in filters and "(date" in filters
    assert {r.connector: r.n for r in audit.by_connector(audit.read(spark, path, fields)).collect()} == {"a": 3, "b": 3}


def test_iso_dates_are_guarded():
    assert audit.iso_moment("2024-01-15") == "2024-01-15 00:00:00"
    assert audit.iso_moment("2024-01-15T18:00:00+02:00") == "2024-01-15 16:00:00"
    for bad in ("15.01.2024", "", "2024-02-30", None):
        with pytest.raises(ValueError):
            audit.iso_moment(bad)


def test_policy_names():
    p = govern.Policy(deny=[re.compile("^drop_")], allow=["read*", re.compile("s$")])
    assert p.decide("readAll", "x") and p.decide("other", "orders")
    assert not p.decide("drop_orders", "orders") and not p.decide("other", "order")
    assert not govern.named_by("a?", "ab") and not govern.named_by("[ab]", "a") and govern.named_by("a.*", "a.b") and not govern.named_by("a.*", "axb")


def test_changes_by_what_is_given(spark, tmp_path):
    new = spark.createDataFrame([(1, "a", 5), (2, "c", 9), (3, "d", 9)], "id long, v string, at long")
    kept = changes.Snapshots(spark, str(tmp_path))
    kept.save("all", spark.createDataFrame([(1, "a", 5), (2, "b", 5), (4, "e", 5)], "id long, v string, at long"), Request([("id", "lt", 4)]))
    found = lambda df: sorted((r.key, r.change) for r in df.collect())
    assert found(changes.detect(new, "id", ["v"], snapshots=kept, name="all")) == [("2", "modified"), ("3", "added")]
    assert found(changes.detect(new, "id", ["v"], "at", "5", kept, "all")) == [("2", "modified"), ("3", "modified")]
    with pytest.raises(ValueError):
        changes.detect(new, "id")
