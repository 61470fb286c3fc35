"""Two streams compared as two tables are."""

from pyspark.sql import functions as F

from tallymark.operators.compare import FieldPair, compare
from tallymark.streaming.compare import compare_streams

SCHEMA = "id long, v string, t timestamp"


def test_streams_are_compared_as_tables(spark, tmp_path):
    source = [(1, "a", 0), (2, "b", 1), (3, "c", 2), (9, "late", 600)]
    target = [(1, "a", 5), (2, "x", 3), (4, "d", 2), (8, "late", 600)]

    def write(rows, name):
        spark.createDataFrame(rows, "id long, v string, m int").select("id", "v", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("m"))).alias("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    streams = {}
    for name, rows in (("source", source), ("target", target)):
        write(rows[:-1], name)
        streams[name] = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    fields = [FieldPair("v", "v")]
    compared = compare_streams(streams["source"], streams["target"], ("id", "id"), fields, ("t", "t"))
    run = compared.writeStream.format("memory").queryName("compared").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        run.processAllAvailable()
        first = sorted((r.key, r.status) for r in spark.table("compared").collect())
        assert first == [("1", "match"), ("2", "difference")]  # the others may still meet a row
        for name, rows in (("source", source), ("target", target)):
            write(rows[-1:], name)
        run.processAllAvailable()
        seen = [p.observedMetrics["comparison"] for p in run.recentProgress if p.observedMetrics.get("comparison")]
        assert sum(m.matches for m in seen) == 1
    finally:
        run.stop()
    got = sorted((r.key, r.status) for r in spark.table("compared").collect())
    tables = [spark.read.parquet(str(tmp_path / n)).where("id < 8") for n in ("source", "target")]
    batch = compare(*tables, [("id", "id")], fields)
    assert got == sorted((r.key, r.status) for r in batch.rows.collect()) == [("1", "match"), ("2", "difference"), ("3", "source_only"), ("4", "target_only")]
    assert sorted((r.key, r.status) for r in compare_streams(*tables, ("id", "id"), fields, ("t", "t")).collect()) == got
