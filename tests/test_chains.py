import hashlib

from pyspark.sql import functions as F

from tallymark.operators import audit


def test_long_chains_are_linked(spark):
    n = 100_000  # nearly all in one chain
    log = spark.range(n, numPartitions=7).select(F.when(F.col("id") % 1000 == 0, F.lit("b")).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise("a").alias("chain"), "id", F.concat(F.lit("é"), F.col("id")).alias("body"))
    rows = audit.linked(log, "chain", "id", "body").collect()
    assert len(rows) == n
    at = {}
    for r in sorted(rows, key=lambda r: r.id):
        assert r.previous_hash == at.get(r.chain, "")
        at[r.chain] = hashlib.sha256(f"{r.previous_hash}\n{r.body}".encode()).hexdigest()
        assert r.hash == at[r.chain]


def test_null_content_ends_a_chain(spark):
    log = spark.createDataFrame([("f", 1, "a"), ("f", 2, None), ("f", 3, "c"), ("g", 1, "a")], "chain string, id long, body string")
    assert [(r.chain, r.id, r.previous_hash is None, r.hash is None) for r in audit.linked(log, "chain", "id", "body").orderBy("chain", "id").collect()] == [("f", 1, False, False), ("f", 2, False, True), ("f", 3, True, True), ("g", 1, False, False)]


def test_segments_and_their_heads(spark):
    """Breaks inside a segment, between segments, and an end cut off are found; untouched chains are whole."""
    rows = [(c, d, k, f"{c}{d}{k}") for c in ("a", "a, 1") for d in range(1, 5) for k in range(5)]
    log = spark.createDataFrame(rows, "chain string, day int, id long, body string")
    stored = audit.segmented(log, "chain", "day", "id", "body").cache()
    kept = audit.heads(stored, "chain", "day", "id").cache()
    found = lambda s, k=kept: sorted(((r.chain, r.day, r.id, r.what) for r in audit.segment_breaks(s, k, "chain", "day", "id", "body").collect()), key=str)
    assert stored.count() == 40 and kept.count() == 8 and found(stored) == []
    assert kept.where("previous_hash = ''").count() == 2 and stored.where("previous_hash = ''").count() == 8
    forged = stored.withColumn("body", F.when((F.col("chain") == "a") & (F.col("day") == 2) & (F.col("id") == 3), "forged").otherwise(F.col("body")))
    assert found(forged) == [("a", 2, "3", "entry")]
    assert found(stored.where("not (chain = 'a' and day = 2 and id = 2)")) == sorted([("a", 2, "3", "entry"), ("a", 2, None, "segment")], key=str)
    assert found(stored.where("not (chain = 'a' and day = 3 and id = 4)")) == [("a", 3, None, "segment")]
    assert found(stored.where("not (chain = 'a' and day = 3)")) == [("a", 3, None, "segment")]
    assert found(stored, kept.where("not (chain = 'a' and day = 3)")) == [("a", 3, None, "segment"), ("a", 4, None, "head")]
