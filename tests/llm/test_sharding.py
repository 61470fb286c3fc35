import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import sharding


def pmf(good, bad, draws):
    return {x: math.comb(good, x) * math.comb(bad, draws - x) / math.comb(good + bad, draws) for x in range(max(0, draws - bad), min(good, draws) + 1)}


def test_inversion_is_the_hypergeometric_law():
    for good, bad, draws in ((5, 7, 6), (30, 4, 20), (1, 1, 1), (60, 60, 120), (200, 3, 2)):
        total = 0.0
        for x, p in pmf(good, bad, draws).items():
            for u in (total + 1e-9, total + p / 2, total + p - 1e-9):
                if p > 1e-6:
                    assert sharding.invert_hypergeometric(u, good, bad, draws) == x
            total += p
    rng = np.random.default_rng(1)
    big = [sharding._hypergeometric(rng, 4 * 10**9, 60 * 10**9, 10**6) for _ in range(2000)]
    sd = math.sqrt(10**6 / 16 * 15 / 16)
    assert abs(np.mean(big) - 62_500) < 4 * sd / math.sqrt(2000) and 0.9 < np.std(big) / sd < 1.1


def test_matrices_are_uniform():
    seen = Counter(sharding.draw_matrix([2, 2], 2, seed)[0, 0] for seed in range(3000))
    assert all(abs(seen[x] / 3000 - p) < 0.04 for x, p in pmf(2, 2, 2).items())


def test_each_row_meets_each_shard_alike(spark):
    docs = spark.range(0, 40, numPartitions=3).select(F.col("id").alias("doc_id"))
    seen = Counter()
    for seed in range(25):
        rows = sharding.shard(docs, 4, seed).collect()
        assert sorted(Counter(r.shard for r in rows).values()) == [10] * 4
        seen.update((r.doc_id < 20, r.shard) for r in rows)
    assert all(abs(n - 125) < 45 for n in seen.values())


def test_shuffled_input_is_dealt(spark):
    table = spark.range(0, 500, numPartitions=5).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("k"))
    for docs in (table.repartition(7, "k"), table.orderBy("k", "doc_id"), table.groupBy("doc_id").agg(F.max("k").alias("k"))):
        rows = sharding.shard(docs).collect()
        assert sorted(r.doc_id for r in rows) == list(range(500))
        assert {n for n in Counter(r.shard for r in rows).values()} == {31, 32}
