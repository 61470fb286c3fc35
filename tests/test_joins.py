"""Assignment, band joins and n-gram joins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import assignment, joins, matching
from tallymark.operators.matching import Rule
from tests.test_operators import greedy

EDGE = "s long, t long, confidence double, k long"


def test_two_thousand_equal_sources_of_one_customer(spark):
    """Each takes its own target, in order, in one pass: 4,000,000 edges of one group."""
    n = 2000
    edges = spark.range(n * n, numPartitions=8).select((F.col("id") % n).alias("s"), (F.col("id") / n).cast("long").alias("t"), F.lit(50.0).alias("confidence"), F.lit(1).alias("k"))
    settled = []
    got = matching.assign(edges, "s", "t", "t", within="k", settle=lambda df: settled.append(1) or df.checkpoint())
    assert not settled, "no rounds"
    assert sorted((r.s, r.t) for r in got.collect()) == [(k, k) for k in range(n)]


def test_equal_sources_without_a_key_end_in_few_rounds(spark):
    n, settled = 120, []
    edges = spark.range(n * n).select((F.col("id") % n).alias("s"), (F.col("id") / n).cast("long").alias("t"), F.lit(50.0).alias("confidence"))
    got = matching.assign(edges, "s", "t", "t", settle=lambda df: settled.append(1) or df.checkpoint())
    assert sorted((r.s, r.t) for r in got.collect()) == [(k, k) for k in range(n)]
    assert len(settled) < 40


@pytest.mark.parametrize("seed", range(3))
def test_assignment_without_a_key_is_sequential_greedy(spark, seed):
    """Long chains of refusals beside calm pairs, repeated edges and ties."""
    rng = random.Random(seed)
    edges = [(s, s + d, 90.0 - d) for s in range(0, 60, 2) for d in (0, 1, 2)] + [(s, t, float(rng.randint(1, 3))) for s in range(100, 130) for t in range(100, 130) if rng.random() < 0.2] + [(500, 500, 9.0), (500, 500, 8.0)]
    edges += [(200 + k, 200 + min(j, k), 5.0) for k in range(15) for j in range(k + 1)]
    best = {(s, t): c for s, t, c in sorted(edges)}
    df = spark.createDataFrame(edges, "s long, t long, confidence double")
    assert {r.s: r.t for r in matching.assign(df, "s", "t", "t").collect()} == greedy([(s, t, c) for (s, t), c in best.items()])


def test_groups_are_assigned_apart(spark):
    rng = random.Random(8)
    edges = [(s, t, float(rng.randint(1, 3)), k) for k in range(5) for s in range(k * 10, k * 10 + 8) for t in range(k * 10, k * 10 + 6) if rng.random() < 0.6]
    got = matching.assign(spark.createDataFrame(edges, EDGE), "s", "t", "t", within="k")
    assert {r.s: r.t for r in got.collect()} == greedy([e[:3] for e in edges])
    assert matching.assign(spark.createDataFrame([], EDGE), "s", "t", "t", within="k").count() == 0
    assert matching.assign(spark.createDataFrame([], EDGE), "s", "t", "t").count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(200, 260)] + [(1, 5), (5, 1), (9, 9), (7, 5), (300, 250)]
    got = {r.id: r.root for r in assignment.components(spark.createDataFrame(links, "a long, b long"), lambda df: df.checkpoint()).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 9} | {k: 200 for k in [*range(200, 261), 300]}


def test_band_is_part_of_the_key(spark):
    """A hot key's rows meet only in three buckets of the band; no pair in the band is lost."""
    rng = random.Random(3)
    rows = [(k, 1 if rng.random() < 0.8 else rng.randint(2, 4), rng.choice([None, float("nan"), float("inf"), rng.uniform(-50, 50), rng.randint(-5, 5) * 0.5])) for k in range(300)]
    a, b = spark.createDataFrame(rows[:150], "id long, k long, x double"), spark.createDataFrame(rows[150:], "id long, k long, x double")
    rules = [Rule("k", "k", "k", "equals", 50, True), Rule("x", "x", "x", "equals_tolerance", 50, True, {"tolerance": 0.5})]
    met = matching.candidates(a, b, rules)
    close = lambda p, q: p is not None and q is not None and abs(p - q) <= 0.5
    want = sorted((p[0], q[0]) for p in rows[:150] for q in rows[150:] if p[1] == q[1] and close(p[2], q[2]))
    assert sorted((r.s_id, r.t_id) for r in matching.scored(a, b, rules, 0).collect()) == want
    hot = sum(p[1] == 1 for p in rows[:150]) * sum(q[1] == 1 for q in rows[150:])
    assert met.where("s_k = 1").count() < hot / 4


def test_lone_rows_of_a_block_meet_by_the_required_rules(spark):
    a = spark.createDataFrame([(1, "aa", 1.0), (2, "zz", 5.0), (3, None, 9.0)], "id long, b string, x double")
    b = spark.createDataFrame([(1, "aa", 1.0), (2, "bb", 5.1), (3, "bb", 70.0)], "id long, b string, x double")
    rules = [Rule("x", "x", "x", "equals_tolerance", 50, True, {"tolerance": 0.2})]
    met = matching.candidates(a, b, rules, ("b", "b", "exact"))
    assert "Cartesian" not in met._jdf.queryExecution().toString() and "NestedLoop" not in met._jdf.queryExecution().toString()
    assert sorted((r.s_id, r.t_id) for r in matching.scored(a, b, rules, 0, ("b", "b", "exact")).collect()) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("algorithm,threshold", [("levenshtein", 0.85), ("levenshtein", 0.5), ("dice_sorensen", 0.7), ("jaccard", 0.6), ("jaccard", 1.0), ("soundex", 1)])
def test_gram_join_loses_no_pair(spark, algorithm, threshold):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeÄß ") for _ in range(rng.choice([0, 1, 2, 3, 8, 14])))
    left = [word() for _ in range(70)] + [None, "", "x"]
    right = [t[:-1] + rng.choice("abc") if t and rng.random() < 0.6 else word() for t in left] + [None, "", "X", "xx"]
    a, b = (spark.createDataFrame(list(enumerate(x)), "id long, text string") for x in (left, right))
    rule = Rule("text", "text", "text", "similarity", 100, True, {"algorithm": algorithm, "threshold": threshold})
    met = matching.candidates(a, b, [rule])
    assert "Cartesian" not in met._jdf.queryExecution().toString() and "NestedLoop" not in met._jdf.queryExecution().toString()
    everyone = a.alias("a").crossJoin(b.alias("b"))
    want = everyone.where(matching.rule(rule, F.col("a.text"), F.col("b.text"), ("string", "string"))).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"))
    got = [(r.s_id, r.t_id) for r in matching.scored(a, b, [rule], 0).collect()]
    assert sorted(got) == sorted((r.i, r.j) for r in want.collect()) and len(got) == len(set(got)) > 3


def test_gram_join_leaves_most_pairs_of_unlike_texts_out(spark):
    texts = spark.range(2000).select("id", F.base64(F.unhex(F.md5(F.col("id").cast("string")))).alias("text"))
    s, t = (texts.select(*(F.col(c).alias(f"{p}_{c}") for c in texts.columns)) for p in "st")
    assert joins.gram_join(s, t, F.col("s_text"), F.col("t_text"), "jaccard", 0.8).count() < 4_000


@pytest.mark.parametrize("keyed", [False, True])
def test_no_side_of_a_band_join_is_broadcast(spark, keyed):
    """Targets in three buckets each were broadcast where their files are small: 134 MB of 13 MB of orders."""
    a = spark.range(500).selectExpr("id", "id % 3 as k", "cast(id as double) as x")
    rules = [Rule("x", "x", "x", "equals_tolerance", 50, True, {"tolerance": 0.5}), *([Rule("k", "k", "k", "equals", 50, True)] if keyed else [])]
    met = matching.scored(a, a, rules, 0)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 500
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
