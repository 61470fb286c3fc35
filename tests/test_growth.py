"""Reconciliation whose work must not grow with the number of pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark import plans
from tallymark.functions import similarity as sim
from tallymark.operators import assignment, joins, matching
from tallymark.operators.matching import Rule
from tests.test_operators import greedy


def test_soundex_codes_are_made_once_for_a_pair(spark):
    """Each use of a code was a copy of its expression: 1,000,000 parts took eight times as long."""
    texts = [(1, "Robert", "Rupert"), (2, "large ring", "blue ring"), (3, "", "x"), (4, None, "x"), (5, "Tymczak", "tymczak")]
    df = spark.createDataFrame(texts, "i long, a string, b string")
    alike = df.select(sim.soundex_similarity(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in alike.collect()] == [1.0, 0.0, 0.75, 0.0, 1.0]
    plan = alike._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(.)\\1+") <= 2


@pytest.mark.parametrize("days", [0, 1, 2.5])
def test_pairs_of_a_date_band_are_counted_without_being_made(spark, days):
    rng = random.Random(4)
    made = lambda: [(k, rng.choice([None, rng.randint(-9, 9) * 86_400_000, rng.randint(-900_000_000, 900_000_000)])) for k in range(200)]
    left, right = made(), made()
    a, b = (spark.createDataFrame(x, "id long, ms long") for x in (left, right))
    r = Rule("date", "ms", "ms", "date_range", 100, True, {"days": days})
    got = {x.at: x.pairs for x in matching.counted(a, b, r).select(F.unix_millis("moment").alias("at"), "pairs").collect()}
    want = {}
    for _, p in left:
        n = sum(p is not None and q is not None and abs(p - q) <= days * 86_400_000 for _, q in right)
        if n:
            want[p] = want.get(p, 0) + n
    assert got == want and (days == 0 or len(want) > 50)


def test_days_of_a_crowd_are_counted(spark, tmp_path):
    """40,000 orders of two days have about 10**9 pairs, which did not end in minutes."""
    spark.range(40_000).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "1.0d as o_totalprice", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 2 as int)) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = plans.QUERIES["r_days"](spark, str(tmp_path)).collect()
    booked, dated = {}, {0: 20_000, 1: 20_000}
    for k in range(40_000):
        booked[k % 2 + k % 10] = booked.get(k % 2 + k % 10, 0) + 1
    want = {d: n * sum(dated.get(d + e, 0) for e in (-1, 0, 1)) for d, n in booked.items()}
    assert {r.day.toordinal() - 738886: r.pairs for r in got} == {d: n for d, n in want.items() if n}


@pytest.mark.parametrize("algorithm,threshold", [("levenshtein", 0.9), ("dice_sorensen", 0.9), ("jaccard", 0.85)])
def test_gram_join_of_texts_of_one_length_grows_with_the_texts(spark, algorithm, threshold):
    """Unlike texts of one length hardly meet: all of them met by length before, or by one frequent gram."""
    texts = spark.range(3000).select("id", F.base64(F.unhex(F.md5(F.col("id").cast("string")))).alias("text"))
    s, t = (texts.select(*(F.col(c).alias(f"{p}_{c}") for c in texts.columns)) for p in "st")
    pairs = joins.gram_join(s, t, F.col("s_text"), F.col("t_text"), matching.BY_GRAMS[algorithm], threshold)
    assert 3000 <= pairs.count() < 3100
    joined = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "level#" in joined and "gram#" not in joined, "texts meet by sets of grams, not by single ones"
    assert sum(r.s_id == r.t_id for r in pairs.collect()) == 3000


@pytest.mark.parametrize("seed", range(4))
def test_stretches_of_a_line_settle_only_what_the_rest_cannot_change(seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        width, (begin, end) = float(rng.choice([0, 0.1, 0.3, 1.0])), (3.0, 7.0)
        s, t = (np.round(rng.random(rng.integers(0, 40)) * 10, 1) for _ in range(2))
        want = greedy([(k, j, 1.0) for k, x in enumerate(s) for j, y in enumerate(t) if abs(x - y) <= width])
        pairs, left, _ = assignment.settled_stretch(s, t, width, None, None)
        assert dict(pairs) == want and not left
        of_s, of_t = (np.flatnonzero((v >= begin) & (v < end)) for v in (s, t))
        pairs, left, still = assignment.settled_stretch(s[of_s], t[of_t], width, begin, end)
        got = {int(of_s[k]): int(of_t[j]) for k, j in pairs}
        assert all(want.get(int(k)) == got.get(int(k)) for i, k in enumerate(of_s) if i not in left)
        others = {j for k, j in want.items() if k not in got}
        assert others & set(of_t.tolist()) <= set(of_t[still].tolist()), "no target that others take is lost"


def test_open_assignment_makes_no_pairs(spark, tmp_path, monkeypatch):
    """4,000 orders in a band of tolerance have 16,000,000 pairs, which were made and walked by one task."""
    monkeypatch.setattr(assignment, "CELL_ROWS", 256)
    rng = random.Random(3)
    made = [(k, k % 7, 50.0 + k % 5 if k < 4000 else round(rng.uniform(100, 5000), 2)) for k in range(6000)]
    df = spark.createDataFrame(made, "o_orderkey long, o_custkey long, o_totalprice double").withColumn("o_orderdate", F.expr("timestamp_ntz'2024-01-01'"))
    df.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(matching, "scored", None)
    got = plans.QUERIES["r_assign_open"](spark, str(tmp_path))
    assert got.columns == ["s_pk", "t_ik", "confidence"] and all(r.confidence == 100 for r in got.collect())
    by_loops = {k: k for k in range(6000)}  # whoever comes first takes itself, as all before it are taken
    assert {r.s_pk: r.t_ik for r in got.collect()} == by_loops


def test_open_assignment_is_that_of_the_pairs(spark, monkeypatch):
    """Text amounts, nulls, NaN and amounts without partners; keys that repeat; against scored pairs walked in order."""
    monkeypatch.setattr(assignment, "CELL_ROWS", 32)
    rng = random.Random(6)
    r = Rule("amount", "x", "y", "equals_tolerance", 60, True, {"tolerance": 0.75})
    s = [(f"s{rng.random()}", rng.choice([None, float("nan"), *[round(rng.uniform(0, 90), 2)] * 20])) for _ in range(400)]
    t = [(k, rng.choice([None, *[str(round(rng.uniform(0, 90), 1))] * 20])) for k in rng.sample(range(1000), 350)]
    for more in ([], [(t[0][0], "44.5")]):
        a, b = spark.createDataFrame(s, "k string, x double"), spark.createDataFrame(t + more, "k long, y string")
        edges = [tuple(e) for e in matching.scored(a, b, [r]).select("s_k", "t_k", "confidence").collect()]
        got = matching.assigned_near(a, "k", b, "k", r)
        assert {e.s_k: e.t_k for e in got.collect()} == greedy(edges) and {e.confidence for e in got.collect()} == {100.0}
    with pytest.raises(ValueError):
        matching.assigned_near(a, "k", b, "k", Rule("amount", "x", "y", "equals_tolerance", 60, False, {"tolerance": 1}))
    none = matching.assigned_near(a.limit(0), "k", b, "k", r)
    assert none.count() == 0
