"""Texts meet by parts of their grams or by segments: against all pairs, and without a side in the driver's memory."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import joins, matching
from tallymark.operators.matching import Rule

SETS = [("dice_sorensen", 0.9), ("dice_sorensen", 0.98), ("jaccard", 0.85), ("jaccard", 0.75)]


def edited(rng: random.Random, text: str, edits: int) -> str:
    out = list(text)
    for _ in range(edits):
        k, how = rng.randrange(len(out) + 1), rng.random()
        out[k : k + (how < 0.7)] = [] if how < 0.3 else [rng.choice("abcdeÄß7")]
    return "".join(out)


def made(seed: int) -> tuple[list, list]:
    """Texts of many lengths, few grams, one beginning or end, and copies with some edits."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghÄß0123") for _ in range(n))
    left = [word(rng.choice([1, 2, 5, 9, 12, 20, 24, 25, 31, 48, 60, 90])) for _ in range(60)]
    left += ["invoice-2024-" + word(7) for _ in range(30)] + [word(9) + "-of-the-archive" for _ in range(15)] + ["ab" * k for k in (3, 9, 10, 15, 27)] + ["a" * k for k in (7, 8, 10, 11, 30, 33)] + [None, "", "x"]
    right = [t if not t or rng.random() < 0.1 else edited(rng, t, rng.choice([0, 1, 1, 2, 2, 3, 4, 5])) for t in left for _ in range(2)] + [None, "", "", "X", "xx"]
    return left, right


def checked(spark, algorithm: str, threshold: float, seed: int) -> None:
    left, right = made(seed)
    a, b = (spark.createDataFrame(list(enumerate(x)), "id long, text string") for x in (left, right))
    rule = Rule("text", "text", "text", "similarity", 100, True, {"algorithm": algorithm, "threshold": threshold})
    everyone = a.alias("a").crossJoin(b.alias("b"))
    want = everyone.where(matching.rule(rule, F.col("a.text"), F.col("b.text"), ("string", "string"))).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"))
    got = [(r.s_id, r.t_id) for r in matching.scored(a, b, [rule], 0).collect()]
    assert sorted(got) == sorted((r.i, r.j) for r in want.collect()) and len(got) == len(set(got)) > 20
    for p, q in ((a.limit(0), b), (a, b.limit(0))):
        assert matching.scored(p, q, [rule], 0).count() == 0


def not_broadcast(spark, algorithm: str, threshold: float) -> None:
    """Keys are many for each text: as one side of a broadcast they were 1 GB for 120,000 texts, in the driver."""
    texts = spark.range(300).select("id", F.base64(F.unhex(F.md5(F.col("id").cast("string")))).alias("text"))
    rule = Rule("text", "text", "text", "similarity", 100, True, {"algorithm": algorithm, "threshold": threshold})
    met = matching.candidates(texts, texts, [rule])
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() >= 300
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("crowd,algorithm,threshold", [(c, *how) for c in (1 << 20, 3) for how in SETS])
def test_sets_of_parts_lose_no_pair(spark, monkeypatch, crowd, algorithm, threshold):
    """Also where a few pairs already crowd a key, so that its texts meet by rare grams."""
    monkeypatch.setattr(joins, "CROWD", crowd)
    checked(spark, algorithm, threshold, crowd)


@pytest.mark.parametrize("algorithm,threshold", [("dice_sorensen", 0.9), ("dice_sorensen", 0.6)])
def test_no_side_of_a_dice_join_is_broadcast(spark, algorithm, threshold):
    not_broadcast(spark, algorithm, threshold)


def test_a_text_has_few_keys(spark):
    """24 characters had 70 keys on each side."""
    text = F.base64(F.unhex(F.md5(F.col("id").cast("string"))))
    grams = joins.sim.ngrams(text, joins.GRAM)
    keys = spark.range(200).select(F.size(joins.part_keys(grams, F.size(grams), (18, 24), 0.1, 0.9 / 1.1, 48)).alias("n"))
    assert keys.agg(F.max("n")).first()[0] <= 31


def test_texts_with_a_passage_in_common_make_few_pairs(spark, monkeypatch):
    """Texts that differ in a short end only have most parts in common, so their pairs grew with the square of their number without rare grams."""
    monkeypatch.setattr(joins, "CROWD", 1 << 10)
    texts = spark.range(1200).select("id", F.concat(F.lit("a passage that all of these texts begin with, word for word: "), F.substring(F.base64(F.unhex(F.md5(F.col("id").cast("string")))), 1, 22)).alias("text"))
    s, t = (texts.select(*(F.col(c).alias(f"{p}_{c}") for c in texts.columns)) for p in "st")
    assert 1200 <= joins.gram_join(s, t, F.col("s_text"), F.col("t_text"), "dice", 0.9).count() < 120_000


@pytest.mark.parametrize("algorithm,threshold", [("jaccard", 0.85), ("jaccard", 0.5)])
def test_no_side_of_a_jaccard_join_is_broadcast(spark, algorithm, threshold):
    not_broadcast(spark, algorithm, threshold)


@pytest.mark.parametrize("crowd,edits,threshold", [(1 << 20, 4, 0.9), (1 << 20, 4, 0.8), (1 << 20, 1, 0.85), (3, 4, 0.9), (3, 2, 0.8)])
def test_segments_lose_no_pair(spark, monkeypatch, crowd, edits, threshold):
    """Also where texts are too long for segments, and where a few pairs already crowd a key."""
    monkeypatch.setattr(joins, "CROWD", crowd)
    monkeypatch.setattr(joins, "EDITS", edits)
    checked(spark, "levenshtein", threshold, edits)


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_no_side_of_a_levenshtein_join_is_broadcast(spark, threshold):
    not_broadcast(spark, "levenshtein", threshold)


@pytest.mark.parametrize("threshold", [0.8, 0.85, 0.9, 0.97, 1.0])
def test_similar_texts_have_a_segment_in_common(spark, threshold):
    """Keys of a pair alone, for 20,000 pairs around the threshold; a text of 24 characters has at most 20 keys (70 before)."""
    rng = random.Random(int(threshold * 100))
    short = max(k for k in range(100) if int(k * (1 - threshold) + 1e-9) <= joins.EDITS)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, min(short, 45)))) for _ in range(20_000)]
    pairs = spark.createDataFrame([(t, edited(rng, t, rng.randint(0, 4)).lower()) for t in texts], "a string, b string").where(F.char_length("b") <= short)
    long = lambda c: F.char_length(c).cast("long")
    source = joins.segment_keys(F.col("a"), long("a"), threshold, short, list(range(short + 1)))
    keyed = pairs.select("a", joins.sim.levenshtein(F.col("a"), F.col("b")).alias("s"), source.alias("x"), joins.segment_keys(F.col("b"), long("b"), threshold, short).alias("y"))
    got = keyed.where(F.col("s") >= threshold).agg(F.count("*").alias("similar"), F.sum(F.when(~F.arrays_overlap("x", "y"), 1).otherwise(0)).alias("lost")).first()
    assert got.similar > 1000 and got.lost == 0
    assert threshold < 0.9 or keyed.where("length(a) = 24").agg(F.max(F.size("x"))).first()[0] <= 20
