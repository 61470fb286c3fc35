import numpy as np
import pytest

from tallymark.llm import nearest


def exact(ids, x, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def found(spark, ids, x, **how):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    out = {}
    for r in sorted(nearest.nearest(df, **how).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def clustered(rng, n):
    x = rng.normal(size=(100, 64))[rng.integers(0, 100, n)] + 0.5 * rng.normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("n", [1, 15, 40])
def test_small_tables_are_searched_whole(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    ids = np.arange(n)
    assert found(spark, ids, x) == {q: best for q, best in exact(ids, x, 20).items() if best}


def test_queries_with_few_candidates_see_all_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SMALL_BAND", 0)  # all are hashed
    x = clustered(np.random.default_rng(1), 300)
    ids = np.arange(300)
    got, want = found(spark, ids, x, tables=1, probes=1), exact(ids, x, 20)
    assert {q: len(v) for q, v in got.items()} == {q: 20 for q in want}


@pytest.mark.parametrize("length", [10.0, 1000.0])
def test_long_vectors_do_not_hide_others(spark, length):
    x = clustered(np.random.default_rng(2), 5000)
    x[[7, 1234, 4321]] *= length
    ids = np.arange(5000)
    got, want = found(spark, ids, x), exact(ids, x, 20)
    share = [len(set(want[q]) & set(got.get(q, []))) / 20 for q in want]
    assert all(len(got[q]) == 20 for q in want)
    assert np.mean(share) > 0.97 and min(share) > 0.7


def test_hashing_saves_products():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    queries, products, hits = x[:100], 0, 0
    truth = np.argsort(-(queries @ x[100:].T), axis=1)[:, :20]
    met = np.zeros((100, len(x) - 100), bool)
    for sign in nearest.signs(64, nearest.TABLES, nearest.axes_for(len(x), 64)):
        cell, rest = nearest.own_buckets(x[100:], sign)
        own = cell * 1000 + rest
        for k, probed in enumerate(zip(*nearest.probed_buckets(queries, sign, nearest.PROBES))):
            hit = np.isin(own, probed[0] * 1000 + probed[1])
            products += int(hit.sum())
            met[k] |= hit
    assert products < 0.25 * 100 * len(x)
    assert np.take_along_axis(met, truth, 1).mean() >= 0.9


def test_ties_repeats_and_empty_tables(spark):
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>, rank int")).count() == 0
    rows = [(k, [1.0, 0.0]) for k in (3, 1, 2, 20, 40)] + [(2, [1.0, 0.0]), (20, [1.0, 0.0]), (7, [0.5, 0.5]), (8, [1.0]), (9, None), (None, [1.0, 1.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(20, 1, 1.0), (20, 2, 1.0), (20, 2, 1.0), (20, 3, 1.0), (40, 1, 1.0), (40, 2, 1.0), (40, 2, 1.0), (40, 3, 1.0)]
