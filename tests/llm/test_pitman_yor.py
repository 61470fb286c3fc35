"""The distributed model against plain dictionaries: counts, seatings, probabilities and scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallymark.llm import pitman_yor as py
from tallymark.llm.words import spaced_words

SCHEMA = "doc_id long, text string, n_tokens long, score string, word long"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    return [(i, " ".join(rng.choice(words[: 3 + int(rng.random() ** 3 * 57)]) for _ in range(rng.randint(0, 40)))) for i in range(n)]


ODD = [(1, None), (2, ""), (3, "ÀB Àb  \t x y"), (3, "a A b"), (3, "a A b"), (None, "a b a b"), (None, None), (4, "word " * 30_000), (5, "unseen"), (7, "\n\r\x0b\x0c"), (9, "solo a b")]


def code(word):
    """The number that a word has in the model."""
    return int((py.END if word is None else spaced_words(pa.array([word])).hashes[0]).astype(np.int64))


@pytest.fixture(scope="module", params=["prose", "odd"])
def fitted(spark, request):
    rows = corpus() if request.param == "prose" else ODD
    blocks, buckets = py.blocked(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3))
    counts, owned = py.counted(blocks, buckets)
    model = py.Model(owned, buckets)
    seen = tables(model, owned)  # scoring deletes what it needs no more
    return rows, model, *seen, py.scored(blocks, counts, model).collect()


class Seen:
    """A word's restaurant or a pair: vals hold the tables (and for words customers and tables in the parent) of each sample."""

    def __init__(self, n, vals):
        self.n = self.customers = n
        self.vals = vals


def tables(model, owned):
    words, pairs = {}, {}
    for k, state in enumerate(model.states):
        for r in state.collect():
            for w, v in zip(py.unpacked_keys(r["keys"]).view(np.int64).tolist(), py.unpacked(r["vals"]).reshape(-1, py.STATE).tolist()):
                words.setdefault(w, Seen(v[0], [])).vals.extend(v[3:])
    seats = [{r.block: py.unpacked(r.t).tolist() for r in s.collect()} for s in model.seats]
    for r in owned[0].collect():
        w = py.unpacked_keys(r.words).view(np.int64).tolist()
        for k, (u, d, c) in enumerate(zip(*(py.unpacked(c).tolist() for c in (r.context, r.dish, r.customers)))):
            pairs[w[u], w[d]] = Seen(c, [s[r.block][k] for s in seats])
    return {w: s for w, s in words.items() if s.n or s.vals[0] or s.vals[1]}, pairs


def test_counts_and_base_scores(fitted):
    rows, model, _, _, got = fitted
    count = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, kinds = sum(count.values()), len(count)
    assert (model.tokens, model.distinct) == (total, kinds)
    want = sorted((-1 if i is None else i, held(i), len(t := tokens(text)), sum(w in count for w in t), total, round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t), 4)) for i, text in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


def test_seatings_and_scores(fitted):
    """Tables lie between one and the customers, send each table to the parent once, and make probabilities that sum to one and the scores."""
    rows, model, words, pairs, got = fitted
    start = int(py.START)
    seen = Counter()
    for i, text in rows:
        if not held(i):
            w = [start, *map(code, tokens(text))]
            seen.update(zip(w, w[1:]))
    many, of = pairs, words
    assert {k: r.customers for k, r in many.items()} == {k: c for k, c in seen.items() if c > 1}
    sums = []
    for s in range(py.SAMPLES):
        t = {k: many[k].vals[s] if k in many else 1 for k in seen}
        assert all(1 <= t[k] <= c for k, c in seen.items())
        sent, own = Counter(), Counter()
        for (u, w), k in t.items():
            sent[w] += k
            own[u] += k
        assert {w: (of[w].vals[3 * s], of[w].vals[3 * s + 1]) for w in of} == {w: (own[w], sent[w]) for w in of}
        assert all(1 <= of[w].vals[3 * s + 2] <= sent[w] for w in sent)
        sums.append((sum(sent.values()), sum(of[w].vals[3 * s + 2] for w in sent)))
    assert model.totals == sums

    def probability(w, u):
        total = 0
        for s, (c, t) in enumerate(sums):
            parent = ((of[w].vals[3 * s + 1] - model.d0 * of[w].vals[3 * s + 2]) if w in of else 0) + (py.THETA_0 + model.d0 * t) / (model.distinct + 1)
            n = of[u].n if u in of else 0
            back = (py.THETA + model.d * (of[u].vals[3 * s] if u in of else 0)) / (py.THETA + n)
            k = (many[u, w].vals[s] if (u, w) in many else 1) if (u, w) in seen else 0
            total += (seen[u, w] - model.d * k) / (py.THETA + n) + back * parent / (py.THETA_0 + c)
        return total / py.SAMPLES

    for u in [start, *[w for w in of if w != int(py.END)][:5]]:  # no text goes on after its end
        assert sum(probability(w, u) for w in of if w != start) + probability(-7, u) == pytest.approx(1)
    want = []
    for i, text in rows:
        w = [start, *map(code, tokens(text))]
        want.append((-1 if i is None else i, round(sum(math.log10(probability(b, a)) for a, b in zip(w, w[1:])), 4)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 4)) for r in got) == sorted(want)


@pytest.mark.parametrize("rows", [[], [(1, "")], [(4, "a b"), (4, None)]])
def test_tables_without_rows_or_training_texts(spark, rows):
    assert not held(1) or not held(4)
    got = py.language_scores(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    if all(held(i) for i, _ in rows):
        assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in got)


def test_seats_follow_the_restaurant(spark):
    """Means of many seatings against a plain loop, where all are seated one by one and where some are seated together."""
    rng = random.Random(4)
    for c, others, p, theta, d in ((5, 3, 0.3, 1.0, 0.7), (60, 0, 0.01, 2.0, 0.5), (900, 20, 0.05, 1.0, 0.6)):
        n = 3000 if c < 100 else 400
        got = py.seat(np.full(n, c), np.full(n, others), np.full(n, p), theta, d, np.arange(n, dtype=np.uint64) + np.uint64(99)).mean()
        plain = []
        for _ in range(n):
            t = 1
            for i in range(1, c):
                new = (theta + d * (others + t)) * p
                t += rng.random() < new / (new + i - d * t)
            plain.append(t)
        mean, spread = np.mean(plain), np.std(plain) / math.sqrt(n)
        assert abs(got - mean) < 6 * spread + 0.01 * mean


def test_scores_of_prose_beat_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [r for r in py.language_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
