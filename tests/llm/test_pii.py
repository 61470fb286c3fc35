import random

from tallymark.llm import pii


def test_em_finds_planted_reliabilities():
    rng = random.Random(3)
    right = (0.95, 0.9, 0.8, 0.7)
    counts = {}
    for _ in range(40_000):
        true = rng.random() < 0.4
        votes = tuple((1 if true else -1) if rng.random() < r else (-1 if true else 1) for r in right)
        counts[votes] = counts.get(votes, 0) + 1
    prior, chance = pii.reliabilities(sorted(counts.items()))
    assert abs(prior - 0.4) < 0.03
    for r, own in zip(right, chance):
        assert abs(own[1][0] - r) < 0.03 and abs(own[-1][1] - r) < 0.03
    again = pii.reliabilities(sorted(counts.items()))
    assert again == (prior, chance)  # settled, and the same in each run


def test_added_spans(spark):
    texts = [f"Dear Herr Weber, call ({k + 201}) 555-0{100 + k} or mail w{k}@post.de. IBAN DE44 5001 0517 5407 3249 {k:02d}." for k in range(30)]
    texts += [f"release 1.2.3.{k} build 123-45-67{k:02d}x" for k in range(30)] + [None, ""]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in rows}
    assert all({"email", "iban", "name"} <= set(kinds[k]) for k in range(30))
    assert all(set(kinds[k]) <= {"ip"} for k in range(30, 62))
    for r in rows:
        loose = [s for s in r.spans if not s.base]
        assert all(a.end <= b.start for a, b in zip(sorted(loose, key=lambda s: s.start), sorted(loose, key=lambda s: s.start)[1:]))
        assert [s.start for s in r.spans] == sorted(s.start for s in r.spans)


def test_gazetteers_come_from_the_corpus(spark):
    texts = [f"x{k}@a.museum and y@b.q{k}" for k in range(5)]
    rows = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert pii.gazetteer(rows.selectExpr("explode(spans) as s")) == ["email museum"]


def test_overlaps_are_those_of_comparing_all(spark):
    """Random spans: a loose one stays if no base span and no likelier loose one overlaps it."""
    rng = random.Random(9)
    data = []
    for row in range(40):
        spans = []
        for order in range(6):
            at = 0
            for _ in range(rng.randint(0, 12)):
                at += rng.randint(0, 9)
                end = at + rng.randint(1, 8)
                spans.append((at, order, f"k{order}", end, "b", order < 2, rng.choice([0.5, 0.7, 0.9])))
                at = end
        data.append((row, [s for s in spans if s[5]], [s for s in spans if not s[5]]))
    span = "array<struct<start:long,order:int,kind:string,end:long,body:string,base:boolean,probability:double>>"
    got = {r.row: sorted((s.start, s.order) for s in r.added) for r in pii.added(spark.createDataFrame(data, f"row long, base_spans {span}, loose {span}")).collect()}
    meet = lambda a, b: a[0] < b[3] and b[0] < a[3]
    for row, base, loose in data:
        clear = [s for s in loose if not any(meet(b, s) for b in base)]
        want = [s for s in clear if not any(meet(o, s) and (-o[6], o[0], o[1]) < (-s[6], s[0], s[1]) for o in clear)]
        assert got.get(row, []) == sorted((s[0], s[1]) for s in want)


def test_five_thousand_spans_in_one_text(spark):
    import time

    text = " ".join(f"call ({k % 800 + 200}) 555-{k % 10000:04d}" for k in range(5000))
    began = time.time()
    row = pii.pii_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.spans.count(":") >= 2 * 5000 or row.n_phone == 0
    assert time.time() - began < 60
