"""The permutation trie against counting every order on its own."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallymark.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, n_words long"
SHORT, LONG = "few words, Some CAPITALS", " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG + " $", "b"), (4, SHORT, "b"), (5, SHORT, None), (6, None, None), (7, "", ""), (None, LONG, "a"), (None, None, None),
    (8, "same " * 300, "a"), (9, ("ABC " * 100 + LONG) * 30, "a"), (10, " \t\n", "b"), (11, "x y z é" * 60, "c"), (12, "same " * 300, "b"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, None), (5, 1, 1), (99, 1, 1), (None, 1, 1), (8, 1, 0)]


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain(docs, labels):
    facts = []
    for i, text, source in docs:
        t = text or ""
        w = words(t)
        smaller = any(j is not None and i is not None and j < i and (x or "") == t for j, x, _ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": smaller}
        said = [r for r in labels if i is not None and r[0] == i]
        facts.append((source or "", fails, any(r[1] == 1 for r in said), any(r[2] == 1 for r in said)))
    out, totals = {}, {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in permutations("ABCDE"):
            there = own
            for k, f in enumerate(order):
                gone = [d for d in there if d[1][f]]
                there = [d for d in there if not d[1][f]]
                totals[part, f] = totals.get((part, f), 0) + len(gone)
                out[part, "".join(order), k + 1] = [len(there), len(gone), sum(d[1][f] for d in own) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {key: (*v, totals[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def found(spark, docs, labels):
    d = spark.createDataFrame([(*r, "clash", 7) for r in docs], SCHEMA)
    rows = filter_audit.filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}, len(rows)


def test_trie_is_every_order_counted_alone(spark):
    got, n = found(spark, DOCS, LABELS)
    assert n == len(got) == 600 * len({r[2] or "" for r in DOCS})
    assert got == plain(DOCS, LABELS)


def test_hot_text_and_hot_document(spark, monkeypatch):
    monkeypatch.setattr("tallymark.llm.common.FEW_ROWS", 2)
    docs = [(i % 40, LONG, "a") for i in range(60)] + [(100, f"{LONG} {i}", None) for i in range(50)] + [(None, SHORT, "c")] * 20
    assert found(spark, docs, [(100, 1, 0), (3, 0, 1)])[0] == plain(docs, [(100, 1, 0), (3, 0, 1)])


@pytest.mark.parametrize("docs", [[], [(None, None, None)]])
def test_empty_tables(spark, docs):
    assert found(spark, docs, [])[0] == plain(docs, [])


def test_each_set_of_filters_is_visited_once(spark):
    root = spark.createDataFrame([("a", True, False), ("b", False, True)], "part string, x boolean, y boolean")
    edges, states = filter_audit.walk(root, {"X": F.col("x"), "Y": F.col("y")}, {})
    assert states == 3 and edges.select("edge").distinct().count() == 4
