import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import similarity as sim
from tallymark.functions.values import money, redact
from tallymark.operators import audit, changes, govern, matching, request, validate
from tallymark.operators.compare import FieldPair, compare
from tallymark.operators.matching import Rule
from tallymark.operators.request import Request
from tallymark.sources import files

RULES = [Rule("id", "id", "id", "equals", 50, True), Rule("amount", "amount", "amount", "equals_tolerance", 50, options={"tolerance": 0.01})]


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def pairs(spark, source, target, schema="id string, amount double"):
    return spark.createDataFrame(source, schema), spark.createDataFrame(target, schema)


def status(spark, source, target):
    s, t = pairs(spark, source, target, "id long, value string")
    return sorted(r.status for r in compare(s, t, [("id", "id")], [FieldPair("id", "id"), FieldPair("value", "value")]).rows.collect())


def test_compare(spark):
    assert status(spark, [], []) == []
    assert status(spark, [(1, "A")], [(1, "B")]) == ["difference"]
    assert status(spark, [(1, "X"), (2, "Y")], [(1, "X"), (2, "Y")]) == ["match", "match"]
    assert status(spark, [(i, f"v-{i}") for i in range(900)], [(i, f"v-{i}") for i in range(900)]) == ["match"] * 900
    assert status(spark, [(None, "A"), (3, None)], [(None, "A"), (4, "x")]) == ["match", "source_only", "target_only"]


@pytest.mark.parametrize(
    "source,target,minimum,expected",
    [([("A", 10.0)], [("A", 10.0)], 50, [100.0]), ([("A", 10.0)], [("B", 10.0)], 50, []), ([("A", 100.0)], [("A", 150.0)], 0, [50.0]), ([("A", 0.0), ("B", -10.0)], [("A", 0.0), ("B", -10.0)], 50, [100.0, 100.0])],
)
def test_reconcile(spark, source, target, minimum, expected):
    assert [r.confidence for r in matching.scored(*pairs(spark, source, target), RULES, minimum).collect()] == expected


def test_reconcile_similarity_and_blocks(spark):
    s, t = pairs(spark, [("A", "INV-12345")], [("A", "INV-12346")], "id string, ref string")
    near = Rule("ref", "ref", "ref", "similarity", 100, True, {"algorithm": "levenshtein", "threshold": 0.85})
    assert matching.scored(s, t, [near], 0).first().confidence == 100
    s, t = pairs(spark, [("A", "Robert")], [("A", "Rupert")], "id string, name string")
    assert matching.scored(s, t, [Rule("name", "name", "name", "similarity", 100, True, {"algorithm": "soundex", "threshold": 1})], 0).count() == 1
    s, t = pairs(spark, [("A", "INV-12345"), ("B", "INV-99999")], [("X", "INV-12345"), ("Y", "INV-99999")], "id string, ref string")
    edges = matching.scored(s, t, [Rule("ref", "ref", "ref", "equals", 100, True)], 0, ("ref", "ref", "prefix"))
    assert sorted((r.s_id, r.t_id) for r in edges.collect()) == [("A", "X"), ("B", "Y")]


def greedy(edges):
    used, out = set(), {}
    for s in sorted({e[0] for e in edges}):
        free = [(-c, t) for a, t, c in edges if a == s and t not in used]
        if free:
            used.add(min(free)[1])
            out[s] = min(free)[1]
    return out


def test_assignment_is_sequential_greedy(spark):
    cases = [[(1, 1, 90.0), (2, 1, 95.0), (2, 2, 60.0), (3, 2, 80.0)]]
    random.seed(5)
    cases += [[(s, t, float(random.randint(1, 4) * 10)) for s in range(6) for t in range(6) if random.random() < 0.5] for _ in range(2)]
    for edges in cases:
        df = spark.createDataFrame(edges, "s long, t long, confidence double")
        assert {r.s: r.t for r in matching.assign(df, "s", "t", "t").collect()} == greedy(edges)


def test_snapshots(spark, tmp_path):
    def diff(old, new):
        a, b = pairs(spark, old, new, "id long, value string")
        return sorted((r.key, r.change) for r in changes.against_snapshot(a, b, "id").collect())

    assert diff([(1, "A")], [(1, "A")]) == []
    assert diff([], [(1, "A")]) == [("1", "added")]
    assert diff([(1, "A")], []) == [("1", "deleted")]
    assert diff([(1, "A"), (2, "B")], [(1, "A-updated"), (3, "C")]) == [("1", "modified"), ("2", "deleted"), ("3", "added")]
    store = changes.Snapshots(spark, str(tmp_path))
    store.save("a/b", spark.range(3))
    assert store.load("a/b").count() == 3
    with pytest.raises(Exception, match="EXISTS|exists"):
        store.save("a/b", spark.range(3))


def test_requests(spark):
    df = spark.createDataFrame([(1, "b", None), (2, None, 5.0), (3, "a", 1.0)], "id long, name string, x double")
    ids = lambda *w: [r.id for r in request.matching(df, list(w)).orderBy("id").collect()]
    assert ids(("name", "eq", None)) == [2] and ids(("name", "neq", "a")) == [1, 2] and ids(("id", "eq", "1")) == []
    assert ids(("x", "gt", 1)) == [2] and ids(("name", "contains", "A")) == [3] and ids(("id", "in", [1, 3])) == [1, 3]
    assert [r.id for r in request.run(df, Request([], ["id", "zz"], [("name", "asc")], 1, 2)).collect()] == [3, 1]
    with pytest.raises(ValueError):
        ids(("__proto__", "eq", 1))


@pytest.mark.parametrize("a,b,expected", [("DIXON", "DICKSONX", 0.766667), ("abcdefgh", "abzzzzzz", 0.5), ("a", "ab", 0.833333)])
def test_jaro(spark, a, b, expected):
    assert value(spark, sim.jaro(F.lit(a), F.lit(b))) == pytest.approx(expected, abs=1e-6)


def test_similarities(spark):
    two = lambda f, a, b: value(spark, f(F.lit(a), F.lit(b)))
    assert two(sim.jaro_winkler, "MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert two(sim.jaro_winkler, "abcdefgh", "abzzzzzz") == pytest.approx(0.6)
    assert two(sim.levenshtein, "kitten", "sitting") == pytest.approx(1 - 3 / 7)
    assert two(sim.dice, "night", "nacht") == 0.25 and two(sim.jaccard, "night", "nacht") == pytest.approx(1 / 7)
    assert two(sim.dice, "", "ab") == 0 and two(sim.jaccard, "aa", "aaaa") == 1
    for text, code in {"Robert": "R163", "Ashcraft": "A226", "Pfister": "P236", "Tymczak": "T522", "Müller": "M460", "123": "0000", "": "0000", "1abc": "A120"}.items():
        assert value(spark, sim.soundex(F.lit(text))) == code
    assert value(spark, sim.cologne(F.lit("Müller-Lüdenscheidt"))) == "65752682"


@pytest.mark.parametrize("text,plain,locale,right", [("1.234,56", 1.234, "de", 1234.56), ("1,234.56", 1.234, "en", 1234.56), ("1.234.567,8", 1234.567, None, 1234.567), ("EUR 12,50", 12.5, "de", 12.5)])
def test_money(spark, text, plain, locale, right):
    assert value(spark, money(F.lit(text))) == pytest.approx(plain)
    assert value(spark, money(F.lit(text), locale)) == pytest.approx(right)


def test_governance_and_audit(spark):
    df = spark.createDataFrame([("=1",), (" @x",), ("-5",), ("'=1",), ("a=1",), (None,)], "t string")
    assert [r.t for r in govern.guard_formulas(df).collect()] == ["'=1", "' @x", "'-5", "'=1", "a=1", None]
    assert govern.mask(df, ["T "]).first().t == "[REDACTED]"
    assert value(spark, redact(F.lit("Bearer a.b http://u:p@h Bearer abcdefgh"))) == "Bearer a.b http://u:[REDACTED]@h Bearer [REDACTED]"
    policy = govern.Policy(deny=["delete_*"], rules=[("read", "crm", False)], writes=False)
    assert not policy.decide("delete_x", "a") and not policy.decide("read", "crm") and policy.decide("read", "erp") and not policy.decide("write", "erp", True)
    log = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("f", 3, "c")], "chain string, id long, body string")
    chained = audit.linked(log, "chain", "id", "body")
    assert audit.breaks(chained, "chain", "id", "body").count() == 0
    assert [r.id for r in audit.breaks(chained.where("id <> 2"), "chain", "id", "body").collect()] == [3]


def test_validation_and_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "2024-01-02", None), ("x", "2024-02-03", "")], "a string, b string, c string")
    found = {r.field: (r.type, r.required) for r in validate.infer(df, ["b"]).collect()}
    assert found == {"a": ("integer", True), "b": ("date", True)}
    assert [r.errors for r in validate.validate(df, ["a", "c"]).collect()] == ["c", "c"]
    with pytest.raises(ValueError):
        validate.gate(df, ["c"])
    (tmp_path / "e.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "n.json").write_text('{"data": {"items": [{"id": 1, "nested": {"a": 1, "b": "x"}}]}}')
    assert files.read_json(spark, str(tmp_path / "n.json"), "data.items").first().nested.b == "x"
    with pytest.raises(ValueError):
        files.read_json(spark, str(tmp_path / "n.json"), "__proto__.items")
    table = spark.createDataFrame([(1, "Alice", 10.0)], "id long, name string, amount double")
    rows = spark.createDataFrame([(1, 20.0, 1), (2, 5.0, 2)], "id long, amount double, turn int")
    assert sorted((r.id, r.name, r.amount) for r in files.upserted(table, rows, "id", "turn").collect()) == [(1, "Alice", 20.0), (2, None, 5.0)]
    files.write_csv(spark.createDataFrame([("=2+2",)], "name string"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().name == "'=2+2"
