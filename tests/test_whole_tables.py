"""The reconciliation queries over all orders against plain loops, on orders with large keys and a hot customer."""

from datetime import datetime, timedelta

import pytest

from tallymark import plans
from tests.test_operators import greedy

KEYS = [*range(0, 40, 7), 999, 1000, 1500, 1999, 2000, 2001, 9999, 10_000, 10_001, 123_456, 1_234_567, *range(50_000, 50_030)]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    made = [(k, 1 if k >= 50_000 else k % 5, float(100 + 13 * (k % 9)), datetime(2024, 1, 1) + timedelta(days=k % 11)) for k in KEYS]
    spark.createDataFrame(made, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{path}/orders.parquet")
    return path, [(k, c, t + k % 3 * 0.005, d + timedelta(days=k % 10)) for k, c, t, d in made], made


def test_orders_are_reconciled(spark, orders):
    path, pay, inv = orders
    run = lambda name: plans.QUERIES[name](spark, path).collect()
    same = [(p, i) for p in pay for i in inv if p[1] == i[1]]
    assert run("r_candidates")[0].pairs == len(same)
    assert sorted((r.pk, r.ik) for r in run("r_band")) == sorted((p[0], i[0]) for p in pay for i in inv if abs(p[2] - i[2]) <= 50)
    near = lambda p, i: abs(p[2] - i[2]) <= 0.006
    day = lambda p, i: abs(p[3] - i[3]) <= timedelta(days=5)
    assert {r.pk: r.ik for r in run("r_assign")} == greedy([(p[0], i[0], 100.0) for p, i in same if near(p, i)])
    edges = [(p[0], i[0], (40 + 60 * near(p, i) + 25 * day(p, i)) / 125 * 100) for p, i in same]
    assert {r.s_pk: r.t_ik for r in run("r_assign_chain")} == greedy([e for e in edges if e[2] >= 50])
    for name in ("k_exact", "k_prefix"):
        assert sorted((r.pk, r.ik) for r in run(name)) == sorted((k, k) for k in KEYS)


def test_amounts_are_parsed(spark, orders):
    got = {r.o_orderkey: r.amount for r in plans.QUERIES["r_money_parse"](spark, orders[0]).collect()}
    assert got == {k: pytest.approx([k + 0.5, k / 1000, k + 0.25][k % 3]) for k in KEYS}


def test_equal_invoices_of_one_customer_are_one_pair_each(spark, tmp_path):
    """The matched pairs and their counts are those of the SQL, where an invoice has a copy, too."""
    made = [(k, k % 4 // 2, 50.0 if k < 6 else 10.0 * k, datetime(2024, 1, 1)) for k in range(12)]
    spark.createDataFrame(made, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    want = [(k, i) for k, c, t, _ in made for i, e, u, _ in made if c == e and abs(t + k % 3 * 0.005 - u) <= 0.006]
    assert len(want) > len({k for k, _ in want})
    assert sorted(tuple(r) for r in run("r_assign_single")) == sorted((k, i, 100.0) for k, i in want)
    assert [tuple(r) for r in run("r_summary")] == [(len(want), 100.0)]
    lone = [12 - len({p[side] for p in want}) for side in (0, 1)]
    assert tuple(run("r_report")[0]) == (len(want), *lone, pytest.approx(len(want) * 100 / 12, abs=0.005), 100.0)
    assert [len(run(name)) for name in ("r_unmatched_src", "r_unmatched_tgt")] == lone
