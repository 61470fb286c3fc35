"""The trie against dictionaries of whole prefixes."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallymark.llm import conversation_trie
from tallymark.llm.scan import scanned

SCHEMA = "conv_id long, turn long, role string, text string, depth long, f string"


def rest(a, b):
    """SQL's %: the sign is that of a."""
    return abs(a) % b * (1 if a >= 0 else -1)


def plain(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = (*turns.get(c - rest(c, 20), [])[:h], *own[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = sum(below[k][0] for k in kids[node]) if node in kids else 1
        below[node] = (leaves, own + sum(below[k][1] for k in kids.get(node, [])))
    ends = lambda node: ",".join(map(str, sorted(c for c in members[node] if built[c] == node)))
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(kids.get(node, [])), *below[node], hashlib.sha256(ends(node).encode()).hexdigest())
        for node, m in members.items()
    )


def found(spark, rows, **options):
    made = conversation_trie.conversation_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), **options)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(made.columns) == sorted(names) and all(k == ("string" if c == "ends_sha256" else "bigint") for c, k in made.dtypes)
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in made.collect())


def conversations(seed, n=60, texts=("a", "b", "c c", "")):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, 6))]


ODD = [
    (1, None, None, None), (1, None, None, None), (1, 3, "user", "x" * 50_000), (2, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "user", "same"), (21, 2, "b", "tie"), (21, 2, "a", "tie"),
    (22, 1, "user", None), (-5, 1, "user", "negative"), (0, 1, "user", "base  of\tthree"), (0, 2, "assistant", ""), (None, 1, "user", "no id"), (40, 1, "", "user"), (41, 1, "user", ""),
]


@pytest.mark.parametrize("bits", [64, 2])
def test_trie_is_that_of_whole_prefixes(spark, bits):
    """With hashes of two bits most turns and prefixes collide and are split."""
    rows = conversations(3) + [(1000 + c, t, "user", f"long {t}") for c in range(30) for t in range(8)]
    assert found(spark, rows, bits=bits) == plain(rows)


@pytest.mark.parametrize("rows", [ODD, [], [(None, 1, "a", "b")], [(5, 1, "user", "short")]])
def test_odd_and_empty_conversations(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_one_conversation_of_a_third_of_all_turns_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr("tallymark.llm.common.FEW_ROWS", 2)
    monkeypatch.setattr(conversation_trie, "PIECE_IDS", 7)
    rows = [(7, t, "user", f"turn {t}") for t in range(400)] + [(100 + c, t, "user", f"copy {t}") for c in range(200) for t in range(4)]
    assert found(spark, rows) == plain(rows)


def test_scan_over_partition_edges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id") % 3).cast("long").alias("k"), "id", (F.col("id") * 7 - 900).alias("v"))
    made = scanned(rows, "k", ["id"], ["v"], "scan", base=3, before=True).collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.id)):
        n, s = want.get(r.k, (0, 0))
        got = next(m for m in made if m.id == r.id) if r.id % 97 == 0 or n < 2 else None
        total = (s + r.v * pow(3, n, 1 << 64)) % (1 << 64)
        if got:
            assert (got.at, got.before_v % (1 << 64), got.sum_v % (1 << 64)) == (n, s, total)
        want[r.k] = (n + 1, total)
    assert len(made) == 3000
