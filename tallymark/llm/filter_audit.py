"""What each filter removes in every order of the filters: execution of the trie of all permutations.

Each document is measured once; a filter is a condition on the measures. From the root, which holds all documents, the trie is
walked depth-first: a state is the set of filters applied so far, its survivors are filtered from its
parent's and persisted while its subtree is walked. Orders that share a set of filters share its state,
which is visited once, so 5 filters make 31 counts for 120 orders. One aggregate of the survivors of a state
counts what each remaining filter removes there: the edges of the trie.

A lost executor costs the persisted blocks it held; they are filtered anew from the written measures.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, scratch, settle

#: White space between words, as a pattern for Java and for RE2.
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"

#: The five filters: conditions of failure on the measures.
FAILS: dict[str, Column | str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "has_symbol",
    "E": "is_copy",
}
#: Documents whose loss is counted apart: conditions on the measures.
LOST: dict[str, str] = {"good_lost": "good", "toxic_lost": "toxic"}


def measures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: part, n_words, n_distinct, n_capitals, n_chars, has_symbol, is_copy, good, toxic.

    A null text counts as empty, a null source as the empty one. A copy has a text that a row of a smaller doc_id has, too; a row
    without doc_id is no copy and makes none. Texts count as identical by their SHA-256. A document is good
    or toxic if one of the labels of its doc_id says so.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        capitals.cast("long").alias("n_capitals"), F.char_length(text).cast("long").alias("n_chars"), text.rlike("[#$%&*|]").alias("has_symbol"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    own = settle(own, "measures")
    repeated = own.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = looked_up(own, "digest", repeated, "copies").select("*", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("is_copy")).drop("digest", "first_id")
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(F.max((F.col("quality") == 1)).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("doc_id is not null")
    full = looked_up(settle(marked, "copies"), "doc_id", said, "labels").drop("doc_id")
    return settle(full.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}), "root")


def _counts(survivors: DataFrame, state: str, fails: dict[str, Column], lost: dict[str, Column]) -> DataFrame:
    """Rows part, edge (state and filter), filter, depth, before, removed and what is lost: one for each filter that is left."""
    every = {f"{f}_{c}": F.count_if(fails[f] & cond) for f in fails if f not in state for c, cond in ({"removed": F.lit(True)} | lost).items()}
    counted = survivors.groupBy("part").agg(F.count("*").alias("before"), *(c.alias(n) for n, c in every.items()))
    rows = F.array(*(F.struct(F.lit(f"{state}-{f}").alias("edge"), F.lit(f).alias("filter"), *(F.col(f"{f}_{c}").alias(c) for c in ("removed", *lost))) for f in fails if f not in state))
    return counted.select("part", "before", F.inline(rows))


def walk(root: DataFrame, fails: dict[str, Column], lost: dict[str, Column]) -> tuple[DataFrame, int]:
    """(the edges of the trie with their counts by part, how many states were visited). `root` has a column part."""
    spark, path, seen = root.sparkSession, scratch(root.sparkSession, "edges"), set()

    def visit(state: str, survivors: DataFrame) -> None:
        seen.add(state)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        _counts(survivors, state, fails, lost).write.mode("append").parquet(path)
        for f in fails:
            below = "".join(sorted({*state, f}))
            if f not in state and len(below) < len(fails) and below not in seen:
                visit(below, survivors.where(~fails[f]))
        survivors.unpersist()

    visit("", root)
    return spark.read.schema(_counts(root, "", fails, lost).schema).parquet(path), len(seen)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Parts are the sources, a null one counted with the empty one; every part has all 600 rows, zeros included. Rows are
    documents: repeated rows count each, and equal rows of one doc_id are no copies of each other. Empty tables give
    no rows. Very long texts are measured whole, columns beside doc_id, text and source are ignored.
    """
    fails = {f: F.coalesce(F.expr(c), F.lit(False)) for f, c in FAILS.items()}
    lost = {n: F.coalesce(F.expr(c), F.lit(False)) for n, c in LOST.items()}
    root = measures(docs, labels)
    edges, _ = walk(root, fails, lost)
    return report(edges, list(fails), list(lost))


def report(edges: DataFrame, names: list[str], lost: list[str]) -> DataFrame:
    """The edges' counts laid out for every order: a part has one row for each edge, and orders look their edges up."""
    spark, n = edges.sparkSession, len(names)
    orders = [("".join(order), k + 1, f"{''.join(sorted(order[:k]))}-{f}") for order in permutations(names) for k, f in enumerate(order)]
    shape = {e: (e[-1], k, math.factorial(k - 1) * math.factorial(n - k), k == n) for _, k, e in orders}
    steps = spark.createDataFrame(orders, "filter_order string, step int, edge string")
    every = F.array(*(F.struct(F.lit(e).alias("edge"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("weight"), F.lit(k == 1).alias("is_first"), F.lit(last).alias("is_last")) for e, (f, k, w, last) in sorted(shape.items())))
    zeros = edges.select("part").distinct().select("part", F.inline(every))
    full = zeros.join(edges.drop("filter"), ["part", "edge"], "left").na.fill(0, ["before", "removed", *lost])
    own = Window.partitionBy("part", "filter")
    full = full.select(
        "part", "edge", (F.col("before") - F.col("removed")).alias("kept"), "removed", (F.sum(F.when(F.col("is_first"), F.col("removed"))).over(own) - F.col("removed")).alias("redundant"),
        F.sum(F.when(F.col("is_last"), F.col("removed"))).over(own).alias("unique_fails"), *lost, F.sum(F.col("removed") * F.col("weight")).over(own).alias("shapley"),
    )
    return full.join(F.broadcast(steps), "edge").drop("edge").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley")


def _sql() -> str:
    """The same by a profile of the documents' failures, counted for every order and step."""
    fail = {"A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_capitals > 2 * n_chars", "D": "symbol", "E": "copy"}
    at = lambda what: f"case substr(o, step, 1) {' '.join(f'when {chr(39)}{f}{chr(39)} then {what(f)}' for f in fail)} end"
    before = " and ".join(f"(not {f} or position('{f}' in substr(o, 1, step - 1)) = 0)" for f in fail)
    alone = reduce(lambda a, b: f"{a} + {b}", (f"{f}::int" for f in fail))
    return f"""
with t as (select doc_id, coalesce(source, '') part, coalesce(text, '') x from documents),
firsts as (select x, min(doc_id) first_id from t group by x),
m as (select t.doc_id, part, regexp_extract_all(t.x, '{WORD}') w, length(t.x) n_chars, length(t.x) - length(regexp_replace(t.x, '[A-Z]', '', 'g')) n_capitals,
  regexp_matches(t.x, '[#$%&*|]') symbol, coalesce(t.doc_id > first_id, false) copy from t join firsts using (x)),
n as (select *, len(w) n_words, len(list_distinct(w)) n_distinct from m),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
f as (select part, {', '.join(f'({c}) {k}' for k, c in fail.items())}, coalesce(good, false) good, coalesce(toxic, false) toxic from n left join l using (doc_id)),
p as (select part, A, B, C, D, E, good, toxic, count(*) n from f group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) c),
orders as (select a.c || b.c || c.c || d.c || e.c o from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s as (select *, unnest([1, 2, 3, 4, 5]) step from orders),
x as (select p.*, o, step, ({before}) there, ({at(lambda f: f)}) fails, ({alone}) = 1 alone from p, s),
r as (select part, o, step, sum(case when there and not fails then n else 0 end) kept, sum(case when there and fails then n else 0 end) removed, sum(case when fails and not there then n else 0 end) redundant,
  sum(case when fails and alone then n else 0 end) unique_fails, sum(case when there and fails and good then n else 0 end) good_lost, sum(case when there and fails and toxic then n else 0 end) toxic_lost from x group by all)
select part, o as filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, substr(o, step, 1)))::bigint as shapley from r"""


SQL = _sql()
