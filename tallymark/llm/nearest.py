"""Approximate nearest neighbours by cross-polytope hashing.

In each table fast pseudo-rotations (three rounds of random signs and a Hadamard transform) send a
unit vector to its nearest signed axis each; the axes together are its bucket, and how many there are
follows the table's size. Vectors lie in one bucket per table; queries probe the buckets nearest to
them, in the order of what they lack in the rotated coordinates. Buckets with the same first axis are
one cell. A cell is cut into blocks of bounded numbers of vectors and of queries; in a block, exact inner
products are taken of a query and the vectors of the buckets that it probes. Only those are
passed on that reach the query's bound: its best inner products with a sample of the vectors.
Equal vectors are one candidate that carries its smallest ids, so a group of copies of any size
costs what one vector costs.

Candidates are hashed in bands of like length, so that a few long ones do not move the others' buckets.
Bands of up to SMALL_BAND candidates are scored whole, and so is the table for queries whose
buckets hold too few candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Tables, buckets that a query probes in each with two axes (three times as many with each further axis; more in tables
#: of fewer vectors than PROBED_AT, whose nearest neighbours lie further off), and the stride of ids that are queries.
TABLES, PROBES, QUERY_STRIDE = 12, 200, 20
PROBED_AT = 50_000
NEIGHBOURS = 20
#: Of each rotation the nearest axes that probes combine.
NEAREST_AXES = 32
#: Distinct vectors in one block of a cell.
BLOCK_ROWS = 2048
#: Distinct vectors up to which a band of lengths is scored whole, and queries that meet a block of such vectors in one task.
SMALL_BAND, QUERY_ROWS = 2048, 1024
#: Distinct vectors that bound each query's scores from below, whatever the table's size.
SAMPLE_ROWS = 2048
#: Pairs of vectors that one step multiplies.
STEP_PAIRS = 16_384
#: Share by which lengths of a band may differ while angles alone order inner products well enough for hashing.
EVEN = 1e-3
SEED = 7


def signs(dims: int, tables: int, axes: int) -> np.ndarray:
    """(tables, axes, 3, padded dims) of +1 and -1."""
    padded = 1 << max(1, (dims - 1).bit_length())
    return np.random.default_rng(SEED).choice(np.array([-1.0, 1.0]), (tables, axes, 3, padded))


def axes_for(rows: int, dims: int) -> int:
    """Axes of a bucket: two at least, and so many that a bucket holds 64 of the rows at most if they were spread evenly."""
    return max(2, math.ceil(math.log(max(rows, 64) / 64) / math.log(2 << max(1, (dims - 1).bit_length()))))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of each row."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotated(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Rows of x after one pseudo-rotation (up to scale)."""
    y = np.zeros((len(x), sign.shape[1]))
    y[:, : x.shape[1]] = x
    for s in sign:
        y = hadamard(y * s)
    return y


def own_buckets(x: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's first axis and its further ones as one number; an axis is twice its place, plus 1 if negative."""
    out = np.zeros((len(sign), len(x)), np.int64)
    for k, s in enumerate(sign):
        y = rotated(x, s)
        at = np.abs(y).argmax(1)
        out[k] = 2 * at + (y[np.arange(len(x)), at] < 0)
    rest = np.zeros(len(x), np.int64)
    for further in out[1:]:
        rest = rest * 2 * sign.shape[2] + further
    return out[0], rest


def probed_buckets(x: np.ndarray, sign: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of the `probes` buckets nearest to each row: those that lack least in all rotated coordinates together."""
    first = rest = lack = None
    for s in sign:
        y = rotated(x, s)
        both = np.concatenate([y, -y], axis=1)
        near = np.argsort(-both, axis=1, kind="stable")[:, : min(NEAREST_AXES, both.shape[1])]
        value = np.take_along_axis(both, near, 1)
        less, axis = value[:, :1] - value, np.where(near < y.shape[1], 2 * near, 2 * (near - y.shape[1]) + 1)
        if lack is None:
            first, rest, lack = axis, np.zeros_like(axis), less
            continue
        lack = (lack[:, :, None] + less[:, None, :]).reshape(len(x), -1)
        best = np.argsort(lack, axis=1, kind="stable")[:, :probes]
        old, new = best // axis.shape[1], best % axis.shape[1]
        lack = np.take_along_axis(lack, best, 1)
        first, rest = np.take_along_axis(first, old, 1), np.take_along_axis(rest, old, 1) * 2 * sign.shape[2] + np.take_along_axis(axis, new, 1)
    return first[:, :probes], rest[:, :probes]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


CELL, PROBE = "array<struct<cell:int,rest:bigint>>", "array<struct<cell:int,rests:array<bigint>>>"


def _hash_task(dims: int, tables: int, axes: int, longest: dict[int, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates with their cell and further axes in each table. Where the lengths of a band differ, longest has its
    greatest, and one more coordinate makes all lengths equal; a query's is 0, so angles order as inner products do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signs(dims + bool(longest), tables, axes)
        for b in batches:
            x = matrix(b.column("v"), dims)
            if longest:
                x = x / np.array([longest[k] for k in b.column("band").to_pylist()])[:, None]
                x = np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]])
            cells, rests = zip(*(own_buckets(x, s) for s in sign))
            cells = np.stack(cells, 1) + np.arange(tables) * 2 * sign.shape[3]
            each = pa.StructArray.from_arrays([pa.array(cells.ravel().astype(np.int32)), pa.array(np.stack(rests, 1).ravel())], ["cell", "rest"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(np.arange(len(x) + 1) * tables, each)], [*b.schema.names, "cells"])

    return run


def _probe_task(dims: int, tables: int, axes: int, probes: int, padded: bool, sample, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries with the cells they probe, the further axes in each, and a bound that their k-th best score reaches.

    The bound is the k + 1-th best of the sample's distinct vectors, as one of these may be the query's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, known = signs(dims + padded, tables, axes), sample.value
        slack = 1e-12 * np.sqrt((known * known).sum(1)).max(initial=0.0)
        for b in batches:
            x = matrix(b.column("v"), dims)
            bound = np.full(len(x), -np.inf)
            if len(known) > k:
                bound = -np.partition(-(x @ known.T), k, axis=1)[:, k] - slack * np.sqrt((x * x).sum(1))
            wide = np.hstack([x, np.zeros((len(x), int(padded)))])
            found: list[list[dict]] = [[] for _ in x]
            for t, s in enumerate(sign):
                for own, first, rest in zip(found, *probed_buckets(wide, s, probes)):
                    order = np.argsort(first, kind="stable")
                    cell, at = np.unique(first[order], return_index=True)
                    own += [{"cell": int(c) + t * 2 * sign.shape[3], "rests": r} for c, r in zip(cell, np.split(rest[order], at[1:]))]
            kind = pa.list_(pa.struct([("cell", pa.int32()), ("rests", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bound), pa.array(found, kind)], [*b.schema.names, "bound", "cells"])

    return run


def _best(query: np.ndarray, candidate: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query: by score, then by smaller id."""
    order = np.lexsort((candidate, -score, query))
    q = query[order]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[rank < k]


#: What a block tells of a query: its best vectors there with their scores.
FOUND = "query_id long, reps array<bigint>, scores array<double>"
NOTHING = pd.DataFrame({"query_id": np.zeros(0, np.int64), "reps": pd.Series([], dtype=object), "scores": pd.Series([], dtype=object)})


def _lists(query: np.ndarray, rep: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """One row for each query with its k best."""
    best = _best(query, rep, score, k)
    if not len(best):
        return NOTHING
    ids, at = np.unique(query[best], return_index=True)
    return pd.DataFrame({"query_id": ids, "reps": pd.Series(np.split(rep[best], at[1:]), dtype=object), "scores": pd.Series(np.split(score[best], at[1:]), dtype=object)})


def _score_cell(dims: int, k: int) -> Callable:
    """One block of a cell with queries -> each query's k + 1 best of the vectors in buckets that it probes, as far as they reach its bound."""

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return NOTHING
        candidates = candidates.sort_values("rest")
        x = np.array(candidates["v"].tolist(), np.float64).reshape(-1, dims)
        q = np.array(queries["v"].tolist(), np.float64).reshape(-1, dims)
        rest, rep, ids, bound = candidates["rest"].to_numpy(), candidates["rep"].to_numpy(), queries["query_id"].to_numpy(), queries["bound"].to_numpy()
        asked = np.concatenate(queries["rests"].tolist())
        who = np.repeat(np.arange(len(q)), [len(r) for r in queries["rests"]])
        begin, end = np.searchsorted(rest, asked), np.searchsorted(rest, asked, side="right")
        who, begin, n = who[end > begin], begin[end > begin], (end - begin)[end > begin]
        starts = np.cumsum(n) - n
        out = []
        for lo in range(0, int(n.sum()), STEP_PAIRS):
            pair = np.arange(lo, min(lo + STEP_PAIRS, int(n.sum())))
            at = np.searchsorted(starts, pair, side="right") - 1
            row, col = who[at], begin[at] + pair - starts[at]
            score = np.einsum("ij,ij->i", q[row], x[col])
            ok = score >= bound[row]
            out.append((ids[row][ok], rep[col][ok], score[ok]))
        if not out:
            return NOTHING
        return _lists(*(np.concatenate(c) for c in zip(*out)), k + 1)

    return run


def _score_block(dims: int, k: int) -> Callable:
    """One block of vectors with queries -> each query's k + 1 best in it (one more, for the query's own copy)."""

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return NOTHING
        x = np.array(candidates["v"].tolist(), np.float64).reshape(-1, dims)
        rep = candidates["rep"].to_numpy()
        out = []
        for at in range(0, len(queries), 1024):
            part = queries.iloc[at : at + 1024]
            q = np.array(part["v"].tolist(), np.float64).reshape(-1, dims)
            s = q @ x.T
            n = min(k + 1, len(rep))
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            edge = np.take_along_axis(s, top, 1).min(1)
            row, col = np.nonzero(s >= edge[:, None])  # ties at the edge stay, then go by id
            out.append(_lists(part["query_id"].to_numpy()[row], rep[col], s[row, col], k + 1))
        return pd.concat(out)

    return run


def usable(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id and a non-null, non-zero vector whose components are all finite."""
    v = F.col(vector) if dict(vectors.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    return vectors.where(F.col(id_).isNotNull() & v.isNotNull() & ~bad & ~zero).select(F.col(id_).cast("long").alias("vec_id"), v.alias("v"))


def _length_task(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the Euclidean length of v, without overflow of the squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), dims)
            most = np.abs(x).max(axis=1, initial=0.0)
            length = most * np.sqrt(((x / most[:, None]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(length)], [*b.schema.names, "length"])

    return run


def _every(rep: DataFrame, n: int, asked: DataFrame, queries: int, dims: int, k: int) -> DataFrame:
    """Each query's best of all n candidates, in tasks of bounded blocks of both."""
    parts, blocks = -(-queries // QUERY_ROWS), -(-n // BLOCK_ROWS)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    x = rep.select(F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"), each(parts).alias("part"), "rep", "v")
    q = asked.select(each(blocks).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), "query_id", "v")
    return x.groupBy("block", "part").cogroup(q.groupBy("block", "part")).applyInPandas(_score_block(dims, k), FOUND)


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, stride: int = QUERY_STRIDE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by `stride` its k nearest found among all other rows.

    Nearness is the inner product in double precision; ties go to the smaller id; a query gets fewer
    than k rows only if there are fewer other rows. Vectors that are null, zero, of another length than the
    first usable one's, or hold null or non-finite components take no part; nor do rows without id.
    Of repeated ids each row counts as a candidate; a query id asks once, with its smallest vector.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    dims = rows.agg(F.min_by(F.size("v"), "vec_id")).first()[0] or 1
    rows = rows.where(F.size("v") == dims)
    # equal vectors: one candidate with its k + 1 smallest ids; partial lists are cut as they are merged
    rep = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"), F.count("*").alias("n"))
    rep = rep.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.sum("n").alias("n"))
    kind = dict(rows.dtypes)["v"]
    rep = rep.select(F.col("ids")[0].alias("rep"), "ids", "v", "n").mapInArrow(_length_task(dims), f"rep long, ids array<long>, v {kind}, n long, length double")
    rep = settle(rep.withColumn("band", F.floor(F.log2("length") + 0.5)), "vectors")  # from 0.71 to 1.41 times a power of two
    asked = rows.where(F.col("vec_id") % stride == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"), F.count("*").alias("own"))
    asked = settle(asked, "queries")
    bands = rep.groupBy("band").agg(F.max("length").alias("longest"), F.min("length").alias("shortest"), F.count("*").alias("vectors"), F.sum("n").alias("rows")).collect()  # about 2,100 at most
    queries, total = asked.count(), sum(r.rows for r in bands)
    small = {r.band: r.vectors for r in bands if r.vectors <= SMALL_BAND}
    large = [r for r in bands if r.band not in small]
    longest = {r.band: r.longest for r in large} if any(r.shortest < r.longest * (1 - EVEN) for r in large) else {}
    most = max((r.vectors for r in large), default=1)
    axes, probes = axes_for(most, dims + bool(longest)), int(probes * max(1.0, (PROBED_AT / most) ** 0.5))
    sample = rep.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("v").collect()
    sample = spark.sparkContext.broadcast(np.array([r.v for r in sample], np.float64).reshape(-1, dims))
    hashed = rep.where(~F.col("band").isin(list(small))).select("rep", "v", "band").mapInArrow(_hash_task(dims, tables, axes, longest), f"rep long, v {kind}, band long, cells {CELL}")
    hashed = hashed.select("rep", "v", "band", F.inline("cells"))
    probing = asked.select("query_id", "v").mapInArrow(_probe_task(dims, tables, axes, probes * 3 ** (axes - 2), bool(longest), sample, k), f"query_id long, v {kind}, bound double, cells {PROBE}")
    probing = probing.select("query_id", "v", "bound", F.inline("cells"))
    # the tables' cells number 2 * tables * padded dims a band at most
    blocks = settle(hashed.groupBy("band", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "blocks")
    parts = settle(probing.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts")), "parts")
    sizes = F.broadcast(blocks.join(F.broadcast(parts), "cell"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = hashed.join(sizes, ["band", "cell"]).select("band", "cell", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), each("parts").alias("part"), "rep", "rest", "v")
    asked_of = probing.join(sizes, "cell").select("band", "cell", each("blocks").alias("block"), F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), "query_id", "bound", "rests", "v")
    key = ["band", "cell", "block", "part"]
    found = dealt.groupBy(*key).cogroup(asked_of.groupBy(*key)).applyInPandas(_score_cell(dims, k), FOUND)
    if small and queries:
        found = found.union(_every(rep.where(F.col("band").isin(list(small))), sum(small.values()), asked, queries, dims, k))

    def ranked(found: DataFrame) -> DataFrame:
        """The k best rows of each query. Lists are merged in two steps, so that no task gathers all that was found for one query."""

        def merged(rows: DataFrame, *by: str) -> DataFrame:
            gathered = rows.groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("all"))
            once = F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["rep"] != x["rep"]))
            near = F.slice(F.sort_array(F.transform(once, lambda x: F.struct(x["s"].alias("s"), x["rep"].alias("rep")))), 1, k + 1)
            return gathered.select(*by, F.transform(near, lambda x: F.struct(x["rep"].alias("rep"), x["s"].alias("s"))).alias("best"))

        lists = found.select("query_id", F.pmod(F.xxhash64("reps"), F.lit(16)).alias("salt"), F.zip_with("reps", "scores", lambda r, s: F.struct(r.alias("rep"), (-s).alias("s"))).alias("best"))
        reps = merged(merged(lists, "query_id", "salt"), "query_id").select("query_id", F.inline("best"))
        ids = reps.join(rep.select("rep", "ids"), "rep").select("query_id", "s", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        return ids.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "vec_id"))), 1, k).alias("best"))

    best = settle(ranked(found), "best")
    held = asked.join(best, "query_id", "left").where(F.coalesce(F.size("best"), F.lit(0)) < F.least(F.lit(k), F.lit(total) - F.col("own")))
    few = settle(held.select("query_id", "v"), "few")
    lacking = few.count()
    if lacking:
        best = best.join(few, "query_id", "left_anti").union(ranked(_every(rep, sum(r.vectors for r in bands), few, lacking, dims, k)))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
