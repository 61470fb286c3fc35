"""Running sums along keys of any length: sorted ranges are scanned by numpy and joined at their edges.

Rows are range-partitioned by key and order, so the rows of one key may lie in many partitions. Each task
scans its own run of every key; of the first and last key of a partition the run's length and sum go to
the driver (two rows a partition at most), which says where each run of a divided key starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import partitions, settle

U = np.uint64
Batches = Iterator[pa.RecordBatch]


def _run_task(key: str, terms: list[str], base: int, before: bool) -> Callable[[Batches], Batches]:
    """Sorted rows -> the same with their place in the key's run and the run's sums so far; then one row for the first and the last key."""

    def run(batches: Batches) -> Batches:
        at, sums, last, first, ended = 0, np.zeros(len(terms), U), None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            carried = last is not None and keys[0] == last
            if last is not None and not carried and ended is None:
                ended = (at, sums)  # the first key ended with the batch before
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            run_of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
            place = np.arange(n) - begin[run_of]
            if carried:
                place[run_of == 0] += at
            made, without = [], []
            for k, t in enumerate(terms):
                value = batch.column(t).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
                value = value if base == 1 else value * _power(place, base)
                total = np.cumsum(value, dtype=U)
                made.append(total - np.where(begin > 0, total[begin - 1], U(0))[run_of])
                if carried:
                    made[-1][run_of == 0] += sums[k]
                without.append(made[-1] - value)
            first = keys[0] if first is None else first
            if ended is None and len(begin) > 1:
                ended = (int(place[begin[1] - 1]) + 1, np.array([m[begin[1] - 1] for m in made], U))
            at, sums, last = int(place[-1]) + 1, np.array([m[-1] for m in made], U), keys[-1]
            yield _with(batch, place, made, without, False)
        if first is None:
            return
        edges = [(first, *ended), (last, at, sums)] if ended else [(last, at, sums)]
        n, pid = len(edges), batch.column("pid")[0].as_py()
        own = [pa.array([e[0] for e in edges], f.type) if f.name == key else pa.array([pid] * n, f.type) if f.name == "pid" else pa.nulls(n, f.type) for f in batch.schema]
        whole = list(np.array([e[2] for e in edges], U).reshape(n, len(terms)).T)
        yield _with(pa.RecordBatch.from_arrays(own, batch.schema.names), np.array([e[1] for e in edges]), whole, whole, True)

    def _with(batch: pa.RecordBatch, place: np.ndarray, made: list[np.ndarray], without: list[np.ndarray], edge: bool) -> pa.RecordBatch:
        extra = [pa.array(place.astype(np.int64)), *(pa.array(np.ascontiguousarray(m).view(np.int64)) for m in (made + without if before else made)), pa.array(np.full(batch.num_rows, edge))]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "at", *_made(terms, before), "edge"])

    return run


def _made(terms: list[str], before: bool) -> list[str]:
    return [f"sum_{t}" for t in terms] + [f"before_{t}" for t in terms if before]


def _power(exponents: np.ndarray, base: int) -> np.ndarray:
    """base ** each exponent modulo 2 ** 64, by squaring, however large the exponents are."""
    out, factor, left = np.ones(len(exponents), U), base, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * U(factor), out)
        left >>= 1
        factor = factor * factor % (1 << 64)
    return out


def _join_task(key: str, names: list[str], base: int, starts: dict[int, dict[int, tuple[int, list[int]]]]) -> Callable[[Batches], Batches]:
    """Runs that continue a key get the place and the sums with which they start."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            pid, keys = batch.column("pid").to_numpy(zero_copy_only=False), batch.column(key).to_numpy(zero_copy_only=False)
            place = batch.column("at").to_numpy(zero_copy_only=False).copy()
            made = [batch.column(c).to_numpy(zero_copy_only=False).view(U).copy() for c in names]
            for p in np.unique(pid).tolist():
                for k, (offset, sums) in starts.get(p, {}).items():
                    own = (pid == p) & (keys == k)
                    place[own] += offset
                    for m, s in zip(made, sums + sums):
                        m[own] = m[own] * U(pow(base, offset, 1 << 64)) + U(s)
            fresh = {"at": pa.array(place)} | {c: pa.array(m.view(np.int64)) for c, m in zip(names, made)}
            yield pa.RecordBatch.from_arrays([fresh.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return run


def scanned(rows: DataFrame, key: str, order: list[str], terms: list[str], name: str, base: int = 1, ranges: list[Column] | None = None, drop: tuple[str, ...] = (), before: bool = False) -> DataFrame:
    """rows with `at`, a row's place in its key from 0 on, and for each term sum_<term>: the sum of term * base ** place up to the row, modulo 2 ** 64;
    if asked for, before_<term> is the same without the row's own part.

    `key` is a long that is never null, `order` the columns that order a key's rows (with `desc` or `nulls first`), `ranges` what ranges are
    divided by after the key where the order itself is too long for that, `drop` columns that only the order needs. Places of equal rows are arbitrary.
    """
    by = [F.col(key), *map(_sorted, order)]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), F.col(key), *(ranges if ranges is not None else by[1:]))
    ready = dealt.sortWithinPartitions(*by).drop(*drop).withColumn("pid", F.spark_partition_id())
    extra = [StructField("at", LongType()), *(StructField(c, LongType()) for c in _made(terms, before)), StructField("edge", BooleanType())]
    local = settle(ready.mapInArrow(_run_task(key, terms, base, before), StructType([StructField(f.name, f.dataType) for f in ready.schema] + extra)), name)
    edges = local.where("edge").select("pid", key, "at", *(f"sum_{t}" for t in terms)).collect()
    starts, so_far = {}, {}
    for e in sorted(edges, key=lambda e: e[0]):
        k = e[1]
        offset, sums = so_far.get(k, (0, [0] * len(terms)))
        if offset:
            starts.setdefault(e[0], {})[k] = (offset, sums)
        grown = pow(base, offset, 1 << 64)
        so_far[k] = (offset + e[2], [(s + (x % (1 << 64)) * grown) % (1 << 64) for s, x in zip(sums, e[3:])])
    whole = local.where("not edge").drop("edge")
    return whole.mapInArrow(_join_task(key, _made(terms, before), base, starts), whole.schema).drop("pid") if starts else whole.drop("pid")


def _sorted(order: str) -> Column:
    c, _, how = order.partition(" ")
    return {"": F.col(c).asc(), "desc": F.col(c).desc(), "nulls first": F.col(c).asc_nulls_first()}[how]
