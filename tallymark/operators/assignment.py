"""One-to-one assignment: sources in order each take their best free target.

The rule is one sequence, but only inside what edges connect. Where the caller names a column that all edges of a source and of a target
share (an equality key), one shuffle by it puts whole sequences into tasks, which read their edges in
order, in a stream, and hold no more than the targets taken so far. Else a bounded number of parallel rounds settles
what has no long chains of refusals; the components of what is left are then walked in the same way.
So the number of jobs does not grow with ties or chains.

Where nearness of two numbers is the only rule, all pairs are equally good and none is made: see assign_near.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

Settle = Callable[[DataFrame], DataFrame]
#: Parallel rounds before what is left is walked by components.
ROUNDS = 4
#: Rows of a cell of the line, and cells for each partition at most.
CELL_ROWS, CELLS = 1 << 16, 4


def components(links: DataFrame, settle: Settle) -> DataFrame:
    """(a, b) -> (id, root): each id with the smallest id it is connected to, itself counted.

    Every id points to its smallest neighbour or itself, and pointers are doubled until all reach an end; ends that links
    still connect go through the same again. Each pass at least halves them.
    """
    edges = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = settle(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("root", F.col("id")))
    while not (edges := settle(edges.where("a <> b"))).isEmpty():
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        points = settle(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("b")))
        while True:
            ahead = points.where("a <> b").select(F.col("a").alias("b"), F.col("b").alias("c"))
            further = points.join(ahead, "b", "left")
            points = settle(further.select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
            if points.where("moved").isEmpty():
                break
            points = points.drop("moved")
        to = points.select(F.col("a").alias("root"), F.col("b").alias("end"))
        roots = settle(roots.join(to, "root", "left").select("id", F.coalesce("end", "root").alias("root")))
        of = [to.select(F.col("root").alias(c), F.col("end").alias(f"{c}_end")) for c in "ab"]
        moved = edges.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("a_end", "a").alias("a"), F.coalesce("b_end", "b").alias("b"))
        edges = settle(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return roots


def _walk_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of whole groups by source, best first -> each source with its first target that is free."""
    group, source, taken, served = object(), object(), set(), False
    for batch in batches:
        kept = []
        columns = (batch.column(c).to_pylist() for c in ("_group", "_source", "_target"))
        for k, (g, s, t) in enumerate(zip(*columns)):
            if g != group:
                group, source, taken = g, object(), set()
            if s != source:
                source, served = s, False
            if not served and t not in taken:
                taken.add(t)
                served = True
                kept.append(k)
        rows = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("_source", "_target", "_confidence")], ["_source", "_target", "_confidence"])


def _walked(edges: DataFrame) -> DataFrame:
    """(_group, _source, _target, _confidence, _order) -> the assignment in each group."""
    ready = edges.repartition("_group").sortWithinPartitions("_group", "_source", F.desc("_confidence"), "_order", "_target")
    kinds = {f.name: f.dataType for f in edges.schema}
    return ready.mapInArrow(_walk_task, StructType([StructField(n, kinds[n]) for n in ("_source", "_target", "_confidence")]))


def _choices(edges: DataFrame) -> DataFrame:
    """Each source with its best edge."""
    best = F.min(F.struct((-F.col("_confidence")).alias("c"), "_order", "_target"))
    return edges.groupBy("_source").agg(best.alias("m")).select("_source", F.col("m._target").alias("_target"), (-F.col("m.c")).alias("_confidence"))


def assign(edges: DataFrame, source_order: str, target_key: str, target_order: str, within: str | None = None, settle: Settle | None = None) -> DataFrame:
    """Rows source, target, confidence: sources in order each take their best free target (confidence, then target order).

    `within` names a column that all edges of one source and all of one target agree on. Repeated edges count once, with their best
    confidence. Edges of a null source or target count as of one more source or target. `settle` cuts lineage between rounds; the default is checkpoint().
    """
    settle = settle or (lambda df: df.checkpoint())
    names = [F.col(source_order).alias("_source"), F.col(target_key).alias("_target"), (-F.col("confidence")).cast(DoubleType()).alias("c"), F.col(target_order).alias("_order")]
    group = [F.col(within).alias("_group")] if within else []
    best = edges.select(*names, *group).groupBy(*(["_group"] if within else []), "_source", "_target").agg(F.min(F.struct("c", "_order")).alias("b"))
    each = best.select(*(["_group"] if within else []), "_source", "_target", (-F.col("b.c")).alias("_confidence"), F.col("b._order").alias("_order"))
    out = _walked(each) if within else _by_rounds(settle(each), settle)
    return out.select(F.col("_source").alias(source_order), F.col("_target").alias(target_key), F.col("_confidence").alias("confidence"))


def _by_rounds(edges: DataFrame, settle: Settle) -> DataFrame:
    """All targets rank sources alike, so the outcome is the one stable matching: sources ask their best target that has not refused them, and targets keep the first."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    for _ in range(ROUNDS):
        choice = settle(_choices(edges))
        winner = choice.groupBy(F.col("_target").alias("_t")).agg(F.min("_source").alias("_winner"))
        refused = settle(choice.join(winner, same("_target", "_t")).where(~same("_source", "_winner")).select(F.col("_source").alias("_s"), "_t"))
        if refused.isEmpty():
            return choice
        edges = settle(edges.join(refused, same("_source", "_s") & same("_target", "_t"), "left_anti"))
    hubs = edges.groupBy(F.col("_target").alias("_t")).agg(F.min("_source").alias("_hub"))
    roots = components(edges.join(hubs, same("_target", "_t")).select(F.col("_source").alias("a"), F.col("_hub").alias("b")), settle)
    unsettled = roots.join(refused, same("id", "_s"), "left_semi").select(F.col("root").alias("_group")).distinct()
    open_ = settle(roots.join(unsettled, same("root", "_group"), "left_semi").select(F.col("id").alias("_s"), F.col("root").alias("_group")))
    rest = edges.join(open_, same("_source", "_s")).select("_group", "_source", "_target", "_confidence", "_order")
    calm = _choices(edges.join(open_, same("_source", "_s"), "left_anti"))
    return calm.unionByName(_walked(rest))


class _Free:
    """Free targets, numbered by rank, in places on a line; a tree of minima finds the first one between two places."""

    def __init__(self, places: np.ndarray, count: int):
        self.order = np.argsort(places, kind="stable").tolist()
        self.ends = np.searchsorted(places[self.order], np.arange(count), side="right").tolist()
        self.at = [0, *self.ends][:count]
        self.none = len(places)
        self.base = 1 << max(count - 1, 0).bit_length()
        self.least = [self.none] * (2 * self.base)
        for p, k in enumerate(self.at):
            self.least[self.base + p] = self.order[k]
        for k in range(self.base - 1, 0, -1):
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])

    def first(self, low: int, high: int) -> int:
        """The least rank in the places from low to below high; `none` if there is no free target."""
        found, least, low, high = self.none, self.least, low + self.base, high + self.base
        while low < high:
            if low & 1:
                found = min(found, least[low])
                low += 1
            if high & 1:
                high -= 1
                found = min(found, least[high])
            low, high = low >> 1, high >> 1
        return found

    def take(self, place: int) -> None:
        """The first target of a place is free no more."""
        self.at[place] += 1
        least, k = self.least, place + self.base
        least[k] = self.order[self.at[place]] if self.at[place] < self.ends[place] else self.none
        while k > 1:
            k >>= 1
            now = min(least[2 * k], least[2 * k + 1])
            if least[k] == now:
                break
            least[k] = now


def settled_stretch(sources: np.ndarray, targets: np.ndarray, width: float, begin: float | None, end: float | None) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Sources and targets (numbers in order of rank) from `begin` to below `end` of a line -> (pairs, sources left, targets left).

    A source takes its first free target that is `width` off at most. Near an open end, neighbours may take part: a
    source that reaches what is in doubt is left, and all it reaches is in doubt from then on. So doubt grows from the
    ends, and what lies between is settled for good. None is an end of the line.
    """
    values, places = np.unique(targets, return_inverse=True)
    n = len(values)
    low, high = np.searchsorted(values, sources - width), np.searchsorted(values, sources + width, side="right")
    line = np.concatenate([[-np.inf], values, [np.inf]])  # rounding of the sum may hide a target that the difference shows
    while (more := sources - line[low] <= width).any():
        low = low - more
    while (less := sources - line[low + 1] > width).any():
        low = low + less
    while (more := line[high + 1] - sources <= width).any():
        high = high + more
    while (less := line[high] - sources > width).any():
        high = high - less
    left = int((values - begin <= width).sum()) if begin is not None else 0
    right = int((end - values > width).sum()) if end is not None else n
    before = sources - begin <= width if begin is not None else np.zeros(len(sources), bool)
    after = end - sources <= width if end is not None else np.zeros(len(sources), bool)
    free, pairs, open_ = _Free(places, n), [], []
    own = places.tolist()
    for k, (a, b, p, q) in enumerate(zip(low.tolist(), high.tolist(), before.tolist(), after.tolist())):
        if a < b:
            p, q = p or a < left, q or b > right
        if p or q:
            open_.append(k)
            left, right = max(left, b) if p else left, min(right, a) if q else right
        elif a < b and (t := free.first(a, b)) < free.none:
            free.take(own[t])
            pairs.append((k, t))
    taken = {t for _, t in pairs}
    return pairs, open_, [t for t, place in enumerate(own) if (place < left or place >= right) and t not in taken]


def _stretch_task(bounds: list[float], width: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (_stretch, _side, _source, _target, _at) of whole stretches, targets first and each side by rank -> their pairs, with _side null, and the rows that are left."""

    def done(number: int, rows: pa.Table) -> pa.Table:
        at = rows.column("_at").to_numpy()
        first = int((rows.column("_side").to_numpy() == 0).sum())
        ends = (bounds[k] if 0 <= k < len(bounds) else None for k in (number - 1, number))
        pairs, sources, targets = settled_stretch(at[first:], at[:first], width, *ends)
        rows = rows.drop_columns(["_stretch"])
        rows = rows.cast(pa.schema([pa.field(f.name, f.type) for f in rows.schema]))
        s, t = (rows.take(pa.array([p[k] + first * (k == 0) for p in pairs], pa.int64())) for k in (0, 1))
        made = pa.table([pa.nulls(len(pairs), pa.int32()), s.column("_source"), t.column("_target"), s.column("_at")], schema=rows.schema)
        return pa.concat_tables([made, rows.take(pa.array([*targets, *(first + k for k in sources)], pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for batch in batches:
            of = batch.column("_stretch").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a < b and of[a] != number:
                    if held:
                        yield from done(number, pa.Table.from_batches(held)).to_batches()
                    number, held = int(of[a]), []
                held += [batch.slice(a, b - a)] if a < b else []
        if held:
            yield from done(number, pa.Table.from_batches(held)).to_batches()

    return run


def assign_near(sources: DataFrame, targets: DataFrame, width: float, settle: Settle | None = None) -> DataFrame:
    """The assignment of `assign` where all pairs that are `width` apart at most are equally good: rows (_source, _target).

    `sources` has (_source, _at) and `targets` (_target, _at): keys, each in one row only, and finite numbers. No pair is made. The line of numbers
    is cut into stretches, and each is one sequence for one task; only what may hang together with the next stretch is left. The
    next round cuts in the middle of half the stretches, so a round has twice the length around what is left, and the last has no cuts: the number of
    rounds is a logarithm of that of the stretches.
    """
    settle = settle or (lambda df: df.checkpoint())
    spark = sources.sparkSession
    s = sources.select(F.lit(1).alias("_side"), "_source", F.lit(None).cast(targets.schema["_target"].dataType).alias("_target"), F.col("_at").cast("double").alias("_at"))
    t = targets.select(F.lit(0).alias("_side"), F.lit(None).cast(sources.schema["_source"].dataType).alias("_source"), "_target", F.col("_at").cast("double").alias("_at"))
    rows = settle(s.union(t))
    most = min(rows.count() // CELL_ROWS, CELLS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = 1 << max(most, 1).bit_length() - 1
    cuts = rows.approxQuantile("_at", [k / cells for k in range(1, cells)], 0.25 / cells) if cells > 1 else []
    kinds = StructType([StructField(f.name, f.dataType) for f in rows.schema])
    pairs, step = [], 1
    while True:
        bounds = cuts[step - 1 :: 2 * step]
        stretch = F.pandas_udf(lambda at, b=np.array(bounds): pd.Series(np.searchsorted(b, at, side="right").astype("int32")), "int")
        placed = rows.select(stretch("_at").alias("_stretch"), "_side", "_source", "_target", "_at")
        ready = placed.repartition("_stretch").sortWithinPartitions("_stretch", "_side", "_source", "_target")
        found = settle(ready.mapInArrow(_stretch_task(bounds, width), kinds))
        pairs.append(found.where("_side is null").select("_source", "_target"))
        rows, step = found.where("_side is not null"), 2 * step
        if not bounds or rows.where("_side = 1").isEmpty():
            return reduce(DataFrame.union, pairs)
