"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document gets a 60-bit hash of its id. Sizes are summed by source and by the hash's leading
bits; a running sum over those few sums finds the bucket in which a source's budget is crossed; only
that bucket is split by the next bits, until one hash is left. Documents are then kept by comparing
their hash with their source's threshold: nothing is sorted, and no task ever holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, settle

#: Weights by the order of sources (code points, null last), repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all sizes; no target exceeds so many times its source's size.
SHARE, MOST = 1.5, 2
#: Leading bits that each level adds; five levels use the whole hash.
LEVEL_BITS, LEVELS = 12, 5
#: Sources up to which the one-row-per-source table is broadcast; beyond, Spark joins by source and splits hot ones.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """The number of runs of characters other than space and tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 of the id as text (a null id is the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> target: SHARE of all sizes by weight, filled up to MOST times each source's size.

    The excess of sources at their limit is shared by weight among the others. In order of limit
    per weight, the sources at their limit come first; the level of the rest is what remains
    divided by their weights. One row per source goes through the window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (turn + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * MOST)
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(SHARE)
    full = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("weight").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (budget - full) / open_)
    held = F.col("level") * F.col("weight") <= F.col("limit")  # true from the first source below its limit on
    level = F.min(F.when(held, F.struct(F.col("limit") / F.col("weight"), "source", "level"))).over(everything)["level"]
    share = F.coalesce(level * F.col("weight"), F.col("limit").cast("double"))
    return rows.select("source", "source_size", F.least(share, F.col("limit").cast("double")).alias("target"))


def _small(rows: DataFrame, sources: int) -> DataFrame:
    """A hint to broadcast rows of which each source has one, behind a check of their number."""
    return F.broadcast(rows) if sources <= BROADCAST_SOURCES else rows


def thresholds(docs: DataFrame, budgets: DataFrame, sources: int) -> DataFrame:
    """(source, hash, size) and (source, budget) -> (source, threshold): take hashes below the threshold.

    The sizes below it come as near to the budget as whole hashes can: the one that crosses the
    budget is in if that leaves the smaller error.
    """
    sure = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * LEVEL_BITS
        if level == 1:
            own = docs
        else:
            inside = F.expr(f"shiftright(hash, {shift + LEVEL_BITS})") == F.col("s_prefix")
            at = sure.select(F.col("source").alias("s_source"), F.col("prefix").alias("s_prefix"))
            own = docs.join(_small(at, sources), docs["source"].eqNullSafe(at["s_source"]) & inside, "left_semi")
        bucket = F.expr(f"shiftright(hash, {shift})")
        sums = own.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        open_ = sure.select(F.col("source").alias("s_source"), "budget", "before")
        sums = sums.join(_small(open_, sources), sums["source"].eqNullSafe(open_["s_source"])).drop("s_source")
        running = Window.partitionBy("source").orderBy("bucket")  # 2 ** LEVEL_BITS rows of a source at most
        up_to = F.col("before") + F.sum("size").over(running)
        sums = sums.withColumn("up_to", up_to)
        crossed = sums.where("up_to > budget").groupBy("source", "budget").agg(F.min_by(F.struct("bucket", "up_to", "size"), "bucket").alias("x"))
        sure = crossed.select("source", "budget", F.col("x.bucket").alias("prefix"), (F.col("x.up_to") - F.col("x.size")).alias("before"), F.col("x.size").alias("size"))
        sure = settle(sure, "thresholds")
    take = F.col("budget") - F.col("before") > F.col("before") + F.col("size") - F.col("budget")
    return sure.select("source", (F.col("prefix") + take.cast("long")).alias("threshold"))


def mix(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source and others) with size, source_size, target, taken on each row.

    size: words of the text (null: none). source_size, target: of the row's source (null is a
    source like others, last in order). taken: size times the copies the mix takes, 0 to 2. If a
    source's target exceeds its size, all its documents are taken once and the rest is drawn again
    by the same hash, so mixes of growing budgets are nested. Rows of one doc_id share a hash and
    are taken together. Sources without words have target 0 and none taken. An empty table gives
    an empty result. New columns with taken names get an underscore. Reruns agree.
    """
    names = {n: free_name(docs, n) for n in ("size", "source_size", "target", "taken")}
    narrow = docs.select("doc_id", "source", words(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("hash"), F.struct(*docs.columns).alias("row"))
    return _mixed(narrow).select("row.*", *(F.col(n).alias(names[n]) for n in names))


def _mixed(rows: DataFrame) -> DataFrame:
    sized = settle(rows.select("source", "hash", "size"), "sizes")
    per_source = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    sources = per_source.count()
    again = F.col("target") > F.col("source_size")
    budget = F.when(again, F.col("target") - F.col("source_size")).otherwise(F.col("target"))
    cut = thresholds(sized, per_source.select("source", budget.alias("budget")), sources)
    per_source = per_source.join(cut, per_source["source"].eqNullSafe(cut["source"]), "left").select(per_source["source"].alias("s_source"), "source_size", "target", "threshold")
    copies = (F.col("target") > F.col("source_size")).cast("long") + F.coalesce(F.col("hash") < F.col("threshold"), F.col("target") > 0).cast("long")
    joined = rows.join(_small(per_source, sources), rows["source"].eqNullSafe(F.col("s_source")))
    return joined.withColumn("taken", F.col("size") * copies)


def mix_digest(docs: DataFrame) -> DataFrame:
    """Sizes, targets and what the mix takes of all documents, without their texts."""
    narrow = docs.select("doc_id", "source", words(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("hash"))
    return _mixed(narrow).select("doc_id", "size", "source_size", "target", "taken")


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as it is taken."""
    mixed = mix(docs)
    size, taken = mixed.columns[-4], mixed.columns[-1]
    copies = F.when(F.col(size) > 0, (F.col(taken) / F.col(size)).cast("int")).otherwise(0)
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), copies)).alias(taken)).select(*docs.columns)


#: The mix as one query for DuckDB.
SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size, 2 * sum(size)::bigint as lim from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3)::int + 1] as weight from s),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(lim) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
         / sum(weight) over (order by lim / weight, source nulls last rows between current row and unbounded following) as level from w),
t as (select source, source_size, lim, least(lim::double, coalesce(weight * (select arg_min(level, lim / weight) from l where level * weight <= lim), lim::double)) as target from l),
b as (select *, case when target > source_size then target - source_size else target end as budget from t),
g as (select source, h, sum(size) as size from d group by source, h),
c as (select g.source, g.h, g.size, budget, sum(g.size) over (partition by g.source order by g.h) as up_to
      from g join b on g.source is not distinct from b.source),
x as (select source, min(h) as h, arg_min(up_to, h) as up_to, arg_min(size, h) as size, any_value(budget) as budget from c where up_to > budget group by source),
th as (select source, h + case when budget - (up_to - size) > up_to - budget then 1 else 0 end as threshold from x)
select d.doc_id, d.size, b.source_size, b.target,
       (d.size * ((case when b.target > b.source_size then 1 else 0 end)
        + (case when coalesce(d.h < th.threshold, b.target > 0) then 1 else 0 end)))::bigint as taken
from d join b on d.source is not distinct from b.source left join th on d.source is not distinct from th.source
"""
