"""Keyed comparison of two growing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import as_text, free_name, named, qualified
from ..operators.compare import FieldPair, _field


def compare_streams(source: DataFrame, target: DataFrame, key: tuple[str, str], fields: list[FieldPair], times: tuple[str, str], lateness: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Rows key, status (match, difference, source_only, target_only), n_differences of two streams, or of two tables.

    Rows with one key meet if their times are at most `within` apart; each pair is compared. A row that meets none by then is reported once no row
    that could meet it can come, that is when both watermarks are `within` beyond it; rows later than `lateness` are not seen. State holds
    the rows of that span only. The observed metrics `comparison` count rows and matches of each batch. A null key counts as empty text.
    """
    kinds = dict(source.dtypes), dict(target.dtypes)
    k, at, there = (free_name(n, source, target) for n in ("key", "at", "there"))

    def side(df: DataFrame, name: str, time: str, own: dict) -> DataFrame:
        made = df.withColumns({k: F.coalesce(as_text(named(name), own[name]), F.lit("")), at: named(time).cast("timestamp"), there: F.lit(True)})
        return made.withWatermark(at, lateness) if df.isStreaming else made

    s, t = side(source, key[0], times[0], kinds[0]).alias("s"), side(target, key[1], times[1], kinds[1]).alias("t")
    span = F.expr(f"interval {within}")
    near = (qualified("s", at) >= qualified("t", at) - span) & (qualified("s", at) <= qualified("t", at) + span)
    joined = s.join(t, (qualified("s", k) == qualified("t", k)) & near, "full_outer")
    n = F.size(F.array_compact(F.array(*(_field(p, kinds) for p in fields)))) if fields else F.lit(0)
    status = F.when(qualified("t", there).isNull(), "source_only").when(qualified("s", there).isNull(), "target_only").when(n == 0, "match").otherwise("difference")
    rows = joined.select(F.coalesce(qualified("s", k), qualified("t", k)).alias("key"), status.alias("status"), F.when(status == "difference", n).otherwise(0).alias("n_differences"))
    return rows.observe("comparison", F.count("*").alias("rows"), F.count_if(F.col("status") == "match").alias("matches"))
