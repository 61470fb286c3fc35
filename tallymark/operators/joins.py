"""Joins by nearness that lose no pair: numeric bands inside equality keys, and n-gram sets by rare prefixes.

Both turn a condition into equality of keys, so that Spark can shuffle by them: a band into neighbouring buckets of its own
width, a set similarity into sets of a few rare grams of which two similar texts must share one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.values import free_name

#: Slots of the table that tells how frequent grams are.
SLOTS = 1024
GRAM = 2


@dataclass
class Width:
    """A band: both sides as numbers, and how far apart they may be."""

    source: Column
    target: Column
    width: float


def band_join(s: DataFrame, t: DataFrame, on: list[str], band: Width) -> DataFrame:
    """Pairs that agree on the columns `on` and lie in neighbouring buckets of the band: a superset of those in the band.

    Each target lies in three buckets, so that no pair is lost. The bucket is part of the key, so
    rows of one frequent key are dealt by their numbers. Null numbers, NaN and infinities meet nothing.
    Both sides grow with the tables, so neither is broadcast.
    """
    place = free_name("band", s, t)
    # the width grows a little, so that rounding of the division cannot part two numbers by more than one bucket
    at = lambda c: F.floor(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) / (band.width * (1 + 1e-9)))
    one = at(band.target)
    s, t = s.withColumn(place, at(band.source)), t.withColumn(place, F.explode(F.array(one - 1, one, one + 1)))
    return s.hint("merge").join(t, [*on, place]).drop(place)


def band_counts(s: DataFrame, t: DataFrame, x: Column, y: Column, width: int) -> DataFrame:
    """(value, pairs): for each distinct whole number x of s, how many pairs its rows have with rows of t whose y is `width` off at most.

    No pair is made: each y opens at y - width and closes after y + width, and a running sum tells how many are open at x.
    Sums run inside stretches of the line that are longer than a band; a band that reaches into the next stretch opens there
    again. Rows of equal numbers are one. Values without pairs and nulls are left out.
    """
    span = 2 * width + 1
    stretch = lambda c: c - F.pmod(c, F.lit(span))
    counted = lambda df, c: df.select(c.cast("long").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    event = lambda at, of, place, delta, rows: F.struct(of.alias("stretch"), at.alias("at"), F.lit(place).alias("place"), delta.alias("delta"), rows.alias("rows"))
    v, n, none = F.col("v"), F.col("n"), F.lit(0).cast("long")
    first, last = v - F.lit(width), v + F.lit(width)
    again = F.when(stretch(last) > stretch(first), event(stretch(last), stretch(last), 0, n, none))
    bands = counted(t, y).select(F.explode(F.array(event(first, stretch(first), 0, n, none), again, event(last, stretch(last), 2, -n, none))).alias("e")).where("e is not null")
    asked = counted(s, x).select(event(v, stretch(v), 1, none, n).alias("e"))
    open_ = F.sum("delta").over(Window.partitionBy("stretch").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0))
    found = bands.union(asked).select("e.*").withColumn("open", open_).where("place = 1 and open > 0")
    return found.select(F.col("at").alias("value"), (F.col("open") * F.col("rows")).alias("pairs"))


def gram_classes(*texts: DataFrame) -> Column:
    """A text of SLOTS characters: how frequent, in powers of two, the grams of the texts (frames of one column `text`) are that hash to each slot."""
    grams = texts[0]
    for more in texts[1:]:
        grams = grams.union(more)
    counted = grams.select(F.explode(sim.ngrams(F.col("text"), GRAM)).alias("g")).groupBy(_slot(F.col("g")).alias("slot")).agg(F.count("*").alias("n")).collect()
    found = {r.slot: r.n for r in counted}
    return F.lit("".join(chr(ord("0") + found.get(k, 0).bit_length()) for k in range(SLOTS)))


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def least_common(measure: str, n: Column, length: Column, threshold: float) -> Column:
    """Grams that a text of n distinct grams has at least in common with any text that is similar enough.

    Jaccard: |x & y| >= t |x|. Dice: |y| is at least the overlap, so |x & y| >= t |x| / (2 - t). Levenshtein: the longer
    text has length / t characters at most, so there are (1 - t) length / t edits at most, and each takes GRAM grams at most.
    """
    if measure == "jaccard":
        return F.ceil(n * threshold - 1e-9)
    if measure == "dice":
        return F.ceil(n * threshold / (2 - threshold) - 1e-9)
    return n - GRAM * F.floor(length * (1 - threshold) / threshold + 1e-9)


#: Grams that make one key, and keys a text has at most where it has keys of more than one gram.
SHARED, KEYS = 4, 128


def shared_grams(least: Column, spare: Column) -> Column:
    """How many grams a text's keys are made of: as many as KEYS allows, `least` at most."""
    out = F.lit(1)
    for k in range(2, SHARED + 1):
        most = max(m for m in range(KEYS) if math.comb(m + k, k) <= KEYS)
        out = F.when((least >= k) & (spare <= most), k).otherwise(out)
    return out


def gram_keys(ranked: Column, spare: Column, k: int) -> Column:
    """The hashes of all sets of k of the first spare + k grams, each in the order of the grams."""
    grams = F.slice(ranked, 1, spare + k)
    sets = F.transform(grams, lambda g, i: F.struct(i.alias("last"), F.xxhash64(F.lit(k), g).alias("hash")))
    for _ in range(k - 1):
        longer = lambda c: F.transform(F.slice(grams, c["last"] + 2, F.size(grams)), lambda g, i: F.struct((c["last"] + 1 + i).alias("last"), F.xxhash64(c["hash"], g).alias("hash")))  # noqa: B023, E731
        sets = F.flatten(F.transform(sets, longer))
    return F.transform(sets, lambda c: c["hash"])


#: Dice similarity (of jaccard its dice form) and levenshtein similarity from which texts meet by parts or segments first.
BY_PARTS, BY_SEGMENTS = 0.85, 0.8
#: Edits of a pair of texts at most that meets by segments, and pairs of one key beyond which its texts meet by rare grams instead.
EDITS, CROWD = 4, 1 << 20


def part_keys(grams: Column, n: Column, others: tuple[int, int], share: float, ratio: float, most: int) -> Column:
    """Keys (level, key) of a set of n grams, of which two sets have one in common if they differ in `share` of their sizes' sum at most.

    Two sets that differ in h grams at most, dealt by hash to h + q parts, have q equal parts at least; a key is a set of q parts.
    Levels are the h that partners of the sizes `others` (least, most) may have, rounded up, so that there are few.
    """
    differ = lambda sizes: F.floor(sizes * share + 1e-9)
    low = differ(n + F.greatest(F.ceil(n * ratio - 1e-9), F.lit(others[0])))
    high = differ(n + F.least(F.floor(n / ratio + 1e-9), F.lit(others[1])))
    levels = [0, 1, 2, 3, 4]
    while levels[-1] < most * share:
        levels.append(2 * levels[-2])
    made = []
    for before, h in zip([-1, *levels], levels):
        q = 3 if h <= 2 else 2 if h <= 12 else 1
        parts = lambda hashes: F.transform(F.sequence(F.lit(0), F.lit(h + q - 1)), lambda j: F.xxhash64(j, F.filter(hashes, lambda g: F.pmod(g, F.lit(h + q)) == j)))  # noqa: B023, E731
        sets = lambda ps: ps if q == 1 else F.array(*(F.xxhash64(*(F.get(ps, i) for i in c)) for c in combinations(range(h + q), q)))  # noqa: B023, E731
        keys = F.flatten(F.transform(F.transform(F.array(F.array_sort(F.transform(grams, lambda g: F.xxhash64(g)))), parts), sets))
        made.append(F.when((low <= h) & (high > before), F.transform(keys, lambda c: F.struct(F.lit(h).alias("level"), c.alias("key")))))  # noqa: B023
    return F.flatten(F.array_compact(F.array(*made)))


def _segment(text: Column, size: Column, edits: Column, place: Column, moved: Column | None = None) -> Column:
    """Key (level, key) of one of the edits + 1 even segments of a text of that size, or of what a text has there, some places further."""
    start, end = (F.floor(k * size / (edits + 1)) for k in (place, place + 1))
    found = F.substring(text, (start + 1 if moved is None else start + 1 + moved).cast("int"), (end - start).cast("int"))
    return F.struct(edits.cast("int").alias("level"), F.xxhash64(place.cast("int"), size.cast("int"), found).alias("key"))


def segment_keys(text: Column, length: Column, threshold: float, short: int, sizes: list[int] | None = None) -> Column:
    """Keys (level, key) of a text of `short` characters at most, of which two texts that are similar enough have one in common.

    A target, of its own size, is cut into one segment more than edits are allowed. Some segment i is then without edits,
    with i edits before it and edits - i after it at most (the first i at which edits up to i are fewer than segments), so
    a source has it i places off at most from the left, and edits - i from the right. A source (with `sizes`, those of the
    targets) has all texts at such places as keys, for each size.
    """
    edits = lambda size: F.floor(size * (1 - threshold) + 1e-9)
    longest = F.least(F.floor(length / threshold + 1e-9), F.lit(short))
    if sizes is None:
        return F.flatten(F.transform(F.sequence(edits(length), edits(longest)), lambda e: F.transform(F.sequence(F.lit(0).cast("long"), e), lambda i: _segment(text, length, e, i))))

    def places(size: Column, e: Column, i: Column) -> Column:
        start, end = (F.floor(k * size / (e + 1)) for k in (i, i + 1))
        moves = F.filter(F.sequence(-i, i), lambda d: (F.abs(d - (length - size)) <= e - i) & (start + d >= 0) & (end + d <= length))
        return F.transform(moves, lambda d: _segment(text, size, e, i, d))

    of_size = lambda size, e: F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), e), lambda i: places(size, e, i)))
    fitting = F.filter(F.array(*map(F.lit, sizes)).cast("array<bigint>"), lambda k: (k >= F.ceil(length * threshold - 1e-9)) & (k <= longest))
    return F.flatten(F.transform(fitting, lambda k: of_size(k, edits(F.greatest(k, length)))))


def crowded_keys(s: DataFrame, t: DataFrame) -> DataFrame:
    """Keys (level, key) of more than CROWD pairs."""
    sides = [side.select("level", "key", *(F.lit(int(k == at)).alias(name) for k, name in enumerate(("in_s", "in_t")))) for at, side in enumerate((s, t))]
    return sides[0].union(sides[1]).groupBy("level", "key").agg(F.sum("in_s").alias("s"), F.sum("in_t").alias("t")).where(F.col("s") * F.col("t") > CROWD).select("level", "key")


def gram_join(s: DataFrame, t: DataFrame, x: Column, y: Column, measure: str, threshold: float) -> DataFrame:
    """Pairs of which the texts x and y can be similar by `threshold` or more: a superset without any loss.

    Distinct texts, known by a hash, meet by equal keys. From thresholds BY_PARTS and BY_SEGMENTS on, they meet by parts of
    their sets of grams (dice, jaccard) or by segments (levenshtein, of up to EDITS edits), which are few and long. All else
    meets by rare grams: lower thresholds, longer texts, and the texts of keys that more than CROWD pairs share.

    There grams are ordered from rare to frequent. Of two texts with `least` grams in common, their first n - least + k share k
    at least. Texts meet by a set of k grams there, so that few unlike ones do; k is the
    smaller one of what both allow, and a text has keys of fewer grams than it allows only if there are texts of fitting size that
    need them. Texts so short that edits could take all their grams (levenshtein only) meet those of
    fitting length instead. Null texts meet nothing.

    Keys are many for each text, which estimates of sizes don't see: sides that grow with the tables are never broadcast.
    """
    names = {c: free_name(c, s, t) for c in ("text", "known")}
    of = lambda c, tag: F.col(f"{names.get(c, c)}_{tag}")
    ratio = threshold / (2 - threshold) if measure == "dice" else threshold
    fits = lambda p, q: F.least(p, q) >= F.greatest(p, q) * ratio - 1e-9
    share = {"dice": 1 - threshold, "jaccard": (1 - threshold) / (1 + threshold)}.get(measure)

    def whole(df: DataFrame, c: Column, tag: str) -> DataFrame:
        own = df.withColumn(f"{names['text']}_{tag}", c).where(of("text", tag).isNotNull())
        return own.withColumn(f"{names['known']}_{tag}", F.xxhash64(of("text", tag)))

    def sized(rows: DataFrame, tag: str) -> DataFrame:
        own = rows.select(of("text", tag).alias("text"), of("known", tag).alias("known")).distinct()
        own = own.withColumn("grams", sim.ngrams(F.col("text"), GRAM)).withColumn("n", F.size("grams"))
        own = own.withColumn("least", least_common(measure, F.col("n"), F.char_length("text"), threshold).cast("int"))
        own = own.withColumn("spare", F.col("n") - F.col("least")).withColumn("k", shared_grams(F.col("least"), F.col("spare")))
        return own.withColumn("long", F.char_length("text") if measure == "levenshtein" else F.col("n"))

    def keyed(own: DataFrame, classes: Column, others: list, tag: str) -> DataFrame:
        ranked = F.array_sort(F.transform("grams", lambda g: F.struct(F.substring(classes, _slot(g) + 1, F.lit(1)).alias("n"), g.alias("g"))))
        own = own.where("least > 0").withColumn("ranked", F.transform(ranked, lambda r: r["g"]))
        lower = {r.k: (F.col("long") * ratio - 1e-9 <= r.high) & (F.col("long") + 1e-9 >= r.low * ratio) for r in others}
        keys = lambda k: F.when((F.col("k") == k) | ((F.col("k") > k) & lower.get(k, F.lit(False))), gram_keys(F.col("ranked"), F.col("spare"), k))
        leveled = lambda k: F.transform(keys(k), lambda h: F.struct(F.lit(k).alias("level"), h.alias("key")))
        each = own.select("known", "k", "long", F.explode(F.flatten(F.array_compact(F.array(*(leveled(k) for k in range(1, SHARED + 1)))))).alias("m"))
        return each.select("m.level", "m.key", *(F.col(c).alias(f"{c}_{tag}") for c in ("known", "k", "long")))

    knowns = [F.col(f"known_{tag}").alias(f"{names['known']}_{tag}") for tag in "st"]

    def by_rare_grams(each: dict) -> DataFrame:
        classes = gram_classes(*(df.select("text") for df in each.values()))
        sizes = {tag: df.where("least > 0").groupBy("k").agg(F.min("long").alias("low"), F.max("long").alias("high")).collect() for tag, df in each.items()}
        met = keyed(each["s"], classes, sizes["t"], "s").hint("merge").join(keyed(each["t"], classes, sizes["s"], "t"), ["level", "key"])
        met = met.where((F.col("level") == F.least("k_s", "k_t")) & fits(F.col("long_s"), F.col("long_t")))
        return met.select(*knowns)

    size = free_name("length", s, t)
    long = lambda tag: F.char_length(of("text", tag))

    def by_length(p: DataFrame, q: DataFrame) -> DataFrame:
        """Pairs of fitting length of which one text could lose all its grams."""
        least = lambda tag: least_common(measure, F.size(sim.ngrams(of("text", tag), GRAM)), long(tag), threshold)
        reach = F.sequence(F.ceil(long("t") * threshold - 1e-9), F.floor(long("t") / threshold + 1e-9))
        by_size = lambda p, q: p.withColumn(size, long("s").cast("long")).hint("merge").join(q.withColumn(size, F.explode(reach)), size).drop(size)
        return by_size(p.where(least("s") <= 0), q).unionByName(by_size(p.where(least("s") > 0), q.where(least("t") <= 0)))

    a, b = whole(s, x, "s"), whole(t, y, "t")
    each = {"s": sized(a, "s"), "t": sized(b, "t")}
    extra = [f"{names[c]}_{tag}" for c in names for tag in "st"]
    # merged, not broadcast: both sides grow with the tables
    rows = lambda pairs: a.hint("merge").join(pairs.distinct(), extra[2]).hint("merge").join(b, extra[3]).drop(*extra)
    if threshold < BY_SEGMENTS if measure == "levenshtein" else 1 - share < BY_PARTS:
        found = rows(by_rare_grams(each))
        return found.unionByName(by_length(a, b).drop(*extra)) if measure == "levenshtein" else found

    spans = {tag: df.agg(F.coalesce(F.min("long"), F.lit(0)), F.coalesce(F.max("long"), F.lit(0))).first() for tag, df in each.items()}
    if measure == "levenshtein":
        longest = math.floor(max(spans["s"][1], spans["t"][1]) / threshold + 1e-9)
        short = max(k for k in range(longest + 1) if math.floor(k * (1 - threshold) + 1e-9) <= EDITS)
        sizes = [r.long for r in each["t"].where(F.col("long") <= short).select("long").distinct().collect()]
        keys = {tag: segment_keys(F.col("text"), F.col("long").cast("long"), threshold, short, sizes if tag == "s" else None) for tag in "st"}
        few = F.col("long") <= short
    else:
        keys = {tag: part_keys(F.col("grams"), F.col("n"), tuple(spans[other]), share, ratio, spans["s"][1] + spans["t"][1]) for tag, other in ("st", "ts")}
        few = F.lit(True)
    near = {tag: df.where(few).select(F.col("known").alias(f"known_{tag}"), F.explode(keys[tag]).alias("m")).select("m.level", "m.key", f"known_{tag}") for tag, df in each.items()}
    crowded = crowded_keys(near["s"], near["t"]).persist()  # at most a key for each CROWD pairs
    crowds = not crowded.isEmpty()
    met = near["s"].hint("merge").join(crowded, ["level", "key"], "left_anti") if crowds else near["s"]
    pairs = met.hint("merge").join(near["t"], ["level", "key"]).select(*knowns)

    def left(tag: str) -> DataFrame:
        """Texts that may have partners too long for segments, or have a crowded key."""
        own = each[tag]
        longer = own.where(F.floor(F.col("long") / threshold + 1e-9) > short) if measure == "levenshtein" else own.where(F.lit(False))
        if not crowds:
            return longer
        those = near[tag].hint("merge").join(crowded, ["level", "key"], "left_semi").select(F.col(f"known_{tag}").alias("known"))
        return own.hint("merge").join(those.unionByName(longer.select("known")), "known", "left_semi")

    if crowds or measure == "levenshtein" and longest > short:
        rest = {tag: left(tag).persist() for tag in "st"}
        pairs = pairs.unionByName(by_rare_grams(rest))
        if measure == "levenshtein":
            texts = [df.select(F.col("text").alias(f"{names['text']}_{tag}"), F.col("known").alias(f"{names['known']}_{tag}")) for tag, df in rest.items()]
            pairs = pairs.unionByName(by_length(*texts).select(extra[2], extra[3]))
    return rows(pairs)
