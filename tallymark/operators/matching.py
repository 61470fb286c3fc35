"""Reconciliation: weighted rules, blocking, scoring, one-to-one assignment."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.values import as_text, family, free_name, moment, money, rounded, trim
from .assignment import assign, assign_near
from .joins import Width, band_counts, band_join, gram_join

MAX_TEXT, MAX_PATTERN, KEY_CHARS = 10_000, 200, 256


@dataclass
class Rule:
    name: str
    source: str
    target: str
    operator: str
    weight: float = 50
    required: bool = False
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.name or not self.source or not self.target or not 1 <= self.weight <= 100:
            raise ValueError("a rule needs a name, both fields and a weight from 1 to 100")
        if self.operator not in ("equals", "equals_tolerance", "contains", "regex", "similarity", "date_range"):
            raise ValueError(f"unknown operator {self.operator}")
        if self.operator == "similarity" and self.options.get("algorithm", "jaro_winkler") not in sim.MEASURES:
            raise ValueError(f"unknown algorithm {self.options['algorithm']}")


def _search_batch(subject: pd.Series, pattern: pd.Series) -> pd.Series:
    import re

    out = []
    for s, p in zip(subject, pattern):
        try:
            out.append(s is not None and p is not None and len(p) <= MAX_PATTERN and len(s) <= MAX_TEXT and re.search(p, s, re.I) is not None)
        except re.error:
            out.append(False)
    return pd.Series(out, dtype="boolean")


def rule(r: Rule, a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """A rule as a column: a null on either side fails it."""
    x, y = as_text(a, kinds[0]), as_text(b, kinds[1])
    o = r.options
    if r.operator == "equals":
        same = family(kinds[0]) == family(kinds[1])
        if same and family(kinds[0]) == "string" and not o.get("case_sensitive", True):
            a, b = F.lower(a), F.lower(b)
        out = a == b if same else F.lit(False)
    elif r.operator == "equals_tolerance":
        u, v = (c.cast("double") if family(k) == "number" else money(c) for c, k in zip((a, b), kinds))
        out = F.abs(u - v) <= o.get("tolerance", 0)
    elif r.operator in ("contains", "regex") and not o.get("unsafe"):
        if not o.get("case_sensitive", False):
            x, y = F.lower(x), F.lower(y)
        out = F.contains(x, y) | (F.contains(y, x) if r.operator == "contains" else F.lit(False))
    elif r.operator == "regex":
        out = F.pandas_udf(_search_batch, "boolean")(x, y)
    elif r.operator == "similarity":
        if not o.get("case_sensitive", False):
            x, y = F.lower(x), F.lower(y)
        how = o.get("algorithm", "jaro_winkler")
        measure = sim.MEASURES[how]
        short = F.greatest(F.char_length(x), F.char_length(y)) <= MAX_TEXT
        out = F.when(short, measure(x, y) >= o.get("threshold", 0.85))
    else:
        out = F.abs(moment(a, kinds[0]) - moment(b, kinds[1])) <= o.get("days", 0) * 86_400_000_000
    return F.coalesce(out, F.lit(False))


def block_key(c: Column, how: str = "exact", length: int = 4, case_sensitive: bool = False) -> Column:
    """exact, prefix, soundex or cologne_phonetic; null and empty give no key, a phonetic key of marks is one."""
    base = trim(c.cast("string"))
    base = F.substring(base if case_sensitive else F.lower(base), 1, KEY_CHARS)
    base = F.when(base != "", base)
    if how == "prefix":
        return F.substring(base, 1, length)
    if how == "soundex":
        return sim.soundex(base)
    if how == "cologne_phonetic":
        code = sim.cologne(base)
        return F.when(code != "", code)
    return base


def _sides(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    return source.select(*(F.col(c).alias(f"s_{c}") for c in source.columns)), target.select(*(F.col(c).alias(f"t_{c}") for c in target.columns))


def _band(rules: list[Rule], kinds: tuple[dict, dict]) -> Width | None:
    """The first required tolerance or date rule of some width."""
    for r in rules:
        if r.required and r.operator == "equals_tolerance" and r.options.get("tolerance", 0) > 0:
            sides = [F.col(f"{p}_{c}").cast("double") if family(k[c]) == "number" else money(F.col(f"{p}_{c}")) for p, c, k in (("s", r.source, kinds[0]), ("t", r.target, kinds[1]))]
            return Width(*sides, r.options["tolerance"])
        if r.required and r.operator == "date_range" and r.options.get("days", 0) > 0:
            return Width(moment(F.col(f"s_{r.source}"), kinds[0][r.source]).cast("double"), moment(F.col(f"t_{r.target}"), kinds[1][r.target]).cast("double"), r.options["days"] * 86_400_000_000)
    return None


#: Similarities whose threshold bounds which n-grams two texts must share.
BY_GRAMS = {"levenshtein": "levenshtein", "dice_sorensen": "dice", "jaccard": "jaccard"}


def candidates(source: DataFrame, target: DataFrame, rules: list[Rule], block: tuple | None = None) -> DataFrame:
    """All pairs that can match, with s_ and t_ columns.

    Required equals rules become join keys, as does a configured block (source field, target field,
    how, and for a prefix its length); sources without a block key or whose bucket is empty meet all targets as if no block
    were given. A required tolerance or date rule adds the bucket of its width to these keys, or is the key alone. Without any of these a required
    similarity by n-grams is joined by rare grams, and one that is equality of codes by the codes. Only rules without any key
    meet by a cross join.
    """
    s, t = _sides(source, target)
    return _met(s, t, rules, (dict(source.dtypes), dict(target.dtypes)), block)


def _met(s: DataFrame, t: DataFrame, rules: list[Rule], kinds: tuple[dict, dict], block: tuple | None) -> DataFrame:
    band = _band(rules, kinds)
    if block:
        key = free_name("block", s, t)
        keyed_s = s.withColumn(key, block_key(as_text(F.col(f"s_{block[0]}"), kinds[0][block[0]]), *block[2:]))
        keyed_t = t.withColumn(key, block_key(as_text(F.col(f"t_{block[1]}"), kinds[1][block[1]]), *block[2:]))
        lone = keyed_s.join(keyed_t.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").drop(key)
        inside = band_join(keyed_s, keyed_t, [key], band) if band else keyed_s.join(keyed_t, key)
        return inside.drop(key).unionByName(_met(lone, t, rules, kinds, None))
    exact = [r for r in rules if r.required and r.operator == "equals"]
    if exact:
        on = []
        for r in exact:
            key, case = free_name("key", s, t), r.options.get("case_sensitive", True)
            s = s.withColumn(key, block_key(as_text(F.col(f"s_{r.source}"), kinds[0][r.source]), case_sensitive=case))
            t = t.withColumn(key, block_key(as_text(F.col(f"t_{r.target}"), kinds[1][r.target]), case_sensitive=case))
            on.append(key)
        return (band_join(s, t, on, band) if band else s.join(t, on)).drop(*on)
    if band:
        return band_join(s, t, [], band)
    for r in rules:
        how, least = r.options.get("algorithm", "jaro_winkler"), r.options.get("threshold", 0.85)
        if not r.required or r.operator != "similarity" or least <= 0:
            continue
        x, y = as_text(F.col(f"s_{r.source}"), kinds[0][r.source]), as_text(F.col(f"t_{r.target}"), kinds[1][r.target])
        if not r.options.get("case_sensitive", False):
            x, y = F.lower(x), F.lower(y)
        if how in BY_GRAMS and least <= 1:
            return gram_join(s, t, x, y, BY_GRAMS[how], least)
        if how == "soundex" and least >= 1:
            key = free_name("key", s, t)
            return s.withColumn(key, sim.soundex(x)).join(t.withColumn(key, sim.soundex(y)), key).drop(key)
    return s.crossJoin(t)


def scored(source: DataFrame, target: DataFrame, rules: list[Rule], min_confidence: float = 50, block: tuple | None = None) -> DataFrame:
    """Candidates that meet the required rules and the threshold, with confidence, matched and failed rule names."""
    if not rules:
        raise ValueError("at least one rule is needed")
    kinds = dict(source.dtypes), dict(target.dtypes)
    pairs = candidates(source, target, rules, block)
    hits = {f"_r{i}": rule(r, F.col(f"s_{r.source}"), F.col(f"t_{r.target}"), (kinds[0][r.source], kinds[1][r.target])) for i, r in enumerate(rules)}
    pairs = pairs.withColumns(hits)
    need = [F.col(f"_r{i}") for i, r in enumerate(rules) if r.required]
    pairs = pairs.where(reduce(lambda a, b: a & b, need)) if need else pairs
    won = reduce(lambda a, b: a + b, (F.when(F.col(f"_r{i}"), float(r.weight)).otherwise(0.0) for i, r in enumerate(rules)))
    names = lambda yes: F.array_join(F.array_compact(F.array(*(F.when(F.col(f"_r{i}") == yes, F.lit(r.name)) for i, r in enumerate(rules)))), ",")
    out = pairs.withColumns({"confidence": rounded(won / sum(r.weight for r in rules) * 100), "matched": names(True), "failed": names(False)})
    return out.where(F.col("confidence") >= min_confidence).drop(*hits)


def assigned_near(source: DataFrame, source_key: str, target: DataFrame, target_key: str, r: Rule) -> DataFrame:
    """The assignment by one required tolerance rule alone, in the order of both keys: s_ and t_ key and confidence, as `assign` gives it for `scored`.

    No pair is made, as all are equally good. Keys that several rows have need their pairs, so these are made then.
    """
    if r.operator != "equals_tolerance" or not r.required:
        raise ValueError("one required tolerance rule is needed")
    names = f"s_{source_key}", f"t_{target_key}"
    if any(not side.groupBy(key).count().where("count > 1").isEmpty() for side, key in ((source, source_key), (target, target_key))):
        return assign(scored(source, target, [r]), *names, names[1])
    sides = []
    for side, key, field, name in ((source, source_key, r.source, "_source"), (target, target_key, r.target, "_target")):
        at = F.col(field).cast("double") if family(dict(side.dtypes)[field]) == "number" else money(F.col(field))
        sides.append(side.select(F.col(key).alias(name), at.alias("_at")).where(~F.isnan("_at") & (F.abs("_at") < float("inf"))))
    return assign_near(*sides, r.options.get("tolerance", 0)).select(F.col("_source").alias(names[0]), F.col("_target").alias(names[1]), F.lit(100.0).alias("confidence"))


def counted(source: DataFrame, target: DataFrame, r: Rule) -> DataFrame:
    """(moment, pairs): how many pairs of a date rule the source rows of each moment have, counted without making them."""
    if r.operator != "date_range":
        raise ValueError("pairs are counted for date rules only")
    found = band_counts(source, target, moment(F.col(r.source), dict(source.dtypes)[r.source]), moment(F.col(r.target), dict(target.dtypes)[r.target]), math.floor(r.options.get("days", 0) * 86_400_000_000))
    return found.select(F.timestamp_micros("value").alias("moment"), "pairs")


def unmatched(side: DataFrame, key: str, matched: DataFrame, matched_key: str) -> DataFrame:
    """Rows whose key text no match has."""
    used = matched.select(F.coalesce(F.col(matched_key).cast("string"), F.lit("unknown")).alias("_used")).distinct()
    return side.join(used, F.coalesce(F.col(key).cast("string"), F.lit("unknown")) == F.col("_used"), "left_anti")


def summary(source: DataFrame, source_key: str, target: DataFrame, target_key: str, matches: DataFrame, matched: tuple[str, str]) -> DataFrame:
    """One row: matched, unmatched_source, unmatched_target, match_rate (percent of source rows; 100 of none) and average confidence."""
    one = matches.agg(F.count("*").alias("matched"), rounded(F.avg("confidence")).alias("average"))
    lone = [unmatched(side, key, matches, m).agg(F.count("*").alias(name)) for side, key, m, name in ((source, source_key, matched[0], "unmatched_source"), (target, target_key, matched[1], "unmatched_target"))]
    rows = source.agg(F.count("*").alias("rows"))
    whole = one.crossJoin(F.broadcast(lone[0])).crossJoin(F.broadcast(lone[1])).crossJoin(F.broadcast(rows))  # one row each
    rate = F.when(F.col("rows") == 0, 100.0).otherwise(rounded(F.col("matched") * 100.0 / F.col("rows")))
    return whole.select("matched", "unmatched_source", "unmatched_target", rate.alias("match_rate"), "average")
