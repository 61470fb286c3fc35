"""String similarity and phonetic codes. All but Jaro and the Cologne code are plain columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein(a: Column, b: Column) -> Column:
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, 1.0).when(F.least(F.char_length(a), F.char_length(b)) == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def ngrams(c: Column, n: int = 2) -> Column:
    """The set of n-grams; a text shorter than n is one gram."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.array_distinct(grams)


def dice(a: Column, b: Column, n: int = 2) -> Column:
    x, y = ngrams(a, n), ngrams(b, n)
    return F.when(a == b, 1.0).when(F.least(F.char_length(a), F.char_length(b)) == 0, 0.0).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def jaccard(a: Column, b: Column, n: int = 2) -> Column:
    x, y = ngrams(a, n), ngrams(b, n)
    return F.when(a == b, 1.0).when(F.least(F.char_length(a), F.char_length(b)) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    m, swapped = len(left), sum(x != y for x, y in zip(left, right))
    return (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3


def _jaro_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro(x, y) for x, y in zip(a, b)], dtype="float64")


def jaro(a: Column, b: Column) -> Column:
    return F.pandas_udf(_jaro_batch, "double")(a, b)


def jaro_winkler(a: Column, b: Column, scale: float = 0.1) -> Column:
    """Jaro raised by a common prefix of up to four characters, whatever the Jaro value."""
    same = [F.substring(a, 1, k) == F.substring(b, 1, k) for k in range(1, 5)]
    long_enough = [F.least(F.char_length(a), F.char_length(b)) >= k for k in range(1, 5)]
    prefix = sum((F.when(s & ok, 1).otherwise(0) for s, ok in zip(same, long_enough)), F.lit(0))
    j = jaro(a, b)
    return j + prefix * scale * (1 - j)


def _code_likeness(x: str, y: str) -> float:
    if x == y:
        return 1.0
    same = [p == q for p, q in zip(x, y)]
    prefix = same.index(False) if False in same else len(same)
    return (0.6 * sum(same) + 0.4 * prefix) / max(len(x), len(y))


def _code_batch(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or q is None else _code_likeness(p, q) for p, q in zip(x, y)], dtype="float64")


def cologne_similarity(a: Column, b: Column) -> Column:
    """1 for equal Cologne codes, else by the places of the longer code: 0.6 for each equal one, 0.4 for each of the common prefix."""
    return F.pandas_udf(_code_batch, "double")(cologne(a), cologne(b))


def sounds_alike(a: Column, b: Column) -> Column:
    """Both have one Cologne code."""
    return cologne(a) == cologne(b)


#: Spellings of German names that stand for one another.
NAME_FORMS = {"schmidt": ("schmitt", "schmid"), "meier": ("meyer", "maier", "mayer")}


def spellings(c: Column) -> Column:
    """The distinct spellings of a name: lower case, umlauts written out, vowel pairs as umlauts, other forms of common names."""
    low = F.lower(c)
    out, back = low, low
    for mark, pair in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(mark), F.lit(pair))
        back = back if mark == "ß" else F.replace(back, F.lit(pair), F.lit(mark))
    other = [F.when(F.contains(low, F.lit(name)), F.regexp_replace(low, f"^(.*?){name}", f"$1{form}")) for name, forms in NAME_FORMS.items() for form in forms]
    return F.array_distinct(F.array_compact(F.array(low, out, back, *other)))




def composite(parts: list[tuple[Column, float]]) -> Column:
    """The weighted mean of similarities; 0 if the weights are."""
    total = sum(w for _, w in parts)
    return sum((c * w for c, w in parts), F.lit(0.0)) / total if total else F.lit(0.0)


def soundex(c: Column) -> Column:
    """The first letter and three digits; vowels and H, W, Y all end a run; text without letters is 0000."""
    letters = F.regexp_replace(F.upper(F.translate(F.upper(c), "ÄÖÜ", "")), "[^A-Z]", "")
    codes = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    tail = F.replace(F.substring(F.regexp_replace(codes, r"(.)\1+", "$1"), 2, 1_000_000), F.lit("0"), F.lit(""))
    return F.when(letters == "", "0000").otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), F.substring(tail, 1, 3)), 4, "0"))


def soundex_similarity(a: Column, b: Column) -> Column:
    """Codes are bound by a transform, so that each is made once, not once for each of its uses."""
    codes = F.transform(F.array(F.struct(soundex(a).alias("x"), soundex(b).alias("y"))), lambda c: code_similarity(c["x"], c["y"]))
    return F.get(codes, 0)


def code_similarity(x: Column, y: Column) -> Column:
    """The share of equal places of two soundex codes."""
    return F.when(x == y, 1.0).otherwise(sum((F.when(F.substring(x, k, 1) == F.substring(y, k, 1), 1).otherwise(0) for k in range(1, 5)), F.lit(0)) / 4)


def contract_umlauts(c: Column) -> Column:
    """Lower case; ae, oe, ue and umlauts become the plain vowel, sharp s becomes ss."""
    c = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    for pair, vowel in (("ae", "a"), ("oe", "o"), ("ue", "u")):
        c = F.replace(c, F.lit(pair), F.lit(vowel))
    return F.translate(c, "äöü", "aou")


def german(c: Column) -> Column:
    """Lower case; umlauts and sharp s expanded, accents dropped, white space collapsed."""
    c = F.lower(c)
    for mark, pair in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        c = F.replace(c, F.lit(mark), F.lit(pair))
    return F.trim(F.regexp_replace(F.translate(c, "àáâãåçèéêëìíîïñòóôõùúûýÿ", "aaaaaceeeeiiiinoooouuuyy"), r"\s+", " "))


def _cologne(text: str) -> str:
    """The published Kölner Phonetik rules on letters only."""
    t = [c for c in text.upper() if "A" <= c <= "Z"]
    out = []
    for i, c in enumerate(t):
        before, after = t[i - 1] if i else "", t[i + 1] if i + 1 < len(t) else ""
        if c in "AEIJOUY":
            code = "0"
        elif c == "H":
            continue
        elif c == "B" or c == "P" and after != "H":
            code = "1"
        elif c in "DT":
            code = "8" if after and after in "CSZ" else "2"
        elif c in "FVWP":
            code = "3"
        elif c in "GKQ" or c == "C" and (after and after in ("AHKLOQRUX" if not i else "AHKOQUX")) and before not in ("S", "Z"):
            code = "4"
        elif c == "X":
            code = "8" if before and before in "CKQ" else "48"
        else:
            code = {"L": "5", "M": "6", "N": "6", "R": "7"}.get(c, "8")
        out.append(code)
    raw = "".join(out)
    slim = "".join(c for i, c in enumerate(raw) if not i or c != raw[i - 1])
    return slim[:1] + slim[1:].replace("0", "")


def _cologne_batch(c: pd.Series) -> pd.Series:
    return c.map(_cologne, na_action="ignore")


def cologne(c: Column) -> Column:
    return F.pandas_udf(_cologne_batch, "string")(german(c))


MEASURES = {"levenshtein": levenshtein, "jaro": jaro, "jaro_winkler": jaro_winkler, "dice_sorensen": dice, "jaccard": jaccard, "soundex": soundex_similarity, "cologne_phonetic": cologne_similarity}
