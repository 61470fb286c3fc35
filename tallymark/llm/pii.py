"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the base matches (e-mail, IP, card, phone) and looser shapes (national phone numbers,
SSN-like numbers, IBANs, names after a title). Four labelers vote 1, -1 or 0 on each: a strict
regular expression, gazetteers, cue words before the span, and the span's edges. The gazetteers are learned from
the corpus: they list the entries (domains' last labels, number prefixes, countries, surnames) that spans
of the strict shapes have often. Vote patterns are
counted over all documents; expectation-maximisation over those few counts estimates each labeler's
reliability; a naive Bayes span classifier is then trained on features of the spans weighted by the
posteriors. Base spans always stay, looser ones stay if the classifier says so.

Every pattern is linear in the text: runs are possessive and a match may only begin where a run
begins or where the last match ended, which gives the same leftmost matches as the plain patterns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: The base patterns (linear forms) in the order of kinds, then the looser shapes.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "local_phone": r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? [A-Z][a-z]{1,30}(?![A-Za-z])",
}
KINDS = [*BASE, *LOOSE]
#: A quick test that a text can hold a kind at all.
GATES = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Stricter shapes that the regex labeler looks for.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$",
    "card": r"^[0-9]{4}([ -]?)[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{1,4})?$",
    "phone": r"^\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}$",
    "local_phone": r"^(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-][2-9][0-9]{2}[ .-][0-9]{4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{13,32}$",
    "name": r"^[^ ]+ [A-Z][a-z]{2,14}$",
}
#: What of a span the gazetteers list: the last label of a domain, the leading digits or letters that a kind's numbering
#: plan assigns, a surname.
ENTRY = {
    "email": r"\.([A-Za-z]+)$", "ip": r"^([0-9]{1,3})\.", "card": r"^([0-9]{2})", "phone": r"^(\+[0-9]{2})",
    "local_phone": r"^\(?([0-9]{3})", "ssn": r"^([0-9]{3})", "iban": r"^([A-Z]{2})", "name": r" ([A-Z][a-z]+)$",
}
#: An entry is listed if this many spans of the strict shape have it at least, and more than half of all its spans; of
#: these the most frequent ones, so many of all kinds together.
LEAST_SPANS, LISTED = 3, 2_000
#: Words shortly before a span that speak for personal data, and words that speak against it.
CUES_FOR = r"(?i)(?:mail|e-mail|correo|courriel|contact|kontakt|phone|tel|telefon|teléfono|call|fax|card|karte|tarjeta|carte|visa|ip|address|host|from|ssn|social|iban|account|konto|cuenta|compte|dear|signed)[ .:=#]*$"
CUES_AGAINST = r"(?i)(?:version|ver|v|release|section|chapter|figure|table|isbn|doi|rfc|serial|build|port)[ .:=#]*$"
#: Characters of context on the left, and spans that one inner step places.
CONTEXT, STEP = 24, 512
VOTES = ["by_regex", "by_gazetteer", "by_cue", "by_edge"]
#: EM ends when no pattern's chance moves by more than this in a round, or after so many rounds.
SETTLED, ROUNDS = 1e-6, 2_000
KEEP_FROM = 0.5


def spans(text: Column, kind: str) -> Column:
    """All leftmost matches: array of (start, end, body, left, right) in code points, end exclusive."""
    pattern = BASE.get(kind) or LOOSE[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # whole arrays are zipped: an array named inside a function of its elements is made anew for each of them
    parts = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("body"), F.char_length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("left")))
    parts = F.zip_with(parts, F.slice(gaps, 2, F.size(found)), lambda p, g: F.struct(p["body"].alias("body"), p["gap"].alias("gap"), p["left"].alias("left"), F.left(g, F.lit(1)).alias("right")))
    return _placed(parts)


SPAN = "array<struct<start:bigint,end:bigint,body:string,left:string,right:string>>"


def _placed(parts: Column) -> Column:
    """Running positions of spans. Two levels of steps, as appending to one long array is quadratic."""
    empty = F.from_json(F.lit("[]"), SPAN)

    blocks = F.get(F.transform(F.array(parts), lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / STEP).cast("int")), lambda b: F.slice(own, b * STEP + 1, F.lit(STEP)))), 0)

    def one(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.char_length(p["body"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["body"].alias("body"), p["left"].alias("left"), p["right"].alias("right")))).alias("out"))

    def block(acc: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(acc["at"].alias("at"), empty.alias("out")), one)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array(empty).alias("out"))
    return F.when(F.size(parts) > 0, F.flatten(F.aggregate(blocks, start, block)["out"])).otherwise(empty)


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def valid(kind: str, body: Column) -> Column:
    """The checks that a match of a base pattern must pass."""
    if kind == "ip":
        return F.forall(F.split(body, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    n = F.length(_digits(body))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(body))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, order, base, start, end, body, left, right) of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.col("text").rlike("[0-9]").alias("digit"), F.col("text").rlike("(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señora?|Monsieur|Madame)[. ]").alias("title"))
    found = []
    for order, kind in enumerate(KINDS):
        gate = {"email": F.lit(True), "name": F.col("title")}.get(kind, F.col("digit"))
        if kind in GATES:
            gate = gate & F.contains(F.col("text"), F.lit(GATES[kind]))
        own = F.when(gate, spans(F.col("text"), kind)).otherwise(F.from_json(F.lit("[]"), SPAN))
        if kind in BASE:
            own = F.filter(own, lambda s: valid(kind, s["body"]))
        found.append(F.transform(own, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("order"), F.lit(kind in BASE).alias("base"), s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body"), s["left"].alias("left"), s["right"].alias("right"))).alias(kind))
    rows = rows.select("doc_id", *found)
    return rows.select("doc_id", F.concat(*KINDS).alias("spans"))


def _per_kind(kind: Column, patterns: dict[str, str], body: Column) -> Column:
    out = F.lit(False)
    for k, p in patterns.items():
        out = F.when(kind == k, body.rlike(p)).otherwise(out)
    return out


def entry(s: Column) -> Column:
    """What gazetteers may list of a span, with its kind."""
    found = F.lit("")
    for kind, pattern in ENTRY.items():
        found = F.when(s["kind"] == kind, F.lower(F.regexp_extract(s["body"], pattern, 1))).otherwise(found)
    return F.concat(s["kind"], F.lit(" "), found)


def gazetteer(each: DataFrame) -> list[str]:
    """The listed entries of all spans s: LISTED at most."""
    rows = each.select(entry(F.col("s")).alias("entry"), _per_kind(F.col("s")["kind"], STRICT, F.col("s")["body"]).alias("strict"))
    counts = rows.groupBy("entry").agg(F.count_if("strict").alias("n_strict"), F.count("*").alias("n"))
    often = counts.where((F.col("n_strict") >= LEAST_SPANS) & (F.col("n_strict") * 2 > F.col("n")) & ~F.col("entry").endswith(" "))
    return sorted(r.entry for r in often.orderBy(F.desc("n_strict"), "entry").limit(LISTED).collect())


def votes(s: Column, listed: list[str]) -> list[Column]:
    """The four labelers' votes on a span."""
    strict = F.when(_per_kind(s["kind"], STRICT, s["body"]), 1).otherwise(-1)
    known = entry(s).isin(listed) if listed else F.lit(False)  # a hashed set
    gazetteer = F.when(known, 1).otherwise(-1)
    cue = F.when(s["left"].rlike(CUES_FOR), 1).when(s["left"].rlike(CUES_AGAINST), -1).otherwise(0)
    open_left = (s["left"] == "") | s["left"].rlike(r"[\s(\[<\"':,;=]$")
    open_right = (s["right"] == "") | s["right"].rlike(r"^[\s)\]>\"'.,;:!?]")
    edge = F.when(open_left & open_right, 1).when(~open_left & ~open_right, -1).otherwise(0)
    return [strict, gazetteer, cue, edge]


def reliabilities(counts: list[tuple[tuple, int]]) -> tuple[float, list[dict]]:
    """EM over the counts of vote patterns: the share of true spans, and for each labeler the chance of each vote on true and on other spans."""
    true = {p: 0.5 + 0.4 * math.tanh(sum(p)) for p, _ in counts}
    prior, chance = 0.5, []
    for _ in range(ROUNDS):
        total = sum(n for _, n in counts)
        weight = sum(n * true[p] for p, n in counts)
        prior = (weight + 1) / (total + 2)
        chance = []
        for j in range(len(VOTES)):
            own = {}
            for v in (-1, 0, 1):
                yes = sum(n * true[p] for p, n in counts if p[j] == v)
                no = sum(n * (1 - true[p]) for p, n in counts if p[j] == v)
                own[v] = ((yes + 0.5 + (v == 1)) / (weight + 2.5), (no + 0.5 + (v == -1)) / (total - weight + 2.5))
            chance.append(own)
        new = {p: posterior(p, prior, chance) for p, _ in counts}
        moved = max((abs(new[p] - true[p]) for p in new), default=0.0)
        true = new
        if moved < SETTLED:
            break
    return prior, chance


def posterior(pattern: tuple, prior: float, chance: list[dict]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(chance[j][v][0] / chance[j][v][1]) for j, v in enumerate(pattern))
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))


def _features(s: Column, v: list[Column]) -> Column:
    """The span classifier's features, each as name=value of a small range."""
    digits = F.least(F.length(_digits(s["body"])), F.lit(20))
    values = {
        "kind": s["kind"], "length": F.least(F.floor(F.length(s["body"]) / 3), F.lit(15)), "digits": digits,
        "strict": v[0], "gazetteer": v[1], "cue": v[2], "edge": v[3],
        "right": F.when(s["right"] == "", "none").when(s["right"].rlike(r"\s"), "space").when(s["right"].rlike(r"[A-Za-z0-9]"), "word").otherwise("mark"),
    }
    return F.array(*(F.concat(F.lit(f"{k}="), x.cast("string")) for k, x in values.items()))


def added(rows: DataFrame) -> DataFrame:
    """(row, added): of each row's loose spans those that meet no base span and no loose span that is likelier.

    One sort per text finds how far base spans that start before a loose span's end reach. What is left falls into runs of
    spans that overlap; only spans of one run are compared with each other.
    """
    numbers = F.concat(
        F.transform("base_spans", lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("turn"), s["end"].alias("reach"), F.get(F.filter("loose", lambda x: F.lit(False)), 0).alias("s"))),
        F.transform("loose", lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("reach"), s.alias("s"))),
    )
    events = rows.where(F.size("loose") > 0).select("row", F.inline(numbers))
    so_far = Window.partitionBy("row").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    clear = events.withColumn("reach", F.max("reach").over(so_far)).where("s is not null and coalesce(reach, 0) <= s.start").select("row", "s")
    before = Window.partitionBy("row").orderBy("s.start", "s.end", "s.order").rowsBetween(Window.unboundedPreceding, -1)
    opens = clear.withColumn("opens", (F.coalesce(F.max("s.end").over(before), F.lit(0)) <= F.col("s.start")).cast("int"))
    runs = opens.withColumn("run", F.sum("opens").over(Window.partitionBy("row").orderBy("s.start", "s.end", "s.order").rowsBetween(Window.unboundedPreceding, 0)))
    meet = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    first = lambda x, y: F.struct(-x["probability"], x["start"], x["order"]) < F.struct(-y["probability"], y["start"], y["order"])
    each = runs.groupBy("row", "run").agg(F.collect_list("s").alias("own"))
    kept = each.select("row", F.filter("own", lambda s: ~F.exists("own", lambda o: meet(o, s) & first(o, s))).alias("own"))
    return kept.groupBy("row").agg(F.flatten(F.collect_list("own")).alias("added"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (start, order, kind, end, body, base, probability), sorted, of every whole text.

    base: spans of the base patterns, all of which stay. Others stay if the classifier gives them
    0.5 or more, they overlap no base span and no other span that is likelier. A null or empty text has none; a null doc_id and
    repeated rows are rows like all others; an empty table gives no rows; other columns are ignored.
    """
    rows = settle(candidates(docs), "candidates")
    each = rows.select(F.explode("spans").alias("s"))
    listed = gazetteer(each)
    voted = each.select(*(v.alias(n) for n, v in zip(VOTES, votes(F.col("s"), listed))))
    counts = [((r[0], r[1], r[2], r[3]), r[4]) for r in voted.groupBy(*VOTES).count().collect()]  # 36 rows at most
    log_odds = F.create_map(F.lit(""), F.lit(0.0))
    bias = 0.0
    if counts:
        prior, chance = reliabilities(counts)
        known = F.create_map(*(F.lit(x) for p, _ in counts for x in (",".join(map(str, p)), posterior(p, prior, chance))))
        v = votes(F.col("s"), listed)
        weight = known[F.concat_ws(",", *(x.cast("string") for x in v))]
        trained = each.select(F.explode(_features(F.col("s"), v)).alias("feature"), weight.alias("yes")).groupBy("feature").agg(F.sum("yes"), F.sum(1 - F.col("yes")))
        table = {r[0]: (r[1] + 1.0, r[2] + 1.0) for r in trained.collect()}  # about 80 features
        yes = sum(n * posterior(p, prior, chance) for p, n in counts) + 1.0
        no = sum(n for _, n in counts) + 2.0 - yes
        bias = math.log(yes / no)
        log_odds = F.create_map(*(F.lit(x) for k, (a, b) in sorted(table.items()) for x in (k, math.log(a / yes) - math.log(b / no))))
    # the four votes and the four other features tell much the same twice, so each counts half
    odds = lambda s: F.lit(bias) + 0.5 * F.aggregate(_features(s, votes(s, listed)), F.lit(0.0), lambda a, f: a + F.coalesce(log_odds[f], F.lit(0.0)))
    scored = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), s["end"].alias("end"), s["body"].alias("body"), s["base"].alias("base"), (1 / (1 + F.exp(-odds(s)))).alias("probability")))
    rows = rows.select("doc_id", F.array_sort(scored).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    rows = rows.select("doc_id", "spans", base.alias("base_spans"))
    loose = F.filter("spans", lambda s: ~s["base"] & (s["probability"] >= KEEP_FROM))
    rows = settle(rows.select("doc_id", "base_spans", loose.alias("loose"), F.monotonically_increasing_id().alias("row")), "scored")
    full = rows.join(added(rows), "row", "left")
    stays = F.array_sort(F.concat("base_spans", F.coalesce("added", F.slice("loose", 1, F.lit(0)))))
    return full.select("doc_id", stays.alias("spans"))


def _joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest and all spans of every document."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}") for k in BASE]
    return find(docs).select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
