"""Near-duplicate classes by Order MinHash and banded alignment.

Sketches. A text's five-word shingles are labelled with their occurrence number. In each of many random
orders the two smallest labelled shingles are found and kept in text order; their hash is the text's
bucket. Two texts share a bucket only if they agree on the shingles and on their order, which follows
edit similarity, not just set overlap.

Candidates. Texts of equal words are one node from the start. In each bucket the smallest id is the
pivot, and each member is compared with it, first with the pivot it shares most buckets with. Pairs of one class are compared no more.
Where a bucket then still holds several classes, members outside its largest class are compared with all members of other
classes, if the bucket has CROWD members at most. Members of larger buckets (texts with one passage in common, above all) meet by their rarest
words: texts of L words at most that are similar share L less a fifth of L words at least, repeats counted, so that of
any order of all words the first one they share is among the first fifth and one more of each. The order is
from rare to frequent. So no pair of a bucket is left out, however large it is, and few unlike ones are compared.

Signatures. Each text has a bit for each slot that its words, labelled with their occurrence number, are hashed to, set if their
number there is odd. Two texts' bits differ in no more places than they have labelled words that the other lacks, so that pairs
whose bits differ in more places than similarity allows are dropped without loss, before any text is moved.

Verification. Word-level edit distance inside the band that a similarity of SIMILARITY allows, with one
bit for each diagonal of the band: 1 - distance / longer length.

Classes are connected components of the verified links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, free_name, freed, partitions, settle, small_batches
from .words import U, Words, mix, occurrences, shingles, words

SIMILARITY = 0.8
SHINGLE_WORDS = 5
#: Random orders, and picks in each.
ORDERS = (80, 2)
#: Members up to which those of a bucket meet each other at once; in larger ones they meet by rare words.
CROWD = 32
#: Slots of the table that tells how frequent words are.
SLOTS = 1 << 17
#: Texts outside the largest class of one rare word that one task compares with all of that word.
TURN = 128
#: Texts up to which a pair meets at each rare word that so many share; at more frequent words it meets once.
FEW = 8
#: More frequent words of a text that are listed for that.
LISTED = 128
#: Bits of a text's signature, and of the folded one that goes with rare words. A few times the words of a text tell unlike ones best.
SIGNATURE, FOLDED = 1024, 256
#: Ids up to which the list of candidate documents is broadcast; beyond, it is joined by a shuffle.
BROADCAST_IDS = 500_000
#: Places of a word in a text beyond which they are kept as a bit mask, not as a list.
OFTEN = 32
OCCURRENCE = U(0x9E3779B97F4A7C15)
#: Bits of a place in a block of texts; the other bits of 64 order the shingles.
PLACE_BITS = 28


def sketch(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each text that has words: its number, and its bucket in each order."""
    tables, picked = ORDERS
    s = shingles(w, SHINGLE_WORDS)
    own = np.flatnonzero(s.counts)
    keys = np.zeros((len(own), tables), np.int64)
    if not len(own):
        return own, keys
    label = mix(s.hashes + occurrences(s).astype(U) * OCCURRENCE)
    starts = s.bounds[:-1][own]
    seeds = mix(np.arange(1, 2 * tables + 1, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)
    place, low = np.arange(len(label), dtype=U), U((1 << PLACE_BITS) - 1)
    at = np.zeros((len(own), picked), np.int64)
    for t in range(tables):
        v = (label ^ seeds[t]) * seeds[tables + t]
        v ^= v >> U(29)
        v *= U(0xBF58476D1CE4E5B9)
        v &= ~low
        v |= place  # the least value tells its place, too
        for k in range(picked):
            at[:, k] = np.minimum.reduceat(v, starts) & low
            v[at[:, k]] |= ~low  # last from now on; of texts with fewer shingles it is picked again
        key = np.full(len(own), seeds[t], U)
        for column in np.sort(at, axis=1).T:
            key = mix(key * U(0x2545F4914F6CDD1D) + label[column])
        keys[:, t] = key.view(np.int64)
    return own, keys


def whole_text(w: Words, own: np.ndarray) -> np.ndarray:
    """Two hashes of the word sequence of each text that has words."""
    if not len(own):
        return np.zeros((0, 2), np.int64)
    place = (np.arange(len(w.hashes)) - np.repeat(w.bounds[:-1], w.counts)).astype(U)
    first = w.bounds[:-1][own]
    return np.stack([np.add.reduceat(mix(w.hashes * c + place * OCCURRENCE), first) for c in (U(1), U(0xC2B2AE3D27D4EB4F))], axis=1).view(np.int64)


def _sketch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch, "text"):
            w = words(b.column("text"))
            own, keys = sketch(w)
            whole = whole_text(w, own)
            lists = pa.ListArray.from_arrays(np.arange(len(own) + 1) * keys.shape[1], keys.ravel())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(own)), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(w.counts[own]), lists], ["doc_id", "d1", "d2", "n_words", "keys"])


def signatures(labels: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """For each text its SIGNATURE bits as 64-bit numbers: the parities of how many of its labelled words are hashed to each slot."""
    slot = (labels >> U(64 - (SIGNATURE - 1).bit_length())).astype(np.int64)
    odd = np.bincount(owner * SIGNATURE + slot, minlength=texts * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(texts, SIGNATURE // 64)


def _token_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as 32 bits of each of its words' hashes, with their number and its signature."""
    for batch in batches:
        for b in blocks(batch, "text"):
            w = words(b.column("text"))
            body = (w.hashes >> U(32)).astype("<u4")
            cut = pa.array([body[i:j].tobytes() for i, j in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())], pa.binary())
            owner, label = _labelled(cut)
            signs = signatures(label, owner, len(cut))
            lists = pa.ListArray.from_arrays(np.arange(len(cut) + 1) * signs.shape[1], signs.ravel())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), cut, pa.array(w.counts), lists], ["id", "tokens", "n_words", "signature"])


def _labelled(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For all words of some token strings: the number of the string, and a hash of the word and its occurrence."""
    each = [np.frombuffer(x, "<u4") for x in tokens.to_pylist()]
    w = Words(mix(np.concatenate(each).astype(U)), np.concatenate([[0], np.cumsum([len(x) for x in each])]))
    return np.repeat(np.arange(len(each)), w.counts), mix(w.hashes + occurrences(w).astype(U) * OCCURRENCE)


def _slot_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token strings -> how many words are hashed to each slot."""
    n = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for b in blocks(batch, "tokens"):
            n += np.bincount((_labelled(b.column("tokens"))[1] % U(SLOTS)).astype(np.int64), minlength=SLOTS)
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["slot", "n"])


def rare_words(tokens: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, from rare to frequent slots, of which similar texts share one: their number for each token string, and their hashes."""
    owner, label = _labelled(tokens)
    counts = np.bincount(owner, minlength=len(tokens))
    order = np.lexsort((label, often[(label % U(SLOTS)).astype(np.int64)], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.minimum(((1 - SIMILARITY) * counts + 1e-9).astype(np.int64) + 1, counts)
    return first, label[order][place < np.repeat(first, counts)].view(np.int64)


def _rare_task(often: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "tokens"):
                counts, keys = rare_words(b.column("tokens"), often)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]), keys)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_words"), b.column("signature"), lists], ["id", "n_words", "signature", "keys"])

    return run


def rest(known: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The words of b outside those of its runs of five words that are known (sorted hashes)."""
    hit = np.isin(shingles(Words(b.astype(U), np.array([0, len(b)])), SHINGLE_WORDS).hashes, known)
    if len(b) < SHINGLE_WORDS:
        return b[:0] if hit.all() else b
    step = np.zeros(len(b) + 1, np.int64)
    step[: len(hit)] += hit
    step[SHINGLE_WORDS:] -= hit
    return b[np.cumsum(step)[:-1] == 0]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common, repeats counted."""
    if not len(a) or not len(b):
        return 0
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.minimum(nx, ny[at])[y[at] == x].sum())


def _pairs(a: np.ndarray) -> np.ndarray:
    return (a[:-1].astype(U) << U(32)) | a[1:].astype(U)


def within(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """True if at most `limit` insertions, deletions and substitutions turn a into b."""
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return False
    if n == m and int((a != b).sum()) <= limit:
        return True
    if max(n, m) - _common(a, b) > limit or max(n, m) - 1 - _common(_pairs(a), _pairs(b)) > 2 * limit:
        return False  # an edit takes one common word and two common pairs of neighbours at most
    differ = np.flatnonzero(a[: min(n, m)] != b[: min(n, m)])
    head = int(differ[0]) if len(differ) else min(n, m)
    a, b = a[head:], b[head:]
    differ = np.flatnonzero(a[::-1][: min(len(a), len(b))] != b[::-1][: min(len(a), len(b))])
    tail = int(differ[0]) if len(differ) else min(len(a), len(b))
    return _banded(a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist(), limit)


def _banded(a: list[int], b: list[int], limit: int) -> bool:
    """The same by rows of a band: one bit for each diagonal that is at most `limit` off the main one.

    Bit t stands for the cell of a's word j - limit + t in the row of b's word j; `up` and `down` are the
    cells that are one more and one less than their left neighbour, as in Myers' bit vectors. Cells outside the band
    count as too far.
    """
    if len(a) < len(b):
        a, b = b, a
    ends = len(a) - len(b)
    if ends > limit or limit >= len(a):
        return ends <= limit
    places: dict[int, list[int]] = {}
    for i, word in enumerate(a):
        places.setdefault(word, []).append(i)
    often = {word: sum(1 << i for i in at) for word, at in places.items() if len(at) > OFTEN}
    width = 2 * limit + 1
    full, top, end = (1 << width) - 1, 1 << (width - 1), 1 << (limit + ends)
    up, down, distance = full ^ ((1 << (limit + 1)) - 1), 0, ends
    for j, word in enumerate(b):
        first = j - limit
        if word in often:
            equal = (often[word] >> first if first > 0 else often[word] << -first) & full
        else:
            equal = 0
            for i in places.get(word, ()):
                if 0 <= i - first < width:
                    equal |= 1 << (i - first)
        up, down = (up >> 1) | top, down >> 1
        level = (((equal & up) + up) ^ up) | equal | down  # no more than their upper left neighbour
        if not level & end:
            distance += 1
            if distance > limit:
                return False
        right, left = ((down | ~(level | up)) << 1) | 1, (up & level) << 1
        up, down = (left | ~(level | right)) & full, right & level & full
    return True


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Word-level edit similarity of two token strings is `least` or more."""
    return within(a, b, int((1 - least) * max(len(a), len(b)) + 1e-9))


def _align_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows (a, run, b, tokens): a's own text first, without b, then the texts to compare it with."""
    at, own = None, []
    for batch in batches:
        out: list[tuple[int, int, bool]] = []
        for a, run, b, tokens in zip(*(batch.column(c).to_pylist() for c in ("a", "run", "b", "tokens"))):
            text = np.frombuffer(tokens, "<u4")
            if b is not None:
                out.append((a, b, any(similar(x, text) for x in own)))
            elif at == (a, run):
                own.append(text)  # an id with several texts
            else:
                at, own = (a, run), [text]
        columns = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "same"])


def _side_by_side(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Rows (a, run, b, tokens) in runs: a's own text, without b, then the texts of its partners b.

    The pairs of one a are dealt to as many runs as there are partitions at most; a's text goes to each run
    once, and a run is read in a stream, so a text with very many partners is neither one task nor held with them.
    """
    runs = partitions(pairs.sparkSession)
    dealt = settle(pairs.distinct().select("a", F.pmod(F.xxhash64("b"), F.lit(runs)).alias("run"), "b"), f"{name}_pairs")
    own = dealt.select("a", "run").distinct().select("a", "run", F.lit(None).cast("long").alias("b"), F.col("a").alias("id"))
    both = own.union(dealt.select("a", "run", "b", F.col("b").alias("id")))
    ids = settle(both.select("id").distinct(), f"{name}_ids")
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    return both.join(texts.select("id", "tokens"), "id").select("a", "run", "b", "tokens").repartition(runs, "a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())


def verified(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """(a, b) with the outcome of their alignment, written once."""
    return settle(_side_by_side(pairs, texts, name).mapInArrow(_align_task, "a long, b long, same boolean"), name)


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of different ids -> (id, to): each linked id with the smallest id of its component.

    Each id points to its smallest neighbour or itself; pointers are followed to their ends, and each tree of
    them becomes one id. What links are left between these go through the next round. Only
    the question whether any are left comes to the driver.
    """
    edges = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves = None
    while moves is None or not edges.isEmpty():
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a"))
        step = settle(ends.groupBy("id").agg(F.min("other").alias("to")).select("id", F.least("id", "to").alias("to")), "step")
        while True:
            further = step.where("id <> to").select(F.col("id").alias("to"), F.col("to").alias("further"))
            if step.join(further, "to", "left_semi").isEmpty():
                break
            step = settle(step.join(further, "to", "left").select("id", F.coalesce("further", "to").alias("to")), "step")
        of_a, of_b = (step.select(F.col("id").alias(c), F.col("to").alias(f"of_{c}")) for c in "ab")
        left = edges.join(of_a, "a").join(of_b, "b").where("of_a <> of_b")
        edges = settle(left.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct(), "edges")
        further = step.select(F.col("id").alias("to"), F.col("to").alias("further"))
        moves = settle(moves.join(further, "to", "left").select("id", F.coalesce("further", "to").alias("to")), "moves") if moves is not None else step
    return moves


class _Classes:
    """The classes found so far: labels (id, label) of all candidates, and the pairs (a, b) that have been aligned."""

    def __init__(self, ids: DataFrame, texts: DataFrame):
        self.texts = texts
        self.labels = ids.select("id", F.col("id").alias("label"))
        self.tested: DataFrame | None = None

    def test(self, pairs: DataFrame, name: str, apart: bool = False) -> DataFrame | None:
        """Align the pairs (a, b), a below b, of different classes that have not been aligned yet, and join classes along the links.

        `apart`: the pairs are known to be of different classes. Returns (label, to) of the labels that others take the place of, if any.
        """
        of = lambda c: self.labels.select(F.col("id").alias(c), F.col("label").alias(f"of_{c}"))
        fresh = pairs.distinct()
        if self.tested is not None:
            fresh = fresh.join(self.tested.select("a", "b"), ["a", "b"], "left_anti")
        if not apart:
            fresh = fresh.join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select("a", "b")
        found = verified(fresh, self.texts, name)
        self.tested = self.tested.union(found) if self.tested is not None else found
        if found.where("same").isEmpty():
            return None
        same = found.where("same").join(of("a"), "a").join(of("b"), "b")
        moved = components(same.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).withColumnRenamed("id", "label")
        self.labels = settle(self.labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        return moved

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The rows of `pairs` (a, b and others) whose texts' signatures allow similarity, each once."""
        of = lambda c: self.texts.select(F.col("id").alias(c), F.col("n_words").alias(f"n_{c}"), F.col("signature").alias(f"signature_{c}"))
        signed = pairs.join(of("a"), "a").join(of("b"), "b")
        return signed.where(_alike("signature_a", "signature_b", "n_a", "n_b", SIGNATURE)).select(pairs.columns).distinct()

    def mixed(self, shared: DataFrame) -> DataFrame:
        """`shared` with (label, main, outside, n) for the buckets with several classes: main is the largest, `outside` counts the members of others, n all.

        Buckets of one class, however large, go by an aggregate.
        """
        members = settle(shared.join(self.labels, "id"), "members")
        sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"))
        main = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"), F.sum("n").alias("n")).where("outside > 0")
        return settle(members.join(main, "key"), "mixed")


def _across(outside: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of some members of buckets with all members of other classes whose length allows similarity."""
    x = outside.select("key", F.col("id").alias("i"), F.col("label").alias("of_i"), F.col("n_words").alias("n_i"))
    y = members.select("key", F.col("id").alias("j"), F.col("label").alias("of_j"), F.col("n_words").alias("n_j"))
    near = (x["key"] == y["key"]) & (F.col("of_i") != F.col("of_j")) & _near(F.col("n_i"), F.col("n_j"))
    return x.join(y, near).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def _meetings(rows: DataFrame) -> DataFrame:
    """(id_i, label_i, label_j, id_j) of rows of rare words that can be similar, from `rows` (key, id, label, main, outside, n, n_words, text, place); `text` tells texts of one id apart.

    The rows of a word outside its largest class are dealt to turns, each of which all rows of the word go to. A pair
    may share many words; it meets at each of those that FEW texts have at most, but of the others only at the first one.
    For that a row has the more frequent words that its text has before, the first LISTED of them. Rows may have a column `folded`,
    their text's folded signature; then pairs that these tell apart do not meet.
    """
    rows = rows.withColumn("after", F.col("n_words") - F.col("place"))
    in_order = Window.partitionBy("id", "n_words", "text").orderBy("place")
    many = rows.where(F.col("n") > FEW).withColumn("nth", F.row_number().over(in_order))
    many = many.withColumn("before", F.collect_list(F.when(F.col("nth") <= LISTED, F.col("key"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    longer = F.greatest("n_words_i", "n_words_j")
    # words before the first one that two texts share are not shared, so those from there on must be enough; two that are both outside the largest class meet once
    able = (F.col("label_i") != F.col("label_j")) & (F.least("after_i", "after_j") >= longer - F.floor(longer * (1 - SIMILARITY) + 1e-9)) & (F.col("in_main_j") | (F.col("id_i") < F.col("id_j")))
    columns = ["id", "label", "n_words", "after"]
    if "folded" in rows.columns:
        columns.append("folded")
        able &= _alike("folded_i", "folded_j", "n_words_i", "n_words_j", FOLDED)
    first = ~F.arrays_overlap("before_i", "before_j")

    def meet(own: DataFrame, columns: list[str], condition: Column) -> DataFrame:
        turns = F.ceil(F.col("outside") / TURN)
        own = own.withColumn("in_main", F.col("label") == F.col("main"))
        x = own.where("not in_main").select("key", F.pmod(F.xxhash64("id", "key"), turns).alias("turn"), *(F.col(c).alias(f"{c}_i") for c in columns))
        y = own.select("key", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)).alias("turn"), *(F.col(c).alias(f"{c}_j") for c in (*columns, "in_main")))
        return x.join(y, ["key", "turn"]).where(condition).select("id_i", "label_i", "label_j", "id_j")

    return meet(rows.where(F.col("n") <= FEW), columns, able).union(meet(many, [*columns, "before"], able & first))


def _by_rare_words(crowd: DataFrame, found: _Classes) -> DataFrame:
    """Pairs (a, b) of different classes, of_i and of_j, among the ids of `crowd` that can be similar: a superset without any loss.

    Most texts that share rare words differ in so many others that their signatures tell. `first` marks for each id and each class it meets the partner that it meets at most words.
    """
    own = settle(found.texts.join(crowd, "id", "left_semi"), "crowd_tokens")
    often = np.zeros(SLOTS, np.int64)
    for r in own.mapInArrow(_slot_task, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        often[r.slot] = r.n
    nodes = settle(own.mapInArrow(_rare_task(often.astype(np.uint32)), "id long, n_words long, signature array<long>, keys array<long>"), "rare_words")
    members = nodes.select("id", "n_words", _folded("signature").alias("folded"), F.xxhash64("keys", "signature").alias("text"), F.posexplode("keys").alias("place", "key"))
    met = _meetings(found.mixed(members)).groupBy("id_i", "label_i", "label_j", "id_j").agg(F.count("*").alias("common"))
    first = F.row_number().over(Window.partitionBy("id_i", "label_j").orderBy(F.desc("common"), "id_j")) == 1
    pairs = met.select(F.least("id_i", "id_j").alias("a"), F.greatest("id_i", "id_j").alias("b"), F.col("label_i").alias("of_i"), F.col("label_j").alias("of_j"), first.alias("first"))
    return settle(pairs, "by_rare_words")


def _still_apart(pairs: DataFrame, moved: DataFrame | None) -> DataFrame:
    """Of pairs with the labels of_i and of_j, those that differ after some labels have moved."""
    if moved is None:
        return pairs
    now = lambda c: moved.select(F.col("label").alias(f"of_{c}"), F.col("to").alias(f"to_{c}"))
    return pairs.join(now("i"), "of_i", "left").join(now("j"), "of_j", "left").where("coalesce(to_i, of_i) <> coalesce(to_j, of_j)")


def _near(n: Column, m: Column) -> Column:
    """The distance is the difference of lengths at least."""
    return F.least(n, m) >= F.greatest(n, m) * SIMILARITY


def _alike(x: str, y: str, n: str, m: str, bits: int) -> Column:
    """The bits differ in no more places than two similar texts of n and m words can have words that the other lacks."""
    differ = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(bits // 64)), F.lit(0))
    longer = F.greatest(n, m)
    return differ <= 2 * F.floor(longer * (1 - SIMILARITY) + 1e-9) - F.abs(F.col(n) - F.col(m))


def _folded(signature: str) -> Column:
    """FOLDED bits: what falls to one of them is added modulo two, so that folded ones differ in no more places than whole ones."""
    each, step = SIGNATURE // 64, FOLDED // 64
    return F.array(*(reduce(Column.bitwiseXOR, (F.col(signature)[i] for i in range(k, each, step))) for k in range(step)))


def _shared(nodes: DataFrame) -> DataFrame:
    """(key, id, n_words, pivot) of the buckets that several nodes (id, n_words, keys) share.

    Members are shuffled once, for the pivots and to meet them, as both read the same columns. One key has at most one row
    in as many as there are orders.
    """
    members = nodes.select("id", "n_words", F.explode("keys").alias("key")).repartition(partitions(nodes.sparkSession), "key")
    pivots = members.groupBy("key").agg(F.min("id").alias("pivot"), F.count("n_words").alias("n")).where("n > 1").select("key", "pivot")
    return settle(members.join(pivots, "key").select("key", "id", "n_words", "pivot"), "shared")


def _with_pivots(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of the pivots of buckets with members whose length allows similarity, and how many buckets they share."""
    pairs = shared.where("id <> pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b"), "n_words").agg(F.count("*").alias("buckets"))
    pivots = shared.where("id = pivot").select("pivot", F.col("n_words").alias("n_pivot")).distinct()
    return pairs.join(pivots, F.col("a") == F.col("pivot")).where(_near(F.col("n_words"), F.col("n_pivot"))).select("a", "b", "buckets")


def _once(texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Equal texts of one repeated id only once; texts of other ids are not moved."""
    repeated = settle(sketches.groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id"), "repeated")
    if repeated.isEmpty():
        return texts
    return settle(texts.join(repeated, "id", "left_anti").union(texts.join(repeated, "id", "left_semi").distinct()), "once")


def _classes(shared: DataFrame, known: DataFrame, sketches: DataFrame) -> DataFrame:
    """(id, label) of all nodes that share a bucket."""
    ids = settle(shared.select("id").distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = settle(known.join(wanted, known["doc_id"] == ids["id"], "left_semi").mapInArrow(_token_task, "id long, tokens binary, n_words long, signature array<long>"), "tokens")
    found = _Classes(ids, _once(texts, sketches))
    pivots = settle(found.possible(_with_pivots(shared)), "with_pivots")
    found.test(pivots.groupBy("b").agg(F.max_by("a", F.struct("buckets", -F.col("a"))).alias("a")).select("a", "b"), "first_pivots", apart=True)
    found.test(pivots.select("a", "b"), "pivots")
    mixed = found.mixed(shared)
    few = mixed.where(F.col("n") <= CROWD)
    found.test(found.possible(_across(few.where("label <> main"), few).distinct()), "few", apart=True)
    crowd = settle(mixed.where(F.col("n") > CROWD).select("id").distinct(), "crowd")
    if not crowd.isEmpty():
        met = _by_rare_words(crowd, found)
        moved = found.test(met.where("first").select("a", "b"), "first_of_crowds", apart=True)
        found.test(_still_apart(met.where("not first"), moved).select("a", "b"), "crowds", apart=True)
    return found.labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), kept (it is that document).

    Texts are compared by their words (case of ASCII and Latin-1 letters, marks and white space
    do not count). Texts without words (null and empty ones, too) link to nothing; rows without doc_id
    have a null class and are kept. Rows of one doc_id count as one document, similar to another if one of
    its texts is. Texts of fewer than five words are near-duplicates of equal ones only. Very long texts
    are compared whole. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where("doc_id is not null")
    sketches = settle(known.mapInArrow(_sketch_task, "doc_id long, d1 long, d2 long, n_words long, keys array<long>"), "sketches")
    every = settle(sketches.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys")), "nodes")
    whole, sketches = sketches, settle(sketches.select("doc_id", "d1", "d2"), "texts")
    freed(spark, whole)  # buckets are the most of what is written
    shared = _shared(every)
    whole, every = every, settle(every.select("d1", "d2", "id"), "distinct_texts")
    freed(spark, whole)
    labels = _classes(shared, known, sketches)
    classes = every.join(labels, "id", "left").select("d1", "d2", F.coalesce("label", "id").alias("class_id"))
    linked = sketches.join(classes, ["d1", "d2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = rows.select("doc_id").join(linked, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns; rows without doc_id stay, and rows of one doc_id share its fate."""
    key = free_name(docs, "kept_id")
    dropped = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col(key), "left_anti")
