"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

Each word (and the start of a text) is a restaurant: the customers are the tokens that follow it, the dishes
their words. Every table of a restaurant sends one customer to the parent that all share, the restaurant of words without
context, whose own parent is uniform over the known words and one unknown. Seatings are sampled by Gibbs
sweeps: all customers of one dish in one restaurant are seated anew, one after the other, given the tables of the restaurant's other
dishes and the parent's probability of the sweep before. A dish of one customer has one table in any seating. The
probabilities of SAMPLES sweeps after BURN_IN are averaged for each token.

Texts become blocks of some megabytes, as word numbers. What a block has to know of the corpus it asks for:
its distinct keys (words, pairs of words) are dealt to buckets by hash, a bucket counts or looks up what all blocks ask of it, and answers
go back to the blocks. A key comes from a block once, however frequent it is, so no bucket is hot, and
nothing of the corpus is held whole anywhere. A pair of two customers or more is seated by the first block that
trains on it; buckets keep the restaurants of their words. In each sweep blocks ask for the restaurants of their words, seat
their pairs, and tell the buckets how many tables these have. Words and pairs are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import batches_of, freed, gathered, partitions, scratch
from .words import U, mix, spaced_words

BURN_IN, SAMPLES = 1, 2
#: Strengths of a context's restaurant and of the shared parent.
THETA, THETA_0 = 1.0, 1.0
#: Discounts are estimated from how many dishes have one and two customers, within these bounds.
LEAST_DISCOUNT, MOST_DISCOUNT = 0.05, 0.95
#: Keys in one bucket.
BUCKET_KEYS = 2_000_000
#: Customers seated one by one; beyond, 1 / STEP of those seated so far are seated at once, as its middle customer would be.
STEP = 16
START, END = U(1), U(2)
TURN_KEY, PAIR_KEY = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)

Batches = Iterator[pa.RecordBatch]
BLOCKS = "block long, docs array<long>, held binary, sizes binary, vocab binary, tokens binary, n_tokens long"


settle = partial(common.settle, codec="zstd")


def is_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 5. A null id counts as empty text and is never held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _block_task(batches: Batches) -> Batches:
    """Texts -> blocks: the distinct words of some megabytes of text and each token's number among them."""
    number = TaskContext.get().partitionId() << 32
    for b in gathered(batches, "text"):
        w = spaced_words(b.column("text"))
        sizes = w.counts + 1
        ends = np.cumsum(sizes) - 1
        hashes = np.full(int(sizes.sum()), END, U)
        own = np.ones(len(hashes), bool)
        own[ends] = False
        hashes[own] = w.hashes
        vocab, tokens, often = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # frequent words get small numbers
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        vocab, tokens = vocab[order], rank[tokens]
        held = b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        row = [number, b.column("doc_id").to_pylist(), held.tobytes(), packed(sizes), vocab.tobytes(), packed(tokens), len(tokens)]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["block", "docs", "held", "sizes", "vocab", "tokens", "n_tokens"])
        number += 1


class Block:
    """A block's tokens with their contexts. Words are numbers in vocab; len(vocab) stands for the start of a text."""

    def __init__(self, row: dict):
        self.number, self.docs = row["block"], row["docs"]
        self.sizes, self.vocab = unpacked(row["sizes"]), np.frombuffer(row["vocab"], U)
        self.tokens = unpacked(row["tokens"])
        self.start = len(self.vocab)
        self.first = np.cumsum(self.sizes) - self.sizes
        held = np.frombuffer(row["held"], bool)
        self.trains, self.training = np.repeat(~held, self.sizes), int((~held).sum())
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[self.first] = self.start
        pairs, self.pair_of = np.unique(context * (self.start + 1) + self.tokens, return_inverse=True)
        self.context, self.dish = np.divmod(pairs, self.start + 1)
        self.words = np.append(self.vocab, START)

    def pair_keys(self) -> np.ndarray:
        return mix(self.words[self.context] * PAIR_KEY + mix(self.vocab[self.dish]))

    def word_counts(self) -> np.ndarray:
        """How often the words occur in the block's training texts; of the start, how many these are."""
        return np.append(np.bincount(self.tokens[self.trains], minlength=self.start), self.training)

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of[self.trains], minlength=len(self.context))


def _rows(batches: Batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where each bucket, a range of keys, begins in it."""
    order = np.argsort(keys)
    bounds = np.array([b * (1 << 64) // buckets for b in range(buckets)], U)
    return order, np.append(np.searchsorted(keys[order], bounds), len(keys))


def _pieces(block: int | None, keys: np.ndarray, values: np.ndarray, buckets: int, with_keys: bool = True) -> pa.RecordBatch:
    """Rows (bucket, block, keys, vals)."""
    order, at = _dealt(keys, buckets)
    full = np.flatnonzero(np.diff(at)).tolist()
    cut = [order[at[b] : at[b + 1]] for b in full]
    own = [packed_keys(keys[c]) for c in cut] if with_keys else [None] * len(cut)
    columns = [(full, pa.int32()), ([block] * len(full), pa.int64()), (own, pa.binary()), ([packed(values[c]) for c in cut], pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], ["bucket", "block", "keys", "vals"])


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the differences between neighbours."""
    return packed(np.diff(keys, prepend=U(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_values(raw), dtype=U)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in one, two, four or eight bytes each, first all lowest bytes, and compressed; the first byte says how many."""
    width = np.min_scalar_type(int(values.max())).itemsize if values.size else 1
    raw = np.ascontiguousarray(values).astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    return bytes([width]) + zstandard.compress(raw.T.tobytes(), 1)


def _values(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def unpacked(raw: bytes) -> np.ndarray:
    return _values(raw).astype(np.int64)


def _count_task(batches: Batches) -> Batches:
    """Buckets, one after the other: for each block's keys twice their count in the corpus, plus one where this block is the first to train on the key."""
    for group in _buckets(batches):
        own = [unpacked_keys(g[1]) for g in group]
        keys = np.concatenate(own)
        values = np.concatenate([unpacked(g[2]) for g in group])
        known, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, weights=values, minlength=len(known)).astype(np.int64)
        owner = np.zeros(len(keys), np.int64)
        there = np.flatnonzero(values)
        owner[there[np.unique(which[there], return_index=True)[1]]] = 1
        yield _answers(group, [len(k) for k in own], 2 * total[which] + owner)


def _find_task(width: int) -> Callable[[Batches], Batches]:
    """Buckets, one after the other: rows of a table (without block) first, then for each block's keys the `width` values that the table has, or zeros."""

    def run(batches: Batches) -> Batches:
        for group in _buckets(batches):
            table = [(k, v) for b, k, v, _ in group if b is None]
            known = np.concatenate([np.zeros(0, U), *(unpacked_keys(k) for k, _ in table)])
            values = np.concatenate([np.zeros((0, width), np.int64), *(unpacked(v).reshape(-1, width) for _, v in table)])
            order = np.argsort(known)
            known, values = known[order], np.concatenate([values[order], np.zeros((1, width), np.int64)])
            asked = [g for g in group if g[0] is not None]
            if asked:
                own = [unpacked_keys(g[1]) for g in asked]
                keys = np.concatenate(own)
                at = np.searchsorted(known, keys)
                known = np.append(known, U(0))
                at[known[at] != keys] = len(known) - 1
                yield _answers(asked, [len(k) for k in own], values[at])

    return run


def _buckets(batches: Batches) -> Iterator[list[tuple]]:
    bucket, group = None, []
    for batch in batches:
        for b, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "keys", "vals"))):
            if b != bucket and group:
                yield group
                group = []
            bucket = b
            group.append((*row, b))
    if group:
        yield group


def _answers(group: list[tuple], sizes: list[int], values: np.ndarray) -> pa.RecordBatch:
    vals = [packed(v) for v in np.split(values, np.cumsum(sizes)[:-1])]
    return pa.RecordBatch.from_arrays([pa.array([g[0] for g in group], pa.int64()), pa.array([g[3] for g in group], pa.int32()), pa.array(vals, pa.binary())], ["block", "bucket", "vals"])


def _ask_task(what: Callable[[dict], tuple[np.ndarray, np.ndarray]], buckets: int) -> Callable[[Batches], Batches]:
    """Rows of blocks -> pieces of the keys they ask for, and what they say of them."""

    def run(batches: Batches) -> Batches:
        for row in _rows(batches):
            yield _pieces(row["block"], *what(row), buckets)

    return run


PIECES = "bucket int, block long, keys binary, vals binary"


def _exchanged(pieces: DataFrame, task: Callable[[Batches], Batches], buckets: int, name: str) -> DataFrame:
    """(block, bucket, vals): the answers to what blocks ask."""
    spark = pieces.sparkSession
    ready = pieces.repartition(max(buckets, partitions(spark)), "bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
    with batches_of(spark, 64):
        return settle(ready.mapInArrow(task, "block long, bucket int, vals binary"), name)


def _with(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """blocks with all answers to each, which what it asks for bounds."""
    return blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "vals")).alias(name)), "block", "left")


def _gather(keys: np.ndarray, answers: list[dict] | None, buckets: int, width: int = 1) -> np.ndarray:
    """The answers in the order of the keys."""
    out = np.zeros((len(keys), width), np.int64)
    order, at = _dealt(keys, buckets)
    for a in answers or ():
        out[order[at[a["bucket"]] : at[a["bucket"] + 1]]] = unpacked(a["vals"]).reshape(-1, width)
    return out


#: What each block keeps, by kind. 0: its words, and the pairs it owns as numbers of these; 1: pieces of what it says of its words; 2: pieces of the pairs of several customers that it asks for.
OWNED = "block long, words binary, context binary, dish binary, customers binary, pairs binary, twos long, bucket int, keys binary, vals binary, kind int"
#: Of a word: tokens, dishes and contexts of one customer, owned pairs by context and by dish.
FACTS = 5


def _owned_task(buckets: int) -> Callable[[Batches], Batches]:
    """Blocks with their counts -> what they add to the words, and the pairs of two customers or more that are theirs."""

    def run(batches: Batches) -> Batches:
        for row in _rows(batches):
            b = Block(row)
            keys, v = b.pair_keys(), len(b.vocab)
            count, owner = np.divmod(_gather(keys, row["counts"], buckets)[:, 0], 2)
            one, more = (owner == 1) & (count == 1), np.flatnonzero((owner == 1) & (count > 1))
            sides = [np.bincount(x[which], minlength=v + 1) for which in (one, more) for x in (b.context, b.dish)]
            more = more[np.argsort(keys[more])]
            order = np.argsort(b.words)
            place = np.empty_like(order)
            place[order] = np.arange(v + 1)
            facts, c = np.stack([b.word_counts(), *sides], axis=1)[order], count[more]
            values = [b.number, packed_keys(b.words[order]), packed(place[b.context[more]]), packed(place[b.dish[more]]), packed(c), packed_keys(keys[more]), int((c == 2).sum())]
            yield _row(OWNED, [*values, None, None, None, 0])
            asked = keys[count > 1]
            for kind, pieces in ((1, _pieces(b.number, b.words[order], facts, buckets)), (2, _pieces(b.number, asked, np.zeros(len(asked), np.int64), buckets))):
                yield _row(OWNED, *([b.number, *[None] * 6, r["bucket"], r["keys"], r["vals"], kind] for r in pieces.to_pylist()))

    return run


def _row(ddl: str, *rows: list) -> pa.RecordBatch:
    names, kinds = zip(*(f.split(" ") for f in ddl.split(", ")))
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, t in enumerate(kinds)], list(names))


def _times(n: int, key: np.uint64) -> np.uint64:
    return U(n * int(key) % (1 << 64))


def _uniform(seeds: np.ndarray, turn: int) -> np.ndarray:
    return (mix(seeds + _times(turn, TURN_KEY)) >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _successes(m: np.ndarray, q: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Binomial draws, by the gaps between successes."""
    k, at, left, turn = np.zeros(len(m), np.int64), np.zeros(len(m)), np.arange(len(m)), 0
    while len(left):
        at[left] += np.floor(np.log(_uniform(seeds[left], turn)) / np.log1p(-q[left])) + 1
        left = left[at[left] <= m[left]]
        k[left] += 1
        turn += 1
    return k


def seat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, theta: float, discount: float, seeds: np.ndarray) -> np.ndarray:
    """Tables of dishes whose customers are seated one after the other.

    A customer takes a new table with a weight of (theta + discount * tables of the restaurant) * parent, an old one with that
    of customers - discount * tables. `others` are the tables of the restaurant's other dishes.
    """
    tables = (customers > 0).astype(np.int64)
    active, seated = np.flatnonzero(customers > 1), 1
    while len(active):
        size = max(1, seated // STEP)
        t = tables[active]
        new = (theta + discount * (others[active] + t)) * parent[active]
        q = new / (new + np.maximum(seated + (size - 1) / 2 - discount * t, 1e-12))
        own = mix(seeds[active] + _times(seated, PAIR_KEY))
        tables[active] += _uniform(own, 0) < q if size == 1 else _successes(np.minimum(size, customers[active] - seated), q, own)
        seated += size
        active = active[customers[active] > seated]
    return tables


#: Rows of the buckets of words. kind 0: the restaurants of a bucket's words; 1: words that a block asks for, with what it adds to them.
ROWS = "bucket int, kind int, block long, keys binary, vals binary"
#: A restaurant: tokens of the word, dishes of one customer in it, restaurants where the word is such a dish, tables, customers in the parent, tables in the parent.
STATE = 6
TOTALS = "bucket int, keys binary, vals binary, distinct long, tokens long, texts long, ones long, once long, twice long, customers long, tables long"


def _state_row(bucket: int, keys: np.ndarray, state: np.ndarray) -> list:
    real, n, customers = keys != START, state[:, 0], state[:, 4]
    sums = [int((real & (n > 0)).sum()), int(n[real].sum()), int(n[~real].sum()), int(state[:, 1].sum()), int((customers == 1).sum()), int((customers == 2).sum()), int(customers.sum()), int(state[:, 5].sum())]
    return [bucket, packed_keys(keys), packed(state), *sums]


def _told(group: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all blocks that ask a bucket, and the sums of what the blocks say of them."""
    keys = [unpacked_keys(r["keys"]) for r in group if r["kind"] == 1]
    known, which = np.unique(np.concatenate([np.zeros(0, U), *keys]), return_inverse=True)
    said = [unpacked(r["vals"]).reshape(len(k), -1) for r, k in zip((r for r in group if r["kind"] == 1), keys)]
    if not said:
        return known, np.zeros((0, FACTS), np.int64)
    return known, np.stack([np.bincount(which, weights=column, minlength=len(known)).astype(np.int64) for column in np.concatenate(said).T], axis=1)


def _open_task(batches: Batches) -> Batches:
    """What blocks say of their words -> the restaurants at first: each dish at one table."""
    for bucket, group in _groups(batches):
        keys, f = _told(group)
        customers = f[:, 2] + f[:, 4]
        yield _row(TOTALS, _state_row(bucket, keys, np.stack([f[:, 0], f[:, 1], f[:, 2], f[:, 1] + f[:, 3], customers, customers > 0], axis=1)))


def _close_task(sweep: int, tables: int, discount: float, uniform: float) -> Callable[[Batches], Batches]:
    """Restaurants and what blocks say of their words' tables -> the restaurants after the sweep, the parent seated anew."""

    def run(batches: Batches) -> Batches:
        for bucket, group in _groups(batches):
            keys, state = unpacked_keys(group[0]["keys"]), unpacked(group[0]["vals"]).reshape(-1, STATE)
            said, sums = _told(group)
            sent = np.zeros((len(keys), 2), np.int64)
            sent[np.searchsorted(keys, said)] = sums[:, :2]
            customers = state[:, 2] + sent[:, 1]
            seated = seat(customers, tables - state[:, 5], np.full(len(keys), uniform), THETA_0, discount, mix(keys + _times(sweep + 1, PAIR_KEY)))
            yield _row(TOTALS, _state_row(bucket, keys, np.stack([state[:, 0], state[:, 1], state[:, 2], state[:, 1] + sent[:, 0], customers, seated], axis=1)))

    return run


def _groups(batches: Batches) -> Iterator[tuple[int, list[dict]]]:
    bucket, group = None, []
    for row in _rows(batches):
        if row["bucket"] != bucket and group:
            yield bucket, group
            group = []
        bucket = row["bucket"]
        group.append(row)
    if group:
        yield bucket, group


def _tell_task(batches: Batches) -> Batches:
    """For each block's words the tables of their restaurants, their customers and their tables in the parent, of all given states in turn, and last the tokens of the word."""
    for bucket, group in _groups(batches):
        states = [r for r in group if r["kind"] == 0]
        known = unpacked_keys(states[0]["keys"])
        state = [unpacked(r["vals"]).reshape(-1, STATE) for r in states]
        values = np.concatenate([*(x[:, 3:] for x in state), state[0][:, :1]], axis=1)
        asked = [(r["block"], r["keys"], None, bucket) for r in group if r["kind"] == 1]
        own = [unpacked_keys(a[1]) for a in asked]
        yield _answers(asked, [len(k) for k in own], values[np.searchsorted(known, np.concatenate(own))])


STEP_ROWS = "bucket int, block long, keys binary, vals binary"


def _sweep_task(m: dict, sweep: int, buckets: int) -> Callable[[Batches], Batches]:
    """Blocks with the restaurants of their words -> the tables of the pairs they own, and what these add to their words."""
    customers, tables = m["totals"][-1]
    nowhere = (THETA_0 + m["d0"] * tables) / (m["distinct"] + 1)

    def run(batches: Batches) -> Batches:
        for row in _rows(batches):
            words, context, dish, c = unpacked_keys(row["words"]), *(unpacked(row[c]) for c in ("context", "dish", "customers"))
            of = _gather(words, row["told"], buckets, 4)
            before = unpacked(row["t"]) if row["t"] else np.ones(len(c), np.int64)
            parent = (of[:, 1] - m["d0"] * of[:, 2] + nowhere) / (THETA_0 + customers)
            t = seat(c, of[context, 0] - before, parent[dish], THETA, m["d"], mix(unpacked_keys(row["pairs"]) + _times(sweep, PAIR_KEY)))
            sums = np.stack([np.bincount(x, weights=t, minlength=len(words)).astype(np.int64) for x in (context, dish)], axis=1)
            yield _row(STEP_ROWS, [None, row["block"], None, packed(t)])
            there = np.flatnonzero(sums.any(axis=1))
            yield _pieces(row["block"], words[there], sums[there], buckets)

    return run


class Model:
    """d, d0: discounts; states: the restaurants after each sample; seats: the tables of the owned pairs in it; totals: customers and tables of the parent."""

    def __init__(self, parts: list[DataFrame], buckets: int):
        self.buckets, self.owned, self.asked, self.asked_pairs = buckets, parts[0].drop("bucket", "keys", "vals"), *(p.select("bucket", "block", "keys", "vals") for p in parts[1:])
        owned, spark = self.owned, parts[0].sparkSession
        with batches_of(spark, 4):
            state = settle(self._by_bucket(_kind(self.asked, 1)).mapInArrow(_open_task, TOTALS), "state")
            of = state.agg(*(F.sum(c) for c in ("distinct", "tokens", "texts", "ones", "once", "twice"))).first()
            self.distinct, self.tokens, self.texts = (x or 0 for x in of[:3])
            self.d, self.d0 = _discount(of[3] or 0, owned.agg(F.sum("twos")).first()[0] or 0), _discount(of[4] or 0, of[5] or 0)
            self.states, self.seats, self.totals = [], [], [self._totals(state)]
            seats = None
            for sweep in range(BURN_IN + SAMPLES):
                freed(spark)
                told = self._told([state], "told")
                freed(spark)
                rows = _with(owned, told, "told")
                rows = rows.join(seats, "block", "left") if seats is not None else rows.withColumn("t", F.lit(None).cast("binary"))
                step = settle(rows.mapInArrow(_sweep_task({k: getattr(self, k) for k in ("d", "d0", "distinct", "totals")}, sweep, buckets), STEP_ROWS), "step")
                freed(spark, told)
                last, seats = seats, settle(step.where("bucket is null").select("block", F.col("vals").alias("t")), "seats")
                close = _close_task(sweep, self.totals[-1][1], self.d0, 1 / (self.distinct + 1))
                past, state = state, settle(self._by_bucket(_kind(step.where("bucket is not null"), 1).unionByName(_kind(state, 0))).mapInArrow(close, TOTALS), "state")
                self.totals.append(self._totals(state))
                if sweep >= BURN_IN:
                    self.states.append(state)
                    self.seats.append(seats)
                freed(spark, step, *([past] if sweep <= BURN_IN else []), *([last] if last is not None and sweep <= BURN_IN else []))
        self.totals = self.totals[-SAMPLES:]

    def _by_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(max(self.buckets, partitions(rows.sparkSession)), "bucket").sortWithinPartitions("bucket", "kind", "block")

    def _told(self, states: list[DataFrame], name: str) -> DataFrame:
        """(block, bucket, vals): what the states say of the words that blocks ask for."""
        rows = _kind(self.asked.withColumn("vals", F.lit(None).cast("binary")), 1)
        for k, state in enumerate(states):
            rows = rows.unionByName(_kind(state, 0).withColumn("block", F.lit(k).cast("long")))
        return settle(self._by_bucket(rows).mapInArrow(_tell_task, "block long, bucket int, vals binary"), name)

    @staticmethod
    def _totals(state: DataFrame) -> tuple[int, int]:
        return tuple(x or 0 for x in state.agg(F.sum("customers"), F.sum("tables")).first())

    def told(self) -> DataFrame:
        return self._told(self.states, "of_words")

    def tables(self) -> DataFrame:
        """(block, pairs, t0, t1, ...): the tables of owned pairs in each sample."""
        rows = self.owned.select("block", "pairs")
        for k, seats in enumerate(self.seats):
            rows = rows.join(seats.withColumnRenamed("t", f"t{k}"), "block")
        return rows


def _kind(rows: DataFrame, kind: int) -> DataFrame:
    block = F.col("block") if "block" in rows.columns else F.lit(None).cast("long")
    return rows.select("bucket", F.lit(kind).alias("kind"), block.alias("block"), "keys", "vals")


def _discount(ones: int, twos: int) -> float:
    return min(max(ones / (ones + 2 * twos), LEAST_DISCOUNT), MOST_DISCOUNT) if ones + twos else 0.5


def _score_task(m: dict, buckets: int) -> Callable[[Batches], Batches]:
    """Blocks with all they asked for -> rows of their texts."""

    def run(batches: Batches) -> Batches:
        for row in _rows(batches):
            b = Block(row)
            v = len(b.vocab)
            keys = b.pair_keys()
            c = _gather(keys, row["counts"], buckets)[:, 0] // 2
            of_word = _gather(b.words, row["words"], buckets, 3 * SAMPLES + 1)
            n, of_word = of_word[:, -1], of_word[:, :-1].reshape(v + 1, SAMPLES, 3)
            tables = np.ones((len(c), SAMPLES), np.int64)
            more = np.flatnonzero(c > 1)
            tables[more] = _gather(keys[more], row["pairs"], buckets, SAMPLES)
            probability = np.zeros(len(c))
            for s, (customers, all_tables) in enumerate(m["totals"]):
                parent = (of_word[:, s, 1] - m["d0"] * of_word[:, s, 2] + (THETA_0 + m["d0"] * all_tables) / (m["distinct"] + 1)) / (THETA_0 + customers)
                back = (THETA + m["d"] * of_word[:, s, 0]) / (THETA + n)
                own = np.where(c > 0, c - m["d"] * tables[:, s], 0.0) / (THETA + n[b.context])
                probability += own + back[b.context] * parent[b.dish]
            score = np.log10(probability / SAMPLES)[b.pair_of]
            base = np.log10((n[:v] + 0.5) / (m["tokens"] + 0.5 * (m["distinct"] + 1)))[b.tokens]
            sums = [np.add.reduceat(x, b.first) for x in ((n[:v] > 0)[b.tokens].astype(np.int64), base, score)]
            held = np.frombuffer(row["held"], bool)
            yield pa.RecordBatch.from_arrays([pa.array(b.docs, pa.int64()), pa.array(held), pa.array(b.sizes), *map(pa.array, sums)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def blocked(docs: DataFrame) -> tuple[DataFrame, int]:
    """The blocks of all texts, and how many buckets their keys are dealt to."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), is_held_out(F.col("doc_id")).alias("held_out"))
    with batches_of(spark, 256):
        blocks = settle(rows.mapInArrow(_block_task, BLOCKS), "blocks")
    return blocks, int((blocks.agg(F.sum("n_tokens")).first()[0] or 0) // BUCKET_KEYS + partitions(spark))


def counted(blocks: DataFrame, buckets: int) -> tuple[DataFrame, list[DataFrame]]:
    """What blocks have to know of the counts of their keys, and what each keeps for the model."""
    spark = blocks.sparkSession

    def of_block(row: dict) -> tuple[np.ndarray, np.ndarray]:
        b = Block(row)
        return b.pair_keys(), b.pair_counts()

    with batches_of(spark, 4):
        counts = _exchanged(blocks.mapInArrow(_ask_task(of_block, buckets), PIECES), _count_task, buckets, "counts")
        freed(spark)
        path = scratch(spark, "owned")
        _with(blocks, counts, "counts").mapInArrow(_owned_task(buckets), OWNED).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    freed(spark)
    return counts, [_folder(spark, f"{path}/kind={k}", OWNED.removesuffix(", kind int")) for k in range(3)]


def _folder(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The rows below a path, none where no row was written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(ddl).parquet(path) if there else spark.createDataFrame([], ddl)


def scored(blocks: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """The rows of all blocks' texts."""
    spark, buckets = blocks.sparkSession, model.buckets
    m = {k: getattr(model, k) for k in ("d", "d0", "distinct", "tokens", "totals")}

    def seated(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return unpacked_keys(row["pairs"]), np.stack([unpacked(row[f"t{k}"]) for k in range(SAMPLES)], axis=1)

    with batches_of(spark, 4):
        words = model.told()
        freed(spark, model.asked, *model.states)
        known = settle(model.tables().mapInArrow(_ask_task(seated, buckets), PIECES).withColumn("block", F.lit(None).cast("long")), "known")
        freed(spark, model.owned, *model.seats)
        pairs = _exchanged(model.asked_pairs.union(known), _find_task(SAMPLES), buckets, "of_pairs")
        freed(spark, known, model.asked_pairs)
        full = _with(_with(_with(blocks, counts, "counts"), words, "words"), pairs, "pairs")
        out = settle(full.mapInArrow(_score_task(m, buckets), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    freed(spark, words, pairs)
    return out.withColumn("train_tokens", F.lit(m["tokens"]).cast("long"))


def language_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (runs of all but white space, A-Z lower-cased) and one end. A null or empty text is its end alone. Each
    row is scored; rows of one doc_id are rows of their own, and a row without doc_id is in training. A text of any length is one whole
    piece of a block. Without training texts every probability is one. An empty table gives no rows; other columns are ignored.
    """
    blocks, buckets = blocked(docs)
    counts, owned = counted(blocks, buckets)
    model = Model(owned, buckets)
    out = scored(blocks, counts, model)
    freed(docs.sparkSession, blocks, counts)
    return out
