"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words, pairs of neighbours and pairs with one word between, each as a
position of a table of 2**TABLE_BITS, present or not. Training visits a bounded sample of labelled
texts in hashed order; every coordinate has its own rate, and the L1 term leaves few weights, which
are broadcast as (position, weight).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, is_held_out, small_batches
from .words import POSITION, U, Words, mix, words

TABLE_BITS = 22
#: The bounded training sample: about so many labelled rows that are not held out.
SAMPLE_ROWS = 20_000
ALPHA, BETA, L1, L2, EPOCHS = 0.08, 1.0, 1.5, 1.0, 2
#: Scores from here on are predicted as toxic.
THRESHOLD = 0.3
#: Salts of the three kinds of features.
WORD, NEIGHBOURS, SKIP = U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, position) of every feature, repeats included."""
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    h = w.hashes
    made, of = [mix(h ^ WORD)], [owner]
    for gap, salt in ((1, NEIGHBOURS), (2, SKIP)):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            made.append(mix((h[:-gap] * POSITION[0] + h[gap:] * POSITION[1])[same] ^ salt))
            of.append(owner[gap:][same])
    return np.concatenate(of), (np.concatenate(made) >> U(64 - TABLE_BITS)).astype(np.int64)


class Ftrl:
    """The state of the learner: z and n of each coordinate; position 2**TABLE_BITS is the bias, without L1."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.size = size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.size, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task over the bounded sample -> the weights that are not 0."""
    rows: list[tuple[int, int, np.ndarray]] = []
    size = 1 << TABLE_BITS
    for batch in batches:
        for b in blocks(batch, "text"):
            owner, at = features(words(b.column("text")))
            order = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[order], np.arange(b.num_rows + 1))
            for k, (turn, label) in enumerate(zip(b.column("turn").to_pylist(), b.column("toxic").to_pylist())):
                own = np.unique(at[order[cut[k] : cut[k + 1]]]).astype(np.int32)
                rows.append((turn, int(label), np.append(own, np.int32(size))))
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    model = Ftrl(size)
    for _ in range(EPOCHS):
        for _, label, at in rows:
            model.learn(at.astype(np.int64), label)
    touched = np.flatnonzero(model.n)
    w = model.weights(touched)
    kept = w != 0
    yield pa.RecordBatch.from_arrays([pa.array(touched[kept].astype(np.int32)), pa.array(w[kept].astype(np.float32))], ["position", "weight"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions and weights, learnt from about SAMPLE_ROWS labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    turn = F.xxhash64(F.lit("toxicity"), F.col("l_id"))
    rate = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    sample = known.where(F.pmod(turn, F.lit(1 << 20)) < rate * (1 << 20)).withColumn("turn", turn)  # SAMPLE_ROWS rows, give or take a few
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("d_id"), text.alias("text")).join(F.broadcast(sample), F.col("d_id") == F.col("l_id"))
    got = rows.select("turn", "toxic", "text").repartition(1).mapInArrow(_train_task, "position int, weight float").toArrow()
    order = np.argsort(got.column("position").to_numpy())
    return got.column("position").to_numpy()[order], got.column("weight").to_numpy()[order]


def _score_task(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position, weight = model.value
        table = np.zeros((1 << TABLE_BITS) + 1, np.float32)
        table[position] = weight
        for batch in batches:
            for b in blocks(batch, "text"):
                owner, at = features(words(b.column("text")))
                hit = table[at] != 0
                once = np.unique(owner[hit] * (1 << TABLE_BITS) + at[hit])
                own, at = once >> TABLE_BITS, once & ((1 << TABLE_BITS) - 1)
                total = np.bincount(own, weights=table[at], minlength=b.num_rows) + table[-1]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every whole text.

    A null or empty text has the score of the bias alone. Labels without id, with a null mark or
    of documents that are not there are not used; of several labels of one document the highest
    counts. Without labels every score is one half. Repeated rows are scored each for itself; a
    null doc_id is never held out; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_score_task(model), "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, with the mark of those that were held out of training."""
    made = score(docs, labels)
    return made.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
