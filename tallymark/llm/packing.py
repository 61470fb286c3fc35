"""Cost-balanced packing of documents into fixed-length training sequences.

Each task tokenises its share of the documents and packs it on the spot: nothing is shuffled and
no task depends on another. Documents longer than a sequence give whole sequences first. The rest
is packed in windows: with cost = linear * n + quadratic * n * n for a piece of n tokens, pieces go
in descending order to the lowest-cost open sequence that still has room; a piece that fits nowhere
whole is cut over the emptiest sequences. A window has just as many sequences as its tokens need, so
all but the tail of the last are full; that tail is carried into the next window, and the tail of a
task is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, small_batches
from .tokens import encoder

SEQUENCE_TOKENS = 2048
#: Cost of a piece of n tokens: LINEAR * n for the dense layers plus QUADRATIC * n * n for attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: A window is packed once it holds so many tokens or so many pieces.
WINDOW_TOKENS, WINDOW_PIECES = 1 << 18, 8192
END_ID = 1

Piece = tuple[int, int, int]  # document (index in the window), start in the document, length


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack_window(pieces: list[Piece], size: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences of `size` tokens and the pieces that are left over (fewer than `size` tokens)."""
    total = sum(p[2] for p in pieces)
    n = total // size
    if not n:
        return [], pieces
    room, load = np.full(n, size, np.int64), np.zeros(n)
    rows: list[list[Piece]] = [[] for _ in range(n)]
    rest: list[Piece] = []

    def put(at: int, p: Piece) -> None:
        rows[at].append(p)
        room[at] -= p[2]
        load[at] += cost(p[2])

    for p in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        fits = np.flatnonzero(room >= p[2])
        if len(fits):
            put(int(fits[np.argmin(load[fits])]), p)
        else:
            rest.append(p)
    left: list[Piece] = []
    emptiest = iter(np.argsort(-room, kind="stable").tolist())
    at = next(emptiest, None)
    for doc, start, length in rest:
        while length and at is not None:
            take = min(length, int(room[at]))
            if take:
                put(at, (doc, start, take))
                start, length = start + take, length - take
            if not room[at]:
                at = next(emptiest, None)
        if length:
            left.append((doc, start, length))
    return rows, left


def power_of_two_tail(pieces: list[Piece]) -> list[list[Piece]]:
    """The rest of a task as sequences of power-of-two lengths, largest first."""
    out = []
    total = sum(p[2] for p in pieces)
    queue = sorted(pieces, key=lambda p: (-p[2], p[0], p[1]))
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        row: list[Piece] = []
        while size:
            doc, start, length = queue.pop(0)
            take = min(length, size)
            row.append((doc, start, take))
            size -= take
            if length > take:
                queue.insert(0, (doc, start + take, length - take))
        out.append(row)
    return out


class _Packer:
    """Packs one task's documents; holds a window of them at a time."""

    def __init__(self, size: int, task: int):
        self.size, self.next_id = size, task << 40
        self.docs: list[tuple[int | None, bytes, int, int]] = []  # id, ids from a start on, that start, ids in all
        self.pieces: list[Piece] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n - n % self.size
        for start in range(0, whole, self.size):
            self.rows.append((doc_id, start, self.size, n, self.next_id, 0, ids[4 * start : 4 * (start + self.size)]))
            self.next_id += 1
        if n > whole:
            self.pieces.append((len(self.docs), whole, n - whole))
            self.docs.append((doc_id, ids[4 * whole :], whole, n))
            self.tokens += n - whole
        if self.tokens >= WINDOW_TOKENS or len(self.pieces) >= WINDOW_PIECES:
            self.close(False)

    def close(self, last: bool) -> None:
        rows, left = pack_window(self.pieces, self.size)
        for row in rows + (power_of_two_tail(left) if last else []):
            self._emit(row)
        keep = {} if last else {doc: k for k, doc in enumerate(sorted({p[0] for p in left}))}
        self.pieces = [] if last else [(keep[doc], start, length) for doc, start, length in left]
        self.docs = [self.docs[doc] for doc in keep]
        self.tokens = sum(p[2] for p in self.pieces)

    def _emit(self, row: list[Piece]) -> None:
        offset = 0
        for doc, start, length in row:
            doc_id, ids, base, n = self.docs[doc]
            self.rows.append((doc_id, start, length, n, self.next_id, offset, ids[4 * (start - base) : 4 * (start - base + length)]))
            offset += length
        self.next_id += 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            kinds = [pa.int64()] * 6 + [pa.binary()]
            for k in range(0, len(self.rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows[k : k + 2000]), kinds)], COLUMNS)
            self.rows = []


COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def _pack_task(vocabulary: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = _Packer(size, TaskContext.get().partitionId()), encoder(vocabulary).encode
        end = np.array([END_ID], "<u4").tobytes()
        for b in gathered(batches, "text"):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text"))):
                packer.add(doc_id, ids + end)
            yield from packer.batches()
        packer.close(True)
        yield from packer.batches()

    return run


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", size: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A document's ids are its text's, then id 1. A null text counts as empty (one id); a null
    doc_id stays null; repeated rows are packed each for itself; an empty table gives no pieces;
    other columns are ignored. sequence_id is unique, not gapless: the task's number times 2**40
    plus a count. Equal inputs in equal partitions give equal results.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"{c} long" for c in COLUMNS[:-1]) + ", ids binary"
    return rows.mapInArrow(_pack_task(vocabulary, size), schema)


def packed_digest(docs: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
