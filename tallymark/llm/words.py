"""Vectorised words, word hashes and five-word shingles of whole Arrow batches of texts (numpy only).

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII bytes; ASCII and
Latin-1 capitals are folded. Everything is linear in the bytes of the batch, however long one
text or one word is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Fixed odd multipliers (64-bit).
BASE = 0x9E3779B97F4A7C15 | 1
MIX_1, MIX_2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
POSITION = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_is_word = np.zeros(256, bool)
_is_word[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_is_not_space = np.ones(256, bool)
_is_not_space[[32, *range(9, 14)]] = False
#: Powers that a process keeps, 16 bytes each.
KEPT_POWERS = 1 << 22
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> U(30))) * MIX_1
    x = (x ^ (x >> U(27))) * MIX_2
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each at least. Those for one very long text are not kept."""
    made = _powers
    if len(made.get("up", ())) < n:
        made = {} if n > KEPT_POWERS else _powers
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(max(n, 1 << 20), base, U)
            table[0] = 1
            made[key] = np.cumprod(table, dtype=U)
    return made["up"], made["down"]


class Words:
    """hashes: one per word of all texts in turn; bounds: text i has hashes[bounds[i]:bounds[i + 1]]."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        self.hashes, self.bounds = hashes, bounds

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def spaced_words(texts: pa.Array) -> Words:
    """Words as runs of all but white space (space, tab to carriage return); only A-Z are folded."""
    return words(texts, _is_not_space, False)


def words(texts: pa.Array, kept: np.ndarray = _is_word, latin: bool = True) -> Words:
    """Runs of the bytes that `kept` marks; capitals are folded, those of Latin-1 if `latin`."""
    body, at = raw_bytes(texts)
    n = len(body)
    if not n:
        return Words(np.zeros(0, U), np.zeros(len(at), np.int64))
    low = _fold[body]
    if latin:
        after_c3 = np.zeros(n, bool)
        after_c3[1:] = body[:-1] == 0xC3
        capital = after_c3 & (body >= 0x80) & (body <= 0x9E) & (body != 0x97)
        low = np.where(capital, low + np.uint8(0x20), low)
    inside = kept[body]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = at[(at > 0) & (at < n)]
    before[edges], after[edges - 1] = False, False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((low.astype(U) + U(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * down[begin])
    return Words(hashes, np.searchsorted(begin, at).astype(np.int64))


def shingles(w: Words, size: int = 5) -> Words:
    """Hashes of `size` words in a row; a text of fewer words (at least one) makes one shingle of all it has."""
    counts = w.counts
    made = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    total = int(bounds[-1])
    owner = np.repeat(np.arange(len(counts)), made)
    first = w.bounds[owner] + (np.arange(total) - bounds[owner])
    last = w.bounds[owner + 1] if total else first
    out = np.zeros(total, U)
    for k in range(size):
        at = first + k
        ok = at < last
        out += np.where(ok, w.hashes[np.minimum(at, max(len(w.hashes) - 1, 0))] * POSITION[k % 5], U(0)) if total else out
    return Words(mix(out), bounds)


def occurrences(w: Words) -> np.ndarray:
    """For each hash, how many equal ones its text has before it."""
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    order = np.lexsort((w.hashes, owner))
    h, o = w.hashes[order], owner[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    starts = np.flatnonzero(fresh)
    rank = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    out = np.empty(n, np.int64)
    out[order] = rank
    return out
