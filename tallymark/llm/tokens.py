"""Token ids by the tokenizers library, with a per-process memo of chunks between single spaces.

Byte-level BPE with the usual pattern never joins a letter with the single space that follows it,
so a text may be cut before any space that stands between two non-space characters. Chunks that are
not known yet are joined by spaces and encoded by the library in one call; as only a chunk's first
token can begin with a space, the ids are dealt back by the tokens that do. Texts with other white
space next to a space are cut at safe spaces only. Texts that hold the string of an added token go
to the library whole, which makes it that token's id. Cutting, telling the distinct chunks of a block
and putting their ids together are Arrow's work; Python sees each distinct chunk of a block once.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that each of the memo's two generations holds before it makes room, about 200 bytes apiece: a process holds
#: about 70 MB at most, the chunks of one step included.
MEMO_CHUNKS = 150_000
#: Distinct chunks that are looked up, and joined for the library, in one step.
STEP = 20_000
#: Characters of the longest chunk that is remembered.
LONGEST = 32
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"^ | $|\s | \s")
#: White space but spaces and line breaks, of which most texts have none.
_RARE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Texts that may have a space at an end or beside other white space, in RE2's syntax.
_MAYBE_ODD = rf"\A | \z|  |\n | \n|[{_RARE}]"
#: Marks, which are a piece of their own after a letter.
_MARKS = ".,;:!?#$%&*|"
_processes: dict[str, "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; a path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """This process's encoder for a vocabulary file."""
    if path not in _processes:
        _processes[path] = Encoder(path)
    return _processes[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Only byte-level BPE with its usual pattern may be cut at spaces; other vocabularies get whole texts.
        self.cuttable = (
            parts["normalizer"] is None and parts["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space") and not any(c.isspace() for a in self.added for c in a)
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether a token begins with a space, which byte-level BPE writes as the letter 256 + 32.
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t.startswith(chr(288))]] = True
        self.known, self.older, self.marks = {}, {}, {}

    def _any(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that each stand after a space; none has a space in it or other white space at an end."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.leads[ids])
        if len(starts) != len(chunks):
            raise ValueError("the vocabulary has tokens that hold a space inside")
        whole, at = ids.tobytes(), (4 * starts).tolist()
        return [whole[a:b] for a, b in zip(at, [*at[1:], len(whole)])]

    def _step(self, chunks: list[str]) -> list[bytes]:
        """The ids of different chunks that stand after a space."""
        if len(self.known) >= MEMO_CHUNKS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        plain, marked, long = {}, [], []
        for c in chunks:
            if c in known:
                continue
            if len(c) > LONGEST:
                long.append(c)
            if c in older:
                known[c] = older[c]
                continue
            word = c.rstrip(_MARKS)
            if word != c and word.isalpha():
                marked.append((c, word))
                if word in known or word in plain:
                    continue
                if word in older:
                    known[word] = older[word]
                    continue
                if len(word) > LONGEST:
                    long.append(word)
                c = word
            if c and " " not in c and not c[0].isspace() and not c[-1].isspace():
                plain[c] = None
            else:
                known[c] = self._any(" " + c)
        if plain:
            known.update(zip(plain, self._joined(list(plain))))
        for c, word in marked:
            marks = c[len(word) :]
            if marks not in self.marks:
                if len(self.marks) >= STEP:
                    self.marks.clear()
                self.marks[marks] = self._any(marks)
            known[c] = known[word] + self.marks[marks]
        out = list(map(known.__getitem__, chunks))
        for c in long:
            known.pop(c, None)
        return out

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts in turn, at least one of each, and where each text's begin."""
        if not self.cuttable:
            return texts, np.arange(len(texts))
        whole = np.zeros(len(texts), bool)
        for a in self.added:  # added tokens are cut out before all else
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, _MAYBE_ODD).to_numpy(zero_copy_only=False) | whole
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        if odd.any():
            own = [[t] if w else _SAFE.split(t) if _ODD.search(t) else t.split(" ") for t, w in zip(texts.filter(pa.array(odd)).to_pylist(), whole[odd].tolist())]
            place = np.empty(len(texts), np.int64)
            place[np.argsort(odd, kind="stable")] = np.arange(len(texts))
            lists = pa.concat_arrays([lists, pa.array(own, lists.type)]).take(pa.array(place))
        counts = pc.list_value_length(lists).to_numpy()
        return lists.flatten(), np.cumsum(counts, dtype=np.int64) - counts

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text; null counts as empty."""
        if not len(texts):
            return []
        chunks, first = self._cut(pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, ""))
        told = chunks.dictionary_encode()
        at = told.indices.to_numpy().astype(np.int64)
        later = np.ones(len(at), bool)
        later[first] = False
        used = np.bincount(at[later], minlength=len(told.dictionary)) > 0
        distinct = told.dictionary.filter(pa.array(used))
        at = (np.cumsum(used) - 1)[at]
        at[first] = len(distinct) + np.arange(len(first))
        parts = [pa.array(self._step(distinct.slice(k, STEP).to_numpy(zero_copy_only=False).tolist()), pa.large_binary()) for k in range(0, len(distinct), STEP)]
        parts.append(pa.array([self._any(t) if t else b"" for t in chunks.take(pa.array(first)).to_pylist()], pa.large_binary()))
        ids = pa.concat_arrays(parts).take(pa.array(at))
        _, offsets, body = ids.buffers()
        ends = np.frombuffer(offsets, "<i8")[np.append(first, len(ids))].tolist()
        return [body[a:b].to_pybytes() for a, b in zip(ends, ends[1:])] if body is not None else [b""] * len(first)
