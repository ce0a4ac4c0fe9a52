"""Token ids of many texts by a public tokenizer, each distinct word form encoded once a task.

For tokenizers that split at white space before anything else (``word_bpe_49k.json`` does) the ids of a text are
the ids of its words one after the other.  So the words of a block are hashed, the forms not yet known go through
the tokenizer, and the ids are gathered with NumPy.  The table of known forms starts again at ``KNOWN`` forms.
"""

from __future__ import annotations

import os
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from . import textscan as ts

KNOWN = 1_000_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


class WordEncoder:
    def __init__(self, path: str, specials_are_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(str(Path(path)))
        self.tokenizer.encode_special_tokens = specials_are_text
        self.powers = ts.Powers()
        self._forget()

    @classmethod
    def of_worker(cls, path: str, specials_are_text: bool = False) -> "WordEncoder":
        """The encoder of this Python worker, kept between its tasks with the forms it knows.

        Functions travel to workers by value and forget their globals, so it hangs on the tokenizer library.
        """
        import tokenizers
        held = vars(sys.modules[tokenizers.__name__]).setdefault("_word_encoders", {})
        key = (path, specials_are_text)
        if key not in held:
            held[key] = cls(path, specials_are_text)
        return held[key]

    def _forget(self):
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys, block, which):
        forms = [bytes(block.data[s:e]).decode() for s, e in zip(block.start[which].tolist(), block.end[which].tolist())]
        parts, counts = [], []
        for k in range(0, len(forms), 2000):  # the library's results are large objects
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(forms[k:k + 2000], add_special_tokens=False)]
            counts.append(np.array([len(i) for i in ids], np.int64))
            parts.append(np.fromiter((t for i in ids for t in i), np.uint32, int(counts[-1].sum())))
        count, new = np.concatenate(counts), np.concatenate(parts)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(new)), np.uint32)))
        self.flat[self.used:self.used + len(new)] = new
        first = self.used + np.cumsum(count) - count
        self.used += len(new)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.count, at, count)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        block = ts.Block(texts, self.powers)
        if not len(block.start):
            return np.zeros(0, np.uint32), np.zeros(block.n, np.int64)
        if len(self.keys) > KNOWN:
            self._forget()
        keys, first, back = np.unique(block.words(), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, keys)
        seen = np.zeros(len(keys), bool)
        inside = spot < len(self.keys)
        seen[inside] = self.keys[spot[inside]] == keys[inside]
        if not seen.all():
            self._learn(keys[~seen], block, first[~seen])
            spot = np.searchsorted(self.keys, keys)
        begin, count = self.first[spot][back], self.count[spot][back]
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        ids = self.flat[np.repeat(begin, count) + inner]
        return ids, np.bincount(block.text, weights=count, minlength=block.n).astype(np.int64)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    ends = np.cumsum(counts + 1) - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = ids
    return out, counts + 1
