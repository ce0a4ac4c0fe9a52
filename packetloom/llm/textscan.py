"""Words, lines and n-grams of many texts at once, as positions in one byte buffer.

Inside a Spark task the texts of an Arrow batch lie one after the other in a single UTF-8 buffer.  Everything
here works on that buffer with NumPy: no text is split into Python strings.  A span of bytes is hashed with a
polynomial modulo 2**64, so that prefix sums give the hash of any span in constant time.

Memory: about 60 bytes for each byte of a block; a block holds ``BLOCK_BYTES`` of text or one longer text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93

#: Separator tables: index by byte.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
PUNCT = WHITE.copy()
PUNCT[:128] |= ~np.array([chr(b).isalnum() for b in range(128)])


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h + np.uint64((salt * 2 + 1) * _BASE % 2**64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(32)
    return h


class Powers:
    """Powers of the hash base and of its inverse, grown on demand; one per task."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if len(self.up) <= n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


class Block:
    """The words of some texts.

    data: bytes; text_start, text_end: each text's span; start, end: each word's span; text: its text's number.
    """

    def __init__(self, texts: pa.Array, powers: Powers, separators: np.ndarray = WHITE):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        raw = texts.buffers()[2]
        # one separator after each text, so that no word runs over into the next text
        body = np.frombuffer(raw, np.uint8)[low:high] if raw is not None and high > low else np.zeros(0, np.uint8)
        lengths = np.diff(offsets) if len(offsets) else np.zeros(0, np.int64)
        self.n = len(texts)
        self.text_end = np.cumsum(lengths + 1) - 1
        self.text_start = self.text_end - lengths
        self.data = np.full(len(body) + self.n, 10, np.uint8)
        keep = np.ones(len(self.data), bool)
        keep[self.text_end] = False
        self.data[keep] = body
        inside = ~separators[self.data]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        self.inside = inside
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.text = np.searchsorted(self.text_end, self.start, "right")
        self.powers = powers
        self._sums = None

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
        up, down = self.powers.to(len(self.data) + 1)
        if self._sums is None:
            terms = (self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)]
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        return mix((self._sums[end] - self._sums[start]) * down[start])

    def words(self) -> np.ndarray:
        return self.hash(self.start, self.end)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return sums[self.text_end] - sums[self.text_start]

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.text, minlength=self.n)

    def grams(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position of the first word) of every run of `size` words inside one text."""
        m = len(words) - size + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(self.text[:m] == self.text[size - 1:])
        h = np.zeros(len(first), np.uint64)
        for k in range(size):
            h = h * np.uint64(_BASE) + words[first + k]
        return mix(h), first


def repeats(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many of each text's hashes are repeats of an earlier one (compared by their upper bits)."""
    bits = np.uint64(max(1, int(n).bit_length()))
    keys = np.sort((text.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits))
    again = keys[1:][keys[1:] == keys[:-1]] >> (np.uint64(64) - bits)
    return np.bincount(again.astype(np.int64), minlength=n)


def pieces(batch: pa.RecordBatch, column: str | tuple = "text", limit: int = BLOCK_BYTES, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most `rows` rows with at most `limit` bytes of text (or one row)."""
    if not batch.num_rows:
        return
    columns = (column,) if isinstance(column, str) else column
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends, first, total = np.cumsum(sizes), 0, 0
    while first < batch.num_rows:
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, total + limit, "right"))))
        yield batch.slice(first, last - first)
        first, total = last, int(ends[min(last, batch.num_rows) - 1])


def modest_batches(df):
    """Hand texts to Python a thousand rows at a time: ten thousand (Spark's default) fill an executor's memory outside its heap.

    A smaller setting of the session stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= 1000:
        conf.set(name, "1000")
    return df


def map_texts(df, make: Callable, schema: str, column: str = "text", limit: int = BLOCK_BYTES):
    """Run ``make()(rows: RecordBatch) -> RecordBatch | None`` over runs of rows; ``make`` is called once a task."""

    def task(batches):
        one = make()
        for batch in batches:
            for rows in pieces(batch, column, limit):
                out = one(rows)
                if out is not None and out.num_rows:
                    yield out

    return modest_batches(df).mapInArrow(task, schema)
