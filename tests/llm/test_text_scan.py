"""The vectorised scans against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from packetloom.llm import perplexity, textscan as ts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té#*", max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    block = ts.Block(pa.array(texts, pa.string()), ts.Powers())
    words = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert block.text.tolist() == [i for i, _ in words]
    seen = {}
    for h, (_, w) in zip(block.words().tolist(), words):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_base_counts(texts):
    block = ts.Block(pa.array(texts, pa.string()), ts.Powers())
    got = perplexity.base_counts(block, block.words())
    for i, text in enumerate(texts):
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
        times, covered = Counter(windows), set()
        for k, w in enumerate(windows):
            if times[w] > 1:
                covered |= set(range(k, k + 8))
        lines = [line for line in text.split("\n") if WORD.search(line)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_slices_and_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 30, "c", ""])], ["text"])
    parts = list(ts.pieces(batch, limit=12))
    assert [p.num_rows for p in parts] == [2, 1, 2]
    whole, cut = ts.Block(batch.column(0), ts.Powers()), ts.Block(parts[2].column(0), ts.Powers())
    assert cut.words()[0] == whole.words()[2]
    assert np.array_equal(cut.counts(), [1, 0])
