"""Fill-in-the-middle outputs against plain string work, and the exact way back."""

import hashlib

import pyarrow as pa
import pytest

from helpers import frame, odd_documents, prose, rows_of
from packetloom.llm import infilling


def _plain(doc_id, text, seed=1, rate=90, suffix_first=20, markers=infilling.MARKERS):
    text = text or ""
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in markers) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    p, s, m = markers
    a, b, c = text[:low], text[low:high], text[high:]
    spm = h[3] % 100 < suffix_first
    return doc_id, n, "spm" if spm else "psm", low, high - low, s + c + p + a + m + b if spm else p + a + s + c + m + b


ROWS = odd_documents() + [(100 + i, t, "en", "web", 1) for i, t in enumerate(
    ["<", "<P", "a<P>b", "<S", "S>", "P>", "M><", "<<<<>>>>", "<M>", "é", "漢字" * 5, "🙂🙃🙂", "x\x00<", "é", "> <P <S <M"] * 12)] + [
    (900 + i, prose(i, 20 + 9 * i), "en", "web", 1) for i in range(60)]


@pytest.mark.parametrize("markers", [infilling.MARKERS, ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")])
def test_outputs_and_way_back(spark, markers):
    out = infilling.transform(frame(spark, ROWS, extra=True), markers=markers)
    want = sorted((_plain(r[0], r[1], markers=markers) for r in ROWS), key=repr)
    assert rows_of(out) == want
    assert {r[2] for r in want} == set(infilling.FORMS)
    back = infilling.restore(out.selectExpr("form", "output", "doc_id"), markers)
    assert rows_of(back.select("doc_id", "restored")) == sorted(((r[0], r[1] or "") for r in ROWS), key=repr)


def test_digests(spark):
    got = rows_of(infilling.digests(frame(spark, ROWS)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted(((*w[:5], sha(w[5]), sha(r[1] or "")) for r in ROWS for w in [_plain(r[0], r[1])]), key=repr)
    assert infilling.digests(frame(spark, [])).collect() == []


def test_every_cut_of_short_texts():
    import numpy as np
    for text in ("", "a", "aé🙂b", "<P<"):
        cuts = [(i, j) for i in range(len(text) + 1) for j in range(i, len(text) + 1)]
        for form in (0, 1, 2):
            low, high = (np.array(c, np.int64) for c in zip(*cuts))
            forms = np.full(len(cuts), form)
            out = infilling.scatter(pa.array([text] * len(cuts)), forms, low, high)
            for got, (i, j) in zip(out.to_pylist(), cuts):
                a, b, c = text[:i], text[i:j], text[j:]
                assert got == (text, f"<P>{a}<S>{c}<M>{b}", f"<S>{c}<P>{a}<M>{b}")[form]
            assert infilling.gather(out, forms).to_pylist() == [text] * len(cuts)


def test_markers_are_checked():
    for bad in (("<P>", "<P>x", "<M>"), ("<P>", "[S]", "<M>"), ("<<P>", "<S>", "<M>"), ("", "", ""), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            infilling._checked(bad)
