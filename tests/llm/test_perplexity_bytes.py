"""The registered query's language model takes the text itself: n-grams of bytes, not of classes of characters."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from helpers import frame, prose
from packetloom.llm import perplexity as px, queries, textscan as ts


def _bytes_of(text):
    """Bytes with a run of white space as one break."""
    out = []
    for byte in text.encode() + b" ":
        unit = 0 if byte in (32, 9, 10, 11, 12, 13) else 9 if byte == 0 else byte
        if unit or (out and out[-1]):
            out.append(unit)
    return out


def _four(text):
    units = [0] * 3 + _bytes_of(text)
    return [tuple(units[i:i + 4]) for i in range(len(units) - 3)]


def _plain(texts):
    """Modified Kneser-Ney by the textbook over four bytes."""
    tables = {4: Counter(g for t in texts for g in _four(t))}
    for size in (3, 2, 1):
        tables[size] = Counter(g[1:] for g in tables[size + 1])
    follow, cut = defaultdict(dict), {}
    for size, table in tables.items():
        t = Counter(table.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
        cut[size] = [max(0.05, min(k - (k + 1) * y * (t[k + 1] / t[k] if t[k] else k / (k + 1)), k - 0.05)) for k in (1, 2, 3)]
        for g, n in table.items():
            follow[g[:-1]][g[-1]] = n

    def p(g):
        if not g:
            return 1 / 256
        seen, d = follow.get(g[:-1]), cut[len(g)]
        if not seen:
            return p(g[1:])
        off = {u: d[min(n, 3) - 1] for u, n in seen.items()}
        total = sum(seen.values())
        return (seen[g[-1]] - off[g[-1]] if g[-1] in seen else 0) / total + sum(off.values()) / total * p(g[1:])
    return p


def test_every_byte_is_a_unit():
    texts = ["", None, " Ab\n\n Cb9 8.,# ", "éа漢\x00\t", "x"]
    keys, text, _ = px._grams(ts.Block(pa.array(texts), ts.Powers()), px.BYTES)
    want = [(i, int.from_bytes(bytes(g), "big")) for i, t in enumerate(texts) for g in _four(t or "")]
    assert list(zip(text.tolist(), keys.tolist())) == want
    every = px._grams(ts.Block(pa.array([c * 5 for c in map(chr, range(128))]), ts.Powers()), px.BYTES)[0]
    assert len({k for k in every.tolist() if k >= 2 ** 24 and k % 256}) == 128 - 6  # no two bytes fall together, white space apart


def test_registered_query_scores_the_text_itself(spark, tmp_path):
    """Swapped capitals, digits and letters of other scripts count; log perplexities are those of the textbook."""
    texts = [prose(i, 60).capitalize() + f". In 1{i % 3}0 Ra 190 мир " + prose(i + 9, 30) + "." for i in range(30)]
    texts += [texts[0].replace("Ra", "Qa"), texts[0].replace("190", "375"), texts[0].replace("мир", "цаф")]
    frame(spark, [(i, t, "en", None, 1) for i, t in enumerate(texts)]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_perplexity"] for r in queries.op10_perplexity(spark, str(tmp_path)).collect()}
    p = _plain(texts)
    for i, t in enumerate(texts):
        assert abs(got[i] + sum(math.log(p(g)) for g in _four(t)) / len(_four(t))) < 1e-4
    assert all(got[k] > got[0] + 1e-3 for k in (30, 31, 32))
    assert np.isfinite(list(got.values())).all()
