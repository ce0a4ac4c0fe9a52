"""Signatures against exact similarity, classes against all pairs."""

import numpy as np

from helpers import frame, odd_documents, prose
from packetloom.llm import minhash
from packetloom.llm.components import components


def _edit(text: str, every: int, word: str) -> str:
    return " ".join(word + str(i) if i % every == every - 1 else w for i, w in enumerate(text.split()))


def _shingles(text):
    w = (text or "").split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def test_agreement_is_weighted_jaccard():
    r = np.random.default_rng(1)
    n, k = 40, 300
    text, shingle = np.repeat(np.arange(2 * n), k), np.tile(np.arange(k, dtype=np.uint64) * np.uint64(7919), 2 * n)
    weight = r.integers(0, 6, 2 * n * k) * (r.random(2 * n * k) < 0.7)
    weight[n * k:] = np.where(r.random(n * k) < 0.6, weight[:n * k], weight[n * k:])
    keep = weight > 0
    sign = minhash.signatures(text[keep], shingle[keep], weight[keep], 2 * n)
    a, b = weight[:n * k].reshape(n, k), weight[n * k:].reshape(n, k)
    exact = np.minimum(a, b).sum(1) / np.maximum(a, b).sum(1)
    agree = (sign[:n] == sign[n:]).mean(1)
    assert abs((agree - exact).mean()) < 0.02 and np.abs(agree - exact).max() < 0.2


def test_signature_does_not_depend_on_the_block():
    shingle, weight = np.arange(50, dtype=np.uint64) + np.uint64(12345), np.arange(50) % 4 + 1
    alone = minhash.signatures(np.zeros(50, int), shingle, weight, 1)
    among = minhash.signatures(np.repeat([1, 2], [50, 1]), np.append(shingle, np.uint64(3)), np.append(weight, 1), 4)
    assert np.array_equal(alone[0], among[1]) and not among[[0, 3]].any()


def test_classes_against_all_pairs(spark):
    rows = odd_documents()
    base = prose(1000, 400)
    rows += [(100, base, "en", None, 1)] + [(101 + i, _edit(base, 60 + i, f"new{i}x"), "en", None, 1) for i in range(25)]
    rows += [(200, prose(7, 100) + " " + base[:300], "en", None, 1), (201, base + " " + base, "en", None, 1), (300, "tiny text", "en", None, 1), (301, "tiny text", "en", None, 1)]
    known = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    root = {i: i for i in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sorted(known):
        for j in sorted(known):
            a, b = _shingles(known[i]), _shingles(known[j])
            if i < j and (known[i] == known[j] or (a and b and len(a & b) >= 0.8 * len(a | b))):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    out = minhash.classes(frame(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None} == {i: find(i) for i in known}
    assert all(r["class_id"] is None for r in out if r["doc_id"] is None)


def test_empty_table(spark):
    assert minhash.classes(frame(spark, [])).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 102), (101, 102), (50, 50)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100} | {1000 + i: 1000 for i in range(200)}
    assert got == want


def _all_pairs(known):
    """Class of every document by comparing all pairs."""
    root, grams = {i: i for i in known}, {i: _shingles(t) for i, t in known.items()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sorted(known):
        for j in sorted(known):
            a, b = grams[i], grams[j]
            if i < j and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in known}


def _classes(spark, texts):
    docs = frame(spark, [(i, t, "en", None, 1) for i, t in enumerate(texts)])
    return {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}


def _roots(links, root):
    """Roots after joining links."""
    now = dict(root)
    for a, b in links:
        x, y = now[a], now[b]
        now = {i: min(x, y) if r in (x, y) else r for i, r in now.items()}
    return now


def test_settled_buckets_join_what_links_join(spark, monkeypatch):
    """Links between components are found whatever the chunks, and no more links than join something."""
    r = np.random.default_rng(3)
    base = prose(77, 160).split()
    texts = []
    for i in range(60):
        now = list(base)
        for at in r.choice(160, int(r.integers(0, 9)), replace=False):
            now[at] = f"w{i}a{at}"
        texts.append(" ".join(now))
    docs = frame(spark, [(i, t, "en", None, 1) for i, t in enumerate(texts)])
    rows = minhash.sketch(docs.select("doc_id", "text")).selectExpr("doc_id AS rep", "sign", "buckets", "n")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    met = rows.selectExpr("rep", "explode(buckets) AS bucket")
    root = {i: i if i % 3 else i % 2 for i in range(60)}
    given = spark.createDataFrame([(i, x) for i, x in root.items() if i % 5], "node bigint, root bigint")
    root = {i: x if i % 5 else i for i, x in root.items()}
    grams = [_shingles(t) for t in texts]
    want = _roots([(i, j) for i in range(60) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])], root)
    side = docs.selectExpr("doc_id AS rep", "text")
    for chunk in (400, 2000, 1 << 20):
        monkeypatch.setattr(minhash, "CHUNK_SHINGLES", chunk)
        found = minhash.settled(met, rows, side, given).collect()
        assert all(abs(len(grams[a] & grams[b]) / len(grams[a] | grams[b]) - s) < 1e-9 and s >= 0.8 for a, b, s in found)
        got = _roots([(a, b) for a, b, _ in found], root)
        same = lambda x: {frozenset(i for i in x if x[i] == v) for v in x.values()}
        assert same(got) == same(want)


def test_drifting_copies_against_all_pairs(spark):
    """Each text is near some of its group only, so the best leader is often not a link and the next ones count."""
    texts = []
    for group in range(12):
        r = np.random.default_rng(100 + group)
        made = [prose(2000 + group, 200).split()]
        for k in range(14):
            now = list(made[int(r.integers(0, len(made)))])
            for at in r.choice(200, int(r.integers(2, 6)), replace=False):
                now[at] = f"v{group}k{k}a{at}"
            made.append(now)
        texts += [" ".join(made[i]) for i in r.permutation(len(made))]
    want = _all_pairs(dict(enumerate(texts)))
    assert len(set(want.values())) > 12
    assert _classes(spark, texts) == want


def test_a_template_with_many_texts_just_too_far_apart(spark):
    """300 texts of one template, most pairs below 0.8: nothing is lost and exact comparisons hand on few rows."""
    r = np.random.default_rng(9)
    base = prose(5000, 180).split()
    texts = []
    for i in range(300):
        now = list(base)
        for at in r.choice(180, int(r.integers(3, 8)), replace=False):
            now[at] = f"t{i}a{at}"
        texts.append(" ".join(now))
    want = _all_pairs(dict(enumerate(texts)))
    assert 1 < len(set(want.values())) < 300
    assert _classes(spark, texts) == want


def test_multisets(spark):
    """With counts as weights a doubled text is no near copy of the single one."""
    once = prose(31, 120)
    texts = [once, once + " " + once, " ".join(once.split()[:-3] + ["x", "y", "z"])]
    docs = frame(spark, [(i, t, "en", None, 1) for i, t in enumerate(texts)])
    assert [r["class_id"] for r in minhash.classes(docs, weight="count").orderBy("doc_id").collect()] == [0, 1, 0]
    assert [r["class_id"] for r in minhash.classes(docs).orderBy("doc_id").collect()] == [0, 0, 0]
