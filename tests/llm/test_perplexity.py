"""The language model against a plain Kneser-Ney model, and the verdicts."""

import math
from collections import Counter, defaultdict

import numpy as np

from helpers import frame, odd_documents, prose
from packetloom.llm import perplexity as px


WORDS = prose(1, 40_000, vocabulary=300).split()


def _units(text):
    """Classes of a text's characters, by the letter of the description."""
    out = []
    for byte in text.encode():
        c = chr(byte)
        if byte in (32, 9, 10, 11, 12, 13):
            unit = 0
        elif byte >= 128:
            unit = 64 + byte % 64
        elif c.isalpha():
            unit = ord(c) - 96 if c.islower() else 27
        else:
            unit = 28 if c.isdigit() else 29 if c in ".!?" else 30 if c in ",;:" else 31
        if unit or (out and out[-1]):
            out.append(unit)
    return out + [0] * bool(out and out[-1])


def _grams_of(text, size=px.ORDER):
    units = [0] * (size - 1) + _units(text)
    return [tuple(units[i:i + size]) for i in range(len(units) - size + 1)]


def _pack(gram):
    out = 0
    for unit in gram:
        out = out << px.BITS | unit
    return out


def _plain_model(texts):
    """Probabilities by the textbook over n-grams of classes."""
    tables = {px.ORDER: Counter(g for t in texts for g in _grams_of(t))}
    for size in range(px.ORDER - 1, 0, -1):
        tables[size] = Counter(gram[1:] for gram in tables[size + 1])

    def discounts(counts):
        t = Counter(counts.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
        return [max(0.05, min(k - (k + 1) * y * (t[k + 1] / t[k] if t[k] else k / (k + 1)), k - 0.05)) for k in (1, 2, 3)]
    d = {size: discounts(t) for size, t in tables.items()}
    follow = {size: defaultdict(dict) for size in tables}
    for size, t in tables.items():
        for gram, n in t.items():
            follow[size][gram[:-1]][gram] = n

    def p(gram, size):
        if size == 0:
            return 1 / px.CLASSES
        gram = gram[-size:]
        seen = follow[size].get(gram[:-1])
        if not seen:
            return p(gram, size - 1)
        total, cut = sum(seen.values()), lambda n: d[size][min(n, 3) - 1]
        left = sum(cut(n) for n in seen.values()) / total
        own = (seen[gram] - cut(seen[gram])) / total if gram in seen else 0
        return own + left * p(gram, size - 1)
    return p


def test_model_is_kneser_ney(spark):
    texts = [prose(i, 40).capitalize() + ". " + prose(i + 50, 9).capitalize() + "!" for i in range(6)]
    model = px.build(frame(spark, [(i, t, "en", None, 1) for i, t in enumerate(texts)]))
    plain = _plain_model(texts)
    for text in ("kalo tu", "Unseen, 17 words", "lolololo.  Ka", "é x"):
        grams = _grams_of(text)
        got = model.log_p("en", np.array([_pack(g) for g in grams], np.int32))
        assert np.allclose(got, [math.log(plain(g, px.ORDER)) for g in grams], atol=1e-4)


def test_units_of_odd_texts():
    import pyarrow as pa
    from packetloom.llm import textscan as ts

    texts = ["", None, " \n\t ", "a", " Ab\n\n c9.,# ", "é漢\x00", "", "x"]
    keys, text, word = px._grams(ts.Block(pa.array(texts), ts.Powers()))
    assert word.tolist() == [sum(u == 0 for u in _units(t or "")[:k]) for t in texts for k in range(len(_units(t or "")))]
    assert list(zip(text.tolist(), keys.tolist())) == [(i, _pack(g)) for i, t in enumerate(texts) for g in _grams_of(t or "")]


def _sentences(seed, n, alphabet=None):
    """Prose in sentences of ten words of one vocabulary."""
    at = seed * 197 % (len(WORDS) - n)
    words = WORDS[at:at + n]
    if alphabet:
        words = [w.translate(alphabet) for w in words]
    return " ".join(" ".join([words[i].capitalize(), *words[i + 1:i + 10]]) + "." for i in range(0, n, 10))


def test_verdicts_equal_the_definition(spark):
    """Scores by the textbook model, bands by sorting, verdicts by both."""
    rows = [(i, _sentences(i, 60 + 10 * (i % 7)), "en", None, 1) for i in range(80)]
    rows += [(100, "zq xw " * 3 + " ".join(f"q{i}zxw" for i in range(60)), "en", None, 1), (101, rows[5][1], "en", None, 1)]
    got = {r["doc_id"]: r for r in px.rules(frame(spark, rows)).collect()}
    plain = _plain_model([r[1] for r in rows])
    value = {i: -sum(math.log(plain(g, px.ORDER)) for g in _grams_of(t)) / len(_grams_of(t)) for i, t, *_ in rows}
    assert all(abs(got[i]["log_perplexity"] - v) < 1e-4 for i, v in value.items())
    ordered = sorted({(len(t.split()), round(value[i], 9)) for i, t, *_ in rows}, key=lambda x: x[1])
    at = [ordered[max(0, math.ceil(len(ordered) * k / px.STEPS) - 1)][1] for k in range(px.STEPS + 1)]
    wide, low = min((at[k + px.STEPS // 2] - at[k], at[k]) for k in range(px.STEPS // 2 + 1))
    middle, half = low + wide / 2, max(wide / 2, 0.01)
    for i, t, *_ in rows:
        distance, room = abs(value[i] - middle), 4 * half * math.sqrt(1 + 200 / len(t.split()))
        if abs(distance - room) > 1e-3:
            assert got[i]["kept"] == (distance <= room)
    assert not got[100]["kept"] and sum(r["kept"] for r in got.values()) >= 80


def test_quotes_of_another_language_are_clean(spark):
    """Sentences of one language inside texts of another pass; the same words shuffled do not."""
    other = str.maketrans("kalomineturs", "zebgudpyvwjc")
    rows = [(i, _sentences(i, 200), "en", None, 1) for i in range(60)] + [(200 + i, _sentences(i, 200, other), "xx", None, 1) for i in range(60)]
    quoting = [(500 + i, _sentences(i, 120) + " " + _sentences(70 + i, 80, other) + " " + _sentences(90 + i, 60), "en", None, 1) for i in range(20)]
    kept = {x["doc_id"] for x in px.rules(frame(spark, rows + quoting)).collect() if x["kept"]}
    assert sum(r[0] in kept for r in quoting) >= 19


def test_garbage_is_rejected_and_does_not_move_the_bands(spark):
    """A third of all texts is garbage of one kind; order of words, mixed languages and letters are seen."""
    import random

    r = random.Random(8)
    other = str.maketrans("kalomineturs", "zebgudpyvwjc")
    clean = [(i, _sentences(i, 200), "en", None, 1) for i in range(120)] + [(200 + i, _sentences(900 + i, 200, other), "xx", None, 1) for i in range(60)]
    letters = [(1000 + i, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(200)), "en", None, 1) for i in range(70)]

    def shuffled(text):
        words = text.split()
        r.shuffle(words)
        return " ".join(words)
    mixed = [(2000 + i, shuffled(_sentences(i, 100) + " " + _sentences(900 + i, 100, other)), "en", None, 1) for i in range(20)]
    order = [(3000 + i, shuffled(_sentences(300 + i, 200)), "en", None, 1) for i in range(20)]
    kept = {x["doc_id"] for x in px.rules(frame(spark, clean + letters + mixed + order)).collect() if x["kept"]}
    share = lambda rows: sum(x[0] in kept for x in rows) / len(rows)
    assert share(clean) >= 0.95 and share(letters) == 0 and share(mixed) <= 0.1 and share(order) <= 0.2


def test_verdicts(spark):
    rows = [(i, prose(1, 150) if i < 0 else " ".join(prose(1, 4000).split()[i * 20:i * 20 + 120]), "en", None, 1) for i in range(120)]
    rows += [(500, "zq#xw " * 3 + " ".join(f"q{i}zxw%%" for i in range(100)), "en", None, 1), (501, "same words again and again here now " * 20, "en", None, 1)]
    out = {r["doc_id"]: r for r in px.rules(frame(spark, rows, extra=True)).collect()}
    assert all(out[i]["kept"] for i in range(120))
    assert not out[500]["kept"] and not out[500]["base_failed"]
    assert out[501]["base_failed"] and not out[501]["kept"]


def test_odd_cases(spark):
    rows = odd_documents()
    out = px.rules(frame(spark, rows, extra=True)).collect()
    assert sorted(map(repr, (r["doc_id"] for r in out))) == sorted(map(repr, (r[0] for r in rows)))
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in out if r["doc_id"] in (20, 21, 22))
    assert px.rules(frame(spark, [])).collect() == []
    kept = px.keep(frame(spark, rows, extra=True))
    assert kept.columns == frame(spark, rows, extra=True).columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(r["doc_id"]) for r in out if r["kept"])


def test_every_language_is_scored(spark):
    """Twelve languages of different letters: the smallest are judged by their own model and band, too."""
    rows = []
    for k in range(12):
        letters = str.maketrans("kalomineturs", "".join(chr(0x400 + 16 * k + i) for i in range(12)))
        rows += [(100 * k + i, prose(50 * k + i, 120, vocabulary=60 if k < 11 else 20).translate(letters), f"l{k:02}", None, 1) for i in range(12 - k // 2)]
    docs = frame(spark, rows)
    judged = {r["doc_id"]: r["lang"] for r in px.measure(docs, px.build(docs)).collect()}
    assert judged == {r[0]: r[2] for r in rows}
