"""Dice matches against plain Python."""

from collections import Counter

from helpers import frame, odd_documents, prose, rows_of
from packetloom.llm import licenses


def _plain(rows, templates, least):
    out = set()
    for doc_id, text, *_ in rows:
        for unit, parts in (("line", (text or "").split("\n")), ("text", [(text or "")])):
            for position, part in enumerate(parts):
                grams = licenses._bigrams(part)
                for name, t in templates:
                    wanted = licenses._bigrams(t)
                    size = sum(grams.values()) + sum(wanted.values())
                    dice = 2.0 * sum(min(c, wanted[g]) for g, c in grams.items()) / size
                    if grams and dice >= least:
                        out.add((doc_id, unit, position, name, dice))
        best, words = {}, licenses._words(text or "")
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        for name, t in templates:
            wanted = [f"{a} {b}" for a, b in zip(licenses._words(t), licenses._words(t)[1:])]
            votes = Counter(i - j for i, a in enumerate(pairs) for j, b in enumerate(wanted) if a == b)
            for start, n in votes.items():
                inside = Counter(pairs[max(start, 0):start + len(wanted)])
                dice = 2.0 * sum((inside & Counter(wanted)).values()) / (inside.total() + len(wanted))
                if 4 * n >= len(wanted) and dice >= least:
                    key = (doc_id, "window", max(start, 0), name)
                    best[key] = max(best.get(key, 0), dice)
        out |= {(*k, d) for k, d in best.items()}
    return sorted(out, key=repr)


def test_against_plain_python(spark):
    mit = dict(licenses.TEMPLATES)["mit-grant"]
    gpl = dict(licenses.TEMPLATES)["gpl-3.0"]
    texts = [mit, mit.upper().replace(",", " -"), f"{prose(1, 20)}\n{gpl}\n{prose(2, 20)}\n{gpl}", " ".join(mit.split()[:40]), gpl.replace("work", "thing"),
             "license " * 50, "Released under the MIT License", mit + " " + prose(3, 10), "the license of software"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + odd_documents()
    for least in (0.8, 0.6):
        assert rows_of(licenses.scan(frame(spark, rows, extra=True), least=least)) == _plain(rows, licenses.TEMPLATES, least)


def test_wrapped_and_embedded_notices(spark):
    """A notice wrapped over lines of a file, behind comment marks or inside a paragraph is found where it stands."""
    mit = dict(licenses.TEMPLATES)["mit-grant"].split()
    wrapped = "\n".join("# " + " ".join(mit[i:i + 8]) for i in range(0, len(mit), 8))
    texts = [f"#!/bin/sh\n{wrapped}\n\n" + "\n".join(prose(i, 12) for i in range(40)),
             prose(5, 200) + " " + " ".join(mit) + " " + prose(6, 200),
             prose(5, 90) + " " + " ".join(mit[:30] + ["new", "words"] + mit[30:]) + " " + prose(6, 90),
             prose(5, 90) + " " + " ".join(mit[:20]) + " " + prose(6, 90)]
    got = licenses.scan(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()
    assert {(r["doc_id"], r["position"]) for r in got if r["template"] == "mit-grant" and r["unit"] == "window"} >= {(0, 2), (1, 200)}
    assert {r["doc_id"] for r in got} == {0, 1, 2}


def test_empty_table(spark):
    assert licenses.scan(frame(spark, [])).collect() == []


def test_plan_is_native(spark):
    plan = licenses.scan(frame(spark, odd_documents()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
