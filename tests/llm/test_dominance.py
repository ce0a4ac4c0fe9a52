"""Dominance reduction against exact optima; packing against the tokenizer."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import frame, odd_documents, prose
from packetloom.llm import dominance
from packetloom.llm.tokens import tokenizer_path


def _optimum(items, capacity):
    """Fewest bins, by trying every set that holds the longest piece."""
    @lru_cache(None)
    def fewest(left):
        if not left:
            return 0
        best, seen = len(left), set()

        def grow(at, room, rest):
            nonlocal best
            if rest not in seen:
                seen.add(rest)
                best = min(best, 1 + fewest(rest))
            for i in range(at, len(rest)):
                if rest[i] <= room:
                    grow(i, room - rest[i], rest[:i] + rest[i + 1:])
        grow(0, capacity - left[0], left[1:])
        return best
    return fewest(tuple(sorted(items, reverse=True)))


def _check(plan, demand, capacity):
    held = Counter()
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= capacity and times > 0
        for s, n in pattern.items():
            held[s] += n * times
    assert held == Counter({s: n for s, n in demand.items() if n})


@pytest.mark.parametrize("seed", range(60))
def test_reduction_loses_no_optimum(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 17, 30, 100])
    items = [r.randint(max(1, capacity // r.choice([3, 4, 9])), capacity) for _ in range(r.randint(1, 11))]
    demand = Counter(items)
    fixed, left = dominance.reduce(dict(demand), capacity)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(t for _, t in fixed) + _optimum(rest, capacity) == _optimum(items, capacity)
    _check(fixed + dominance.best_fit(left, capacity), demand, capacity)


def test_every_rule_fires():
    assert dominance.reduce({10: 3}, 10) == ([({10: 1}, 3)], {})
    assert dominance.reduce({7: 2, 3: 2}, 10) == ([({7: 1, 3: 1}, 2)], {})
    assert dominance.reduce({5: 5}, 10) == ([({5: 2}, 2), ({5: 1}, 1)], {})
    assert ({6: 1, 3: 1}, 1) in dominance.reduce({6: 1, 3: 1, 2: 1}, 9)[0]  # fills the sequence
    assert ({60: 1, 30: 1, 9: 1}, 1) in dominance.reduce({60: 1, 30: 1, 9: 1}, 100)[0]  # a pair beside j


def _plain_best_fit(items, capacity):
    rooms = []
    for s in sorted(items, reverse=True):
        fitting = [r for r in rooms if r >= s]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_bulk_best_fit_equals_one_at_a_time(seed):
    r = random.Random(seed)
    items = [r.choice([r.randint(1, 40), 7, 12, 33]) for _ in range(r.randint(1, 300))]
    plan = dominance.best_fit(dict(Counter(items)), 40)
    _check(plan, Counter(items), 40)
    rooms = sorted(40 - sum(s * n for s, n in p.items()) for p, t in plan for _ in range(t))
    assert rooms == _plain_best_fit(items, 40)


def test_plan_of_billions_is_small():
    demand = {s: 1_000_000_007 // s for s in range(1, 2049)}
    plan = dominance.patterns(demand, 2048)
    _check(plan, demand, 2048)
    assert len(plan) < 3 * 2048
    assert sum(t for _, t in plan) * 2048 < 1.01 * sum(s * n for s, n in demand.items())


def test_packing(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = odd_documents() + [(1000 + i, prose(i, 20 + 11 * i), "en", "web", 1) for i in range(120)]
    rows += [(3000, "same words here", "en", "hot", 1)] * 90  # one document holds a third of all rows
    ids = {r[0]: np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], np.uint32) for r in rows if r[0] is not None}
    docs = frame(spark, rows, extra=True).repartition(6)
    out = dominance.pack(docs).collect()
    spans, filled = defaultdict(list), defaultdict(list)
    for p in out:
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
        assert p["start"] == 2048 * p["piece"]
        if p["doc_id"] is not None:
            whole = ids[p["doc_id"]]
            assert p["doc_tokens"] == len(whole) and p["length"] == min(2048, len(whole) - p["start"])
            assert p["ids_crc32"] == zlib.crc32(whole[p["start"]:p["start"] + p["length"]].tobytes())
            spans[p["doc_id"]].append(p["length"])
    copies = Counter(r[0] for r in rows)
    assert all(sum(spans[i]) == copies[i] * len(ids[i]) for i in ids)
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    lengths = [p["length"] for p in out]
    assert len(filled) <= len(_plain_best_fit(lengths, 2048))
    assert dominance.pack(frame(spark, [])).collect() == []
    flat = dominance.sequences(docs).agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"), F.max(F.size("ids")).alias("most")).first()
    assert (flat["n"], flat["ids"]) == (len(filled), sum(lengths)) and flat["most"] <= 2048
