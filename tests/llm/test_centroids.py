"""Threshold-algorithm clustering against brute force."""

import hashlib

import numpy as np

from packetloom.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def _brute(rows, k, rounds, size):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    c = [list(q) for _, q in sorted(kept, key=key)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x)), n) for n, x in enumerate(c))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for n in range(len(c)):
            mine = [q for (_, q), o in zip(kept, of) if o == n]
            if mine:
                c[n] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [(i, *near(q)[::-1]) for i, q in kept]
    total = sum(d for _, _, d in last)
    return sorted(((i, n, d, sum(e for _, m, e in last if m == n), total, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest())
                   for i, n, d in last), key=repr)


def _rows():
    r = np.random.default_rng(5)
    middles = r.normal(0, 0.5, (6, 8))
    rows = [(i, (middles[i % 6] + r.normal(0, 0.2, 8)).tolist(), 0) for i in range(120)]
    rows += [(200 + i, [0.25] * 8, 1) for i in range(30)] + [rows[3], rows[3]]  # a common vector, repeated rows
    rows += [(300, [0.5] * 4 + [-0.5] * 4, 0), (301, [-0.5] * 4 + [0.5] * 4, 0)]  # ties
    rows += [(400, None, 0), (401, [], 0), (402, [1.0] * 7, 0), (403, [1.0] * 9, 0), (404, [1.0] * 7 + [None], 0),
             (405, [1.0] * 7 + [float("nan")], 0), (406, [1.0] * 7 + [float("inf")], 0), (None, [0.1] * 8, 0)]
    return rows


def test_clusters_equal_brute_force(spark):
    rows = _rows()
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS cluster", "'x' AS q", "'x' AS distance").repartition(5)
    for k, rounds in ((7, 3), (1, 1), (500, 1)):
        got = sorted(map(tuple, centroids.clusters(table, k, rounds, size=8).collect()), key=repr)
        assert got == _brute(rows, k, rounds, 8)
    assert centroids.clusters(spark.createDataFrame([], SCHEMA), size=8).collect() == []


def test_huge_components_are_held_in_range(spark):
    got = centroids.clusters(spark.createDataFrame([(1, [3e38, -3e38], 0), (2, [-3e38, 3e38], 0), (3, [0.0, 0.0], 0)], SCHEMA), 1, 0, size=2).collect()
    assert sorted(r["distance"] for r in got)[-1] <= 2 * (2**28) ** 2


def test_walk_stops_early_and_keeps_ties():
    r = np.random.default_rng(1)
    middles = r.integers(-900, 900, (40, 16))
    x = np.concatenate((middles[r.integers(0, 40, 3000)] + r.integers(-40, 40, (3000, 16)), middles[:3], np.repeat((middles[:1] + middles[1:2]) // 2, 2, 0)))
    doubled = np.concatenate((middles, middles[:5]))  # equal centroids: the smaller number wins
    d = ((x[:, None] - doubled[None]) ** 2).sum(2)
    cluster, distance, asked = centroids.nearest(x, doubled)
    assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert asked < 0.75 * d.size
