import random

import pytest

from packetloom.operators import cooldown as chains
from packetloom.operators.cooldown import cooldown


def brute(rows, seconds):
    last, out = {}, []
    for key, ts, pkt, text in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or ts - last[key] >= seconds:
            last[key] = ts
            out.append((key, ts, pkt, text))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    gaps = {
        "dense": lambda: rng.expovariate(5), "sparse": lambda: rng.expovariate(0.02),
        None: lambda: rng.choice([0, 1, 2.5, 31]), "regular": lambda: 0.25, "burst": lambda: rng.choice([0, 0, 0, 0, 40]),
    }
    out = []
    for key, gap in gaps.items():
        ts = 1700000000.0
        for i in range(50 if key == "sparse" else 800):
            ts += gap()
            out.append((key, ts, len(out), f"x{i}"))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts double, pkt_id long, text string").repartition(3)


# Small fans and more levels put many block borders into the data.
@pytest.mark.parametrize("seconds,fan,levels,few", [
    (30.0, 16, 2, 0), (30.0, 2, 3, 0), (30.0, 1, 1, 0), (7.3, 3, 4, 0), (500.0, 2, 2, 0), (30.0, 16, 2, 10**6), (7.3, 16, 2, 10**6)])
def test_same_as_one_by_one(frame, rows, seconds, fan, levels, few, monkeypatch):
    monkeypatch.setattr(chains, "FEW", few)
    got = cooldown(frame, ["k"], seconds, fan=fan, levels=levels).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, seconds)


def test_known_chain_and_no_cooldown(spark):
    df = spark.createDataFrame([("a", float(t), t) for t in (0, 10, 29, 31, 60, 61, 70)], "k string, ts double, pkt_id long")
    assert sorted(r.ts for r in cooldown(df, ["k"], 30).collect()) == [0, 31, 61]
    assert cooldown(df, ["k"], 0).count() == 7


def test_two_keys_with_nulls(spark):
    data = [("a", None, 1.0, 1), ("a", None, 2.0, 2), (None, None, 1.5, 3), (None, "b", 2.0, 4), (None, "b", 40.0, 5)]
    df = spark.createDataFrame(data, "x string, y string, ts double, pkt_id long")
    assert sorted(r.pkt_id for r in cooldown(df, ["x", "y"], 30).collect()) == [1, 3, 4, 5]
