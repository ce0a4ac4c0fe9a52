"""Greedy alert suppression per key, split so that no hot key lands in one task.

A candidate fires when nothing fired for its key in the last ``seconds``.  That is a chain:
the next alert is the first candidate at or after ``last + seconds``.  Following it needs
order, but a block of time only needs one number from the past, the time from which alerts
are allowed again, and it answers with one number, its last alert.  So:

1. cut each key's time line into blocks many cooldowns long and reduce every block to the
   steps ``(start, last alert)`` of that function (only candidates in the first cooldown of
   the block can be a start, so a block shrinks by the same factor);
2. reduce blocks of blocks the same way, ``levels`` times, and walk the few steps that are
   left per key;
3. hand the answers back down, and walk each block of candidates with its known start.

The result is the exact chain.  Groups are bounded by rate x block length, never by key.  While there are at most
``FEW`` candidates in all, each key is walked as one block: the same chain with fewer steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: So many times of eight bytes fit any task, even if all are of one key.
FEW = 200_000
_STEP = "array<struct<start:double,last:double>>"
_KEY, _BLOCK = "__key", "__block"


def _chain_next(start: np.ndarray, last: np.ndarray, seconds: float) -> np.ndarray:
    """Index of the step that follows each step; len(start) where the chain leaves the block."""
    return np.append(np.searchsorted(start, last + seconds, side="left"), len(start))


def _reduce_block(start, last, block_start: float, seconds: float) -> list:
    """Steps of a whole block from the ordered steps of its parts."""
    n = len(start)
    if n == 0:
        return []
    nxt = _chain_next(start, last, seconds)
    final = np.append(np.arange(n), n)
    while True:  # pointer doubling: log2(chain length) rounds
        ahead = nxt[final]
        moved = ahead < n
        if not moved.any():
            break
        final = np.where(moved, final[np.minimum(ahead, n)], final)
    exits = last[final[:n]]
    keep = min(int(np.searchsorted(start, block_start + seconds, side="left")) + 1, n)
    start, exits = start[:keep], exits[:keep]
    tail = np.append(exits[1:] != exits[:-1], True)  # starts that share an exit: the latest decides
    return [{"start": float(s), "last": float(e)} for s, e in zip(start[tail], exits[tail])]


def _walk(start, last, previous, seconds: float) -> np.ndarray:
    """Indices of the steps taken, given the last alert before the block (or none)."""
    n = len(start)
    at = 0 if previous is None or np.isnan(previous) else int(
        np.searchsorted(start, previous + seconds, side="left")
    )
    taken = []
    while at < n:
        taken.append(at)
        at = int(np.searchsorted(start, last[at] + seconds, side="left"))
    return np.asarray(taken, dtype=np.int64)


def _ordered(steps) -> tuple[np.ndarray, np.ndarray]:
    start = np.array([s["start"] for s in steps], dtype=float)
    last = np.array([s["last"] for s in steps], dtype=float)
    order = np.argsort(start, kind="stable")
    return start[order], last[order]


def _reduce_times(seconds: float):
    @F.pandas_udf(_STEP)
    def run(times: pd.Series, block_start: pd.Series) -> pd.Series:
        out = []
        for t, b in zip(times, block_start):
            t = np.unique(np.asarray(t, dtype=float))
            out.append(_reduce_block(t, t, b, seconds))
        return pd.Series(out)

    return run


def _reduce_steps(seconds: float):
    @F.pandas_udf(_STEP)
    def run(steps: pd.Series, block_start: pd.Series) -> pd.Series:
        return pd.Series(
            [_reduce_block(*_ordered(s), b, seconds) for s, b in zip(steps, block_start)]
        )

    return run


def _previous_alerts(seconds: float, length: float):
    """For each child block of a group: the last alert before it."""

    @F.pandas_udf("array<struct<block:bigint,previous:double>>")
    def run(steps: pd.Series, blocks: pd.Series, previous: pd.Series) -> pd.Series:
        out = []
        for s, b, p in zip(steps, blocks, previous):
            start, last = _ordered(s)
            # Exits of the steps taken are alerts; a child block needs the latest one before it.
            exits = last[_walk(start, last, p, seconds)]
            rows = []
            for block in sorted(int(x) for x in b):
                at = int(np.searchsorted(exits, block * length, side="left"))
                before = exits[at - 1] if at else p
                rows.append(
                    {"block": block, "previous": None if before is None or np.isnan(before) else float(before)}
                )
            out.append(rows)
        return pd.Series(out)

    return run


def _fired_times(seconds: float):
    @F.pandas_udf("array<double>")
    def run(times: pd.Series, previous: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(times, previous):
            t = np.unique(np.asarray(t, dtype=float))
            out.append(t[_walk(t, t, p, seconds)])
        return pd.Series(out)

    return run


def _entry_states(steps: DataFrame, seconds: float, length: float, fan: int, levels: int) -> DataFrame:
    """(key, block, steps) → (key, block, previous): the last alert before each block."""
    if levels <= 1:
        groups = _gather(steps, [_KEY]).withColumn("previous", F.lit(None).cast("double"))
    else:
        upper = length * fan
        groups = _gather(
            steps.withColumn("__upper", F.floor(F.col(_BLOCK) / fan).cast("long")), [_KEY, "__upper"]
        )
        reduced = groups.select(
            _KEY, F.col("__upper").alias(_BLOCK),
            _reduce_steps(seconds)("steps", F.col("__upper") * F.lit(upper)).alias("steps"),
        )
        entry = _entry_states(reduced, seconds, upper, fan, levels - 1)
        groups = groups.join(entry.withColumnRenamed(_BLOCK, "__upper"), [_KEY, "__upper"])
    answered = groups.select(
        _KEY, F.inline(_previous_alerts(seconds, length)("steps", "blocks", "previous"))
    )
    return answered.withColumnRenamed("block", _BLOCK)


def _gather(steps: DataFrame, by: list[str]) -> DataFrame:
    return steps.groupBy(*by).agg(
        F.flatten(F.collect_list("steps")).alias("steps"), F.collect_list(_BLOCK).alias("blocks")
    )


def cooldown(
    candidates: DataFrame,
    keys: list[str],
    seconds: float,
    ts: str = "ts",
    seq: str = "pkt_id",
    fan: int = 16,
    levels: int = 2,
    block_seconds: float | None = None,
) -> DataFrame:
    """Rows of ``candidates`` that fire.  Equal times: the row with the lowest ``seq`` fires.

    ``keys`` may hold nulls (a null key is a key).  ``seconds`` of zero means no suppression.
    The candidates are needed twice (for the chain and for the rows), so they are written once.
    """
    if seconds <= 0:
        return candidates
    length = float(block_seconds or seconds * fan)
    if length < seconds:
        raise ValueError("a block must be at least one cooldown long")
    names = candidates.columns
    others = [c for c in names if c not in keys and c not in (ts, seq)]
    # The key is one struct: struct equality treats null fields as equal.
    rows = materialize(
        candidates.select(F.struct(*keys).alias(_KEY), F.col(ts).alias("__ts"),
                          F.struct(F.col(seq).alias("seq"), *others).alias("row"))
    )
    if rows.count() <= FEW:
        chains = rows.groupBy(_KEY).agg(F.collect_set("__ts").alias("times"))
        fired = chains.select(_KEY, F.explode(_fired_times(seconds)("times", F.lit(None).cast("double"))).alias("__ts"))
    else:
        block = F.floor(F.col("__ts") / F.lit(length)).cast("long")
        # A set, combined on the map side: a burst at one instant counts once.
        blocks = rows.groupBy(_KEY, block.alias(_BLOCK)).agg(F.collect_set("__ts").alias("times"))
        steps = blocks.select(
            _KEY, _BLOCK, _reduce_times(seconds)("times", F.col(_BLOCK) * F.lit(length)).alias("steps")
        )
        entry = _entry_states(steps, seconds, length, fan, levels)
        fired = blocks.join(entry, [_KEY, _BLOCK]).select(
            _KEY, F.explode(_fired_times(seconds)("times", "previous")).alias("__ts")
        )
    rows = rows.join(fired, [_KEY, "__ts"], "left_semi").groupBy(_KEY, "__ts").agg(F.min("row").alias("row"))

    def restored(name: str) -> Column:
        if name in keys:
            return F.col(_KEY)[name].alias(name)
        if name == ts:
            return F.col("__ts").alias(ts)
        return F.col("row")["seq" if name == seq else name].alias(name)

    return rows.select(*[restored(c) for c in names])
