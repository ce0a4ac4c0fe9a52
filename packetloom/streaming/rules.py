"""Stateful rules: cooldown and trailing thresholds per key, with state that expires.

Rows of a micro-batch are put in time order per key.  State is what the rule needs and no
more: the last alert, and for trailing rules the rows of one span.  It is dropped when the
watermark shows that it cannot matter any longer.
"""

from __future__ import annotations

from collections import Counter, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout


def _field(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def _expire_at(state, last_needed: float) -> None:
    """Let the state go once the watermark passes ``last_needed``."""
    state.setTimeoutTimestamp(max(int(last_needed * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def cooldown(candidates: DataFrame, keys: list[str], seconds: float, ts: str = "ts", seq: str = "pkt_id") -> DataFrame:
    """Candidate rows that fire; needs a watermark on ``event_time``."""
    columns = [c for c in candidates.columns if c != "event_time"]

    def run(key, batches, state):
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values([ts, seq], kind="stable")
        fired = []
        for at in rows[ts]:
            ok = last is None or at - last >= seconds
            last = at if ok else last
            fired.append(ok)
        state.update((float(last),))
        _expire_at(state, last + seconds)
        yield rows.loc[fired, columns]

    schema = ", ".join(_field(candidates, c) for c in columns)
    return candidates.groupBy(*keys).applyInPandasWithState(
        run, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def trailing_distinct_alerts(
    rows: DataFrame, keys: list[str], value: str, span: float, threshold: int, seconds: float,
    ts: str = "ts", seq: str = "pkt_id",
) -> DataFrame:
    """(keys, ts, seq, n): an alert when a trailing span holds enough distinct values, with cooldown."""
    kind = rows.schema[value].dataType.simpleString()

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, times, values = state.get if state.exists else (None, [], [])
        frame = deque(zip(times, values))
        seen = Counter(values)
        batch = pd.concat(list(batches), ignore_index=True).sort_values([ts, seq], kind="stable")
        batch = batch[batch[ts].notna()]
        out = []
        instants, held, numbers = batch[ts].to_numpy(), batch[value].tolist(), batch[seq].tolist()
        begin = np.flatnonzero(instants[1:] != instants[:-1]) + 1
        edges = [0, *begin.tolist(), len(instants)] if len(instants) else []
        # Rows of one instant enter together, as in the batch rule.
        for low, high in zip(edges, edges[1:]):
            at = float(instants[low])
            for v in held[low:high]:
                frame.append((at, v))
                seen[v] += 1
            while frame and frame[0][0] < at - span:
                old = frame.popleft()[1]
                seen[old] -= 1
                if not seen[old]:
                    del seen[old]
            if len(seen) >= threshold and (last is None or at - last >= seconds):
                last = at
                out.append((*key, at, numbers[low], len(seen)))
        state.update((last, [float(t) for t, _ in frame], [v for _, v in frame]))
        newest = max([frame[-1][0]] if frame else [0.0])
        _expire_at(state, max(newest + span, (last if last is not None else newest) + seconds))
        if out:
            yield pd.DataFrame(out, columns=[*keys, ts, seq, "n"])

    schema = ", ".join([_field(rows, k) for k in keys] + [_field(rows, ts), _field(rows, seq), "n bigint"])
    return rows.groupBy(*keys).applyInPandasWithState(
        run, schema, f"last double, times array<double>, held array<{kind}>", "append",
        GroupStateTimeout.EventTimeTimeout)
