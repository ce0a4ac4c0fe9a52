"""Best-fit packing after Martello and Toth's dominance reduction.

A document longer than a sequence is cut into full sequences and a rest; no other document is cut.  How many pieces there
are of each length is all that planning needs: a histogram of at most `capacity` numbers, whatever the corpus.

Reduction: a set of pieces that holds piece j and fits one sequence dominates if whatever else could share a sequence with j
may be exchanged for pieces of the set without needing more sequences.  Such sets are fixed for good and taken out:

* nothing fits beside j: j alone
* the largest piece that fits beside j fills the sequence, or no two pieces fit beside j: j and that piece
* at most two pieces fit beside j and their largest sum does not exceed the largest single one: j and the single one
* at most two fit, the pair of largest sum holds the largest single one, and no two pieces between the pair's fit
  beside j: j and the pair

Each condition stays true while copies of the set are taken, so all copies go in one step.  Rounds over the lengths, from the
longest, end when nothing can be fixed any more; what remains is packed best-fit, longest first, many equal sequences a
step.  The plan is a list of patterns (how often which lengths share a sequence); tasks look up in it the place of the
k-th piece of a length.  Ranks are counted inside parts of each length that are dealt out row by row, so a length (or a
document) that a third of all rows share is no single group.

Defined cases: a null or empty text is its end id alone; repeated rows are packed once each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored
from .packing import cut
from .tokens import tokenizer_path

Patterns = list[tuple[dict[int, int], int]]


class _Pool:
    """Pieces left, by length."""

    def __init__(self, demand: dict[int, int]):
        self.left = {s: n for s, n in sorted(demand.items()) if n > 0}
        self.sizes = list(self.left)

    def take(self, sizes: tuple[int, ...]) -> int:
        """Take out all copies of a set; returns how many."""
        need = Counter(sizes)
        times = min(self.left[s] // n for s, n in need.items())
        for s, n in need.items():
            self.left[s] -= times * n
            if not self.left[s]:
                del self.left[s]
                del self.sizes[bisect_right(self.sizes, s) - 1]
        return times

    def beside(self, j: int, room: int, above: int = 0, most: int = 3) -> list[int]:
        """The smallest pieces besides one of length j that are longer than `above` and fit the room together, at most `most`."""
        out: list[int] = []
        for s in self.sizes[bisect_right(self.sizes, above):]:
            for _ in range(min(self.left[s] - (s == j), most)):
                if s > room or len(out) == most:
                    return out
                room -= s
                out.append(s)
        return out

    def largest(self, j: int, room: int) -> int:
        """The longest piece besides one of length j that fits the room; 0 if none does."""
        at = bisect_right(self.sizes, room) - 1
        if at >= 0 and self.sizes[at] == j and self.left[j] == 1:
            at -= 1
        return self.sizes[at] if at >= 0 else 0

    def pair(self, j: int, room: int) -> tuple[int, int]:
        """The two pieces besides one of length j with the largest sum that fits the room, the longer one first; of equal sums the
        one with the longest piece."""
        best = (0, 0)
        low, high = 0, bisect_right(self.sizes, room) - 1
        count = lambda s: self.left[s] - (s == j)
        while low <= high:
            a, b = self.sizes[high], self.sizes[low]
            if not count(a) or a + b > room:
                high -= 1
            elif not count(b) or (a == b and count(a) < 2):
                low += 1
            else:
                if a + b > sum(best):
                    best = (a, b)
                low += 1
        return best


def _dominating(pool: _Pool, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates all others with j, if one of those looked for exists."""
    room = capacity - j
    fits = pool.beside(j, room)
    if not fits:
        return (j,)
    single = pool.largest(j, room)
    if single == room or len(fits) == 1:
        return (j, single)
    if len(fits) == 2:
        a, b = pool.pair(j, room)
        if single >= a + b:
            return (j, single)
        if a == single:
            # a pair that fits and is not below (a, b) piece by piece would lie strictly between the two
            between = [s for s in pool.beside(j, 3 * capacity, above=b, most=2) if s < a]
            if len(between) < 2 or sum(between) > room:
                return (j, a, b)
    return None


def reduce(demand: dict[int, int], capacity: int) -> tuple[Patterns, dict[int, int]]:
    """(sets fixed for good and how often, pieces left)."""
    pool, fixed = _Pool(demand), []
    again = True
    while again:
        again = False
        for j in reversed(list(pool.sizes)):
            while pool.left.get(j):
                found = _dominating(pool, j, capacity)
                if found is None:
                    break
                fixed.append((dict(Counter(found)), pool.take(found)))
                again = True
    return fixed, pool.left


def best_fit(demand: dict[int, int], capacity: int) -> Patterns:
    """Best fit, longest first: every piece goes to the sequence with the least room that still holds it."""
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}  # room -> patterns and how often

    def put(room: int, pattern: dict[int, int], s: int, each: int, times: int):
        if times:
            grown = dict(pattern)
            if each:
                grown[s] = grown.get(s, 0) + each
            bins.setdefault(room - each * s, []).append((grown, times))

    for s in sorted(demand, reverse=True):
        n = demand[s]
        while n:
            room = min((r for r in bins if r >= s), default=None)
            if room is None:
                room, pattern, times = capacity, {}, n
            else:
                pattern, times = bins[room].pop()
                if not bins[room]:
                    del bins[room]
            # a sequence that took one piece has the least room of all, so it takes as many as it can hold
            each = min(room // s, n)
            full = min(times, n // each)
            n -= full * each
            put(room, pattern, s, each, full)
            if pattern or room < capacity:
                rest = times - full
                if rest and 0 < n < each:
                    put(room, pattern, s, n, 1)
                    rest, n = rest - 1, 0
                put(room, pattern, s, 0, rest)
            elif 0 < n < each:
                put(room, pattern, s, n, 1)
                n = 0
    return [p for held in bins.values() for p in held]


def patterns(demand: dict[int, int], capacity: int) -> Patterns:
    """(pattern: length -> pieces, how often) that together hold exactly the demanded pieces."""
    fixed, left = reduce(demand, capacity)
    return fixed + best_fit(left, capacity)


def _deals(plan: Patterns) -> dict[str, np.ndarray]:
    """For each length and pattern: the ranks it takes, its first sequence, how many a sequence holds and where they begin."""
    rows, sequence, taken = [], 0, Counter()
    for pattern, times in plan:
        offset = 0
        for size, each in sorted(pattern.items(), reverse=True):
            rows.append((size, taken[size], sequence, each, offset))
            taken[size] += each * times
            offset += size * each
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("size", "low", "sequence", "each", "offset"), table.T))


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to every piece of a stored table (length, part, ...), which is read twice."""
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    shifts = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("shift"))
    demand = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    deals = _deals(patterns(demand, capacity))  # a few rows for each length, however many pieces there are
    columns = [f for f in pieces.schema if f.name != "part"]

    def task(batches):
        starts = {s: int(i) for s, i in zip(*(x.tolist() for x in np.unique(deals["size"], return_index=True)))} if len(deals["size"]) else {}
        ends = {s: int(i) + 1 for i, s in enumerate(deals["size"].tolist())}
        for rows in batches:
            length, rank = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            deal = np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                mine = length == s
                deal[mine] = starts[s] + np.searchsorted(deals["low"][starts[s]:ends[s]], rank[mine], "right") - 1
            nth = rank - deals["low"][deal]
            sequence = deals["sequence"][deal] + nth // deals["each"][deal]
            offset = deals["offset"][deal] + nth % deals["each"][deal] * length
            yield pa.RecordBatch.from_arrays([rows.column(f.name) for f in columns] + [pa.array(sequence), pa.array(offset)], [f.name for f in columns] + ["sequence_id", "offset"])

    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("nth", nth).join(shifts, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("shift")).drop("nth", "shift", "part")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", sequence_id bigint, offset bigint"
    return ranked.select(*[f.name for f in columns], "rank").mapInArrow(task, schema)


def _pieces(docs: DataFrame, path: str | None, end_id: int, capacity: int, keep_ids: bool) -> DataFrame:
    """Stored pieces, dealt row by row to as many parts as a shuffle has."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut(docs, path or tokenizer_path(), end_id, capacity, keep_ids)
    return stored(cuts.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")))


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document."""
    placed = place(_pieces(docs, path, end_id, capacity, False), capacity)
    return placed.select("doc_id", F.floor(F.col("start") / capacity).cast("int").alias("piece"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(sequence_id, ids): the packed ids of every sequence."""
    placed = place(_pieces(docs, path, end_id, capacity, True), capacity)
    # a sequence holds at most `capacity` ids, so its group is bounded
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda s: s["ids"])).alias("ids"))
