"""Address reputation: an ordered fold of score events with decay in between.

Adding points with a ceiling, and decaying with a floor, are both of the form
``min(high, max(low, x + add))``, and two such steps in a row are again one.  So a busy
address is folded per hour in parallel, and only one small step per hour is folded per address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CEILING = 100
_FLOOR = -(10**9)


def ticks_between(last: Column, now: Column, idle: float, every: float, inclusive: bool) -> Column:
    """Decay ticks (multiples of ``every``) after ``last + idle``, up to ``now``."""
    upto = F.floor(now / every) if inclusive else F.ceil(now / every) - 1
    return F.greatest(upto - F.floor((last + F.lit(float(idle))) / every), F.lit(0)).cast("long")


def _clamped(value: Column, step: Column) -> Column:
    return F.least(step["high"], F.greatest(step["low"], value))


def _then(first: Column, second: Column) -> Column:
    """One step for ``first`` followed by ``second``."""
    return F.struct(
        (first["add"] + second["add"]).alias("add"),
        _clamped(first["low"] + second["add"], second).alias("low"),
        _clamped(first["high"] + second["add"], second).alias("high"),
    )


def _step(add: Column, low: Column, high: Column) -> Column:
    return F.struct(add.cast("long").alias("add"), low.cast("long").alias("low"), high.cast("long").alias("high"))


def _bump(points: Column) -> Column:
    return _step(points, F.lit(_FLOOR), F.lit(CEILING))


def _decay(ticks: Column, amount: int) -> Column:
    moved = ticks > 0
    return _step(-ticks * amount, F.when(moved, F.lit(0)).otherwise(F.lit(_FLOOR)), F.lit(-_FLOOR))


def fold(
    events: DataFrame, as_of: Column | float, decay_hours: float = 24, amount: int = 5, cycle_seconds: float = 15,
    day_seconds: float = 3600,
) -> DataFrame:
    """Reputation table at ``as_of`` from events ``ip, ts, seq, points, note[, blocklisted]``.

    ``seq`` orders the events of one instant.  A decay tick runs at the end of every cycle and
    lowers addresses not seen for ``decay_hours``; it does not count as a sighting.
    """
    at = as_of if isinstance(as_of, Column) else F.lit(float(as_of))
    idle = decay_hours * 3600
    if "blocklisted" not in events.columns:
        events = events.withColumn("blocklisted", F.lit(None).cast("boolean"))

    def chained(state: Column, nxt: Column) -> Column:
        """Append a stretch (first, last, step) to the state, with the decay between them."""
        ticks = ticks_between(state["last"], nxt["first"], idle, cycle_seconds, inclusive=False)
        return F.struct(
            state["first"].alias("first"), nxt["last"].alias("last"),
            _then(_then(state["step"], _decay(ticks, amount)), nxt["step"]).alias("step"),
        )

    def folded(stretches: Column) -> Column:
        head, tail = stretches[0], F.slice(stretches, F.lit(2), F.size(stretches))
        return F.aggregate(tail, head, chained)

    def stretch(order: Column, first: Column, last: Column, step: Column) -> Column:
        return F.struct(order.alias("order"), first.alias("first"), last.alias("last"), step.alias("step"))

    def bare(s: Column) -> Column:
        return F.struct(s["first"].alias("first"), s["last"].alias("last"), s["step"].alias("step"))

    def in_order(column: Column) -> Column:
        return F.transform(F.array_sort(column), bare)

    per_day = events.groupBy("ip", F.floor(F.col("ts") / day_seconds).alias("day")).agg(
        F.collect_list(stretch(F.struct("ts", "seq"), F.col("ts"), F.col("ts"), _bump(F.col("points")))).alias("bumps"),
        F.max(F.when(F.col("blocklisted").isNotNull(), F.struct("ts", "seq", "blocklisted"))).alias("flagged"),
    )
    scores = (
        per_day.select("ip", "day", "flagged", folded(in_order(F.col("bumps"))).alias("s"))
        .groupBy("ip")
        .agg(F.collect_list(stretch(F.col("day"), F.col("s.first"), F.col("s.last"), F.col("s.step"))).alias("days"),
             F.max("flagged").alias("flagged"))
        .select("ip", "flagged", folded(in_order(F.col("days"))).alias("s"))
    )
    left = ticks_between(F.col("s.last"), at, idle, cycle_seconds, inclusive=True)
    scores = scores.select(
        "ip",
        F.greatest(_clamped(F.col("s.step.add"), F.col("s.step")) - left * amount,
                   F.when(left > 0, F.lit(0)).otherwise(F.lit(_FLOOR))).cast("int").alias("score"),
        F.col("s.first").alias("first_seen"), F.col("s.last").alias("last_seen"),
        F.coalesce("flagged.blocklisted", F.lit(False)).alias("blocklisted"),
    )
    return scores.join(_notes(events), "ip", "left").withColumn("notes", F.coalesce("notes", F.lit("")))


def advance(events: DataFrame, reputation: DataFrame | None = None, decay_hours: float = 24, amount: int = 5,
            cycle_seconds: float = 15, block_cycles: int = 20, fan: int = 64) -> tuple[DataFrame, DataFrame]:
    """Carry a reputation table on by new score events.

    Returns (ip, ts, next_ts, score, blocklisted, notes) after each instant with events, the carried state included as
    the instant of its last event; and the reputation of every address at its last event (decay since then is left to
    the next step).

    Time is cut into blocks of ``block_cycles`` cycles and ``fan`` blocks are a stretch.  A block is reduced to one step, a
    stretch likewise; an address walks its stretches, hands each the state before it, a stretch does so to its
    blocks, and a block to its events.  A walk keeps every state on its way, so its lists are short by construction.
    """
    idle = decay_hours * 3600
    length = float(cycle_seconds * block_cycles)
    blocks = materialize(events.groupBy(F.struct("ip").alias("key"), F.floor(F.col("ts") / length).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "seq", "points", "note", "blocklisted"))).alias("steps")))

    def noted(text: Column, note: Column) -> Column:
        return F.when(text.contains(note), text).when(text == "", note).otherwise(F.concat(text, F.lit("; "), note))

    def moved(first: Column, last: Column, step: Column, flag: Column, notes: Column) -> Column:
        """What one event, or several in a row, do to a state."""
        return F.struct(first.cast("double").alias("first"), last.cast("double").alias("last"), step.alias("step"), flag.alias("flag"), notes.alias("notes"))

    def event(e: Column) -> Column:
        # the score before is at least 0 when points are added; missing points give the ceiling
        low = F.least(F.lit(CEILING), e["points"])
        return moved(e["ts"], e["ts"], _step(F.coalesce(e["points"], F.lit(0)), low, F.lit(CEILING)), e["blocklisted"], F.array(e["note"]))

    def ticks(last: Column, now: Column) -> Column:
        return F.when(last.isNotNull(), ticks_between(last, now, idle, cycle_seconds, inclusive=False)).otherwise(F.lit(0).cast("long"))

    def joined(m: Column, n: Column) -> Column:
        decay = _step(-ticks(m["last"], n["first"]) * amount, F.lit(_FLOOR), F.lit(-_FLOOR))
        return moved(m["first"], n["last"], _then(_then(m["step"], decay), n["step"]), F.coalesce(n["flag"], m["flag"]),
                     F.array_distinct(F.concat(m["notes"], n["notes"])))

    def reduced(moves: Column) -> Column:
        return F.aggregate(F.slice(moves, F.lit(2), F.size(moves)), moves[0], joined)

    def state(ts: Column, score: Column, blocklisted: Column, notes: Column) -> Column:
        return F.struct(ts.cast("double").alias("ts"), score.cast("int").alias("score"), blocklisted.alias("blocklisted"), notes.alias("notes"))

    def after_move(was: Column, m: Column) -> Column:
        score = _clamped(was["score"] - ticks(was["ts"], m["first"]) * amount + m["step"]["add"], m["step"])
        return state(m["last"], score, F.coalesce(m["flag"], was["blocklisted"]), F.aggregate(m["notes"], was["notes"], noted))

    def walked(begin: Column, moves: Column) -> Column:
        """The state before each move, and the one after all."""
        return F.aggregate(moves, F.array(begin), lambda done, m: F.concat(done, F.array(after_move(F.element_at(done, -1), m))))

    def handed(groups: DataFrame, number: str) -> DataFrame:
        """(key, number, begin, next_ts) of every part of a group: the state before it and the first instant after it."""
        parts = F.transform("parts", lambda p, i: F.struct(
            p["number"].alias(number), F.get("states", i).alias("begin"), F.coalesce(F.get("parts", i + 1)["move"]["first"], F.col("next_ts")).alias("next_ts")))
        return groups.select("key", F.inline(parts))

    def gathered(df: DataFrame, number: str, *by: str) -> DataFrame:
        return df.groupBy("key", *by).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("number"), "move"))).alias("parts"))

    moves = F.transform("parts", lambda p: p["move"])
    of_blocks = blocks.select("key", "block", F.floor(F.col("block") / fan).alias("stretch"), reduced(F.transform("steps", event)).alias("move"))
    stretches = gathered(of_blocks, "block", "stretch")
    of_addresses = gathered(stretches.select("key", "stretch", reduced(moves).alias("move")), "stretch").select("key.ip", "parts")

    none = F.array().cast(of_addresses.schema["parts"].dataType)
    if reputation is None:
        start = of_addresses.select("ip", "parts", F.lit(None).cast("double").alias("first_seen"), F.lit(None).cast("double").alias("last_seen"),
                                    F.lit(0).alias("score"), F.lit(False).alias("blocklisted"), F.lit("").alias("notes"))
    else:
        start = reputation.select("ip", "score", "first_seen", "last_seen", "blocklisted", "notes").join(of_addresses, "ip", "full").select(
            "ip", F.coalesce("parts", none).alias("parts"), "first_seen", "last_seen", F.coalesce("score", F.lit(0)).alias("score"),
            F.coalesce("blocklisted", F.lit(False)).alias("blocklisted"), F.coalesce("notes", F.lit("")).alias("notes"))
    begun = state(F.col("last_seen"), F.col("score"), F.col("blocklisted"), F.col("notes"))
    first = F.get("parts", F.lit(0))["move"]["first"]
    addresses = materialize(start.select(F.struct("ip").alias("key"), "parts", F.coalesce("first_seen", first).alias("first_seen"), first.alias("next_ts"),
                                         walked(begun, moves).alias("states")))

    last = F.lit(None).cast("double")
    of_stretches = handed(addresses.withColumn("next_ts", last).filter("size(parts) > 0"), "stretch").join(stretches, ["key", "stretch"])
    begins = handed(of_stretches.withColumn("states", walked(F.col("begin"), moves)), "block")
    inside = begins.join(blocks, ["key", "block"]).select("key.ip", "next_ts", walked(F.col("begin"), F.transform("steps", event)).alias("states"))
    # of several events of one instant the last state counts
    settled = inside.select("ip", F.inline(F.transform(F.slice("states", F.lit(2), F.size("states")), lambda s, i: F.struct(
        s.alias("s"), F.coalesce(F.get("states", i + 2)["ts"], F.col("next_ts")).alias("next_ts")))))
    carried = addresses.select("key.ip", F.col("states")[0].alias("s"), "next_ts")
    states = settled.unionByName(carried).filter(F.col("s.ts").isNotNull() & ~F.col("s.ts").eqNullSafe(F.col("next_ts"))).select(
        "ip", "s.ts", "next_ts", "s.score", "s.blocklisted", "s.notes")
    end = F.element_at("states", -1)
    after = addresses.select("key.ip", end["score"].alias("score"), "first_seen", end["ts"].alias("last_seen"), end["blocklisted"].alias("blocklisted"), end["notes"].alias("notes"))
    return states, after


def _notes(events: DataFrame) -> DataFrame:
    """Notes joined with ``; `` in first-seen order; one already contained in the text is skipped.

    Only the first occurrence of each note can matter, so the lists hold distinct notes.
    """
    firsts = events.filter(F.col("note") != "").groupBy("ip", "note").agg(F.min(F.struct("ts", "seq")).alias("order"))
    listed = firsts.groupBy("ip").agg(F.array_sort(F.collect_list(F.struct("order", "note"))).alias("notes"))

    def append(text: Column, entry: Column) -> Column:
        note = entry["note"]
        return F.when(text.contains(note), text).when(text == "", note).otherwise(
            F.btrim(F.concat(text, F.lit("; "), note), F.lit("; ")))

    return listed.select("ip", F.aggregate("notes", F.lit(""), append).alias("notes"))


def top_suspects(reputation: DataFrame, n: int = 10) -> DataFrame:
    """Highest scores first; the address breaks ties."""
    return reputation.orderBy(F.desc("score"), "ip").limit(n)
