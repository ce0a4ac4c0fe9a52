"""Chat formatting from event logs.

A log has one row per event of a message: ``start`` (its role), ``delta`` (text to append), ``edit`` (the whole new
text) and ``regenerate`` (what was streamed so far is void).  Logs are grouped by conversation and message, ordered by
sequence number and folded to the final message: everything from the last edit or regeneration on.  The group is
one message, so a conversation that holds a third of all events spreads over many tasks.

A message is rendered as ``### role: text </turn>`` and a line break.  Backslash, ``#`` and ``<`` inside texts (and
``:`` inside roles) are escaped with a backslash, so no text can look like a mark and reading back gives the text
itself.  The loss mask is a span of the rendered segment: the escaped text of assistant messages.  The rendered
conversation is its segments in order; segments stay rows, because a conversation may be too long for one row.

Defined cases: a null text is empty, a null role is an empty role; messages of the same turn are ordered by their
rendered text, repeated rows stay repeated; rows without a conversation id form one conversation; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

EVENTS = "conv_id bigint, turn bigint, message bigint, seq bigint, kind string, role string, text string"


def events_of(turns: DataFrame, delta_chars: int = 400) -> DataFrame:
    """A log that streams every row of (conv_id, turn, role, text).

    Every third turn is streamed after a draft that is regenerated, every other third is edited at the end.
    """
    text = F.coalesce("text", F.lit(""))
    parts = F.ceil(F.length(text) / F.lit(delta_chars)).cast("int")
    one = lambda seq, kind, role, value: F.struct(seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), value.alias("text"))
    none, way = F.lit(None).cast("string"), F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3))
    deltas = F.transform(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1),
                         lambda k: one(k + 10, "delta", none, F.substring(text, k * delta_chars + 1, F.lit(delta_chars))))
    draft = F.array(one(F.lit(1), "delta", none, F.substring(text, F.lit(1), F.lit(delta_chars // 4))), one(F.lit(2), "regenerate", none, none))
    edited = F.array(one(F.lit(1), "delta", none, F.substring(text, F.lit(1), F.lit(delta_chars // 4))), one(F.lit(2), "edit", none, text))
    log = F.concat(F.array(one(F.lit(0), "start", F.coalesce("role", F.lit("")), none)),
                   F.when(way == 1, F.concat(draft, deltas)).when(way == 2, edited).otherwise(deltas))
    # the message number only groups the events made here, in the same stage
    numbered = turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("message"))
    return numbered.select("conv_id", "turn", "message", F.inline(log))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, message, role, text): the final messages."""
    resets = F.col("kind").isin("edit", "regenerate")
    grouped = events.groupBy("conv_id", "turn", "message").agg(
        F.max(F.when(resets, F.col("seq"))).alias("since"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seq", "text"))).alias("parts"))
    valid = F.filter("parts", lambda p: p["seq"] >= F.coalesce("since", F.lit(-(1 << 62))))
    return grouped.select("conv_id", "turn", "message", F.coalesce("role", F.lit("")).alias("role"),
                          F.array_join(F.transform(F.array_sort(valid), lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_length), positions in code points of the segment."""
    head = F.concat(F.lit("### "), F.regexp_replace("role", r"([\\#<:])", r"\\$1"), F.lit(": "))
    body = F.regexp_replace("text", r"([\\#<])", r"\\$1")
    return messages.select("conv_id", "turn", F.concat(head, body, F.lit(" </turn>\n")).alias("segment"),
                           F.when(F.col("role") == trained, F.length(head)).alias("loss_start"),
                           F.when(F.col("role") == trained, F.length(body)).alias("loss_length"))


_SEGMENT = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a rendered message."""
    found = _SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError(f"not a rendered message: {segment[:80]!r}")
    return unescape(found[1]), unescape(found[2])


def read_back(rendered: DataFrame) -> DataFrame:
    """One row of counts and digests for each conversation.

    A digest is one pass over a conversation by its nature; segments stream through in order, memory stays constant.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = [part.split()[0] for part in schema.split(", ")]

    def task(batches):
        state, out = None, []

        def finish():
            conv, turns, all_turns, loss_chars, loss, chars = state
            out.append((conv, turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names)
            out.clear()
            return rows

        for batch in batches:
            for conv, segment, start, length in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "loss_start", "loss_length"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        finish()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_segment(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(segment[start:start + length])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(segment)
            if out:
                yield flush()
        if state is not None:
            finish()
            yield flush()

    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(task, schema)


def format_turns(turns: DataFrame) -> DataFrame:
    """Log, fold, render, write, read back."""
    return read_back(stored(render(fold(events_of(turns)))))
