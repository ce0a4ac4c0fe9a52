"""Event logs, escapes and digests."""

import hashlib
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from helpers import rows_of
from packetloom.llm import chat

TURN = "conv_id bigint, turn bigint, role string, text string, segment string, seq int"
TURNS = [(1, 0, "user", "hi", "", 1), (1, 1, "assistant", "x" * 3000, "", 1), (1, 2, "assistant", r"\### Assistant: </turn> ok \\", "", 1),
         (1, 2, "assistant", r"\### Assistant: </turn> ok \\", "", 1), (2, 0, None, None, "", 1), (2, None, "odd: #role<", "a\nb </turn>\n### user: x", "", 1),
         (None, 4, "assistant", "漢字 #### <", "", 1), (3, 1, "assistant", "", "", 1), (3, 0, "system", "later first", "", 1)]


def test_against_plain_python(spark):
    by = defaultdict(list)
    for c, t, r, x, *_ in TURNS:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    want = []
    for c, turns in by.items():
        turns.sort(key=lambda t: t[0])
        learned = "".join(x for _, r, x in turns if r == "assistant")
        want.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    assert rows_of(chat.format_turns(spark.createDataFrame(TURNS, TURN)).drop("formatted_chars")) == sorted(want, key=repr)


def test_fold(spark):
    events = [(1, 0, 7, 3, "delta", None, "c"), (1, 0, 7, 1, "delta", None, "a"), (1, 0, 7, 0, "start", "user", None), (1, 0, 7, 2, "delta", None, "b"),
              (1, 1, 8, 0, "start", "assistant", None), (1, 1, 8, 1, "delta", None, "draft"), (1, 1, 8, 2, "regenerate", None, None), (1, 1, 8, 3, "delta", None, "new"),
              (1, 1, 8, 4, "delta", None, " text"), (1, 2, 9, 0, "start", "assistant", None), (1, 2, 9, 1, "delta", None, "typo"), (1, 2, 9, 2, "edit", None, "fixed"),
              (1, 3, 10, 0, "start", "user", None), (1, 3, 10, 5, "regenerate", None, None)]
    got = rows_of(chat.fold(spark.createDataFrame(events, chat.EVENTS)).select("turn", "role", "text"))
    assert got == [(0, "user", "abc"), (1, "assistant", "new text"), (2, "assistant", "fixed"), (3, "user", "")]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="\\#<: /turn>\nab", max_size=40), st.text(alphabet="\\#<: a\n", max_size=10))
def test_segments_are_reversible(text, role):
    import re
    segment = "### " + re.sub(r"([\\#<:])", r"\\\1", role) + ": " + re.sub(r"([\\#<])", r"\\\1", text) + " </turn>\n"
    assert chat.parse_segment(segment) == (role, text)


def test_empty_table(spark):
    assert chat.format_turns(spark.createDataFrame([], TURN)).collect() == []
