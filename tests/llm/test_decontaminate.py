"""Templates, slots and whole results against a plain search."""

from helpers import frame, odd_documents, prose, rows_of
from packetloom.llm import decontaminate

ITEM = "A train leaves Boston at 9 and runs 120 km in 3 hours while another train needs 120 km more before it stops there."
ITEMS = [(1, ITEM), (2, "short item of six words here"), (3, None), (4, "")]


def _found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}


def test_verbatim_reparameterised_and_inconsistent(spark):
    other = ITEM.replace("Boston", "Madrid").replace("120", "77").replace("9", "8").replace("3", "5")
    broken = other.replace("77 km more", "78 km more")  # 120 became two different numbers
    around = prose(1, 300), prose(2, 200)
    texts = [f"{around[0]}. {t} {around[1]}" for t in (ITEM, other, broken)] + [around[0], prose(5, 40) + " short item of six words here " + prose(6, 30)]
    assert _found(spark, texts) == {(0, 1), (1, 1), (4, 2)}


def test_every_offset_is_found(spark):
    texts = [" ".join(["filler"] * k) + " " + ITEM for k in range(12)]
    assert _found(spark, texts) == {(k, 1) for k in range(12)}


def test_half_of_an_item_is_enough(spark):
    words = ITEM.split()
    assert _found(spark, [" ".join(words[:16]), " ".join(words[:9])]) == {(0, 1)}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    texts = [prose(k, 50) + " " + ITEM for k in range(5)] + [prose(9, 40)]
    want = _found(spark, texts)
    for limit in ("SET_WORDS", "BROADCAST_WINDOWS"):
        monkeypatch.setattr(decontaminate, limit, 0)
        assert _found(spark, texts) == want == {(k, 1) for k in range(5)}


def test_every_run_at_every_offset(spark):
    """Runs of 8 to 14 words of an item of 14 are found wherever they stand, shorter ones never."""
    item = "the quick river turns under old stone bridges while seven tired horses walk home"
    words = item.split()
    assert len(words) == 14
    texts, want = [], set()
    for length in range(6, 15):
        for first in range(0, 15 - length):
            for offset in range(5):
                if length >= 8:
                    want.add((len(texts), 1))
                texts.append(" ".join(["zz"] * offset + ["yy"] + words[first:first + length] + ["xx"]))
    assert _found(spark, texts, [(1, item)]) == want


def test_tables_of_slots_count_only_as_they_are(spark):
    """Mostly numbers: a verbatim copy is found, other numbers are no copy, and windows of numbers alone are no common key."""
    table = "add 3 5 7 11 13 17 19 23 29 31 37 41 total"
    other = "add 4 6 8 12 14 18 20 24 30 32 38 42 total"
    assert _found(spark, [f"see {table} there", f"see {other} there"], [(1, table)]) == {(0, 1)}
    numbers = " ".join(map(str, range(100, 112)))
    assert _found(spark, [f"x {numbers} y", "x " + " ".join(map(str, range(200, 230)))], [(1, numbers)]) == {(0, 1)}


def test_opening_names_are_names(spark):
    short = "Tom buys three red apples today"
    long = "Tom has 5 apples. Tom gives 2 to Ann. How many apples does Tom keep for the evening?"
    texts = [f"so: {short.replace('Tom', 'Eve')} and", f"and {short.replace('Tom', 'Eve')} and", long.replace("Tom", "Bob").replace("Ann", "Sue").replace("5", "9"),
             long.replace("Tom", "Bob", 1)]
    assert _found(spark, texts, [(1, short), (2, long)]) == {(0, 1), (1, 1), (2, 2)}  # in the last one name became two


def test_all_texts_of_an_item(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota"), (1, "one two three four five six seven eight nine ten")]
    assert _found(spark, [f"x {t} y" for _, t in items] + ["x y z"], items) == {(0, 1), (1, 1)}


def test_odd_cases(spark):
    rows = odd_documents()
    bench = spark.createDataFrame([(1, rows[3][1]), (2, None), (None, "x y z")], "item_id bigint, text string")
    assert {r["doc_id"] for r in decontaminate.matches(frame(spark, rows, extra=True), bench).collect()} == {3, 25}
    assert decontaminate.matches(frame(spark, []), bench).collect() == []
    assert decontaminate.matches(frame(spark, rows), bench.limit(0)).collect() == []
    twice = decontaminate.matches(frame(spark, [rows[3], rows[3]]), bench)
    assert rows_of(twice) == rows_of(decontaminate.matches(frame(spark, [rows[3]]), bench))


def test_steps_lose_nothing(spark, monkeypatch):
    """With and without anchors and runs of pairs the same is found, in texts full of odd letters, marks and joined digits."""
    items = [(1, "İstanbul and the ﬁnal river v1.2 of straße 3.5km go on"), (2, "x\x01y marks\x02 inside words of this odd item here"), (3, "1 2 3 4 5 6 7 8 9 10"),
             (4, "Two Names Only Here"), (5, "plain"), (6, "a1 b2 c3 d4 e5 f6 g7 h8 i9")]
    texts = [f"{a} {t} {b}" for _, t in items for a, b in (("", ""), ("so", "then"), ("(", ")"), ("9.", ",7"))] + [t.upper() for _, t in items] + ["nothing of it", ""]
    want = _found(spark, texts, items[:4])
    assert {(k, i + 1) for i in range(4) for k in range(4 * i, 4 * i + 2)} <= want
    every = _found(spark, texts, items)
    monkeypatch.setattr(decontaminate, "SET_WORDS", 0)
    assert _found(spark, texts, items[:4]) == want and _found(spark, texts, items) == every


def test_plan_is_native(spark):
    plan = decontaminate.matches(frame(spark, odd_documents()), spark.createDataFrame(ITEMS, "item_id bigint, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
