"""Token counts and packing against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from helpers import frame, odd_documents, prose, rows_of
from packetloom.llm import packing, token_counts
from packetloom.llm.tokens import tokenizer_path
from packetloom.session import new_folder

ODD = odd_documents() + [(40, "a <|endoftext|> b don't 'll ﬁ é İ", "en", None, 1)]


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_counts(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    want = sorted(((r[0], len(_ids(tokenizer, r[1]))) for r in ODD), key=repr)
    assert rows_of(token_counts.count(frame(spark, ODD, extra=True))) == want
    files, order = token_counts.write_files(frame(spark, ODD), new_folder(spark), file_tokens=5000)
    found = token_counts.scan(files, range_tokens=37)
    assert rows_of(order.join(found, ["path", "ordinal"]).select("doc_id", "n_tokens")) == want
    assert token_counts.count(frame(spark, [])).collect() == []


def test_rows_of_documents_are_never_broadcast(spark):
    """Their files are far smaller than their rows, so Spark's own choice would fill the driver (F1)."""
    found = token_counts.count(frame(spark, ODD))
    assert len(found.collect()) == len(ODD)
    plan = found._jdf.queryExecution().executedPlan().toString()
    keyed = {key: [x for x in plan.splitlines() if "HashJoin" in x and key in x] for key in ("ordinal#", "block#")}
    assert keyed == {"ordinal#": [], "block#": []} and "SortMergeJoin" in plan


def test_scan_of_foreign_files(spark, tmp_path):
    files = {"a": [5, 0, 0, 6, 7, 8], "b": [0], "c": [1, 2, 3], "d": [1, 0] * 4000}
    for name, ids in files.items():
        np.array(ids, "<u4").tofile(tmp_path / name)
    listed = spark.createDataFrame([(f"file://{tmp_path}/{n}", len(i)) for n, i in files.items()] + [(f"file://{tmp_path}/none", 0)], "path string, n_tokens bigint")
    got = defaultdict(list)
    for r in token_counts.scan(listed, end_id=0, width=4, range_tokens=3).orderBy("path", "ordinal").collect():
        got[r["path"][-1]].append((r["ordinal"], r["n_tokens"], r["ended"]))
    assert got == {"a": [(0, 1, True), (1, 0, True), (2, 3, False)], "b": [(0, 0, True)], "c": [(0, 3, False)], "d": [(i, 1, True) for i in range(4000)]}


def test_packing(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = ODD + [(1000 + i, prose(i, 150 + i), "en", None, 1) for i in range(150)]
    texts = {r[0]: np.array([*_ids(tokenizer, r[1]), 2], np.uint32) for r in rows if r[0] is not None}
    out = packing.pack(frame(spark, rows, extra=True)).collect()
    spans, filled = defaultdict(list), defaultdict(list)
    for p in out:
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
        if p["doc_id"] is not None:
            assert p["doc_tokens"] == len(texts[p["doc_id"]])
            assert zlib.crc32(texts[p["doc_id"]][p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
            spans[p["doc_id"]].append((p["start"], p["length"]))
    copies = {i: sum(r[0] == i for r in rows) for i in texts}
    assert all(sum(n for _, n in spans[i]) == copies[i] * len(texts[i]) for i in texts)
    used = 0
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
        used += end
    assert used > 0.93 * 4096 * len(filled)


def test_whole_sequences(spark):
    rows = [(i, prose(i, 200), "en", None, 1) for i in range(60)]
    out = packing.sequences(frame(spark, rows), pad_id=0).collect()
    assert all(len(r["ids"]) == 4096 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in out)
    assert sum(sum(i == 2 for i in r["ids"]) for r in out) >= 60


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_the_demand(seed):
    r = np.random.default_rng(seed)
    demand = {int(s): int(n) for s, n in zip(r.choice(np.arange(1, 257), 120, replace=False), r.integers(1, 4000, 120))}
    got, sequences = defaultdict(int), 0
    for pattern, times in packing.patterns(demand, 256):
        assert sum(s * a for s, a in pattern.items()) <= 256
        sequences += times
        for s, a in pattern.items():
            got[s] += a * times
    free, first_fit = [], 0  # first fit, largest first, by the histogram
    for s in sorted(demand, reverse=True):
        n = demand[s]
        for i, (room, k) in enumerate(list(free)):
            if room >= s and n:
                used = min(n, k * (room // s))
                whole, part = divmod(used, room // s)
                free[i] = (room, k - whole - bool(part))
                free += [(room - s * (room // s), whole)] * bool(whole) + [(room - s * part, 1)] * bool(part)
                n -= used
        each = 256 // s
        whole, part = divmod(n, each)
        first_fit += whole + bool(part)
        free += [(256 - s * each, whole)] * bool(whole) + [(256 - s * part, 1)] * bool(part)
    assert got == demand and sequences <= first_fit
