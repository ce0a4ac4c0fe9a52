"""Fill-in-the-middle transformation by displacement scatter.

A text is cut at two code points into prefix, middle and suffix, which are written with markers in the order prefix,
suffix, middle (psm) or suffix, prefix, middle (spm).  Where to cut and which form to take comes from a hash of the id, as
Spark expressions.  Inside a task the texts of a block lie in one byte buffer: a scan of the code point starts turns cuts
into byte positions, every piece has one displacement, the differences of neighbouring displacements are laid down at the
piece borders, and a cumulative sum gives every byte of the block its shift.  One NumPy scatter writes all outputs.
`restore` finds the markers in the outputs, lays down the differences the other way round and gathers the bytes back.

A text that contains a marker stays plain, so markers in an output are always those that were written: a marker's first
character stands nowhere else in a marker, so none can begin in a text and end in a marker.

Defined cases: a null text is empty; an empty text is plain; a null id hashes as the empty string; repeated rows are
transformed alike; very long texts are whole blocks of their own (about 40 bytes of memory a byte); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textscan as ts

MARKERS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")


def _checked(markers) -> tuple[str, str, str]:
    heads = {m[:1] for m in markers}
    if len(set(markers)) != 3 or len(heads) != 1 or "" in heads or any(m.count(m[0]) != 1 or not m.isascii() for m in markers) or any(
            a != b and a.startswith(b) for a in markers for b in markers):
        raise ValueError("three ASCII markers are needed that share a first character found nowhere else in them; none may begin another")
    return tuple(markers)


def cuts(docs: DataFrame, seed: int = 1, rate: int = 90, suffix_first: int = 20, markers=MARKERS) -> DataFrame:
    """(doc_id, text, n, form, low, high): code points, form, and the two cuts, all from the id and the text."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = lambda i: F.conv(F.substring("key", 8 * i + 1, 8), 16, 10).cast("bigint")
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    named = given.select("doc_id", "text", F.length("text").cast("bigint").alias("n"), *[h(i).alias(f"h{i + 1}") for i in range(4)])
    marked = F.lit(False)
    for m in _checked(markers):
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("n") == 0) | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    a, b = (F.col(c) % (F.col("n") + 1) for c in ("h1", "h2"))
    return named.select("doc_id", "text", "n", form.alias("form"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of the texts, which lie one after the other."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    return data, offsets[:-1], offsets[1:]


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _shifts(borders: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """Position plus shift of every byte: pieces begin at `borders` (ascending, empty pieces too) and have one shift each."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, borders, np.diff(shift, prepend=0))
    return np.cumsum(step)[:n] + np.arange(n)


def scatter(texts: pa.Array, form: np.ndarray, low: np.ndarray, high: np.ndarray, markers=MARKERS) -> pa.Array:
    """The outputs of texts cut at code points low <= high; form 0 is plain, 1 psm, 2 spm."""
    data, start, end = _buffer(texts)
    points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    base = np.searchsorted(points, start)
    one, two = np.minimum(points[base + low], end), np.minimum(points[base + high], end)
    p, s, m = (np.frombuffer(x.encode(), np.uint8) for x in markers)
    cut = form > 0
    out_length = end - start + cut * (len(p) + len(s) + len(m))
    out_start = np.cumsum(out_length) - out_length
    prefix, suffix = one - start, end - two
    psm, spm = form == 1, form == 2
    at_p = out_start + spm * (len(s) + suffix)  # where markers stand
    at_s = out_start + psm * (len(p) + prefix)
    at_m = out_start + len(p) + len(s) + prefix + suffix
    to_p = np.where(cut, at_p + len(p), out_start) - start
    to_m = np.where(cut, at_m + len(m), out_start + prefix) - one
    to_s = np.where(cut, at_s + len(s), out_start + two - start) - two
    place = _shifts(np.stack((start, one, two), axis=1).ravel(), np.stack((to_p, to_m, to_s), axis=1).ravel(), len(data))
    out = np.zeros(int(out_length.sum()), np.uint8)
    out[place] = data
    for marker, at in ((p, at_p), (s, at_s), (m, at_m)):
        out[at[cut][:, None] + np.arange(len(marker))] = marker
    return _strings(out, out_length)


def _only(data: np.ndarray, marker: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where the marker stands in each of the texts that begin at `start` and hold it once."""
    at = np.flatnonzero(data == marker[0])
    for k in range(1, len(marker)):
        at = at[at + k < len(data)]
        at = at[data[at + k] == marker[k]]
    return at[np.searchsorted(at, start)]


def gather(outputs: pa.Array, form: np.ndarray, markers=MARKERS) -> pa.Array:
    """The texts again, from outputs and forms alone."""
    data, start, end = _buffer(outputs)
    p, s, m = (np.frombuffer(x.encode(), np.uint8) for x in markers)
    cut, spm = np.flatnonzero(form > 0), form == 2
    at_p, at_s, at_m = start.copy(), start.copy(), end.copy()
    for at, marker in ((at_p, p), (at_s, s), (at_m, m)):
        at[cut] = _only(data, marker, start[cut])
    is_cut = form > 0
    width = lambda marker: is_cut * len(marker)
    from_p, from_m, from_s = at_p + width(p), at_m + width(m), at_s + width(s)
    prefix = np.where(is_cut, np.where(spm, at_m, at_s) - from_p, end - start)  # a plain output is all prefix
    suffix = np.where(is_cut, np.where(spm, at_p, at_m) - from_s, 0)
    middle = np.where(is_cut, end - from_m, 0)
    length = prefix + middle + suffix
    to = np.cumsum(length) - length
    borders = np.stack((to, to + prefix, to + prefix + middle), axis=1)
    place = _shifts(borders.ravel(), (np.stack((from_p, from_m, from_s), axis=1) - borders).ravel(), int(length.sum()))
    return _strings(data[place], length)


def _forms(column) -> np.ndarray:
    return pc.index_in(column, pa.array(FORMS)).to_numpy(zero_copy_only=False)


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, suffix_first: int = 20, markers=MARKERS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document."""
    def make():
        def one(rows):
            number = lambda c: rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
            out = scatter(rows.column("text"), _forms(rows.column("form")), number("low"), number("high"), markers)
            return pa.RecordBatch.from_arrays([rows.column(c) for c in ("doc_id", "n", "form", "low", "high")] + [out], ["doc_id", "n", "form", "low", "high", "output"])
        return one

    cut = cuts(docs, seed, rate, suffix_first, markers)
    kind = docs.schema["doc_id"].dataType.simpleString()
    done = ts.map_texts(cut, make, f"doc_id {kind}, n bigint, form string, low bigint, high bigint, output string")
    inside = F.col("form") != "plain"
    return done.select("doc_id", "n", "form", F.when(inside, F.col("low")).alias("prefix_chars"), F.when(inside, F.col("high") - F.col("low")).alias("middle_chars"), "output")


def restore(outputs: DataFrame, markers=MARKERS) -> DataFrame:
    """Rows (form, output, ...) with the text they were made of as `restored`."""
    fields = [f for f in outputs.schema if f.name != "restored"]

    def make():
        def one(rows):
            return rows.append_column("restored", gather(rows.column("output"), _forms(rows.column("form")), markers))
        return one

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", restored string"
    return ts.map_texts(outputs.select(*[f"`{f.name}`" for f in fields]), make, schema, column="output")


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document."""
    back = restore(transform(docs, **options), options.get("markers", MARKERS))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def comparison_sql() -> str:
    h = lambda i: f"CAST('0x' || substr(k, {8 * i + 1}, 8) AS BIGINT)"
    return f"""
WITH keyed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
named AS (SELECT doc_id, text, length(text) AS n, {", ".join(f"{h(i)} AS h{i + 1}" for i in range(4))} FROM keyed),
formed AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM named),
pieces AS (SELECT *, substr(text, 1, low) AS p, substr(text, low + 1, high - low) AS m, substr(text, high + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM pieces"""
