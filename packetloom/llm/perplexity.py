"""Quality rules: repetition and length rules, then n-gram perplexity with language-specific bands.

The language model is a modified Kneser-Ney model over the units of an ``Alphabet``.  The registered query and the pipeline
take ``BYTES``: n-grams of order four of the text itself, every UTF-8 byte a unit of its own and a run of white space one break.
``LETTERS`` (the default) is a smaller form over 96 classes, in which capitals, digits and bytes of other scripts
fall together.  N-grams run over word borders, so the order of words shows where sentences begin and end, and a document's
score is the sum over all its units.  N-grams of all documents are counted by Spark, one model for each stated language;
discounts come from the counts of counts, lower orders use continuation counts, and what the n-grams leave is the back-off mass.

The model is kept in sorted arrays of packed n-grams with their values, looked up by binary search.  All n-grams are kept.
An n-gram has 32 (``LETTERS``: 28) bits and those of a language are soon all seen, so the arrays grow much slower than the corpus.

Clean documents quote other languages, and stated languages are sometimes wrong.  So a text is read in segments of ``SEGMENT``
words, and each segment is scored by the language whose model finds it most probable (of all languages, however many); a
document's main language is the one of most of its characters.  The middle of a language is that of the shortest interval
that holds half of the different values (log perplexity a character) of documents in that language alone that pass the
base rules: neither copies nor garbage, as long as it is less than half, can move it.  A document passes if its log perplexity
lies between bounds around what the middles of its segments' languages let expect: ``width`` half widths of its main
language's interval above and below, more for short texts, whose score varies more.

Defined cases: a null or empty text has no words and fails the base rules; texts without a language train a model of
their own; repeated rows count once each; an empty table gives an empty result; other columns stay out of the result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textscan as ts
from .common import stored

ORDER, BITS, SEGMENT = 4, 7, 8
CLASSES = 1 << BITS
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_BLOCK = 1 << 20
#: Class of every byte.
CLASS = np.full(256, 31, np.uint32)
CLASS[ts.WHITE] = 0
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = 27
CLASS[48:58] = 28
CLASS[[ord(c) for c in ".!?"]] = 29
CLASS[[ord(c) for c in ",;:"]] = 30
CLASS[128:] = 64 + (np.arange(128, 256) & 63)


class Alphabet(NamedTuple):
    """What n-grams are made of: their order, the bits of a unit and the unit of every byte (0: a break)."""

    order: int
    bits: int
    unit: np.ndarray

    @property
    def key(self) -> type:
        """Type of a packed n-gram, and of its stored form below."""
        return np.uint32 if self.order * self.bits < 32 else np.uint64

    @property
    def stored(self) -> type:
        return np.int32 if self.key is np.uint32 else np.int64


LETTERS = Alphabet(ORDER, BITS, CLASS)
#: Every byte is a unit of its own; the null byte takes the number of a tab, which is a break.
BYTES = Alphabet(ORDER, 8, np.where(ts.WHITE, 0, np.where(np.arange(256) == 0, 9, np.arange(256))).astype(np.uint32))


def base_counts(block: ts.Block, words: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, n = block.data, block.n
    out = {"n_words": block.counts(), "word_chars": block.per_text(block.inside & ~_CONTINUES[data]),
           "n_symbols": block.per_text(_SYMBOLS[data])}
    breaks = np.flatnonzero(data == 10)  # the byte after each text is a line end, too
    start = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else breaks
    has_word = np.diff(np.searchsorted(block.start, np.append(start, len(data)))) > 0 if len(breaks) else np.zeros(0, bool)
    start, end = start[has_word], breaks[has_word]
    line_text = np.searchsorted(block.text_end, start, "right")
    out["n_dup_lines"] = ts.repeats(line_text, block.hash(start, end), n)
    gram, first = block.grams(words, 8)
    owner = block.text[first]
    # windows that stand twice in a text: same text and same hash
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (gram >> bits)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(len(words) + 1, np.int64)
    if len(twice):
        spot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        hit = first[twice[spot] == key]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 8, -1)
    inside = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.bincount(block.text[inside], minlength=n)
    return out


def _grams(block: ts.Block, alphabet: Alphabet = LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed n-gram, text, number of breaks before it in its text) of every unit of every text; a run of white space is one
    break, and before a text are breaks."""
    order, bits = alphabet.order, alphabet.key(alphabet.bits)
    unit = alphabet.unit[block.data]
    keep = unit > 0
    keep[1:] |= unit[:-1] > 0  # the first of a run of breaks
    at = np.flatnonzero(keep)
    text = np.searchsorted(block.text_end, at, "left")
    counts = np.bincount(text, minlength=block.n)
    flat = np.zeros(len(at) + (order - 1) * block.n, alphabet.key)
    place = np.arange(len(at)) + (order - 1) * (text + 1)
    flat[place] = unit[at]
    key = np.zeros(len(at), alphabet.key)
    for k in range(order - 1, -1, -1):
        key = (key << bits) | flat[place - k]
    breaks = np.concatenate(([0], np.cumsum(unit[at] == 0)))
    first = np.cumsum(counts) - counts
    return key, text, breaks[:-1] - breaks[first][text]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def count_grams(docs: DataFrame, alphabet: Alphabet = LETTERS) -> DataFrame:
    """(lang, gram, n): counts of packed n-grams of the highest order over all texts."""
    kind = pa.from_numpy_dtype(alphabet.stored)

    def task(batches):
        powers, held = ts.Powers(), {}

        def flush(lang):
            keys, values = (np.concatenate(x) for x in zip(*held.pop(lang)))
            keys, values = _summed(keys, values)
            return keys, values

        for batch in batches:
            langs = pc.fill_null(batch.column("lang").cast(pa.string()), "")
            for lang in pc.unique(langs).to_pylist():
                part = batch.filter(pc.equal(langs, lang))
                for rows in ts.pieces(part, limit=_BLOCK):
                    keys, _, _ = _grams(ts.Block(rows.column("text"), powers), alphabet)
                    keys, times = np.unique(keys, return_counts=True)
                    held.setdefault(lang, []).append((keys.astype(alphabet.stored), times.astype(np.int64)))
                    if sum(len(k) for k, _ in held[lang]) > 2_000_000:
                        merged = flush(lang)
                        if len(merged[0]) > 1_000_000:  # hand on, Spark adds up
                            yield rows_of(lang, *merged)
                        else:
                            held[lang] = [merged]
        for lang in list(held):
            yield rows_of(lang, *flush(lang))

    def rows_of(lang, keys, values):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, kind), pa.array(values, pa.int64())],
                                          ["lang", "gram", "n"])

    parts = ts.modest_batches(docs.select("lang", "text")).mapInArrow(task, f"lang string, gram {'int' if alphabet.stored is np.int32 else 'bigint'}, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def model_table(counts: DataFrame, alphabet: Alphabet = LETTERS) -> DataFrame:
    """(lang, size, gram, p, left): probability part of each n-gram of each size; `left` is the back-off mass of
    the context that the n-gram is (null where it is none)."""
    tables, level = [], counts
    for size in range(alphabet.order, 0, -1):
        of_counts = level.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)])
        y = F.when(F.col("t1") + 2 * F.col("t2") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(0.5)

        def discount(k):
            raw = F.lit(float(k)) - (k + 1) * y * F.when(F.col(f"t{k}") > 0, F.col(f"t{k + 1}") / F.col(f"t{k}")).otherwise(F.lit(k / (k + 1.0)))
            return F.greatest(F.lit(0.05), F.least(raw, F.lit(k - 0.05)))
        of_counts = of_counts.select("lang", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)])
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.shiftright("gram", alphabet.bits)
        totals = level.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"))
        tables.append(level.withColumn("context", context).join(totals, ["lang", "context"]).join(of_counts, "lang")
                      .select("lang", F.lit(size).alias("size"), "context", "gram", "n", ((F.col("n") - d) / F.col("total")).alias("p")))
        # continuation counts: in how many different left contexts the shorter n-gram stands
        level = level.groupBy("lang", F.col("gram").bitwiseAND((1 << alphabet.bits * (size - 1)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


class Model:
    """Sorted arrays: for each language and size the packed n-grams and their values, and the contexts and what they leave."""

    def __init__(self, arrays: dict, alphabet: Alphabet = LETTERS):
        self.arrays, self.alphabet = arrays, alphabet

    @classmethod
    def of(cls, table: pa.Table, alphabet: Alphabet = LETTERS) -> "Model":
        arrays = {}
        for lang in pc.unique(table.column("lang")).to_pylist():
            of_lang = table.filter(pc.equal(table.column("lang"), lang)).drop_columns(["lang"])
            for size in range(1, alphabet.order + 1):
                part = of_lang.filter(pc.equal(of_lang.column("size"), size))
                gram, p = (part.column(c).to_numpy() for c in ("gram", "p"))
                order = np.argsort(gram)
                contexts, used = _summed(gram >> alphabet.bits, p.astype(np.float64))
                if len(gram):
                    arrays[lang, size] = (gram[order], p[order], contexts, (1 - used).astype(np.float32))
        return cls(arrays, alphabet)

    def languages(self) -> list[str]:
        """Every language that has a model."""
        return sorted({lang for lang, _ in self.arrays})

    @staticmethod
    def _look(keys, values, wanted, default):
        if not len(keys):
            return np.full(len(wanted), default)
        spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[spot] == wanted, values[spot], default).astype(np.float64)

    def log_p(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each packed n-gram's last unit after the others."""
        bits = self.alphabet.bits
        p = np.full(len(grams), 1 / (1 << bits))
        for size in range(1, self.alphabet.order + 1):
            if (lang, size) not in self.arrays:
                continue
            keys, values, contexts, left = self.arrays[lang, size]
            gram = grams & ((1 << bits * size) - 1)
            p = self._look(keys, values, gram, 0.0) + self._look(contexts, left, gram >> bits, 1.0) * p
        return np.log(np.maximum(p, 1e-12))


def build(docs: DataFrame, alphabet: Alphabet = LETTERS) -> Model:
    """Count over all documents and gather the n-grams of each language."""
    table = model_table(stored(count_grams(docs, alphabet)), alphabet)
    model = Model.of(table.select("lang", F.col("size").cast("tinyint").alias("size"), "gram", F.col("p").cast("float").alias("p")).toArrow(), alphabet)
    pa.default_memory_pool().release_unused()  # the driver's share is small
    return model


def measure(docs: DataFrame, model: Model, carry: tuple = ()) -> DataFrame:
    """(doc_id, lang, base counts, units, log_p, parts) of every row, with the columns to carry along; parts are the units and log
    probabilities by the languages of its segments, lang is the main one (on a tie the stated one)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays)  # plain arrays, so workers need no import
    langs, alphabet = model.languages(), model.alphabet
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "units")

    def task(batches):
        powers, model = ts.Powers(), Model(shared.value, alphabet)
        known, scores = np.zeros(0, alphabet.key), np.zeros((0, max(len(langs), 1)), np.float32)

        def gram_scores(keys):
            """Log probability of distinct n-grams in every language; those seen before are looked up."""
            nonlocal known, scores
            spot = np.searchsorted(known, keys)
            seen = np.zeros(len(keys), bool)
            inside = spot < len(known)
            seen[inside] = known[spot[inside]] == keys[inside]
            if not seen.all():
                new = keys[~seen]
                fresh = np.zeros((len(new), scores.shape[1]), np.float32)
                for k, lang in enumerate(langs):
                    fresh[:, k] = model.log_p(lang, new.astype(alphabet.stored))
                if len(known) > 8_000_000 // max(8, scores.shape[1]):  # bounded memory: start again with this block's
                    known, scores = keys[seen], scores[spot[seen]]
                at = np.searchsorted(known, new)
                known, scores = np.insert(known, at, new), np.insert(scores, at, fresh, axis=0)
                spot = np.searchsorted(known, keys)
            return scores[spot]

        for batch in batches:
            for rows in ts.pieces(batch, limit=_BLOCK):
                block = ts.Block(rows.column("text"), powers)
                counts = base_counts(block, block.words())
                keys, text, word = _grams(block, alphabet)
                keys, back = np.unique(keys, return_inverse=True)
                each = gram_scores(keys)
                counts["units"] = np.bincount(text, minlength=block.n)
                edge = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(word // SEGMENT, prepend=-1)) if len(text) else np.zeros(0, np.int64)
                owner, size = text[edge], np.diff(np.append(edge, len(text)))
                scored = np.stack([np.add.reduceat(each[back, k], edge, dtype=np.float64) if len(edge) else np.zeros(0) for k in range(each.shape[1])], axis=1)
                own = pc.index_in(pc.fill_null(rows.column("lang"), ""), pa.array(langs, pa.string()))
                own = pc.fill_null(own, 0).to_numpy(zero_copy_only=False)
                row = np.arange(len(edge))
                best = scored.argmax(axis=1) if len(edge) else row
                best = np.where(scored[row, own[owner]] >= scored[row, best], own[owner], best)
                # of no segments the sums are integers
                cell = owner * each.shape[1] + best
                total = lambda w: np.bincount(cell, weights=w, minlength=block.n * each.shape[1]).reshape(block.n, -1).astype(np.float64)
                of_units, of_log_p = total(size), total(scored[row, best])
                main = of_units.argmax(axis=1)
                main = np.where(of_units[np.arange(block.n), own] >= of_units[np.arange(block.n), main], own, main)
                used_row, used = np.nonzero(of_units)
                name = pa.array(langs or [""], pa.string())
                parts = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(np.bincount(used_row, minlength=block.n)))), pa.int32()),
                    pa.StructArray.from_arrays([name.take(pa.array(used)), pa.array(of_units[used_row, used].astype(np.int64)), pa.array(of_log_p[used_row, used])],
                                               ["lang", "units", "log_p"]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), name.take(pa.array(main)), *[pa.array(counts[k].astype(np.int64)) for k in names],
                     pa.array(of_log_p.sum(axis=1)), parts, *[rows.column(c) for c in carried]],
                    ["doc_id", "lang", *names, "log_p", "parts", *carried])

    kind = docs.schema["doc_id"].dataType.simpleString()
    carried = [f"carried_{c}" for c in carry]  # names that can't clash
    extra = "".join(f", carried_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return ts.modest_batches(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text", *[F.col(c).alias(f"carried_{c}") for c in carry])).mapInArrow(
        task, f"doc_id {kind}, lang string, " + ", ".join(f"{k} bigint" for k in names)
        + ", log_p double, parts array<struct<lang:string,units:bigint,log_p:double>>" + extra)


STEPS = 50  # quantiles of a language's values that are looked at: half of them are STEPS / 2 apart


def bands(rated: DataFrame) -> dict[str, tuple[float, float]]:
    """Middle and half width of the shortest interval that holds half of a language's different values, of documents in that
    language alone (nine tenths)."""
    alone = F.exists("parts", lambda p: (p["lang"] == F.col("lang")) & (10 * p["units"] >= 9 * F.col("units")))
    values = rated.where(~F.col("base_failed") & alone).select("lang", "n_words", "log_perplexity").distinct()
    quantiles = F.percentile_approx("log_perplexity", [k / STEPS for k in range(STEPS + 1)], 10_000)
    spans = F.transform(F.sequence(F.lit(0), F.lit(STEPS // 2)), lambda i: F.struct(
        (F.col("q")[i + STEPS // 2] - F.col("q")[i]).alias("wide"), F.col("q")[i].alias("low")))
    found = values.groupBy("lang").agg(quantiles.alias("q")).select("lang", F.array_min(spans).alias("s"))
    return {r["lang"]: (r["s"]["low"] + r["s"]["wide"] / 2, max(r["s"]["wide"] / 2, 0.01)) for r in found.collect()}  # a row for each language


def judge(measured: DataFrame, width: float = 4.0, short: float = 200.0) -> DataFrame:
    """Add base_failed, log_perplexity and kept; carried columns stay.  `measured` is read twice: pass a stored table."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rated = measured.select("*", failed.alias("base_failed"), (-F.col("log_p") / F.greatest("units", F.lit(1))).alias("log_perplexity"))
    of = bands(rated)
    inside = F.lit(False)
    if of:
        band = F.create_map(*[x for lang, (middle, half) in sorted(of.items()) for x in (F.lit(lang), F.struct(F.lit(middle).alias("middle"), F.lit(half).alias("half")))])
        own = band[F.col("lang")]
        # a language that no document is in alone has no middle: its segments are taken as they are
        expected = F.aggregate("parts", F.lit(0.0), lambda total, p: total + F.coalesce(band[p["lang"]]["middle"] * p["units"], -p["log_p"]))
        room = width * F.coalesce(own["half"], F.lit(0.01)) * F.sqrt(1 + F.lit(short) / F.greatest("n_words", F.lit(1)))
        inside = F.abs(F.col("log_perplexity") - expected / F.greatest("units", F.lit(1))) <= room
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "log_perplexity",
                        *[c for c in measured.columns if c.startswith("carried_")])


def rules(docs: DataFrame, width: float = 4.0, alphabet: Alphabet = LETTERS) -> DataFrame:
    """One row of counts and verdict for every document."""
    return judge(stored(measure(docs, build(docs, alphabet))), width)


def keep(docs: DataFrame, width: float = 4.0, alphabet: Alphabet = LETTERS) -> DataFrame:
    """The documents that pass, with all their columns; texts are written once and not shuffled."""
    carried = tuple(docs.columns)
    rated = judge(stored(measure(docs, build(docs, alphabet), carried)), width)
    return rated.where("kept").select(*[F.col(f"carried_{c}").alias(c) for c in carried])
