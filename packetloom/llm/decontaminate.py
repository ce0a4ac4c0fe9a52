"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, names (capitalised words, wherever they stand) and units become typed placeholders, everything else lower-case
words; so a question with other numbers or names has the same template.  Windows of eight template words are hashed and
joined, at every position of items and documents.  A window of placeholders alone says nothing and is hashed with its
values, so tables of numbers are no common key.  A hit gives a diagonal (position in the document minus position in the
item).  There the document's words are laid beside the item's: equal template words in runs of at least eight count as
covered, and the values that stand in the same slots must be a function of the item's values (a number that occurs twice
must be replaced by one number).  A diagonal counts if at most half of its equal words are slots, or if the values
are the item's own.  A document is contaminated by an item if the diagonals cover at least half of the item.  An item
under eight words is looked for as a whole.

While the benchmark has at most ``SET_WORDS`` words, documents are read in steps that lose nothing.  Every benchmark window
has an anchor chosen: three plain words side by side, the longest (two or one where there are no three); a document without
any anchor holds no window and is left after one cheap split into words.  The others get
their template, and windows are hashed only where all pairs of neighbours occur in the benchmark.  Documents are never
shuffled: windows are joined with the benchmark's, which are broadcast while they are at most ``BROADCAST_WINDOWS``;
for a larger benchmark the join is shuffled by window and the documents found are read again.

Defined cases: null and empty texts and items match nothing; an item with several texts is looked for by each of them and
reported with the best covered one; repeated rows are reported once; an empty table gives an empty result; other columns are
ignored; rows without an id are not reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

WINDOW = 8
BROADCAST_WINDOWS, SET_WORDS = 500_000, 20_000
UNITS = ("km", "m", "cm", "mm", "miles", "mile", "feet", "ft", "inches", "kg", "g", "mg", "lb", "lbs", "pounds", "tons", "l", "ml", "litres", "liters",
         "gallons", "seconds", "minutes", "hours", "hour", "days", "day", "weeks", "months", "years", "year", "dollars", "euros", "cents", "percent",
         "mph", "kmh", "degrees", "volts", "watts", "joules", "newtons", "hz", "khz", "mhz", "kb", "mb", "gb")
_NAME, _NUMBER, _UNIT = "\x01", "\x02", "\x03"

#: (pattern, replacement) in this order; the same steps in Spark and in the comparison SQL.
STEPS = (
    (r"(^|[^\p{L}\p{N}])(\p{Lu}\p{Ll}+)", ("", 1, _NAME, 2)),
    (r"(^|[^\p{L}\p{N}])([0-9][0-9.,:/]*)", ("", 1, _NUMBER, 2)),
    (_NUMBER + r"([0-9.,:/]+) ?(" + "|".join(UNITS) + r")\b", (_NUMBER, 1, " " + _UNIT, 2)),
    (r"([0-9])[.,:/]+([0-9])", ("", 1, "", 2)),
    (r"([0-9])[.,:/]+([0-9])", ("", 1, "", 2)),
    (r"[^\p{L}\p{N}\x01-\x03]+", (" ", None, "", None)),
)


def _replacement(parts, mark: str) -> str:
    before, one, between, two = parts
    return before + (f"{mark}{one}" if one else "") + between + (f"{mark}{two}" if two else "")


def words(text: Column) -> Column:
    """Words in lower case; names, numbers and units begin with their mark."""
    for pattern, parts in STEPS:
        text = F.regexp_replace(text, pattern, _replacement(parts, "$"))
    return F.filter(F.split(F.trim(F.lower(text)), " "), lambda w: w != "")


def template(raw: Column) -> Column:
    """The placeholder of a typed word, else the word."""
    return F.when(raw < "\x04", F.substring(raw, 1, 1)).otherwise(raw)


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it in several places of an expression."""
    return F.transform(F.array(value), use)[0]


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text_no, item, plain, n) of every text of every item."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    items = items.select("item_id", F.xxhash64("text").alias("text_no"), words(F.col("text")).alias("item"))
    return items.select("item_id", "text_no", "item", F.transform("item", template).alias("plain"), F.size("item").alias("n")).where("n > 0")


def _window(size, raw: Column, plain: Column, i: Column) -> Column:
    """Key of `size` words from position i: of their template, or of the words where all of them are slots."""
    of = lambda x: F.slice(x, i + 1, size)
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.forall(of(plain), lambda w: w < "\x04"), F.xxhash64(size, F.lit(1), of(raw))).otherwise(F.xxhash64(size, F.lit(0), of(plain)))


def _pairs(plain: Column, use) -> Column:
    """``use`` of the hash of every two neighbours."""
    made = F.transform(F.sequence(F.lit(1), F.size(plain) - 1), lambda i: use(F.xxhash64(F.get(plain, i - 1), F.get(plain, i))))
    return F.when(F.size(plain) > 1, made)


def _anchors(plain: list[list[str]]) -> dict[int, set[tuple[str, ...]]] | None:
    """Runs of three, two or one plain words, by their length, of which every window of the items has at least one; None if some
    window has no plain word."""
    chosen: dict[int, set[tuple[str, ...]]] = {3: set(), 2: set(), 1: set()}
    usable = str.isalpha  # no marks, and no digits, which may have been joined over separators
    for item in plain:
        size = min(len(item), WINDOW)
        for i in range(len(item) - size + 1):
            window = item[i:i + size]
            runs = {k: [r for r in zip(*(window[j:] for j in range(k))) if all(map(usable, r))] for k in chosen}
            if not any(r in chosen[k] for k in chosen for r in runs[k]):
                k = next((k for k in chosen if runs[k]), None)
                if k is None:
                    return None
                chosen[k].add(max(runs[k], key=lambda r: (sum(min(len(w), 6) for w in r), r)))  # any choice is right, rare runs are fast
    return chosen


def _with_anchor(docs: DataFrame, anchors: dict[int, set[tuple[str, ...]]]) -> DataFrame:
    """The documents that hold an anchor."""
    spark = docs.sparkSession
    hashes = {k: [r[0] for r in spark.createDataFrame([(list(r),) for r in sorted(runs)], "r array<string>")
                  .select(F.xxhash64(*[F.col("r")[j] for j in range(k)])).collect()] for k, runs in anchors.items() if runs}
    # as SQL text: a literal made one by one costs more than the search
    tests = [f"size(w) >= {k} AND exists(sequence(0, size(w) - {k}), i -> xxhash64({', '.join(f'get(w, i + {j})' for j in range(k))}) IN ({_longs(known)}))"
             for k, known in hashes.items()]
    tokens = r"split(lower(regexp_replace(coalesce(text, ''), r'[^\p{L}\p{N}]+', ' ')), ' ')"
    return docs.where(F.expr(f"transform(array({tokens}), w -> {' OR '.join(tests)})[0]"))


def _longs(values: list[int]) -> str:
    return ", ".join(f"{v}L" if v > -(2**63) else "CAST('-9223372036854775808' AS BIGINT)" for v in values)


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, covered, item_words) of every contamination found."""
    items = stored(_items(benchmark))
    size = F.least("n", F.lit(WINDOW))
    shape = items.agg(F.sum("n").alias("windows"), F.sort_array(F.collect_set(size)).alias("sizes")).first()  # at most WINDOW sizes
    sizes = shape["sizes"] or []
    wanted = items.select("item_id", "text_no", "n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("n") - size), lambda i: _window(size, F.col("item"), F.col("plain"), i))).alias("b_pos", "window"))
    small = (shape["windows"] or 0) <= BROADCAST_WINDOWS
    pairs = None
    docs = docs.where("doc_id is not null")
    if sizes and (shape["windows"] or 0) <= SET_WORDS:  # so few words may be looked at here
        if anchors := _anchors([r["plain"] for r in items.select("plain").collect()]):
            docs = _with_anchor(docs, anchors)
        if 1 not in sizes:
            pairs = [r["pair"] for r in items.select(F.explode(_pairs(F.col("plain"), lambda h: h)).alias("pair")).distinct().collect()]

    text = F.coalesce("text", F.lit(""))
    both = _let(words(text), lambda raw: F.struct(raw.alias("raw"), F.transform(raw, template).alias("plain")))
    # the one-element inline is a step that filters are not copied through
    plain = docs.select("doc_id", F.inline(F.array(both)))
    if pairs is not None:
        bits = f"transform(sequence(1, size(plain) - 1), i -> CASE WHEN xxhash64(get(plain, i - 1), get(plain, i)) IN ({_longs(pairs)}) THEN '1' ELSE '0' END)"
        plain = plain.where("size(plain) > 1").withColumn("bits", F.expr(f"array_join({bits}, '')")).where(
            F.contains("bits", F.lit("1" * (min(sizes, default=WINDOW) - 1))))

    def windows(size: int) -> Column:
        at = F.sequence(F.lit(0), F.size("plain") - size)
        if pairs is not None:
            at = F.filter(at, lambda i: F.substring("bits", i + 1, F.lit(size - 1)) == "1" * (size - 1))
        made = F.transform(at, lambda i: F.struct(i.alias("d_pos"), _window(size, F.col("raw"), F.col("plain"), i).alias("window")))
        return F.when(F.size("plain") >= size, made).otherwise(F.array().cast("array<struct<d_pos:int,window:bigint>>"))

    every = F.concat(*[windows(size) for size in sizes]) if sizes else windows(WINDOW)
    segment = lambda: F.slice("raw", F.greatest(F.col("d_pos") - F.col("b_pos"), F.lit(0)) + 1, F.col("n"))
    diagonal = (F.col("d_pos") - F.col("b_pos")).alias("diagonal")
    text_of = ["item_id", "text_no"]
    if small:
        found = (plain.select("doc_id", "raw", F.inline(every)).join(F.broadcast(wanted), "window")
                 .select("doc_id", *text_of, diagonal, segment().alias("segment")))
    else:
        at = (plain.select("doc_id", F.inline(every)).join(wanted, "window")
              .select("doc_id", *text_of, "n", "d_pos", "b_pos").dropDuplicates(["doc_id", *text_of, "d_pos", "b_pos"]))
        found = plain.select("doc_id", "raw").join(at, "doc_id").select("doc_id", *text_of, diagonal, segment().alias("segment"))
    # equal (document, item, diagonal) have equal segments unless an id names several texts: keep each text's
    found = found.distinct().join(items.select(*text_of, "item", "n"), text_of)

    # lay the segment beside the item: it starts late if the diagonal is negative
    beside = F.when(F.col("diagonal") >= 0, F.zip_with("item", "segment", lambda b, d: F.struct(b.alias("b"), d.alias("d")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(
            F.col("item")[i].alias("b"), F.when(i + F.col("diagonal") >= 0, F.get("segment", i + F.col("diagonal"))).alias("d"))))
    key = ["doc_id", *text_of, "n"]
    equal = lambda s: F.coalesce(template(s["b"]) == template(s["d"]), F.lit(False))
    laid = found.select(*key, beside.alias("beside"))
    laid = laid.select(*key, "beside", F.array_join(F.transform("beside", lambda s: F.when(equal(s), "1").otherwise("0")), "").alias("bits"))
    slots = F.filter("beside", lambda s: equal(s) & (s["b"] < "\x04"))
    laid = laid.select(
        *key,
        F.aggregate(F.regexp_extract_all("bits", F.concat(F.lit("1{"), F.least("n", F.lit(WINDOW)), F.lit(",}")), 0), F.lit(0), lambda a, r: a + F.length(r)).alias("run_words"),
        (F.size(F.array_distinct(slots)) == F.size(F.array_distinct(F.transform(slots, lambda s: s["b"])))).alias("consistent"),
        F.forall(slots, lambda s: s["b"] == s["d"]).alias("same"),
        F.size(slots).alias("slots"), F.length(F.regexp_replace("bits", "0", "")).alias("equal"))
    good = laid.where("consistent and run_words > 0 and (2 * slots <= equal or same)")
    covered = (good.groupBy(*key).agg(F.least(F.sum("run_words"), F.max("n")).cast("bigint").alias("covered"))
               .where(F.col("covered") >= F.ceil(F.lit(coverage) * F.col("n"))))
    best = covered.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", (-F.col("n")).alias("n"))).alias("t"))
    return best.select("doc_id", "item_id", "t.covered", (-F.col("t.n")).cast("bigint").alias("item_words"))


def comparison_sql(coverage: float = 0.5) -> str:
    """The same in SQL over whole tables: every window of every document, joined by its words."""
    def marked(column):
        out = column
        for pattern, parts in STEPS:
            literal = pattern.replace("\x02", r"\x02").replace("'", "''")
            new = "'" + _replacement(parts, "\\") + "'"
            for mark in (_NAME, _NUMBER, _UNIT):
                new = new.replace(mark, f"' || chr({ord(mark)}) || '")
            out = f"regexp_replace({out}, '{literal}', {new}, 'g')"
        return f"trim(lower({out}))"
    split = lambda c: f"CASE WHEN length({c}) > 0 THEN string_split({c}, ' ') ELSE [] END"
    plain = lambda x: f"CASE WHEN {x} < chr(4) THEN {x}[1] ELSE {x} END"
    key = lambda raw, size: (f"CASE WHEN len(list_filter(plain[i + 1:i + {size}], lambda x: NOT x < chr(4))) = 0 THEN '1 ' || array_to_string({raw}[i + 1:i + {size}], ' ') "  # noqa: E731
                             f"ELSE '0 ' || array_to_string(plain[i + 1:i + {size}], ' ') END")
    return f"""
WITH items AS (SELECT item_id, t, item, list_transform(item, lambda x: {plain('x')}) AS plain, len(item) AS n, least(len(item), {WINDOW}) AS size
    FROM (SELECT item_id, t, {split('t')} AS item FROM (SELECT DISTINCT item_id, {marked("text")} AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)) WHERE len(item) > 0),
d AS (SELECT doc_id, raw, list_transform(raw, lambda x: {plain('x')}) AS plain
    FROM (SELECT doc_id, {split('t')} AS raw FROM (SELECT doc_id, {marked("coalesce(text, '')")} AS t FROM documents WHERE doc_id IS NOT NULL))),
bw AS (SELECT item_id, t, size, i AS b_pos, {key('item', 'size')} AS w FROM (SELECT *, unnest(range(0, n - size + 1)) AS i FROM items)),
dw AS (SELECT doc_id, raw, size, i AS d_pos, {key('raw', 'size')} AS w FROM (SELECT d.*, size, unnest(range(0, len(raw) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM items))),
hits AS (SELECT DISTINCT doc_id, raw, item_id, t, d_pos - b_pos AS diagonal FROM dw JOIN bw USING (size, w)),
laid AS (SELECT doc_id, item_id, t, n, size, list_transform(range(0, n), lambda i: {{'b': item[i + 1], 'd': CASE WHEN i + diagonal >= 0 THEN raw[i + diagonal + 1] END}}) AS beside
    FROM hits JOIN items USING (item_id, t)),
rated AS (SELECT doc_id, item_id, t, n, size, array_to_string(list_transform(beside, lambda s: CASE WHEN ({plain("s['b']")}) = ({plain("s['d']")}) THEN '1' ELSE '0' END), '') AS bits,
    list_filter(beside, lambda s: coalesce(({plain("s['b']")}) = ({plain("s['d']")}), false) AND s['b'] < chr(4)) AS slots FROM laid),
good AS (SELECT doc_id, item_id, t, n, list_sum(list_transform(CASE WHEN size = {WINDOW} THEN regexp_extract_all(bits, '1{{{WINDOW},}}') WHEN NOT contains(bits, '0') THEN [bits] ELSE [] END, lambda r: length(r))) AS run_words
    FROM rated WHERE len(list_distinct(slots)) = len(list_distinct(list_transform(slots, lambda s: s['b'])))
    AND (2 * len(slots) <= length(replace(bits, '0', '')) OR len(list_filter(slots, lambda s: s['b'] <> s['d'])) = 0)),
covered AS (SELECT doc_id, item_id, t, n, least(sum(run_words), n) AS covered FROM good WHERE run_words > 0 GROUP BY doc_id, item_id, t, n HAVING least(sum(run_words), n) >= ceil({coverage} * n))
SELECT doc_id, item_id, max(covered)::BIGINT AS covered, arg_max(n, covered * 100000 - n)::BIGINT AS item_words FROM covered GROUP BY doc_id, item_id"""
