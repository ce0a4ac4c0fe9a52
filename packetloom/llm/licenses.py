"""License scans: lines, whole texts and stretches of texts against licence templates by Dice coefficient over word bigrams.

A notice that is wrapped over lines or stands inside other prose is found as a window: as many words as the template has, laid so
that at least a quarter of the template's bigrams stand in their places.  So the windows that are compared come from the
bigrams a text shares with a template, whatever lines it is cut into.

Both sides are normalised (lower case, everything but letters and digits is a space).  The Dice coefficient is
2 * shared / (bigrams of the text + bigrams of the template), counted with repeats, so a text's size is known before
anything is compared: at threshold t only sizes from t / (2 - t) to (2 - t) / t times the template's are possible, and
other candidates are dropped.  By the same bound a match shares so many of a template's bigrams that at most a known number can be
missing; a set of anchor words that stand in more of its bigrams than that must leave one in the text, so
documents without any anchor word are dropped before they are split.  Both bounds lose no match.

The templates are a parameter, (name, text) pairs.  Their bigrams are broadcast while they are at most
``BROADCAST_BIGRAMS``.  Everything is DataFrame functions.

Defined cases: null and empty texts match nothing; texts and lines of one word have no bigram and match nothing;
repeated rows are reported once; a template under two words is an error; an empty table gives an empty result; rows without an id
are reported without one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

BROADCAST_BIGRAMS = 100_000

#: Public licence notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
     "the above copyright notice and this permission notice appear in all copies."),
)


_COMMON = frozenset("a an and any are at be by for from in is it may not of on or that the this to under with you".split())


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _bigrams(text: str) -> Counter:
    w = _words(text)
    return Counter(f"{a} {b}" for a, b in zip(w, w[1:]))


def anchors(templates, least: float) -> list[str]:
    """Words of which every match of any template has at least one."""
    left = {}
    for name, text in templates:
        grams = _bigrams(text)
        total = sum(grams.values())
        if not total:
            raise ValueError(f"template {name} has fewer than two words")
        # at the smallest possible size the match has least / (2 - least) of the template's bigrams
        missing = int(total - total * least / (2 - least) + 1e-9)
        left[name] = (grams, missing + 1)
    chosen: list[str] = []
    while open_ := {n: (g, k) for n, (g, k) in left.items() if sum(c for b, c in g.items() if set(b.split()) & set(chosen)) < k}:
        gain = Counter()
        for grams, _ in open_.values():
            for gram, c in grams.items():
                if not set(gram.split()) & set(chosen):
                    for word in set(gram.split()):
                        gain[word] += c * (10 if len(word) > 5 else 0.01 if word in _COMMON else 1)  # any choice is right, rare words are fast
        chosen.append(max(sorted(gain), key=gain.get))
    return chosen


def scan(docs: DataFrame, templates=TEMPLATES, least: float = 0.8) -> DataFrame:
    """(doc_id, unit, position, template, dice) of every line (unit `line`, from 0), whole text (unit `text`) and window (unit `window`, its
    first word from 0) that matches."""
    spark = docs.sparkSession
    rows = [(name, gram, c, sum(grams.values())) for name, text in templates for grams in [_bigrams(text)] for gram, c in grams.items()]
    wanted = spark.createDataFrame(rows, "template string, bigram string, in_template int, of_template int")
    if len(rows) <= BROADCAST_BIGRAMS:
        wanted = F.broadcast(wanted)
    low, high = least / (2 - least), (2 - least) / least
    smallest, largest = low * min(r[3] for r in rows), high * max(r[3] for r in rows)

    def stands(text, word):
        """Is the word in the lower-cased text?  Short ones are also parts of many words, so their edges are looked at."""
        inside = text.contains(word)
        return inside if len(word) > 5 else inside & text.rlike(rf"(?<![\p{{L}}\p{{N}}]){word}(?![\p{{L}}\p{{N}}])")

    def any_anchor(text):
        some = None
        for word in sorted(anchors(templates, least), key=len, reverse=True):
            some = stands(text, word) if some is None else some | stands(text, word)
        return some

    # the lower-cased text is made once for all anchors
    lower = F.lower(F.col("text"))
    hit = docs.where(F.transform(F.array(lower), any_anchor)[0]).select("doc_id", F.regexp_replace(lower, r"[^\p{L}\p{N}\n]+", " ").alias("clean")).distinct()
    part = lambda unit, position, line: F.struct(F.lit(unit).alias("unit"), position.alias("position"), line.alias("line"))
    whole = part("text", F.lit(0), F.regexp_replace("clean", "\n", " "))
    lines = F.transform(F.split("clean", "\n"), lambda line, i: part("line", i, line))
    units = hit.select("doc_id", F.xxhash64("clean").alias("content"), F.inline(F.concat(F.array(whole), lines)))
    units = units.select("doc_id", "content", "unit", "position", F.trim(F.regexp_replace("line", " +", " ")).alias("line"))
    n = F.length("line") - F.length(F.translate("line", " ", ""))
    units = units.select("*", n.alias("size")).where(F.col("size").between(smallest, largest) & (F.col("size") > 0))
    words = units.select("doc_id", "content", "unit", "position", "size", F.split("line", " ").alias("w"))
    grams = words.select("doc_id", "content", "unit", "position", "size", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("size")), lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1)))).alias("bigram"))
    possible = (F.col("size") >= low * F.col("of_template")) & (F.col("size") <= high * F.col("of_template"))
    shared = grams.join(wanted, "bigram").where(possible)
    keys = ["doc_id", "content", "unit", "position", "size", "template", "of_template"]
    counted = shared.groupBy(*keys, "bigram", "in_template").agg(F.count(F.lit(1)).alias("n"))
    summed = counted.groupBy(*keys).agg(F.sum(F.least("n", "in_template")).alias("shared"))
    dice = 2.0 * F.col("shared") / (F.col("size") + F.col("of_template"))
    units_found = summed.select("doc_id", "unit", F.col("position").cast("bigint").alias("position"), "template", dice.alias("dice")).where(F.col("dice") >= least)
    return units_found.unionByName(_windows(hit.select("doc_id", F.xxhash64("clean").alias("content"), "clean"), templates, wanted, least))


def _windows(hit: DataFrame, templates, wanted: DataFrame, least: float) -> DataFrame:
    """The windows of texts (doc_id, content, clean) that match; equal texts are read once."""
    spark = hit.sparkSession
    places = [(name, f"{a} {b}", i, len(w) - 1) for name, text in templates for w in [_words(text)] for i, (a, b) in enumerate(zip(w, w[1:]))]
    placed = spark.createDataFrame(places, "template string, bigram string, at int, of_template int")
    if len(places) <= BROADCAST_BIGRAMS:
        placed = F.broadcast(placed)
    texts = hit.select("content", F.split(F.trim(F.regexp_replace("clean", "[ \n]+", " ")), " ").alias("w")).dropDuplicates(["content"]).where(F.size("w") > 1)
    bigrams = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1)))
    votes = (texts.select("content", F.posexplode(bigrams).alias("pos", "bigram")).join(placed, "bigram")
             .groupBy("content", "template", "of_template", (F.col("pos") - F.col("at")).alias("start")).agg(F.count(F.lit(1)).alias("votes"))
             .where("4 * votes >= of_template"))
    first = F.greatest(F.col("start"), F.lit(0))
    last = F.least(F.col("start") + F.col("of_template"), F.size("w") - 1)  # the window's bigrams begin at words first .. last - 1
    laid = texts.join(votes, "content").select("content", "template", "of_template", "start", first.alias("first"), (last - first).alias("size"), F.slice("w", first + 1, last - first + 1).alias("w"))
    keys = ["content", "template", "of_template", "start", "first", "size"]
    grams = laid.select(*keys, F.explode(F.transform(
        F.sequence(F.lit(1), F.col("size")), lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1)))).alias("bigram"))
    counted = grams.groupBy(*keys, "bigram").agg(F.count(F.lit(1)).alias("n")).join(wanted.select("template", "bigram", "in_template"), ["template", "bigram"])
    summed = counted.groupBy(*keys).agg(F.sum(F.least("n", "in_template")).alias("shared"))
    dice = 2.0 * F.col("shared") / (F.col("size") + F.col("of_template"))
    best = summed.where(dice >= least).groupBy("content", "template", "first").agg(F.max(dice).alias("dice"))
    return hit.select("doc_id", "content").join(best, "content").select("doc_id", F.lit("window").alias("unit"), F.col("first").cast("bigint").alias("position"), "template", "dice")


def comparison_sql(templates=TEMPLATES, least: float = 0.8) -> str:
    """The same in SQL, without the bounds."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({quoted(name)}, {quoted(' '.join(_words(text)))})" for name, text in templates)
    grams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t AS (SELECT template, unnest({grams}) AS bigram, len(w) - 1 AS of_template FROM (SELECT template, string_split(words, ' ') AS w FROM (VALUES {listed}) v(template, words))),
tc AS (SELECT template, bigram, of_template, count(*) AS in_template FROM t GROUP BY ALL),
clean AS (SELECT DISTINCT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS c FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, c, 'line' AS unit, unnest(range(0, len(l))) AS position, unnest(l) AS line FROM (SELECT *, string_split(c, chr(10)) AS l FROM clean)
    UNION ALL SELECT doc_id, c, 'text', 0, replace(c, chr(10), ' ') FROM clean),
sized AS (SELECT doc_id, c, unit, position, w, len(w) - 1 AS size FROM (SELECT *, string_split(trim(regexp_replace(line, ' +', ' ', 'g')), ' ') AS w FROM units) WHERE len(w) > 1 AND len(w) < 1000),
dg AS (SELECT doc_id, c, unit, position, size, bigram, count(*) AS n FROM (SELECT *, unnest({grams}) AS bigram FROM sized) GROUP BY ALL),
s AS (SELECT doc_id, c, unit, position, template, size, of_template, sum(least(n, in_template)) AS shared FROM dg JOIN tc USING (bigram) GROUP BY ALL),
tp AS (SELECT template, len(w) - 1 AS of_template, unnest(range(0, len(w) - 1)) AS place, unnest({grams}) AS bigram FROM (SELECT template, string_split(words, ' ') AS w FROM (VALUES {listed}) v(template, words))),
bg AS (SELECT doc_id, c, unnest(range(0, len(w) - 1)) AS pos, unnest({grams}) AS bigram FROM (SELECT doc_id, c, string_split(trim(regexp_replace(c, '[ \n]+', ' ', 'g')), ' ') AS w FROM clean) WHERE len(w) > 1),
votes AS (SELECT doc_id, c, template, of_template, pos - place AS p FROM bg JOIN tp USING (bigram) GROUP BY ALL HAVING 4 * count(*) >= of_template),
wg AS (SELECT v.doc_id, v.c, template, of_template, p, bigram, count(*) AS n FROM votes v JOIN bg ON bg.c = v.c AND bg.doc_id IS NOT DISTINCT FROM v.doc_id AND pos >= p AND pos < p + of_template GROUP BY ALL),
ws AS (SELECT doc_id, c, template, of_template, p, sum(n) AS size, sum(least(n, coalesce(in_template, 0))) AS shared FROM wg LEFT JOIN (SELECT template, bigram, in_template FROM tc) USING (template, bigram) GROUP BY ALL),
ww AS (SELECT doc_id, c, template, greatest(p, 0) AS position, max(2.0::DOUBLE * shared / (size + of_template)) AS dice FROM ws WHERE 2.0::DOUBLE * shared / (size + of_template) >= {least} GROUP BY ALL)
SELECT doc_id, unit, position::BIGINT AS position, template, 2.0::DOUBLE * shared / (size + of_template) AS dice FROM s WHERE 2.0::DOUBLE * shared / (size + of_template) >= {least}
UNION ALL SELECT doc_id, 'window', position::BIGINT, template, dice FROM ww"""
