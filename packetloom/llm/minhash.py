"""Near duplicates by DartMinHash signatures.

A text is its five-word shingles with weights: one each (``weight="plain"``, the Jaccard similarity of sets) or how
often each occurs (``"count"``, of multisets).  Hashed darts are thrown
into the plane of weight and rank of every shingle: the plane is cut into rectangles (doubling in both directions), the
number of darts of a rectangle is a hashed Poisson number, and coordinate, weight and rank of a dart are hashed,
too, so equal shingles get equal darts in every text.  A dart counts if its weight lies below the shingle's.  For
each of ``COORDINATES`` coordinates the dart of the lowest rank is kept; two texts agree there with the probability of
their weighted Jaccard similarity.  Ranks are searched up to about the level at which all coordinates are hit,
so a text costs little more than one hash a shingle, whatever its weight.

Equal texts are one node.  Nodes that agree in all rows of a band share a bucket; with 25 bands of 5 rows a pair of
similarity 0.8 misses every bucket with probability 5e-5, one of 0.9 with 1e-10.  A bucket is first read once, the nodes
with the most company first: every node is laid beside the nodes that lead the bucket so far, signature by signature,
and proposes the one it agrees with most; it becomes a leader itself unless that agreement is nearly full.  So a
bucket of near copies gives one proposal for each, not all pairs.  Proposals are compared exactly, by the shingles
of the whole texts; those of similarity 0.8 or more are links.

Then buckets whose nodes do not all hang together yet are settled in one pass, every node against all nodes of other
components: with the nodes come their shingles, so a task compares exactly whatever agrees enough, joins components as it
finds links, and hands on only the links that join something - fewer rows than nodes.  A pair is looked at in the first
bucket it shares, if its numbers of shingles allow 0.8 at all.  Large buckets are cut into chunks of about
``CHUNK_SHINGLES`` shingles that meet two by two, so no bucket is one task and no pair is left out.  Arithmetic on
signatures grows with the square of what stays apart in a bucket; exact comparisons are only made for pairs that agree.

Defined cases: null and empty texts are equal to each other and make one class; texts under five words match equal
texts only; repeated rows belong to one class and stay rows; rows without an id get no class (null); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textscan as ts
from .common import stored
from .components import components

WORDS, BANDS, ROWS = 5, 25, 5
COORDINATES = BANDS * ROWS
CHUNK = 4096  # nodes of a bucket that one task reads in a row; changes no result
CHUNK_SHINGLES = 1 << 20  # shingles of the nodes of a chunk when buckets are settled; changes no result
#: Shares of agreeing coordinates: below ASK a pair of similarity 0.8 is four deviations off, above SURE a node needs no leader of its own.
ASK, SURE = 0.66, 0.9
_FIRST = 2.0**-6  # mean number of darts of a unit of weight in the lowest band of ranks
_ID = np.uint64(52)  # bits of a shingle's hash, below 12 bits of the text's number in its block


def shingles(texts: pa.Array, powers: ts.Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, how often), ordered by both."""
    block = ts.Block(texts, powers)
    gram, first = block.grams(block.words(), WORDS)
    key = np.sort((block.text[first].astype(np.uint64) << _ID) | (gram >> (np.uint64(64) - _ID)))
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(start, len(key)))
    key = key[start]
    return (key >> _ID).astype(np.int64), key & np.uint64((1 << 52) - 1), times


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(mean: float) -> np.ndarray:
    """Distribution function of a Poisson number."""
    steps = [math.exp(-mean)]
    for k in range(1, 20):
        steps.append(steps[-1] * mean / k)
    return np.cumsum(steps)


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, COORDINATES) identities of the earliest darts; rows of texts without shingles are zero."""
    norm = np.bincount(text, weights=weight, minlength=n)
    want = COORDINATES * (math.log(COORDINATES) + 2)
    level = np.ceil(np.log2(np.maximum(want / np.maximum(norm * _FIRST, 1e-9), 1))).astype(int)
    # one row for each shingle and weight band that its weight reaches: [0, 1), [1, 2), [2, 4), ...
    bands = np.ceil(np.log2(np.maximum(weight, 1))).astype(int) + 1
    row = np.repeat(np.arange(len(text)), bands)
    v = np.arange(len(row)) - np.repeat(np.cumsum(bands) - bands, bands)
    low_w = np.where(v == 0, 0.0, 2.0 ** (v - 1))
    wide = np.where(v == 0, 1.0, low_w)
    seed = ts.mix(shingle[row] + (v.astype(np.uint64) << np.uint64(52)), 3)
    owner, top = text[row], weight[row]
    rank = np.full(n * COORDINATES, np.inf)
    sign = np.zeros(n * COORDINATES, np.uint64)
    open_texts = norm > 0
    b = 0
    while open_texts.any():
        use = np.flatnonzero(open_texts[owner])
        low_r, high_r = (0.0, _FIRST) if b == 0 else (_FIRST * 2.0 ** (b - 1), _FIRST * 2.0**b)
        mean = (high_r - low_r) * wide[use]
        for m in np.unique(mean):
            part = use[mean == m]
            h = ts.mix(seed[part], 16 + b)
            if m > 1:  # so many cells of mean one
                cells = int(m)
                part = np.repeat(part, cells)
                h = ts.mix(np.repeat(h, cells) + np.tile(np.arange(cells, dtype=np.uint64), len(h)), 4)
            hits = np.searchsorted(_poisson(min(m, 1.0)), _unit(h))
            some = np.flatnonzero(hits)
            times = hits[some]
            part = np.repeat(part[some], times)
            number = np.arange(len(part)) - np.repeat(np.cumsum(times) - times, times)
            dart = ts.mix(np.repeat(h[some], times) + number.astype(np.uint64), 5)
            above = _unit(ts.mix(dart, 6)) * wide[part] + low_w[part]
            inside = above < top[part]
            dart, part = dart[inside], part[inside]
            cell = owner[part] * COORDINATES + (((dart >> np.uint64(32)) * np.uint64(COORDINATES)) >> np.uint64(32)).astype(np.int64)
            at = low_r + (high_r - low_r) * _unit(ts.mix(dart, 7))
            np.minimum.at(rank, cell, at)
            first = at == rank[cell]
            sign[cell[first]] = dart[first]
        full = np.isfinite(rank.reshape(n, COORDINATES)).all(axis=1)
        open_texts &= ~((b >= level) & full)
        b += 1
    return sign.reshape(n, COORDINATES)


def sketch(docs: DataFrame, weight: str = "plain") -> DataFrame:
    """(doc_id, content, buckets, sign, n): a digest of the text, the bucket key of every band (none under five words),
    16 bits of every coordinate and the number of shingles."""

    def make():
        powers = ts.Powers()

        def one(rows):
            n = rows.num_rows
            text, shingle, times = shingles(rows.column("text"), powers)
            sign = signatures(text, shingle, times if weight == "count" else np.ones(len(times), np.int64), n)
            has = np.zeros(n, bool)
            has[text] = True
            keys = np.zeros((n, BANDS), np.uint64)
            for r in range(ROWS):
                keys = ts.mix(keys + sign.reshape(n, BANDS, ROWS)[:, :, r], 8 + r)
            keys = ts.mix(keys + np.arange(BANDS, dtype=np.uint64), 14).astype(np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.where(has, BANDS, 0))))
            buckets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[has].ravel()))
            short = (sign >> np.uint64(48)).astype(np.uint16)
            signs = pa.array([short[i].tobytes() if has[i] else None for i in range(n)], pa.binary())
            size = pa.array(np.bincount(text, weights=times if weight == "count" else None, minlength=n).astype(np.int64))
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("content"), buckets, signs, size], ["doc_id", "content", "buckets", "sign", "n"])
        return one

    given = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"), "text")
    return ts.map_texts(given, make, "doc_id bigint, content string, buckets array<bigint>, sign binary, n bigint", limit=ts.BLOCK_BYTES // 2)


def similarity(pairs: DataFrame, weight: str = "plain") -> DataFrame:
    """(a, b, similarity) of rows (a, b, text_a, text_b): exact Jaccard similarity of sets or multisets of shingles."""

    def task(batches):
        powers = ts.Powers()
        for batch in batches:
            for rows in ts.pieces(batch, ("text_a", "text_b"), limit=ts.BLOCK_BYTES // 2, rows=500):
                n = rows.num_rows
                (ta, sa, wa), (tb, sb, wb) = (shingles(rows.column(c), powers) for c in ("text_a", "text_b"))
                ka, kb = ((t.astype(np.uint64) << _ID) | s for t, s in ((ta, sa), (tb, sb)))
                spot = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
                same = kb[spot] == ka if len(kb) else np.zeros(len(ka), bool)
                at = ta[same]
                if weight != "count":
                    wa, wb = np.ones(len(wa), np.int64), np.ones(len(wb), np.int64)
                total = lambda t, w: np.bincount(t, weights=w, minlength=n).astype(np.float64)
                shared = total(at, np.minimum(wa[same], wb[spot[same]]) if same.any() else np.zeros(len(at)))
                out = shared / np.maximum(total(ta, wa) + total(tb, wb) - shared, 1)
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(out)], ["a", "b", "similarity"])

    return ts.modest_batches(pairs.select("a", "b", "text_a", "text_b")).mapInArrow(task, "a bigint, b bigint, similarity double")


def propose(met: DataFrame) -> DataFrame:
    """(p, q): for nodes (bucket, rep, size, company, sign) the best leader of every bucket they are in."""
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = met.select("bucket", F.pmod(F.xxhash64("rep", "bucket"), chunks).cast("int").alias("chunk"), "rep", "company", "sign")
    first = (met.where(F.col("size") > CHUNK).groupBy("bucket", "size").agg(F.max_by(F.struct("rep", "company", "sign"), F.struct("company", -F.col("rep"))).alias("r"))
             .select("bucket", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "r.*"))
    rows = dealt.unionByName(first.withColumn("company", F.lit(1 << 62)))

    def task(batches):
        here, led, n = None, np.zeros((16, COORDINATES), np.uint16), 0
        reps = np.zeros(16, np.int64)
        for batch in batches:
            found = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk")))
            signs = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column("sign")]
            for key, rep, sign in zip(keys, batch.column("rep").to_pylist(), signs):
                if key != here:
                    here, n = key, 0
                if n:
                    agree = (led[:n] == sign).sum(axis=1)
                    best = int(agree.argmax())
                    if agree[best] >= ASK * COORDINATES:
                        found.append((rep, int(reps[best])))
                    if agree[best] >= SURE * COORDINATES:
                        continue
                if n == len(led):
                    led, reps = (np.concatenate((x, np.zeros_like(x))) for x in (led, reps))
                led[n], reps[n], n = sign, rep, n + 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["p", "q"])

    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "bucket", "chunk").sortWithinPartitions("bucket", "chunk", F.desc("company"), "rep")
    return ordered.mapInArrow(task, "p bigint, q bigint").where("p != q").distinct()


def _agreement(signs: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """How many coordinates of each row equal those of one row; rows are padded to 128 equal coordinates."""
    eights = (signs == sign).view(np.uint64).sum(axis=1, dtype=np.uint64)  # each byte counts up to 16
    return ((eights * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64) - (128 - COORDINATES)


def elements(texts: DataFrame, weight: str = "plain") -> DataFrame:
    """(rep, shingles) of rows (rep, text): the sorted shingles as numbers; of multisets the k-th of equal ones has a number of its own."""
    def make():
        powers = ts.Powers()

        def one(rows):
            text, shingle, times = shingles(rows.column("text"), powers)
            if weight == "count":
                text, shingle, repeat = (np.repeat(x, times) for x in (text, shingle, times))
                nth = np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)
                shingle = np.where(nth > 0, ts.mix(shingle + nth.astype(np.uint64), 9) >> np.uint64(12), shingle)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=rows.num_rows))))
            return pa.RecordBatch.from_arrays([rows.column("rep"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(shingle.astype(np.int64)))],
                                              ["rep", "shingles"])
        return one

    return ts.map_texts(texts.select("rep", "text"), make, "rep bigint, shingles array<bigint>", limit=ts.BLOCK_BYTES // 2)


def _settle(bucket: int, split: int, rep, root, buckets, signs, flat, ends, least: float):
    """(a, b, similarity) of links that join components, among the nodes of one block; pairs are taken between the first
    `split` nodes and those behind them, or among all if `split` is 0."""
    n = len(rep)
    label = np.unique(root, return_inverse=True)[1]
    begins = np.concatenate(([0], ends[:-1]))
    size = ends - begins
    ids = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    band = int(np.flatnonzero(buckets[0] == bucket)[0])
    for i in range(split or n):
        start = split or i + 1
        apart = (label[start:] != label[i]) & (size[start:] >= least * size[i] - 1e-9) & (size[i] >= least * size[start:] - 1e-9)
        some = np.flatnonzero(apart) + start
        agree = _agreement(signs[some], signs[i])
        some, agree = some[agree >= ASK * COORDINATES], agree[agree >= ASK * COORDINATES]
        first = (buckets[some] == buckets[i]).argmax(axis=1) == band  # the first bucket they share
        some = some[first][np.argsort(-agree[first], kind="stable")]
        if not len(some):
            continue
        mark[ids[begins[i]:ends[i]]] = True
        lot = 8
        while len(some):
            now, some = some[:lot], some[lot:]
            lot = min(4 * lot, 4096)
            at = np.repeat(begins[now] - np.cumsum(size[now]) + size[now], size[now]) + np.arange(int(size[now].sum()))
            shared = np.add.reduceat(mark[ids[at]].astype(np.int64), np.cumsum(size[now]) - size[now])
            similar = shared / (size[now] + size[i] - shared)
            for j in np.flatnonzero(similar >= least):
                if label[now[j]] != label[i]:
                    label[label == label[now[j]]] = label[i]
                    yield int(rep[i]), int(rep[now[j]]), float(similar[j])
            some = some[label[some] != label[i]]
        mark[ids[begins[i]:ends[i]]] = False


def settled(met: DataFrame, nodes: DataFrame, texts: DataFrame, roots: DataFrame, least: float = 0.8, weight: str = "plain") -> DataFrame:
    """(a, b, similarity): links between nodes of different roots, enough to join all that a bucket's links join.

    met: (rep, bucket); nodes: (rep, sign, buckets, n); texts: (rep, text); roots: (node, root).  Nodes of a bucket's largest
    component stand apart from the others, as they need not meet each other."""
    at = roots.select(F.col("node").alias("rep"), "root")
    state = nodes.join(at, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = stored(met.join(state.select("rep", "root", "n"), "rep"))
    of_root = placed.groupBy("bucket", "root").agg(F.sum("n").alias("n"))
    shape = of_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    chunks = lambda n: F.ceil(n / CHUNK_SHINGLES).cast("int")
    whole = F.col("all") <= CHUNK_SHINGLES
    shape = shape.select("bucket", F.col("main.root").alias("main"), F.when(whole, 1).otherwise(chunks(F.col("all") - F.col("main.n"))).alias("others"),
                         F.when(whole, 0).otherwise(chunks(F.col("main.n"))).alias("mains"))
    spread = F.xxhash64("rep", "bucket")
    of_main = (F.col("root") == F.col("main")) & (F.col("mains") > 0)
    chunk = F.when(of_main, F.col("others") + F.pmod(spread, F.col("mains"))).otherwise(F.pmod(spread, F.col("others"))).cast("int")
    dealt = stored(placed.join(shape, "bucket").withColumn("chunk", chunk).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("others") + F.when(of_main, 0).otherwise(F.col("mains")) - 1)))
        .select("bucket", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "rep", "root"))
    wanted = dealt.select("rep").distinct()
    known = nodes.join(elements(texts.join(wanted, "rep", "left_semi"), weight), "rep").select("rep", "sign", "buckets", "shingles")
    rows = dealt.join(known, "rep")

    def task(batches):
        here, block = None, []

        def joined():
            if len({b[1] for b in block}) < 2:
                return
            _, x, y = here
            rep, root = (np.array([b[k] for b in block], np.int64) for k in (0, 1))
            wide = np.zeros((len(block), 128), np.uint16)
            wide[:, :COORDINATES] = np.frombuffer(b"".join(b[3] for b in block), np.uint16).reshape(-1, COORDINATES)
            flat, ends = np.concatenate([b[5] for b in block]), np.cumsum([len(b[5]) for b in block])
            split = 0 if x == y else sum(b[2] == x for b in block)
            if x != y and split in (0, len(block)):
                return
            yield from _settle(here[0], split, rep, root, np.stack([b[4] for b in block]), wide, flat, ends, least)

        def links():
            found = list(joined())
            return [pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], ["a", "b", "similarity"])
                    for a, b, c in [zip(*found)]] if found else []

        def lists(column):
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "x", "y")))
            columns = [batch.column(c).to_pylist() for c in ("rep", "root", "chunk", "sign")]
            for key, *row in zip(keys, *columns, lists(batch.column("buckets")), lists(batch.column("shingles"))):
                if key != here:
                    yield from links()
                    here, block = key, []
                block.append(row)
        yield from links()

    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "chunk", "rep")
    return ts.modest_batches(ordered).mapInArrow(task, "a bigint, b bigint, similarity double")


def links(docs: DataFrame, nodes: DataFrame, least: float = 0.8, weight: str = "plain") -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) of verified links between nodes (doc_id, content, buckets, sign, n), and (node, root) of what they join."""
    spread = nodes.select(F.col("doc_id").alias("rep"), F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stored(spread.join(shared, "bucket").distinct())
    company = met.groupBy("rep").agg(F.sum("size").alias("company"))
    signs = nodes.select(F.col("doc_id").alias("rep"), "content", "sign", "buckets", "n").join(company, "rep")
    signs = stored(signs.dropDuplicates(["rep"]))
    content = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content")
    wanted = signs.select(F.col("rep").alias("doc_id"), "content")
    texts = stored(docs.select("doc_id", "text", content).join(wanted, ["doc_id", "content"]).select(F.col("doc_id").alias("rep"), "text").dropDuplicates(["rep"]))
    side = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}"))
    proposed = propose(met.join(signs.select("rep", "company", "sign"), "rep"))
    pairs = proposed.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    good = stored(similarity(pairs.join(side("a"), "a").join(side("b"), "b"), weight).where(F.col("similarity") >= least))
    rest = stored(settled(met.select("rep", "bucket"), signs.select("rep", "sign", "buckets", "n"), texts, components(good), least, weight))
    good = good.unionByName(rest)
    return good, components(good)


def classes(docs: DataFrame, least: float = 0.8, weight: str = "plain") -> DataFrame:
    """(doc_id, class_id) of every row: the smallest id among all documents that hang together."""
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = stored(sketch(given, weight))
    reps = rows.where("doc_id is not null").groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    nodes = rows.join(reps, ["content", "doc_id"]).where(F.size("buckets") > 0)
    _, roots = links(given, nodes, least, weight)
    named = reps.join(roots, F.col("doc_id") == F.col("node"), "left").select("content", F.coalesce("root", "doc_id").alias("class_id"))
    return rows.select("doc_id", "content").join(named, "content", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))
