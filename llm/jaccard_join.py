"""N-gram Jaccard join: connected components of documents whose shingle sets are similar, exactly.

Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of distinct shingles of
so many words, by default 85 and 4
(fewer words: the whole sequence is one shingle; no words: an empty set, linked with nothing).

Between unrelated texts every Jaccard distance is about 1, so regions around pivots alone would
copy each document into each region. Regions are therefore seeded first, without losing a link:

1. Equal sets collapse into one node, whatever number of documents has them.
2. Linked sets share shingles among the first of each set in any one order; the order takes long
   shingles first and shingles frequent in a sample last. Sets that meet on as many shingles of at
   most CAP sets each as linked ones must are paired. Sets whose common shingles may all be more frequent than that are
   cut into more hash classes than linked sets of their size can differ in, so that linked sets have whole classes, large ones among them, in
   common; each sends a key for each class, as many as its size asks for, however many sets share them. Equal classes meet by aggregation.
3. Counts by hash class are a contraction of the metric: pairs whose counts are too far apart to
   be linked go. Connected candidates form a region.
4. Inside a region pivots are compared with everything, the most central first; what links to a
   pivot shares its component, and of the rest the triangle inequality leaves a window of distances
   to compare in. Regions of more than REGION sets are dealt into chunks: the pivots go to each
   chunk, then the sets outside the main component do, and no chunk holds more than it was dealt.

Only links of a spanning forest leave a task, never all pairs of a group. Words are
`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; shingles are compared by 64-bit hashes, sets by their size
and two sums of 64 bits. Null and empty texts have the empty set. Each row gives one row: a doc_id that rows with several texts
share is a document of each of their sets; a row without one is linked with nothing but the rows of its set. An empty table has an
empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import components, materialise, read
from .words import U, chunks, mix, ngrams, split_words, text_bytes, word_hashes



class Rule(NamedTuple):
    """Words of a shingle, and how similar linked sets are at least."""

    shingle: int = 4
    percent: int = 85


RULE = Rule()
#: Sets that may meet on one shingle and be paired there; pairs that a task has in memory at once.
CAP, PAIRS = 48, 1 << 18
#: One document in SAMPLE is looked at for frequent shingles: at most MAX_FREQUENT of those in FREQUENT of them or more.
SAMPLE, FREQUENT, MAX_FREQUENT = 16, 1 / 2000, 1 << 18
#: Shingles from which on a class is large; the sizes of a level of classes differ by the power LEVEL of what linked sets may differ by.
HEAVY, LEVEL = 3, 2
#: Hash classes whose counts are compared.
CLASSES = 64
#: Sets that a task compares among each other; pivots of a larger region; outside sets that go to a chunk at once.
REGION, PIVOTS, SLICE = 512, 8, 64


def least_common(n, rule: Rule):
    """Shingles that a set of n has in common with any set it links to."""
    return -(-rule.percent * n // 100)


def slack(n):
    return n // 64 + 2


def sets(texts: pa.Array, rule: Rule = RULE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, shingle, chars, n): each row's distinct shingles from first[i], sorted, with their letters; n: their number."""
    w = split_words(*text_bytes(texts))
    rows = len(w.offsets) - 1
    h, size = word_hashes(w, lower=True), w.end - w.start
    count = np.diff(w.first)
    at = np.flatnonzero(w.doc[: max(0, len(h) - rule.shingle + 1)] == w.doc[rule.shingle - 1 :]) if len(h) >= rule.shingle else np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(size)))
    g, row, chars = [ngrams(h, rule.shingle)[at] if len(at) else np.zeros(0, U)], [w.doc[at]], [total[at + rule.shingle] - total[at] if len(at) else at]
    for m in range(1, rule.shingle):
        short = w.first[:-1][count == m]
        g.append(ngrams(h, m, m)[short] if len(short) else np.zeros(0, U))
        row.append(np.flatnonzero(count == m))
        chars.append(total[short + m] - total[short])
    g, row, chars = np.concatenate(g), np.concatenate(row), np.concatenate(chars)
    order = np.lexsort((g, row))
    g, row, chars = g[order], row[order], chars[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    n = np.bincount(row[new], minlength=rows)
    return np.concatenate(([0], np.cumsum(n)))[:-1], g[new], chars[new], n


def _key(first, g, n, seed: int) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(g ^ U(seed)))))
    return (total[first + n] - total[first]).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], rule: Rule, column: int = 1):
    for batch in batches:
        for a, b in chunks(batch.column(column)):
            part = batch.slice(a, b - a)
            yield part, sets(part.column(column), rule)


KEYS = "doc_id long, text_hash long, n long, a long, b long, counts binary"


def _keys(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for part, (first, g, _, n) in _parts(batches, rule):
        row = np.repeat(np.arange(len(n)), n)
        counts = np.bincount(row * CLASSES + (g >> U(32) & U(CLASSES - 1)).astype(np.int64), minlength=len(n) * CLASSES).astype(np.uint32).reshape(len(n), CLASSES)
        columns = [part.column(0), part.column(2), pa.array(n), pa.array(_key(first, g, n, 0x1234567)), pa.array(_key(first, g, n, 0x89ABCDEF)), pa.array([x.tobytes() for x in counts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "a", "b", "counts"])


def _sampled(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for _, (_, g, _, _) in _parts(batches, rule):
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], ["g"])


def frequent_shingles(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Sorted shingles that many sampled documents have; they only come last in the order."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    least = max(6, sample.count() * FREQUENT)
    found = sample.mapInArrow(lambda rows: _sampled(rows, rule), "g long").groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "g").limit(MAX_FREQUENT)
    return np.sort(np.array([r.g for r in found.select("g").toLocalIterator()], np.int64))


def _first_shingles(frequent, rule: Rule):
    """Of each set, the first shingles in order (frequent ones, which come last, are not named but counted in `hot`, on the set's first row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for _, (first, g, chars, n) in _parts(batches, rule):
            row = np.repeat(np.arange(len(n)), n)
            value = g.view(np.int64)
            last = often[np.minimum(np.searchsorted(often, value), len(often) - 1)] == value if len(often) else np.zeros(len(g), bool)
            order = np.lexsort((g, -chars, last, row))
            rank = np.arange(len(g)) - first[row]
            length = np.minimum(n, n - least_common(n, rule) + 1 + slack(n))
            named = (rank < length[row]) & ~last[order]
            rest = length - np.bincount(row[named], minlength=len(n))
            key = _key(first, g, n, 0x1234567)
            some = np.flatnonzero(rest > 0)
            shingle = np.concatenate((value[order][named], key[some]))
            hot = np.concatenate((np.zeros(named.sum(), np.int64), rest[some]))
            who = np.concatenate((row[named], some))
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(key[who]), pa.array(n[who]), pa.array(hot)], ["g", "a", "n", "hot"])

    return run


def _pairs(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Of small groups, the pairs whose sizes allow a link, and how many named shingles a linked pair shares at least."""
    for batch in batches:
        who = batch.column(0)
        size = pa.compute.list_value_length(who).to_numpy()
        begin = np.cumsum(size) - size
        a, n, hot = (who.flatten().field(c).to_numpy() for c in ("a", "n", "hot"))
        for k in np.unique(size):
            i, j = np.triu_indices(k, 1)
            same = begin[size == k]
            step = max(1, PAIRS // max(1, len(i)))
            for at in range(0, len(same), step):
                x, y = ((same[at : at + step, None] + side).ravel() for side in (i, j))
                fine = rule.percent * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y])
                x, y = x[fine], y[fine]
                need = np.minimum(1 + slack(np.minimum(n[x], n[y])), least_common(np.maximum(n[x], n[y]), rule)) - np.minimum(hot[x], hot[y])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[x], a[y])), pa.array(np.maximum(a[x], a[y])), pa.array(need)], ["x", "y", "need"])


def most_apart(n, rule: Rule):
    """At most so many shingles are in just one of two linked sets with n shingles together."""
    return (100 - rule.percent) * n // (100 + rule.percent)


def _near(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        counts = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, CLASSES).astype(np.int64) for i in (2, 3)]
        apart = np.abs(counts[0] - counts[1]).sum(1)
        yield batch.select([0, 1]).filter(pa.array(apart <= most_apart(counts[0].sum(1) + counts[1].sum(1), rule)))


def size_levels(largest: int, rule: Rule) -> np.ndarray:
    """The sizes at which levels begin: sizes of linked sets are in the same level or in neighbouring ones."""
    begins = [1]
    while begins[-1] <= largest:
        begins.append(int(begins[-1] * (100 / rule.percent) ** LEVEL) + 1)
    return np.array(begins)


def class_keys(first: np.ndarray, g: np.ndarray, n: np.ndarray, rule: Rule, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each set a key for the content of each of its classes, in its own size level, and in the next one where a linked set may be there.

    Linked sets differ in `apart` classes at most and have `spare` + 1 or more alike. A set with at most
    `spare` classes of under HEAVY shingles therefore leaves those out: it has a large class in common with each set it links to.
    """
    begins = size_levels(int(n.max(initial=1)) * 200 // rule.percent, rule)
    apart = most_apart(2 * (begins[1:] - 1), rule)
    spare = apart // 8 + 3
    many = apart + 1 + spare
    own = mix(g ^ U(0x51ED270B + seed))
    content = mix(own)
    row = np.repeat(np.arange(len(n)), n)
    level = np.searchsorted(begins, n, "right") - 1
    reach = np.searchsorted(begins, n * 100 // rule.percent, "right") - 1
    out = []
    for here, some in ((level, n > 0), (level + 1, (n > 0) & (reach > level))):
        if not some.any():
            continue
        m = np.where(some, many[np.minimum(here, len(many) - 1)], 0)
        offset = np.cumsum(m) - m
        entry = some[row]
        at = offset[row[entry]] + ((own[entry] >> U(33)) % m[row[entry]].astype(U)).astype(np.int64)
        sums, size = np.zeros(m.sum(), U), np.bincount(at, minlength=m.sum())
        np.add.at(sums, at, content[entry])
        who = np.repeat(np.arange(len(n)), m)
        light = m - np.bincount(who, size >= HEAVY, len(n)).astype(np.int64)
        empty = m - np.bincount(who, size > 0, len(n)).astype(np.int64)
        limit = np.where(some, spare[np.minimum(here, len(spare) - 1)], 0)
        named = np.flatnonzero(size >= np.where(light <= limit, HEAVY, 1)[who])
        tag = (named - offset[who[named]]).astype(U) * U(0xA0761D6478BD642F) + here[who[named]].astype(U) * U(0x9E3779B97F4A7C15)
        out.append((who[named], mix(sums[named] + tag)))
        bare = np.flatnonzero(some & (empty > limit))  # such sets also meet each other: what they have in common may be empty classes
        out.append((bare, mix(here[bare].astype(U) + U(0xE7037ED1A0B428DB))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _class_keys(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for part, (first, g, _, n) in _parts(batches, rule):
        row, key = class_keys(first, g, n, rule)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(pa.array(row))], ["key", "a"])


def forest(first: np.ndarray, g: np.ndarray, n: np.ndarray, queries: np.ndarray | None = None, rule: Rule = RULE) -> list[tuple[int, int]]:
    """Links that connect all linked sets among those of a task; with `queries`, those between a query and any set only."""
    k = len(n)
    item = np.unique(g, return_inverse=True)[1]
    often = np.bincount(item)
    order = np.argsort(item, kind="stable")
    holders, begin = np.repeat(np.arange(k), n)[order], np.cumsum(often) - often
    central = np.zeros(k)
    if len(use := first[n > 0]):
        central[n > 0] = np.add.reduceat(often[item], use) / n[n > 0]
    label, links, base = np.arange(k), [], None
    for q in sorted(range(k) if queries is None else queries.tolist(), key=lambda i: -central[i]):
        other = (label != label[q]) & (n > 0) & (rule.percent * np.maximum(n, n[q]) <= 100 * np.minimum(n, n[q]))
        if base is not None:
            other &= np.abs(base - base[q]) <= 1 - rule.percent / 100 + 1e-9
        if not n[q] or not other.any():
            continue
        mine = item[first[q] : first[q] + n[q]]
        common = np.zeros(k, np.int64)
        for part in np.array_split(mine, 1 + int(often[mine].sum()) // PAIRS):
            size = often[part]
            common += np.bincount(holders[np.repeat(begin[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())], minlength=k)
        union = n + n[q] - common
        if base is None:
            base = 1 - common / np.maximum(union, 1)
        for x in np.flatnonzero(other & (100 * common >= rule.percent * union)):
            if label[x] != label[q]:
                links.append((q, int(x)))
                label[label == label[x]] = label[q]
    return links


def _solve(table: pa.Table, rule: Rule) -> pa.Table:
    """Links within a chunk: of all its sets, or of the queries that were sent to it."""
    ids, query = table["a"].to_numpy(), table["query"].to_numpy(zero_copy_only=False).astype(bool)
    first, g, _, n = sets(table["text"], rule)
    found = forest(first, g, n, np.flatnonzero(query) if query.any() else None, rule)
    return pa.table({"x": pa.array([int(ids[a]) for a, _ in found], pa.int64()), "y": pa.array([int(ids[b]) for _, b in found], pa.int64())})


def candidates(docs: DataFrame, keys: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(x, y), pairs of nodes near enough to be linked; and (a), nodes whose links may be missing there as their common shingles are all frequent."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, rule))
    rows = docs.mapInArrow(_first_shingles(frequent, rule), "g long, a long, n long, hot long").repartition("g").distinct()
    met = rows.withColumn("sets", F.count("*").over(W.partitionBy("g")))
    met = materialise(met.where("sets > 1 OR hot > 0"))
    often = F.when(F.col("hot") > 0, F.col("hot")).otherwise(1)
    hot = materialise(met.where(f"hot > 0 OR sets > {CAP}").groupBy("a", "n").agg(F.sum(often).alias("hot")))
    small = met.where(f"hot = 0 AND sets <= {CAP}").select("g", "a", "n").join(hot.select("a", F.col("hot").alias("_hot")), "a", "left")
    small = small.groupBy("g").agg(F.collect_list(F.struct("a", "n", F.coalesce("_hot", F.lit(0)).alias("hot"))).alias("who")).select("who")
    pairs = small.mapInArrow(lambda rows: _pairs(rows, rule), "x long, y long, need long").groupBy("x", "y").agg(F.count("*").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("x", "y")
    counts = keys.groupBy("a").agg(F.first("counts").alias("counts"))
    pairs = pairs.join(counts.withColumnsRenamed({"a": "x", "counts": "cx"}), "x").join(counts.withColumnsRenamed({"a": "y", "counts": "cy"}), "y")
    near = pairs.select("x", "y", "cx", "cy").mapInArrow(lambda rows: _near(rows, rule), "x long, y long")

    common = F.ceil(F.col("n") * rule.percent / F.lit(100))
    hot = hot.where(F.col("hot") > F.least(F.floor(common / 64) + 2, common - 1)).select("a")
    return materialise(near), hot


def similar(docs: DataFrame, keys: DataFrame, rule: Rule) -> DataFrame:
    """(x, y): links between different nodes that connect all linked ones."""
    near, hot = candidates(docs, keys, rule)
    # one row stands for all of its set: by doc_id and text, as rows may share a doc_id
    named = keys.groupBy("a").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_hash", "doc_id").alias("text_hash"))
    alike = near.select(F.col("x").alias("a")).union(near.select("y")).union(hot).distinct()
    texts = materialise(docs.join(named.join(alike, "a"), ["doc_id", "text_hash"]).select("a", "text"))

    classes = texts.join(hot, "a", "left_semi").select("a", "text").mapInArrow(lambda rows: _class_keys(rows, rule), "key long, a long")
    stars = classes.groupBy("key").agg(F.min("a").alias("y"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = near.union(classes.join(stars, "key").where("a <> y").select("a", "y")).distinct()
    region = components(edges, "x", "y")
    size = region.groupBy("component").agg(F.ceil(F.count("*") / REGION).cast("int").alias("chunks"))
    dealt = texts.join(region.join(size, "component"), F.col("a") == F.col("node")).drop("node")
    dealt = materialise(dealt.withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int")))
    links = dealt.withColumn("query", F.lit(False)).select("component", "chunk", "a", "text", "query").groupBy("component", "chunk").applyInArrow(lambda table: _solve(table, rule), "x long, y long")

    large = dealt.where("chunks > 1")
    if large.isEmpty():
        return links
    # Pivots of large regions: the sets that most others met, to every chunk; then all outside the main component.
    degree = edges.select(F.col("x").alias("a")).union(edges.select("y")).groupBy("a").agg(F.count("*").alias("degree"))
    best = large.join(degree, "a").groupBy("component", F.pmod(F.xxhash64("a"), F.lit(PIVOTS)).alias("k")).agg(F.max(F.struct("degree", "a"))["a"].alias("a"))
    best = large.join(best.select("a"), "a", "left_semi")
    first = materialise(links.union(_sent(large, best, rule)))
    label = components(first, "x", "y").withColumnRenamed("component", "label")
    state = large.select("component", "a").join(label, F.col("a") == F.col("node"), "left").select("component", "a", F.coalesce("label", "a").alias("label"))
    sizes = state.groupBy("component", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("component").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
    outside = state.join(main, "component").where("label <> main").select("a")
    return first.union(_sent(large, large.join(outside, "a", "left_semi"), rule))


def _sent(members: DataFrame, queries: DataFrame, rule: Rule) -> DataFrame:
    """Links between queries and all members of their region, chunk by chunk."""
    queries = queries.withColumn("slice", F.floor(F.pmod(F.xxhash64("a"), F.lit(1 << 30)) / (1 << 30) * F.greatest(F.lit(1.0), F.col("chunks") * F.lit(REGION / SLICE))).cast("int"))
    sent = queries.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).select("component", "chunk", "slice", "a", "text", F.lit(True).alias("query"))
    slices = queries.select("component", "slice").distinct()
    there = members.join(slices, "component").select("component", "chunk", "slice", "a", "text", F.lit(False).alias("query"))
    return sent.union(there).groupBy("component", "chunk", "slice").applyInArrow(lambda table: _solve(table, rule), "x long, y long")


def jaccard_components(docs: DataFrame, shingle: int = RULE.shingle, percent: int = RULE.percent) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    rule = Rule(shingle, percent)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_hash", F.xxhash64("text"))
    keys = materialise(docs.mapInArrow(lambda rows: _keys(rows, rule), KEYS))
    full = keys.where("n > 0")
    label = components(similar(docs.where("doc_id IS NOT NULL"), full.where("doc_id IS NOT NULL"), rule), "x", "y")
    nodes = full.groupBy("n", "a", "b").agg(F.min("doc_id").alias("low")).join(label, F.col("a") == F.col("node"), "left")
    nodes = nodes.select("n", "a", "b", "low", F.coalesce("component", "a").alias("component"), F.col("component").isNotNull().alias("linked"))
    low = nodes.where("linked").groupBy("component").agg(F.min("low").alias("lowest"))
    nodes = nodes.join(low, "component", "left").select("n", "a", "b", F.coalesce("lowest", "low").alias("component_id"))
    return keys.join(nodes, ["n", "a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
