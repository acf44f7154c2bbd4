"""Source divergence audit by chunk factorization.

Text is cut at white space into chunks. Each block of documents counts its distinct chunks (occurrences and
documents by language and source), Spark adds the blocks' counts, and each globally distinct chunk is
tokenized once; its terms are then joined back to the counts. No row of the shuffles stands for a word of a text.

A language keeps the terms of at least MIN_DOCS of its documents. A document counts once for a chunk, so a term with a chunk
in that many documents is kept, and one whose chunks' documents add up to fewer is not. Only for terms between (each chunk
rare, their sum not) do documents have to be told apart: their chunks go into a bit filter of fixed size, a second pass over the texts
lets the chunks through that it may hold, and an exact join with distinct (document, term) pairs decides. A full filter lets
more rows into that join and changes no result.

Divergences of pairs of sources are sums over all kept terms, those that neither source has included. Terms of a language are
dealt into buckets; a bucket is one matrix of sources by terms. It gives one number for each pair of sources, which Spark adds up, and
the terms of each source that may be among its first. All numbers are whole; products that may not fit a long are Python's.

Null texts, languages and sources count as ''. Each row is a document of its own, whether its doc_id repeats or is null. A group without terms has
pairs of value from the kept terms of its language, or 0 if there are none. Ties rank by item in UTF-8 order. An empty table has an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import bucketed, materialise, read
from .words import chunks, mix, release, split_words, text_bytes, word_hashes

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term is in.
MIN_DOCS = 10
#: Ranks of the part `term`.
RANKS = 10
#: The unit of p.
UNIT = 1_000_000_000
#: Text bytes whose chunks are counted at once; kept terms of a bucket, about; bits of the filter.
BLOCK, BUCKET, BITS = 8 << 20, 1024, 1 << 27

COUNTS = "lang string, source string, chunk string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct chunks of each block of documents by language and source, with occurrences and documents."""
    for batch in batches:
        langs, sources, texts = batch.columns
        for a, b in chunks(texts, BLOCK):
            words = pc.ascii_split_whitespace(texts.slice(a, b - a).cast(pa.large_string()))
            doc, coded = pc.list_parent_indices(words).to_numpy(), words.flatten().dictionary_encode()
            kinds, width = coded.dictionary, max(1, len(coded.dictionary))
            at = doc * width + coded.indices.to_numpy()
            del words, doc, coded
            at, n = np.unique(at, return_counts=True)
            of, groups = [], {}
            for pair in zip(langs.slice(a, b - a).to_pylist(), sources.slice(a, b - a).to_pylist(), strict=True):
                of.append(groups.setdefault(pair, len(groups)))
            key, where = np.unique(np.array(of, np.int64)[at // width] * width + at % width, return_inverse=True)
            n, docs = np.bincount(where, n, len(key)).astype(np.int64), np.bincount(where, minlength=len(key))
            del at, where
            group, chunk = key // width, kinds.take(pa.array(key % width))
            some = np.array(pc.not_equal(chunk, ""), bool)
            names = list(groups)
            out = [pa.array([p[i] for p in names], pa.string()).take(pa.array(group)) for i in (0, 1)]
            out = pa.RecordBatch.from_arrays([*out, chunk.cast(pa.string()), pa.array(n), pa.array(docs)], [c.split()[0] for c in COUNTS.split(", ")])
            yield out.filter(pa.array(some))
            del key, n, docs, group, chunk, some, out, kinds
            release()


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    return (h % np.uint64(BITS)).astype(np.int64), (mix(h) % np.uint64(BITS)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = np.concatenate(_places(word_hashes(split_words(*text_bytes(batch.column(0))))))
        yield pa.RecordBatch.from_arrays([pa.array(places // 64), pa.array((np.uint64(1) << (places % 64).astype(np.uint64)).view(np.int64))], ["place", "bits"])


def bit_filter(rare: DataFrame) -> np.ndarray:
    """The filter of the column `chunk`: BITS bits, whatever the number of rows."""
    found = rare.select("chunk").distinct().mapInArrow(_bits, "place long, bits long").groupBy("place").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[found["place"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def _through(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    hit = np.ones(len(words), bool)
    for place in _places(words):
        hit &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return hit


def documents_of(docs: DataFrame, rare: DataFrame) -> DataFrame:
    """(lang, term, docs): documents of each term, counted by its rows of rare(lang, chunk, term)."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(rare))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, texts = batch.columns
            for a, b in chunks(texts):
                w = split_words(*text_bytes(texts.slice(a, b - a)))
                at = np.flatnonzero(_through(word_hashes(w), bits.value))
                chunk = pa.array([bytes(w.buf[s:e]).decode() for s, e in zip(w.start[at], w.end[at], strict=True)], pa.string())
                row = pa.array(w.doc[at] + a)
                yield pa.RecordBatch.from_arrays([ids.take(row), langs.take(row), chunk], ["id", "lang", "chunk"])
                del w, at, chunk, row
                release()

    found = docs.select(F.monotonically_increasing_id().alias("id"), "lang", "text").mapInArrow(hits, "id long, lang string, chunk string")
    return found.join(rare, ["lang", "chunk"]).select("id", "lang", "term").distinct().groupBy("lang", "term").agg(F.count("*").alias("docs"))


def _rates(count: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """p of counts among `total` occurrences of `kinds` kept terms, in whole units."""
    wide = count if count.max(initial=0) < (1 << 62) // UNIT else count.astype(object)
    return (1 + UNIT * (wide + 2) // (total + 2 * kinds)).astype(np.int64)


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _parts(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Of one bucket of terms: sums for each pair of sources, and the terms of each source that may be among its first RANKS."""
    names, kinds = groups["source"].combine_chunks(), groups["kinds"][0].as_py()
    coded = terms["term"].combine_chunks().dictionary_encode()
    row = pc.index_in(terms["source"], names).to_numpy(zero_copy_only=False)
    count = np.zeros((len(names), len(coded.dictionary)), np.int64)
    count[row, coded.indices.to_numpy()] = terms["count"].to_numpy()
    total = groups["total"].to_numpy()
    # without kept terms there is no column either
    p, q = _rates(count, total[:, None], max(1, kinds)), _rates(count.sum(0), total.sum(), max(1, kinds))
    value = np.stack([_gain(own, p).sum(1) for own in p])
    i, j = np.nonzero(~np.eye(len(names), dtype=bool))
    pairs = [names.take(pa.array(i)), pa.array(["pair"]).take(pa.array(np.zeros(len(i), int))), names.take(pa.array(j)), pa.array(value[i, j])]
    order = np.empty(len(coded.dictionary), np.int64)
    order[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(order))
    at, of = [], []
    for s in range(len(names)):
        high = np.flatnonzero((count[s] > 0) & (p[s] > q))
        of.append(high[np.lexsort((order[high], -_gain(p[s], q)[high]))][:RANKS])
        at.append(np.full(len(of[-1]), s))
    at, of = np.concatenate(at), np.concatenate(of)
    best = [names.take(pa.array(at)), pa.array(["term"]).take(pa.array(np.zeros(len(at), int))), coded.dictionary.take(pa.array(of)), pa.array(_gain(p[at, of], q[of]))]
    columns = [pa.concat_arrays(c) for c in zip(pairs, best, strict=True)]
    return pa.table([pa.array([key[0].as_py()] * len(columns[0]), pa.string()), *columns], names=["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of docs(text, lang, source)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # blocks have counted already, so rows go to their partition by chunk as they are; all that follows by chunk stays in it
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = docs.mapInArrow(_count, COUNTS).repartition(parts, "chunk").groupBy("lang", "source", "chunk").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = bucketed(counts, parts, "chunk")
    found = F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), F.lit(0))
    terms = counts.select("chunk").distinct().select("chunk", F.explode(found).alias("term")).groupBy("chunk", "term").agg(F.count("*").alias("times"))
    terms = bucketed(terms, parts, "chunk")

    spread = counts.groupBy("lang", "chunk").agg(F.sum("docs").alias("docs")).join(terms, "chunk")
    spread = materialise(spread.groupBy("lang", "term").agg(F.max("docs").alias("most"), F.sum("docs").alias("all")).where(F.col("all") >= MIN_DOCS))
    unsure = spread.where(F.col("most") < MIN_DOCS).select("lang", "term")
    rare = materialise(terms.join(unsure, "term").select("lang", "chunk", "term"))
    kept = spread.where(F.col("most") >= MIN_DOCS).select("lang", "term")
    kept = materialise(kept.union(documents_of(docs, rare).where(F.col("docs") >= MIN_DOCS).select("lang", "term")))

    kinds = materialise(kept.groupBy("lang").agg(F.count("*").alias("kinds")))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("kinds") / BUCKET)).cast("int")
    dealt = kept.join(kinds, "lang").select(F.col("lang").alias("own"), "term", F.pmod(F.xxhash64("term"), buckets).cast("int").alias("bucket"))
    useful = terms.join(dealt, "term").repartition(parts, "chunk")
    # the language is no key of this join, as both sides lie by chunk alone
    freq = counts.join(useful, "chunk").where(F.array_contains(F.array("own"), F.col("lang"))).repartition(parts, "lang", "bucket")
    freq = bucketed(freq.groupBy("lang", "bucket", "source", "term").agg(F.sum(F.col("n") * F.col("times")).alias("count")), parts, "lang", "bucket")
    sizes = freq.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(kinds, "lang", "left")
    groups = materialise(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "kinds")]))

    every = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), buckets - 1)))
    found = freq.groupBy("lang", "bucket").cogroup(every.groupBy("lang", "bucket")).applyInArrow(_parts, "lang string, source string, part string, item string, value long")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    by_part = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(by_part)).where((F.col("part") == "pair") | (F.col("rank") <= RANKS)).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
freq AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d)
    LEFT JOIN kinds USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM freq GROUP BY ALL) USING (lang, source) GROUP BY ALL),
rates AS (SELECT g.lang, g.source, k.term, coalesce(f.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(f.c, 0) + 2)) // (g.n + 2 * g.v) AS p
    FROM grp g JOIN kept k USING (lang) LEFT JOIN freq f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
usual AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 2)) // (any_value(t.n) + 2 * any_value(t.v)) AS q
    FROM freq JOIN (SELECT lang, sum(n) AS n, max(v) AS v FROM grp GROUP BY lang) t USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0) AS value FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM rates JOIN usual USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))
