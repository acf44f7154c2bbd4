"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every LENGTH-word window the smallest ANCHOR-word hash, so that two
equal windows always have the same anchor at the same place. All neighbouring windows that share
an anchor form its span, the longest text around the anchor that its windows reach.

1. Documents meet on anchors (one shuffle of three numbers a span). Where a whole span is in a
   document with a smaller doc_id, the match extends over all its windows at once.
2. Of anchors with several different spans, the first document of each span is extended window
   by window both ways, and windows meet by aggregation. Copies of a span collapse into one row
   before this step, so a passage may be in any share of the documents.
3. Matched windows are united per document into maximal runs; their words are removed.

Anchors that a sample of documents says are in very many are dealt out by document into groups of
about GROUP rows; the first document of each span in each group meets the other groups' through an
aggregate. This balances the work and changes no result.

Words are `[^\\x20\\x09-\\x0D]+`; windows and spans are compared by 64-bit hashes next to the
anchor's own. Nulls, empty texts and texts under LENGTH words have no window and lose nothing.
doc_id identifies a row: rows that repeat it are never each other's earlier copy. Rows with a
null doc_id are returned whole. An empty table has an empty result. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import materialise, read
from .words import U, Words, chunks, mix, ngrams, split_words, text_bytes, word_hashes

LENGTH, ANCHOR = 13, 4
#: Anchors of a window.
CHOICE = LENGTH - ANCHOR + 1
#: One document in SAMPLE is looked at for frequent anchors, of which at most MAX_FREQUENT are dealt out.
SAMPLE, MAX_FREQUENT = 64, 1 << 18
#: Rows of an anchor that one task is given.
GROUP = 100_000


class Spans(NamedTuple):
    """row: of the batch; lo: index of the first window's first word; n: windows; window: hashes of all windows by first word."""

    words: Words
    row: np.ndarray
    anchor: np.ndarray
    span: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    window: np.ndarray


def _slide(a: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    size, have = len(a) - width + 1, 1
    while have * 2 <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[:size], a[width - have : width - have + size])


def winnow(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest hash (its lowest 4 bits apart) among each `width` <= 16 neighbours, the leftmost of equal ones."""
    size = len(g) - width + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    at, low = np.arange(len(g)), U(15)
    place = (at & 15).astype(U)
    i = at[:size]
    first = _slide(g & ~low | place, width)
    last = _slide(g & ~low | (low - place), width)
    found = i + ((first & low).astype(np.int64) - i & 15)
    tied = np.flatnonzero(found != i + (15 - (last & low).astype(np.int64) - i & 15))
    if len(tied):
        best = first[tied] >> U(4)
        for j in range(width - 1, -1, -1):
            hit = g[tied + j] >> U(4) == best
            found[tied[hit]] = tied[hit] + j
    return found


def spans(texts: pa.Array) -> Spans:
    w = split_words(*text_bytes(texts))
    h = word_hashes(w)
    g, window = ngrams(h, ANCHOR), ngrams(h, LENGTH, 1)
    if not len(window):
        none = np.zeros(0, np.int64)
        return Spans(w, none, none.astype(U), none.astype(U), none, none, window)
    at = winnow(g, CHOICE)
    own = w.doc[: len(window)] == w.doc[LENGTH - 1 :]
    new = own.copy()
    new[1:] &= ~own[:-1] | (at[1:] != at[:-1])
    lo = np.flatnonzero(new)
    ends = own.copy()
    ends[:-1] &= ~own[1:] | (at[1:] != at[:-1])
    n = np.flatnonzero(ends) - lo + 1
    shape = (n * 16 + at[lo] - lo).astype(U)
    span = mix(window[lo] * U(0xA0761D6478BD642F) + window[lo + n - 1] * U(0xE7037ED1A0B428DB) + shape * U(0x8EBC6AF09C88C6E3))
    return Spans(w, w.doc[lo], mix(g[at[lo]]), span, lo, n, window)


def _seeds(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, groups = frequent.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b in chunks(batch.column(1)):
                s = spans(batch.column(1).slice(a, b - a))
                anchor, doc = s.anchor.view(np.int64), ids[a:b][s.row]
                salt = np.zeros(len(anchor), np.int32)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                    often = np.flatnonzero(hot[at] == anchor)
                    salt[often] = 1 + mix(doc[often].view(U)) % groups[at[often]].astype(U)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(s.span.view(np.int64)), pa.array(doc), pa.array(salt)], ["anchor", "span", "doc_id", "salt"])

    return run


SEED = "anchor long, span long, doc_id long, salt int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the wanted spans of each document, all windows."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for a, b in chunks(batch.column(1)):
            s = spans(batch.column(1).slice(a, b - a))
            wanted = batch.column(2).slice(a, b - a)
            _, found = _matched(s, wanted.flatten().to_numpy(), pa.compute.list_parent_indices(wanted).to_numpy())
            k = np.repeat(found, s.n[found])
            bit = np.arange(len(k)) - np.repeat(np.cumsum(s.n[found]) - s.n[found], s.n[found])
            columns = [s.anchor[k].view(np.int64), s.window[s.lo[k] + bit].view(np.int64), ids[a:b][s.row[k]], s.span[k].view(np.int64), bit.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "window", "doc_id", "span", "bit"])


def _matched(s: Spans, span: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries (row, span): (which entry, which of s) of those of s that have one."""
    key = mix(span.view(U) ^ (row.astype(U) * U(0x9FB21C651E98DF25)))
    order = np.argsort(key)
    mine = mix(s.span ^ (s.row.astype(U) * U(0x9FB21C651E98DF25)))
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = order[np.minimum(np.searchsorted(key[order], mine), len(key) - 1)]
    found = np.flatnonzero(key[at] == mine)
    return at[found], found


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch.column(1)):
            part = batch.slice(a, b - a)
            texts, cover = part.column(1), part.column(2)
            s = spans(texts)
            flat = cover.flatten()
            entry, found = _matched(s, flat.field("span").to_numpy(), pa.compute.list_parent_indices(cover).to_numpy())
            mask = flat.field("mask").to_numpy()[entry]
            step = np.zeros(len(s.words.start) + 1, np.int64)
            for bit in range(CHOICE):
                lo = s.lo[found[(mask >> bit & 1 == 1) & (s.n[found] > bit)]] + bit
                np.add.at(step, lo, 1)
                np.add.at(step, lo + LENGTH, -1)
            gone = np.cumsum(step[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            n, lost = np.diff(s.words.first), total[s.words.first[1:]] - total[s.words.first[:-1]]
            kept, digest = [], []
            buf, off, first = s.words.buf.tobytes(), s.words.offsets, s.words.first
            for i in range(b - a):
                words = buf[off[i] : off[i + 1]].split()
                text = b" ".join(compress(words, (~gone[first[i] : first[i + 1]]).tolist()) if lost[i] else words)
                kept.append(text.decode("utf-8", "replace"))
                digest.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(lost), pa.array(digest), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def frequent_anchors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of more than GROUP rows by a sample, sorted, and the groups to deal each into. Only how work is dealt out depends on them."""
    none = docs.sparkSession.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    found = sample.mapInArrow(_seeds(none), SEED).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > GROUP)
    rows = sorted((r.anchor, -(-r.n * SAMPLE // GROUP)) for r in found.orderBy(F.desc("n"), "anchor").limit(MAX_FREQUENT).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, cover array<struct<span, mask>>): for each document with repeats, the spans and which windows of them a smaller doc_id has."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_anchors(docs))
    seeds = docs.mapInArrow(_seeds(frequent), SEED)
    fine, group = W.partitionBy("anchor", "salt", "span"), W.partitionBy("anchor", "salt")
    met = seeds.repartition("anchor", "salt").withColumn("first", F.min("doc_id").over(fine))
    met = met.withColumns({"low": F.min("doc_id").over(group), "high": F.max("doc_id").over(group), "alike": F.min("span").over(group) == F.max("span").over(group)})
    kind = F.when(F.col("first") < F.col("doc_id"), 0).when(F.col("salt") > 0, 2).when((F.col("low") < F.col("high")) & ~F.col("alike"), 1).otherwise(-1)
    met = materialise(met.withColumn("kind", kind).where("kind >= 0").select("anchor", "span", "doc_id", "kind"))

    often = met.where("kind = 2")
    first = often.groupBy("anchor", "span").agg(F.min("doc_id").alias("first"))
    several = first.groupBy("anchor").agg((F.min("span") != F.max("span")).alias("several"))
    later = often.join(first, ["anchor", "span"]).where("first < doc_id").select("doc_id", "span")
    ones = first.join(several.where("several"), "anchor").select("anchor", "span", F.col("first").alias("doc_id"))

    full = met.where("kind = 0").select("doc_id", "span").union(later).select("doc_id", "span", F.lit(-1).alias("mask"))
    wanted = met.where("kind = 1").select("anchor", "span", "doc_id").union(ones).groupBy("doc_id").agg(F.collect_set("span").alias("wanted"))
    windows = docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_windows, "anchor long, window long, doc_id long, span long, bit int")
    low = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    partial = windows.join(low, ["anchor", "window"]).where("low < doc_id").select("doc_id", "span", F.expr("shiftleft(1, bit)").alias("mask"))
    partial = partial.groupBy("doc_id", "span").agg(F.bit_or("mask").alias("mask"))
    return full.union(partial).groupBy("doc_id").agg(F.collect_list(F.struct("span", "mask")).alias("cover"))


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text (the kept words joined by one space)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    empty = F.lit([]).cast("array<struct<span:long,mask:int>>")
    named = docs.where("doc_id IS NOT NULL")
    both = named.join(matches(named), "doc_id", "left").select("doc_id", "text", F.coalesce("cover", empty).alias("cover"))
    return both.union(docs.where("doc_id IS NULL").select("doc_id", "text", empty)).mapInArrow(_remove, OUT)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).drop("kept_text")
