"""Language-model scoring with a sharded log-frequency Bloom filter.

Counts are quantised on a log scale, and an n-gram of level q enters a filter q times, once for each level
up to its own; a count is read back by probing levels until one is absent. Every unigram and bigram of the training documents is in
the filter. The filter is sharded: the shard of the most frequent unigrams and bigrams has a bounded size and is broadcast; all
other n-grams, singletons included, belong to shards by hash. Documents send their probes, packed into arrays, to these; a shard adds up
the training occurrences among what it gets, builds its filter from them, and answers all probes from it. What each document has of the
shares goes back, packed too. Shards grow in number with the training tokens, not in size, as no n-gram of theirs is frequent.

The head is the tokens of at least a certain count, at most HEAD_TOKENS of them: the unigrams of the broadcast shard, whose exact counts
for the base score are in a broadcast array. It decides where an n-gram is counted, and changes no score but by the filters' false
positives: a bigram is looked up where its rare token is counted, one of two rare tokens in both places, and the two answers meet where
they came from. Shares interpolate the bigram and the unigram.

A token is a lower-cased (A-Z) word `[^\\x20\\x09-\\x0D]+`; each text ends in one end token, so
that null and empty texts have one token. Tokens are compared by 64-bit hashes. doc_id
identifies a row; rows that repeat a doc_id, null too, are scored together as one document. An
empty table has an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise, read
from .words import CHUNK_BYTES, U, chunks, mix, release, split_words, text_bytes, word_hashes

BITS_PER_ENTRY, LEAST_WORDS = 16, 1 << 12
HEAD_TOKENS = 1 << 20
#: One document in SAMPLE is looked at for frequent bigrams, those that come OFTEN times or more there, at most MAX_FREQUENT.
SAMPLE, OFTEN, MAX_FREQUENT = 32, 6, 1 << 17
#: Training tokens for which there is a shard; bytes of text that are packed at once.
SHARD, PACK = 1 << 19, 2 << 20
#: Ratio of neighbouring levels; bits that an entry sets in its word.
RATIO, PROBES = 1.5, 4
LEVELS = 64
#: The bigram's share has the weight WEIGHT * c / (c + PRIOR), where c is the count of the first token.
WEIGHT, PRIOR = 0.15, 8.0
END = np.array([0x6C62272E07BB0142], U)

_VALUE = np.concatenate(([0.0], RATIO ** (np.arange(LEVELS) + 0.5)))  # what a level stands for
_VALUE[1] = 1.0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, row by row and each row's end last; the row of each; where each row's tokens begin."""
    w = split_words(*text_bytes(texts))
    n = np.diff(w.first)
    begin = np.cumsum(n + 1) - (n + 1)
    out = np.full(len(w.start) + len(n), END[0], U)
    out[np.arange(len(w.start)) + w.doc] = word_hashes(w, lower=True)
    return out, np.repeat(np.arange(len(n)), n + 1), begin


def firsts(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The token before each token; the end token before the first."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[begin] = END[0]
    return before


def pairs(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * U(0xD6E8FEB86659FD93) + h * U(0xA0761D6478BD642F))


def _unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[at], np.diff(np.append(at, len(h)))


def _within(values: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the values are among the sorted ones, and where."""
    if not len(sorted_):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[at] == values, at


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0, size: int = CHUNK_BYTES):
    for batch in batches:
        for a, b in chunks(batch.column(column), size):
            part = batch.slice(a, b - a)
            yield part, *tokens(part.column(column))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, h, _, begin in _texts(batches):
        before = firsts(h, begin)
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (pairs(before, h), before, h)], ["pair", "a", "b"])


def frequent_bigrams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and second tokens of the bigrams that are frequent in a sample, sorted by hash: at most MAX_FREQUENT rows reach the driver. Which they are changes no score."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    found = sample.mapInArrow(_sampled, "pair long, a long, b long").groupBy("pair").agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    found = found.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "pair").limit(MAX_FREQUENT).toArrow()
    out = [found[c].to_numpy().view(U) for c in ("pair", "a", "b")]
    order = np.argsort(out[0])
    return tuple(x[order] for x in out)


def _count(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value[0]
        for _, h, _, begin in _texts(batches):
            pair = pairs(firsts(h, begin), h)
            for order, keys in ((1, h), (2, pair[_within(pair, often)[0]])):
                u, n = _unique(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), order, np.int8)), pa.array(u.view(np.int64)), pa.array(n)], ["n", "h", "c"])

    return run


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def counts(docs: DataFrame, frequent) -> tuple[DataFrame, DataFrame]:
    """(h, c) of all training unigrams, and of the frequent bigrams."""
    train = docs.where(~held_out()).select("text")
    all_ = materialise(train.mapInArrow(_count(frequent), "n byte, h long, c long").groupBy("n", "h").agg(F.sum("c").alias("c")))
    return all_.where("n = 1").select("h", "c"), all_.where("n = 2").select("h", "c")


def level(c) -> np.ndarray:
    return np.minimum(LEVELS - 1, 1 + np.floor(np.log(np.maximum(c, 1)) / np.log(RATIO) + 1e-9)).astype(np.int64)


def _level(c):
    """`level` of a column; 0 for null and 0."""
    q = F.least(F.lit(LEVELS - 1), (1 + F.floor(F.log(c) / F.log(F.lit(RATIO)) + 1e-9))).cast("int")
    return F.when(c > 0, q).otherwise(0)


def _slots(h: np.ndarray, q, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word (of a power of two of them) and the bits in it, for entries (h, q)."""
    e = mix(h ^ (np.asarray(q, np.int64).astype(U) * U(0x9FB21C651E98DF25)))
    bits = np.zeros(len(e), U)
    for j in range(PROBES):
        bits |= U(1) << ((e >> U(6 * j)) & U(63))
    return (e >> U(64 - (words.bit_length() - 1))).astype(np.int64), bits


def _words(entries: int, bits: int) -> int:
    """Words of a filter of so many entries: a power of two."""
    return 1 << max(0, (-(-int(entries) * bits // 64) - 1).bit_length())


def _inserted(h: np.ndarray, top: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a filter that entries up to the levels `top` set bits in, and these bits."""
    at, bits = _slots(np.repeat(h, top), np.arange(top.sum()) - np.repeat(np.cumsum(top) - top, top) + 1, words)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) != 0))) if len(order) else order
    return at[order][first], np.bitwise_or.reduceat(bits[order], first) if len(first) else bits


def _entries(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bits = _inserted(batch.column(0).to_numpy().view(U), level(batch.column(1).to_numpy()), words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], ["at", "bits"])

    return run


def build_filter(ngrams: DataFrame) -> np.ndarray:
    """The filter of (h, c), at BITS_PER_ENTRY. Of the head and MAX_FREQUENT bigrams, it has some tens of MB at most."""
    entries = ngrams.agg(F.coalesce(F.sum(_level(F.col("c"))), F.lit(0))).first()[0]
    words = max(LEAST_WORDS, _words(entries, BITS_PER_ENTRY))
    rows = ngrams.mapInArrow(_entries(words), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, U)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(U)
    return out


def levels(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Levels, probed from the first level up until one is absent."""
    found, live, q = np.zeros(len(h), np.int64), np.arange(len(h)), 1
    while len(live) and q < LEVELS:
        at, bits = _slots(h[live], np.full(len(live), q), len(filter_))
        live = live[filter_[at] & bits == bits]
        found[live] = q
        q += 1
    return found


def log_shares(one: np.ndarray, context: np.ndarray, both: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """log10 of each token's smoothed probability after the token before it, from their levels."""
    both = _VALUE[both]
    single = (_VALUE[one] + 1) / (total + kinds + 1)
    context = np.maximum(_VALUE[context], both)
    weight = WEIGHT * context / (context + PRIOR)
    seen = both / np.maximum(context, 1)
    return np.log10(weight * np.minimum(seen, 1) + (1 - weight) * single)


class Model(NamedTuple):
    """The broadcast shard. head, count: its tokens and their exact counts, sorted; often: its bigrams, sorted; total, kinds: training tokens, all and distinct."""

    filter: np.ndarray
    head: np.ndarray
    count: np.ndarray
    often: np.ndarray
    total: int
    kinds: int


#: What the documents of a chunk have for a shard. doc, low, high, x: bigrams of two tokens of the head; low and high are 48 bits of
#: their hash. rare_*: bigrams with a second token beyond the head, in this token's shard; first_*: those with such a first token, in its shard. x is m << 14 |
#: both << 13 | context << 7 | one << 1 | train, with the times in the document, whether both tokens are beyond the head, and the levels of the first and
#: second token. own: sums of whole documents, in one row of each chunk.
SUMS = "doc_id long, n_tokens long, n_known long, base double, score double"
SUMS_LIST = f"array<struct<{SUMS.replace(' ', ':').replace(',:', ',')}>>"
PACKED = (
    "shard int, chunk long, doc array<long>, low array<int>, high array<short>, x array<long>, rare_doc array<long>, rare_token array<long>, rare_pair array<long>, rare_x array<long>, "
    f"first_doc array<long>, first_token array<long>, first_pair array<long>, first_x array<long>, own {SUMS_LIST}"
)
#: What a shard answers. both_*: of bigrams of two rare tokens, the times and levels of the second token and of the bigram; context_*: the levels of their first tokens.
PARTS = f"chunk long, doc array<long>, score array<double>, rare {SUMS_LIST}, both_doc array<long>, both_pair array<long>, both_x array<long>, context_pair array<long>, context_x array<long>"


def _runs(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each distinct (row, key), and how many there are of each."""
    order = np.lexsort((key, row))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def _lists(values: pa.Array, shard: np.ndarray, shards: np.ndarray) -> pa.Array:
    """Values, sorted by shard, as one list for each of `shards`."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(shard, np.append(shards, np.iinfo(np.int64).max)).astype(np.int32)), values)


def _packed(broadcast, count: int):
    def shard_of(h: np.ndarray) -> np.ndarray:
        return ((h >> U(48)) * U(count) >> U(16) if count < 1 << 16 else h % U(count)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        names = [x.split()[0] for x in PACKED.split(", ")]
        for part, h, row, begin in _texts(batches, 2, PACK):
            n, ids, train = part.num_rows, part.column(0), part.column(1).to_numpy(zero_copy_only=False)
            u, inverse = np.unique(np.concatenate((h, END)), return_inverse=True)
            known, at = _within(u, model.head)
            level_of = np.where(known, levels(model.filter, u), 0)
            tenths = np.where(known, np.log10((model.count[at] if len(model.count) else 0) + 1.0), 0.0)
            known, one, end = known[inverse], level_of[inverse], inverse[-1]
            context, first = np.empty(len(h), np.int64), np.empty(len(h), bool)
            context[1:], first[1:] = one[:-2], known[:-2]
            context[begin], first[begin] = level_of[end], known[-1]
            base = tenths[inverse[:-1]]
            known, one, before = known[:-1], one[:-1], firsts(h, begin)
            pair = pairs(before, h)
            closed = _within(pair, model.often)[0] & known & first
            u, where = np.unique(pair[closed], return_inverse=True)
            share = log_shares(one[closed], context[closed], levels(model.filter, u)[where], model.total, model.kinds)

            left = np.flatnonzero(~closed)
            i, m = _runs(row[left], pair[left])
            i = left[i]
            both = ~known[i] & ~first[i]
            x = m << 14 | both << 13 | context[i] << 7 | one[i] << 1 | train[row[i]]
            sent = {}
            for name, of, key in (("", known & first, pair), ("rare_", ~known, h), ("first_", ~first, before)):
                j, shard = i[of[i]], shard_of(key[i[of[i]]])
                order = np.argsort(shard, kind="stable")
                sent[name] = j[order], x[of[i]][order], shard[order], key
            some = np.unique(np.concatenate([v[2] for v in sent.values()]))
            some = some if len(some) else np.zeros(1, np.int64)
            name = h.sum() + mix(ids.fill_null(-1).to_numpy().view(U)).sum()  # chunks of equal rows may share it: all that comes of a chunk are sums
            columns = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), name.view(np.int64)))]
            j, x, shard, _ = sent[""]
            low, high = pair[j].astype(np.uint32).view(np.int32), (pair[j] >> U(32)).astype(np.uint16).view(np.int16)
            columns += [_lists(v, shard, some) for v in (ids.take(pa.array(row[j])), pa.array(low), pa.array(high), pa.array(x))]
            for j, x, shard, key in (sent["rare_"], sent["first_"]):
                columns += [_lists(v, shard, some) for v in (ids.take(pa.array(row[j])), pa.array(key[j].view(np.int64)), pa.array(pair[j].view(np.int64)), pa.array(x))]
            own = _records(ids, np.bincount(row, minlength=n), np.bincount(row[known], minlength=n), np.bincount(row, base, n), np.bincount(row[closed], share, n))
            columns.append(pa.ListArray.from_arrays(pa.array([0] + [n] * len(some), pa.int32()), own))
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _flat(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays([x.flatten() for x in table[name].chunks])


def _by(table: pa.Table, name: str) -> np.ndarray:
    """For each entry of the lists of a column, its row."""
    return np.repeat(np.arange(len(table)), pa.compute.list_value_length(table[name]).to_numpy())


def _answers(key: np.ndarray, trained: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each probe its level in the shard's filter, built from the training occurrences of all keys; and the exact sum of these."""
    u, where = np.unique(key.view(U), return_inverse=True)
    count = np.bincount(where, trained, len(u)).astype(np.int64)
    top = np.where(count > 0, level(count), 0)
    filter_ = np.zeros(_words(top.sum(), bits), U)
    at, set_ = _inserted(u, top, len(filter_))
    filter_[at] = set_
    return levels(filter_, u)[where], count[where]


def _records(docs: pa.Array, *sums: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([docs, *(pa.array(v, t) for v, t in zip(sums, [pa.int64()] * 2 + [pa.float64()] * 2, strict=True))], [x.split()[0] for x in SUMS.split(", ")])


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _shares(table: pa.Table, total: int, kinds: int, bits: int) -> pa.Table:
    """Of a shard, for each row, what its n-grams add to the sums of the row's documents, whose entries follow one another."""
    numbers = lambda name: _flat(table, name).to_numpy()
    fields = lambda x: (x >> 14, x >> 13 & 1 == 1, x >> 7 & LEVELS - 1, x >> 1 & LEVELS - 1, np.where(x & 1, x >> 14, 0))
    lists = lambda row, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(table) + 1)).astype(np.int32)), values)

    def by_document(docs: pa.Array, row: np.ndarray, *sums: np.ndarray):
        code = docs.dictionary_encode("encode").indices.to_numpy()
        at = _groups(row, code) if len(row) else np.zeros(0, np.int64)
        return docs.take(pa.array(at)), row[at], *(np.add.reduceat(v, at) if len(at) else v[:0] for v in sums)

    m, _, context, one, trained = fields(numbers("x"))
    pair = numbers("low").view(np.uint32).astype(U) | numbers("high").view(np.uint16).astype(U) << U(32)
    share = m * log_shares(one, context, _answers(pair, trained, bits)[0], total, kinds)
    who, row, share = by_document(_flat(table, "doc"), _by(table, "doc"), share)
    del pair, m, context, one, trained
    release()

    m, rare, context, _, trained = fields(numbers("rare_x"))
    token, pair = numbers("rare_token"), numbers("rare_pair")
    one, times = _answers(token, trained, bits)
    together = _answers(pair, trained, bits)[0]
    own = np.where(rare, 0.0, m * log_shares(one, context, together, total, kinds))
    docs, at = _flat(table, "rare_doc"), _by(table, "rare_doc")
    rare_who, rare_row, known, base, own = by_document(docs, at, m * (times > 0), m * np.log10(times + 1.0), own)
    some = np.flatnonzero(rare)
    open_ = [lists(at[some], v) for v in (docs.take(pa.array(some)), pa.array(pair[some]), pa.array((m << 14 | one << 7 | together)[some]))]

    # first tokens beyond the head: their counts are those of the bigrams that they end
    m, rare, _, one, trained_first = fields(numbers("first_x"))
    key = numbers("first_token")
    context = _answers(np.concatenate((token, key)), np.concatenate((trained, np.zeros(len(key), np.int64))), bits)[0][len(token) :]
    pair, at = numbers("first_pair"), _by(table, "first_doc")
    single = np.flatnonzero(~rare)
    first_share = m * log_shares(one, context, _answers(pair, np.where(rare, 0, trained_first), bits)[0], total, kinds)
    first_who, first_row, first_share = by_document(_flat(table, "first_doc").take(pa.array(single)), at[single], first_share[single])
    some = np.flatnonzero(rare)
    open_ += [lists(at[some], pa.array(v[some])) for v in (pair, context)]

    who, row, share = pa.concat_arrays([who, first_who]), np.concatenate((row, first_row)), np.concatenate((share, first_share))
    order = np.argsort(row, kind="stable")
    scores = [lists(row[order], v.take(pa.array(order))) for v in (who, pa.array(share))]
    # with the sums of whole documents, where the row has them
    whole = table["own"].combine_chunks()
    sums = pa.concat_arrays([whole.flatten(), _records(rare_who, np.zeros(len(rare_row), np.int64), known, base, own)])
    row = np.concatenate((np.repeat(np.arange(len(table)), pa.compute.list_value_length(whole).to_numpy()), rare_row))
    order = np.argsort(row, kind="stable")
    return pa.table([table["chunk"], *scores, lists(row[order], sums.take(pa.array(order))), *open_], list(PART_NAMES))


#: The columns of PARTS (its structs have commas too).
PART_NAMES = ("chunk", "doc", "score", "rare", "both_doc", "both_pair", "both_x", "context_pair", "context_x")


def _sums(table: pa.Table, total: int, kinds: int) -> pa.Table:
    """Of a chunk, the sums of its documents."""
    own = _flat(table, "rare")
    # bigrams of two rare tokens: the context's level from the one shard, the other levels from the other
    pair, context = _flat(table, "context_pair").to_numpy(), _flat(table, "context_x").to_numpy()
    order = np.argsort(pair, kind="stable")
    asked, x = _flat(table, "both_pair").to_numpy(), _flat(table, "both_x").to_numpy()
    _, at = _within(asked, pair[order])
    share = (x >> 14) * log_shares(x >> 7 & LEVELS - 1, context[order][at] if len(at) else at, x & LEVELS - 1, total, kinds)

    docs = pa.concat_arrays([own.field("doc_id"), _flat(table, "doc"), _flat(table, "both_doc")]).dictionary_encode("encode")
    code, n = docs.indices.to_numpy(), len(docs.dictionary)
    here = len(own)
    sums = [np.bincount(code[:here], own.field(c).to_numpy(), n) for c in ("n_tokens", "n_known", "base", "score")]
    sums[3] = sums[3] + np.bincount(code[here:], np.concatenate((_flat(table, "score").to_numpy(), share)), n)
    return pa.Table.from_batches([pa.RecordBatch.from_struct_array(_records(docs.dictionary, sums[0].astype(np.int64), sums[1].astype(np.int64), *(x.astype(float) for x in sums[2:])))])


def score(docs: DataFrame) -> DataFrame:
    """One row for each doc_id of docs(doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    often, a, b = frequent_bigrams(docs)
    unigrams, bigrams = counts(docs, spark.sparkContext.broadcast((often,)))
    total, kinds = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least level from which on all tokens fit into the head
    room, least = HEAD_TOKENS, LEVELS
    for q, n in unigrams.groupBy(_level(F.col("c")).alias("q")).count().orderBy(F.desc("q")).collect():
        room -= n
        if room < 0:
            break
        least = q
    cut = F.col("c") >= int(np.ceil(RATIO ** (least - 1) - 1e-6))
    found = unigrams.where(cut).toArrow()
    head, count = found["h"].to_numpy().view(U), found["c"].to_numpy()
    order = np.argsort(head)
    head, count = head[order], count[order]
    often = often[_within(a, head)[0] & _within(b, head)[0]]
    filter_ = build_filter(unigrams.where(cut).union(bigrams))
    model, bits = spark.sparkContext.broadcast(Model(filter_, head, count, often, total, kinds)), BITS_PER_ENTRY
    packed = docs.select("doc_id", (~held_out()).alias("train"), "text").mapInArrow(_packed(model, total // SHARD + 1), PACKED)
    parts = packed.groupBy("shard").applyInArrow(lambda table: _shares(table, total, kinds, bits), PARTS)
    sums = parts.groupBy("chunk").applyInArrow(lambda table: _sums(table, total, kinds), SUMS).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return sums.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))).alias("base_score"), "score")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
