"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut by the vocabulary's pattern; each match is encoded on its own. A match is
encoded by parts: short runs of bytes by rank-ordered merges, and two neighbouring encodings
are joined by re-encoding a window of bytes around their boundary, one that grows until the
tokens outside it are provably stable. The proof used: merges by rank give a sequence of tokens
exactly if every neighbouring pair of it is what its own bytes encode to, so a join is right as
soon as the pairs at both edges of the window are such pairs; all pairs further out already are.
Decoding concatenates the tokens' bytes up the same tree.

Nulls and empty texts have no tokens. Very long texts without a cut (one word of many MB) take
time in proportion to their length, as every join touches a window around its boundary only; where windows have to grow over all of a
repeated text, its equal parts are encoded once, and windows in n log n. doc_id may be null or repeated: each row gives one row. An empty
table has an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes that are merged directly; longer matches are halved.
LEAF = 32
#: Bytes up to which the lowest rank is looked for in a list.
SHORT = 128
#: Characters below it may be cut by the faster engine.
LATIN = 0x250
#: Ids that are decoded at once.
RUN = 1 << 16
#: Entries of a generation of a worker's cache; bounds its memory to some 150 MB.
KEPT = 300_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Recent(dict):
    """What `make` gave for recent keys: two generations, so that frequent keys outlive the many that come once."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> str:
        found = self.old.get(key) or self.make(key)
        if len(key) <= 2 * LEAF:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def parsed(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int64, sep=",") if ids else np.zeros(0, np.int64)


@cache
def standard(pattern: str) -> tuple[re.Pattern, re.Pattern]:
    """The pattern for Python's own engine, which is faster, and a pattern of the characters that it may not be used for: those beyond LATIN, and those that the two engines class differently."""
    import regex

    every = "".join(map(chr, range(LATIN)))
    classes = {r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d", r"\s": r"\s"}
    unlike = set().union(*({*regex.findall(a, every)} ^ {*re.findall(b, every)} for a, b in classes.items()))
    own = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", classes[r"\p{L}"]).replace(r"\p{N}", r"\d")
    return re.compile(own), re.compile(f"[{''.join(map(re.escape, sorted(unlike)))}]|[^\\x00-{chr(LATIN - 1)}]")


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {v: k for k, v in ranks.items()}
        ids = sorted(self.tokens)
        self.bytes = np.frombuffer(b"".join(map(self.tokens.__getitem__, ids)), np.uint8)
        self.sizes = np.zeros(ids[-1] + 1, np.int64)
        self.sizes[ids] = [len(self.tokens[i]) for i in ids]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.plain, self.unlike = standard(pattern)
        self.kept = Recent(lambda match: ",".join(map(str, self.encode(match.encode("utf-8", "surrogatepass")))))
        self.pairs: dict[tuple[int, int], bool] = {}

    def leaf(self, data: bytes) -> list[int]:
        """Merges of the lowest-ranked neighbours, the leftmost first."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        if len(data) > SHORT:
            return self.long_leaf(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
        while costs and (low := min(costs)) < 1 << 30:
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[x] for x in parts]

    def long_leaf(self, data: bytes) -> list[int]:
        """`leaf` by a heap of neighbours, in n log n."""
        ranks, n = self.ranks, len(data)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, to = heappop(heap)
            j = after[i]
            if j >= n or end[j] != to or end[i] != j:
                continue  # one of the two has been merged since
            end[i], end[j] = to, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(data[i : end[k]])) is not None:
                    heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:to])) is not None:
                heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = after[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b encode to just a and b."""
        if (found := self.pairs.get((a, b))) is None:
            found = self.pairs[a, b] = self.leaf(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        n = 1
        while True:
            a, b = max(0, len(left) - n), min(len(right), n)
            window = self.leaf(b"".join(map(self.tokens.__getitem__, left[a:] + right[:b])))
            if (a == 0 or self.stable(left[a - 1], window[0])) and (b == len(right) or self.stable(window[-1], right[b])):
                return left[:a] + window + right[b:]
            n *= 2

    def encode(self, data: bytes, seen: dict[int, tuple[bytes, list[int]]] | None = None) -> list[int]:
        """Blocks of a power of two of leaves, then what is left; a block equal to the last one of its size, as in repeated text, is not encoded again."""
        if len(data) <= LEAF:
            return self.leaf(data)
        seen = {} if seen is None else seen
        if (last := seen.get(len(data))) and last[0] == data:
            return last[1]
        cut = LEAF << ((len(data) - 1) // LEAF).bit_length() - 1
        out = self.join(self.encode(data[:cut], seen), self.encode(data[cut:], seen))
        seen[len(data)] = data, out
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) > RUN:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        sizes = self.sizes[ids]
        at = np.repeat(self.begins[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.bytes[at + np.arange(len(at))].tobytes()

    def text(self, text: str) -> str:
        """The ids as decimal text, joined by commas."""
        cut = self.pattern if self.unlike.search(text) else self.plain
        return ",".join(map(self.kept.__getitem__, cut.findall(text)))

    def ids(self, text: str) -> list[int]:
        found = self.text(text)
        return list(map(int, found.split(","))) if found else []


@cache
def coder(vocabulary: str = VOCABULARY) -> Coder:
    """One for each Python worker; `vocabulary` names a rank file of the installed tokenizers."""
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Coder(ranks, public_tokenizers.PATTERN)


def _digest(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = c.text(text.as_py() or "")
                tokens = parsed(ids)
                decoded = c.decode(tokens)
                rows.append((len(tokens), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64() if not i else pa.string()) for i in range(3))], names)

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>)."""

    def run(batches):
        c = coder(vocabulary)
        for batch in batches:
            ids = pa.array([c.ids(x.as_py() or "") for x in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) -> (doc_id, data binary)."""

    def run(batches):
        c = coder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text) -> digests of the ids and of what they decode to; ids stay inside the task."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digest(vocabulary), SCHEMA)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
