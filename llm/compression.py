"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on labelled good and one on labelled bad text. A text
is compressed with each, and the difference of its two sizes over their sum says which of them it
resembles; together with the sizes a byte (a text that repeats itself is small under both) and the
length this goes through a logistic calibration to a score.

The fit uses a bounded sample of labelled rows: MAX_LABELLED of them, the smallest by a hash of
their doc_id. Copies of a text with the same label count once. Half of the sample gives the dictionaries, one block of BLOCK bytes a row at
most; the other half, compressed whole like any other text, gives the calibration, so that no text is judged by a
dictionary that holds it. Only dictionaries of DICTIONARY bytes each and some twenty numbers go to the executors.

Scoring is one pass without a shuffle: whole texts, in blocks of BLOCK bytes, whose compressed sizes add up.
Null and empty texts have size 0 and the score that follows from it. Each row gives one result, also rows
that repeat or lack a doc_id (those count as held out); further columns are ignored. Where the sample has
fewer than MIN_ROWS rows of either kind in either half, every score is the share of good rows. An empty table has an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise, read
from .words import chunks

#: Bounds of the fit: labelled rows, and bytes of a dictionary.
MAX_LABELLED, DICTIONARY = 8000, 112_640
#: Bytes that are compressed at once, small enough for a dictionary to stay in reach; rows of a kind that a fit needs; compression level.
BLOCK, MIN_ROWS, LEVEL = 1 << 14, 8, 3
#: Remainder by FOLDS of the checksum of a doc_id that is held out, and the score from which a text counts as good.
FOLDS, THRESHOLD = 5, 0.3
#: Weight of the squared coefficients in the calibration.
RIDGE = 0.1

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, good_bytes long, bad_bytes long"


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def train(texts: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY bytes; where the texts are too few or too small to train on, they are it themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY:]


class Coder:
    """Sizes of texts under two dictionaries."""

    def __init__(self, dictionaries: tuple[bytes, bytes]) -> None:
        self.coders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) for d in dictionaries]

    def sizes(self, text: bytes) -> list[int]:
        return [sum(len(coder.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for coder in self.coders]


def features(sizes: np.ndarray) -> np.ndarray:
    """Rows of (good, bad, raw) bytes as: normalised difference, both sizes a raw byte, logarithm of the length."""
    good, bad, raw = sizes.astype(float).T
    return np.stack([(bad - good) / np.maximum(good + bad, 1), good / np.maximum(raw, 1), bad / np.maximum(raw, 1), np.log1p(raw)], 1)


class Calibration:
    """Logistic regression on the features and their products."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        a = self.terms(x)
        w = np.zeros(a.shape[1])
        loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + RIDGE / 2 * (w @ w)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(len(w)), a.T @ (y - p) - RIDGE * w)
            size = 1.0
            while size > 1e-6 and loss(w + size * step) > loss(w):
                size /= 2
            w = w + size * step
            if np.abs(size * step).max() < 1e-9:
                break
        self.w = w

    def terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.stack([np.ones(len(z)), *z.T, *(z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1]))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.terms(x) @ self.w, -30, 30)))


def _measured(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches, with the (good, bad, raw) bytes of each row's text."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for a, b in chunks(texts):
            raw = [(t.as_py() or "").encode() for t in texts.slice(a, b - a)]
            yield batch.slice(a, b - a), np.array([[*coder.sizes(t), len(t)] for t in raw], np.int64).reshape(-1, 3)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[tuple[bytes, bytes] | None, Calibration | float]:
    """The two dictionaries (good, bad) and the calibration; None and a constant score where labels are too few."""
    sample = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    sample = sample.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("good")).distinct()
    sample = sample.orderBy(F.xxhash64("id"), "id", "good").limit(MAX_LABELLED)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    rows = rows.withColumn("same", F.xxhash64("text"))
    rows = materialise(rows.groupBy("same", "good").agg(F.min_by("text", F.struct("id", "text")).alias("text")))
    half = F.pmod(F.xxhash64("same", F.lit("half")), F.lit(2))
    counts = {(r["good"], r["half"]): r["n"] for r in rows.groupBy("good", half.alias("half")).agg(F.count("*").alias("n")).collect()}
    of = lambda good: sum(n for (g, _), n in counts.items() if g == good)
    if min(counts.get((g, h), 0) for g in (0, 1) for h in (0, 1)) < MIN_ROWS:
        return None, (of(1) + 1) / (of(0) + of(1) + 1)
    # a block from a place that the text's hash picks
    block = F.expr(f"substring(text, 1 + cast(pmod(xxhash64(same, 'at'), greatest(1, length(text) - {BLOCK // 4})) as int), {BLOCK // 4})")
    parts = rows.where((half == 0) & (F.col("text") != "")).select("same", "good", block.alias("block")).orderBy("same", "good").collect()
    dictionaries = tuple(train([r["block"].encode() for r in parts if r["good"] == g]) for g in (1, 0))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _measured(batches, Coder(dictionaries)):
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in found.T)], ["good", "a", "b", "raw"])

    found = np.array(sorted(map(tuple, rows.where(half == 1).select("good", "text").mapInArrow(sizes, "good int, a long, b long, raw long").collect())), np.int64)
    return dictionaries, Calibration(features(found[:, 1:]), found[:, 0].astype(float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted, and the sizes under the good and the bad dictionary, for each row of docs(doc_id, text)."""
    dictionaries, calibration = fit(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(dictionaries or (b"", b""))
        for part, sizes in _measured(batches, coder):
            score = calibration.score(features(sizes)) if dictionaries else np.full(len(sizes), calibration)
            ids = part.column(0).to_pylist()
            out = [zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == 0 for i in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(out), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(sizes[:, 0]), pa.array(sizes[:, 1])],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, SCHEMA)


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
