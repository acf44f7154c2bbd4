"""Quality rules by repetition coverage.

Each text is hashed once into words; rolling hashes of several n-gram lengths then mark the
words that lie inside an n-gram found twice or more in the same text, and the lines that equal
an earlier line. Everything stays inside one row: no shuffle, whole texts, Arrow batches cut
into runs of a few MB.

Nulls and empty texts have no words: every count is 0 and the base rule rejects them. Further
columns of the input, whatever their names, are ignored by `measure` and kept by `keep_rows`; repeated rows and rows without a doc_id
give a result each. An empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import read
from .words import chunks, ngrams, segment_hashes, split_words, text_bytes, word_hashes

#: n-gram lengths, and the share of a text's word characters that duplicated n-grams of this length may cover.
COVERAGE = {5: 0.40, 8: 0.30, 13: 0.25}
#: The share of word characters that may lie in lines equal to an earlier line.
LINE_COVERAGE = 0.30
#: Symbols `[#*$%&|<>]` a word.
SYMBOLS_PER_WORD = 0.10

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD = np.ones(256, bool)  # a code point's first byte, of what isn't white space
_HEAD[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = False

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_chars_5 long, dup_chars_8 long, dup_chars_13 long, dup_line_chars long, base_failed boolean, kept boolean"


def _sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur twice or more within their group, and which equal an earlier one."""
    order = np.lexsort((h, group))
    same = (h[order][1:] == h[order][:-1]) & (group[order][1:] == group[order][:-1])
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


def covered_words(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window found twice or more in their document."""
    size = len(h) - n + 1
    out = np.zeros(max(len(h), 0), bool)
    if size <= 0:
        return out
    at = np.flatnonzero(doc[:size] == doc[n - 1 :])
    twice, _ = _repeated(doc[at], ngrams(h, n)[at])
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + n, -1)
    return np.cumsum(step[:-1]) > 0


def figures(texts: pa.Array) -> dict[str, np.ndarray]:
    buf, offsets = text_bytes(texts)
    w = split_words(buf, offsets)
    h = word_hashes(w)
    head = np.concatenate(([0], np.cumsum(_HEAD[buf], dtype=np.int64))) if len(buf) else np.zeros(1, np.int64)
    chars = head[w.end] - head[w.start]
    out = {"n_words": np.diff(w.first), "word_chars": head[offsets[1:]] - head[offsets[:-1]], "n_symbols": _sum(_IS_SYMBOL[buf], offsets)}
    # lines: cut at \n and at the ends of rows
    cut = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate((offsets[:-1], cut + 1)))
    end = np.sort(np.concatenate((cut, offsets[1:])))
    full = head[end] > head[start]
    start, end = start[full], end[full]
    row = np.searchsorted(offsets, start, "right") - 1
    _, later = _repeated(row, segment_hashes(buf, start, end))
    n = len(offsets) - 1
    out["n_dup_lines"] = np.bincount(row[later], minlength=n)
    out["dup_line_chars"] = np.bincount(row[later], (head[end] - head[start])[later], n).astype(np.int64)
    for size in COVERAGE:
        inside = covered_words(w.doc, h, size)
        out[f"dup_chars_{size}"] = _sum(chars * inside, w.first)
        if size == 8:
            out["n_repeat_words"] = _sum(inside, w.first)
    return out


def verdict(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The figures with `base_failed` and `kept`."""
    base = (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])
    over = (f["dup_line_chars"] > LINE_COVERAGE * f["word_chars"]) | (f["n_symbols"] > SYMBOLS_PER_WORD * f["n_words"])
    for n, share in COVERAGE.items():
        over |= f[f"dup_chars_{n}"] > share * f["word_chars"]
    return f | {"base_failed": base, "kept": ~base & ~over}


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for a, b in chunks(texts):
            yield batch.slice(a, b - a), verdict(figures(texts.slice(a, b - a)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [x.split() for x in SCHEMA.split(", ")]
    for part, found in _judged(batches):
        found["doc_id"] = part.column(0)
        yield pa.RecordBatch.from_arrays([pa.array(found[k], pa.bool_() if kind == "boolean" else pa.int64()) for k, kind in fields], [k for k, _ in fields])


def measure(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): counts, `base_failed`, and `kept`, the verdict."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure, SCHEMA)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, found in _judged(batches):
        yield part.filter(pa.array(found["kept"]))


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows that `measure` keeps, with all their columns; judged in place, without a join."""
    return docs.mapInArrow(_keep, docs.schema)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return measure(read(spark, sf_dir, "documents"))
