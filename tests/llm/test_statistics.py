"""Source divergence, compression classifier and whitening against brute force: nulls, ties, repeats, empty tables, further columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from llm import compression, divergence, whitening

DOCS = "doc_id long, text string, lang string, source string, chunk string, term string, n long, value long"


def audit(rows):
    """The contract, term by term."""
    docs = [(lang or "", source or "", re.findall(divergence.TERM, "".join(c.lower() if c.isascii() else c for c in text or ""))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = collections.Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= 10}
        counts = {s: collections.Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if t in kept) for s in {d[1] for d in docs if d[0] == lang}}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept}
        gain = lambda a, b: (a - b) ** 2 // (a + b)
        q, rates = p(sum(counts.values(), collections.Counter())), {s: p(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(-sum(gain(rates[s][t], rates[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-gain(rates[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and rates[s][t] > q[t]]
            out += [(lang, s, "pair", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", i.decode(), -v, r) for r, (v, i) in enumerate(sorted(terms)[:10], 1)]
    return sorted(out)


def test_divergence(spark):
    r = random.Random(3)
    forms = ["{}", "{},", "({})", "{}.", "{}-{}", " {}", "{}1{}"]
    vocabulary = ["".join(r.choice("abcdeÉü") for _ in range(r.randrange(1, 4))) for _ in range(90)]

    def text(n):
        return r.choice([" ", "\t", "\x0b\n"]).join(r.choice(forms).replace("{}", r.choice(vocabulary)).title() for _ in range(n))

    rows = [(i, text(r.randrange(1, 40)), r.choice(["en", "de", None]), r.choice(["a", "b", "ü", None])) for i in range(150)]
    rows += [(7, None, "en", "z"), (None, "", "xx", "a"), (None, "", "xx", "b"), (1, "é " * 2000 + "x" * 5000, "en", "a")] + [(8, "same text all over, same", "en", "a")] * 40
    rows = [(*x, "c", "t", 1, 2) for x in rows]
    unsure = []
    old, divergence.documents_of = divergence.documents_of, lambda docs, rare: unsure.append(rare.count()) or old(docs, rare)
    try:
        got = divergence.divergence(spark.createDataFrame(rows, DOCS).repartition(3))
        assert sorted(map(tuple, got.collect())) == audit(rows)
    finally:
        divergence.documents_of = old
    assert unsure[0] > 20  # terms whose chunks are all rare were told apart by document
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_divergence_with_a_full_filter(spark, monkeypatch):
    rows = [(i, f"w{'xyz'[i % 3]}, w{'xyz'[i % 3]}. w{'xyz'[i % 3]}!{i}", "en", "ab"[i % 2], "", "", 0, 0) for i in range(33)]
    monkeypatch.setattr(divergence, "bit_filter", lambda rare: np.full(divergence.BITS // 8, 255, np.uint8))
    assert sorted(map(tuple, divergence.divergence(spark.createDataFrame(rows, DOCS)).collect())) == audit(rows)


def labelled(n):
    """Good texts of sentences, bad ones of shouts and separators."""
    r = random.Random(5)
    syllables = ["ta", "ro", "mi", "ken", "sol", "ver", "la", "du"]
    out = []
    for i in range(n):
        w = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(15, 90))]
        good = i % 3 > 0
        out.append((i, " ".join(w).capitalize() + "." if good else " | ".join(x.upper() + "!!" for x in w), int(good)))
    return out


def test_compression_classifier(spark):
    rows = labelled(900)
    docs = spark.createDataFrame([(i, t, "x", "y", None) for i, t, _ in rows] + [(5000, None, None, None, None), (5001, "", "", "", 1), (None, "words", "", "", 1), (3, rows[3][1], "", "", 1), (5002, rows[1][1] * 400, "", "", 1)], "doc_id long, text string, lang string, good string, score long").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5001, None, 0)], "doc_id long, quality int, toxic int")
    got = compression.classify(docs, labels).collect()
    assert len(got) == 905 and got[0].asDict().keys() >= {"doc_id", "held_out", "score", "predicted"}
    assert all(x.held_out == (zlib.crc32(str("" if x.doc_id is None else x.doc_id).encode()) % 5 == 0) for x in got)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    truth = {i: q for i, _, q in rows}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(held) > 100 and sum(x.predicted == truth[x.doc_id] for x in held) > 0.98 * len(held)
    coder = compression.Coder((b"some text of a dictionary", b"and another one of them"))
    long = (rows[1][1] * 400).encode()
    assert coder.sizes(long) == [sum(len(c.compress(long[i : i + compression.BLOCK])) for i in range(0, len(long), compression.BLOCK)) for c in coder.coders]
    # labels of held-out rows, and names, decide nothing
    other = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    assert {(x.doc_id, x.score) for x in compression.classify(docs, other).collect()} == {(x.doc_id, x.score) for x in got}


def test_compression_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x.score for x in compression.classify(docs, none).collect()} == {1.0}
    few = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert compression.classify(docs, few).count() == 2
    assert compression.classify(docs.limit(0), few).count() == 0


VECTORS = "vec_id long, embedding array<float>, x long, e string, component int"


def direct(vectors, wanted=16):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(wanted, int((e > 1e-9 * e[0]).sum()))
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), e


@pytest.mark.parametrize("rows,width,rank", [(300, 24, 24), (40, 60, 60), (200, 30, 9), (12, 5, 5)])
def test_whitening(spark, rows, width, rank):
    g = np.random.default_rng(rows)
    v = (g.standard_normal((rows, rank)) * np.linspace(3, 1, rank)) @ np.linalg.qr(g.standard_normal((width, width)))[0][:rank]
    v = v.astype(np.float32).tolist()
    if rank < width:  # floor would fill the space
        v = np.hstack([np.round(g.standard_normal((rows, rank)) * np.arange(4, 4 + rank)), np.zeros((rows, width - rank))]).tolist()
    v += [v[0]] * 50
    table = spark.createDataFrame([(i, x, 1, "e", 2) for i, x in enumerate(v)], VECTORS).repartition(3)
    n, deviation, whitened, explained, _ = direct(v)
    got = whitening.whiten(table).toPandas()
    k = whitened.shape[1]
    assert len(got) == len(v) * k and set(got.n) == {n} and got.identity_error.max() < 1e-9
    mine = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((mine * whitened).sum(0))
    assert np.abs(mine * signs - whitened).max() < 1e-6
    assert np.abs(got.groupby("component").explained.first() / explained - 1).max() < 1e-9
    assert (got.groupby("vec_id").deviation.first().to_numpy() == deviation).all()


def test_whitening_of_repeated_eigenvalues(spark):
    """Plus and minus each axis: all eigenvalues are equal, and a Krylov space has one dimension."""
    v = [[float(s) if j == a else 0.0 for j in range(8)] for a in range(8) for s in (1, -1)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>"), 5).toPandas()
    assert len(got) == 16 * 5 and got.identity_error.max() < 1e-9 and np.allclose(got.explained, 1 / 8)
    # one more pair on an axis: the repeated ones stand behind a large one
    v += [[9.0] + [0.0] * 7, [-9.0] + [0.0] * 7]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>"), 5).toPandas()
    assert got.component.nunique() == 5 and got.identity_error.max() < 1e-9
    assert np.allclose(sorted(got.explained.unique())[-1], 164 / 178) and np.allclose(got[got.component > 1].explained, 2 / 178)


def test_whitening_drops_and_pads(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [3.0]), (None, []), (None, []), (7, [1e30, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert sorted(map(str, got.vec_id)) == sorted(map(str, [1.0, 1.0, 6.0, 6.0] + [float("nan")] * 4)) and set(got.n) == {3}
    assert whitening.whiten(spark.createDataFrame(rows[:2], "vec_id long, embedding array<float>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    wide = spark.createDataFrame([(1, [1e11, 5.0]), (2, [-1e11, 3.0])], "vec_id long, embedding array<double>")
    assert set(whitening.whiten(wide).toPandas().deviation.isna()) == {True}
