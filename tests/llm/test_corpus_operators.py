"""The corpus operators against brute force: nulls, empty and long texts, ties, repeats, empty tables, further columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import bpe, chat, exact_dedup, html_text, jaccard_join, line_dedup, lm, mixing, quality, substring_dedup
from llm.tables import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, span long, word string, n long"
rnd = random.Random(7)
VOCABULARY = ["w" + "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]


def words(n):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


def corpus():
    passage = words(60)
    base = words(300)
    texts = [None, "", "  \n\t", "one", "two words", "three of them", "a\x0bb\x1cc", "É é ÉÀ", " ".join(["same"] * 90)]
    texts += [" ".join(words(rnd.randrange(1, 120))) for _ in range(30)]
    texts += [" ".join(words(40) + passage + words(30)) for _ in range(12)]
    for _ in range(25):
        near = list(base)
        for _ in range(rnd.randrange(0, 9)):
            near[rnd.randrange(len(near))] = rnd.choice(VOCABULARY)
        texts.append(" ".join(near))
    texts += ["copy of " + " ".join(base[:50])] * 15 + ["copy  of " + " ".join(base[:50])] * 3
    texts += ["Line one is here for all\n" + " ".join(words(25)) + f"\nown {i}\n\nLine one is here for all" for i in range(14)]
    texts += ["Mixed CASE " + t for t in texts[20:24]] + [" ".join(words(6000)) for _ in range(2)] + ["x" * 20000, "idiot scum " * 3 + " ".join(words(30))]
    return [(i * 3, t, "en", None if i % 11 == 0 else f"s{i % 13}", len(t or ""), i, "w", i) for i, t in enumerate(texts)]


ROWS = corpus()
TEXTS = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def kept_after_substrings():
    first, out = {}, {}
    for i in sorted(TEXTS):
        w = split(TEXTS[i])
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("group", [None, 4])
def test_substring_dedup(docs, empty, monkeypatch, group):
    if group:  # frequent anchors are dealt out
        monkeypatch.setattr(substring_dedup, "GROUP", group)
        monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == kept_after_substrings()
    if not group:
        assert substring_dedup.substring_dedup(empty).collect() == []


def test_substring_dedup_repeated_and_null_ids(spark):
    text = " ".join(words(30))
    rows = substring_dedup.substring_dedup(spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.n_removed) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 30)]


def test_winnow_is_the_leftmost_minimum():
    g = np.random.default_rng(1).integers(0, 40, 300).astype(np.uint64) << np.uint64(4)
    assert substring_dedup.winnow(g, 10).tolist() == [i + int(np.argmin(g[i : i + 10])) for i in range(291)]


def test_exact_dedup(docs, empty):
    groups = collections.defaultdict(list)
    for i, t in TEXTS.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append(i)
    want = {}
    for text, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(TEXTS[i]), i))
        want |= {i: (keep, len(ids), i == keep, sha(text)) for i in ids}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()} == want
    small = {r.id: r.group_id for r in exact_dedup.radix_groups(docs.select("doc_id", "text"), 2, 3).distinct().collect()}
    assert small == {i: min(ids) for ids in groups.values() if len(ids) > 1 for i in ids}
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_null_and_repeated_ids(spark):
    rows = [(5, "alpha beta"), (5, "gamma delta"), (7, "gamma delta"), (None, "gamma  delta "), (None, "one"), (None, "one"), (9, "two"), (9, "two"), (None, None), (3, "")]
    got = sorted(map(str, exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_sha256").collect()))
    row = "Row(doc_id={}, keep_id={}, group_size={}, kept={})".format
    want = [row(5, 5, 1, True), row(5, None, 3, False), row(7, None, 3, False), row(None, None, 3, True)] + [row(None, None, 2, True)] * 2 + [row(9, 9, 2, True)] * 2 + [row(None, 3, 2, False), row(3, 3, 2, True)]
    assert got == sorted(want)


def test_exact_dedup_large_groups(docs, monkeypatch):
    from llm import tables

    want = sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    for share in (0.0, 1.0):  # all groups are broadcast, none is
        monkeypatch.setattr(tables, "HOT", share)
        assert sorted(map(str, exact_dedup.exact_dedup(docs).collect())) == want


def similar():
    sets = {}
    for i, t in TEXTS.items():
        w = split(lower(t))
        sets[i] = {tuple(w)} if 0 < len(w) < 4 else {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(docs, empty, monkeypatch, small):
    if small:  # hot shingles, large regions
        for name, value in (("CAP", 3), ("REGION", 4), ("PIVOTS", 1), ("SLICE", 2)):
            monkeypatch.setattr(jaccard_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == similar()
    if not small:
        assert jaccard_join.jaccard_components(empty).collect() == []


def shingles(text, n):
    w = split(lower(text))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def linked(found, percent):
    """The smallest id that each reaches by links of at least so many percent, by brute force."""
    label = {i: i for i in found}
    for a in found:
        for b in found:
            if a < b and found[a] and 100 * len(found[a] & found[b]) >= percent * len(found[a] | found[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_jaccard_rule_of_the_pipeline(spark):
    import corpus_pipeline

    a = [f"t{i}" for i in range(300)]
    b = [f"x{x}" if 100 <= i < 125 else x for i, x in enumerate(a)]
    c = [f"y{x}" if 60 <= i < 110 else x for i, x in enumerate(a)]
    a, b, c = map(" ".join, (a, b, c))
    like = lambda n, x, y: len(shingles(x, n) & shingles(y, n)) / len(shingles(x, n) | shingles(y, n))
    assert like(4, a, b) < 0.85 and like(5, a, b) >= 0.8 and like(5, a, c) < 0.8
    rows = spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, rows, "").collect()} == {1, 3}
    assert {r.component_id for r in jaccard_join.jaccard_components(rows).collect()} == {1, 2, 3}


@pytest.mark.parametrize("shingle, percent", [(5, 80), (3, 60)])
def test_jaccard_other_rules(docs, shingle, percent):
    found = {i: shingles(t, shingle) for i, t in TEXTS.items()}
    label = linked(found, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, shingle, percent).collect()}
    assert got == {i: (len(found[i]), label[i]) for i in found}


def test_jaccard_null_and_repeated_ids(spark):
    base = words(300)
    near = " ".join([*base[:150], "other", *base[151:]])
    rows = [(1, " ".join(words(200))), (1, " ".join(base)), (2, near), (3, " ".join(words(200))), (None, near), (None, "alone here"), (4, "alone here"), (None, ""), (3, " ".join(base))]
    got = sorted(map(str, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()))
    assert got == sorted(f"Row(doc_id={a}, component_id={b})" for a, b in [(1, 1), (1, 1), (2, 1), (3, 3), (None, 1), (None, 4), (4, 4), (None, None), (3, 1)])


def test_jaccard_pairs_leave_in_bounded_batches(monkeypatch):
    """Whatever the groups of a batch: 10,000 groups of 48 sets gave one batch of 11,280,000 pairs."""
    sizes = [2, 48, 48, 3, 1, 48, 7, 48]
    rows = [[{"a": 100 * g + i, "n": 90 + i % 5, "hot": 0} for i in range(k)] for g, k in enumerate(sizes)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.struct([("a", pa.int64()), ("n", pa.int64()), ("hot", pa.int64())])))], ["who"])
    monkeypatch.setattr(jaccard_join, "PAIRS", 1200, raising=False)
    out = list(jaccard_join._pairs(iter([batch]), jaccard_join.RULE))
    want = {(100 * g + i, 100 * g + j) for g, k in enumerate(sizes) for j in range(k) for i in range(j)}
    found = [(x, y) for b in out for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert len(found) == len(want) and set(found) == want
    assert max(b.num_rows for b in out) <= 1200


@pytest.mark.parametrize("shingle, percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_linked_sets_share_a_class(shingle, percent):
    rule = jaccard_join.Rule(shingle, percent)
    g = np.random.default_rng(shingle)
    for n in [*range(1, 40), *range(40, 2000, 61)]:
        x = np.unique(g.integers(1, 1 << 62, n)).astype(np.uint64)
        for gone in {0, 1, len(x) * (100 - percent) // 100, len(x) * (100 - percent) // 200}:
            y = np.unique(np.concatenate((g.permutation(x)[: len(x) - gone], g.integers(1, 1 << 62, gone // 2).astype(np.uint64))))
            linked = 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))
            size = np.array([len(x), 0, len(y)])
            row, key = jaccard_join.class_keys(np.array([0, len(x), len(x)]), np.concatenate((x, y)), size, rule)
            assert set(row.tolist()) <= {0, 2} and len(row) <= 2 * (len(x) + len(y)) + 40
            assert not linked or set(key[row == 0].tolist()) & set(key[row == 2].tolist()), (n, gone)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(5, 40), (1, 2), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {5: 5, **{i: 5 for i in range(10, 41)}, 1: 1, 2: 1}


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.measure(docs).collect()}
    for i, t in TEXTS.items():
        w, seen, dup = split(t), set(), 0
        for line in t.split("\n"):
            if split(line):
                dup += line in seen
                seen.add(line)
        count = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {j for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        r = got[i]
        chars, dup_line, over = sum(map(len, w)), 0, False
        for n, share in quality.COVERAGE.items():
            count = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            covered = sum(len(w[j]) for j in {j for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for j in range(k, k + n)})
            assert r[f"dup_chars_{n}"] == covered
            over |= covered > share * chars
        seen = set()
        for line in t.split("\n"):
            dup_line += sum(map(len, split(line))) * (line in seen)
            seen.add(line)
        assert r.dup_line_chars == dup_line
        over |= dup_line > quality.LINE_COVERAGE * chars or len(re.findall(r"[#*$%&|<>]", t)) > quality.SYMBOLS_PER_WORD * len(w)
        assert r.kept == (not failed and not over)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), failed)
        assert not (failed and r.kept)
    kept = quality.keep_rows(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.measure(empty).collect() == []


@pytest.mark.parametrize("spare", [False, True])
def test_line_dedup(docs, empty, spare):
    sites = collections.defaultdict(set)
    for r in ROWS:
        for line in (r[1] or "").split("\n"):
            sites[line].add(r[3] or "")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, 5, spare).collect()}
    removed = spared = 0
    for r in ROWS:
        lines = (r[1] or "").split("\n")
        full = [x for x in lines if split(x)]
        gone = [x for x in full if len(sites[x]) >= 5]
        if spare and gone and (len(gone) == len(full) or len(gone) >= line_dedup.COPY_LINES and sum(map(len, gone)) > 0.5 * sum(map(len, full))):
            gone, spared = [], spared + 1
        want = "\n".join(x for x in lines if x not in gone) if gone else r[1]
        removed += len(gone)
        assert (got[r[0]].text, got[r[0]].lines_removed) == (want, len(gone)), r[0]
    assert removed and bool(spared) == spare and line_dedup.line_dedup(empty, 5, spare).collect() == []
    assert line_dedup.without_boilerplate(docs.withColumn("line_count", F.lit("x"))).select("line_count").distinct().collect()[0][0] == "x"


def test_line_dedup_null_and_repeated_ids(spark):
    line = "a line on all sites"
    rows = [(None, f"one {i}\n{line}\n{line}", f"s{i}") for i in range(12)] + [(1, f"{line}\nmine", "s"), (1, f"mine\n{line}", "s"), (1, None, "s"), (2, f"\n{line}\n \nx", None)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert collections.Counter((r.doc_id, r.text, r.line_count, r.lines_removed) for r in got) == {(None, f"one {i}", 3, 2): 1 for i in range(12)} | {(1, "mine", 2, 1): 2, (1, None, 0, 0): 1, (2, "\n \nx", 2, 1): 1}


def test_mixing(spark, docs, empty):
    bad = {i for i in range(400) if i % 8 in (0, 5)}
    texts = [(i, " ".join(words(40)) + (" idiot scum" if i in bad else ""), i) for i in range(400)]
    more = spark.createDataFrame(texts, "doc_id long, text string, copies long")
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mix(more, labels).collect()}
    assert all((got[i].p_toxic > 0.5) == (i in bad) for i in got)  # half of them were never labelled
    assert all(got[i].copies == 0 if i in bad else got[i].copies >= 1 for i in got)
    expected = sum(r.rate * r.tokens * r.p_clean for r in got.values())
    assert expected == pytest.approx(mixing.TARGETS[0] * sum(r.tokens * r.p_clean for r in got.values()), rel=0.01)
    reached = {r.domain: r for r in mixing.totals(mixing.mix(more, labels, (0.5, 0.0, 1.5)), (0.5, 0.0, 1.5)).collect()}
    assert reached["clean"].reached == pytest.approx(reached["clean"].wanted, rel=0.05) and reached["clean"].wanted == pytest.approx(0.5 * reached["clean"].given)
    out = mixing.resample(more, labels)
    assert out.columns == more.columns and out.count() == sum(r.copies for r in got.values())
    none = labels.where("doc_id < 0")
    assert {r.copies >= 1 for r in mixing.mix(docs, none).collect()} == {True}
    assert mixing.mix(empty, labels).collect() == []


def mix_by_brute_force(rows, labels, targets):
    """{doc_id: (tokens, posteriors, rate)} of rows(doc_id, text): naive Bayes over informative words, then projected gradient over all documents in one place."""
    import regex

    words_of = lambda t: set(regex.split(r"[^\p{L}\p{N}\u00a4]+", re.sub(r"[#*$%&|<>]+", " \u00a4 ", (t or "").lower())))
    text = dict(rows)
    sample = {(text[i], 2 if toxic else 0 if quality else 1) for i, quality, toxic in labels if i in text}
    size = [sum(k == j for _, k in sample) for j in range(3)]
    every, count = sum(size), collections.defaultdict(lambda: [0, 0, 0])
    for t, k in sample:
        for w in words_of(t) - {""}:
            count[w][k] += 1
    weights = {}
    for w, n in count.items():
        total = sum(n)
        g2 = 2 * sum(x * math.log(x * every / (total * max(1, size[j]))) for j, x in enumerate(n) if x)
        share = [(x + total / every) / (size[j] + 1.0) for j, x in enumerate(n)]
        if 1 < total < every and g2 >= mixing.MIN_G2 and max(share) > mixing.MIN_RATIO * total / every:
            weights[w] = share
    prior = [math.log((n + (1e-3 if j else 1.0)) / (every + 1)) + sum(math.log1p(-w[j]) for w in weights.values()) for j, n in enumerate(size)]
    out = {}
    for i, t in rows:
        x = np.array([prior[j] + sum(math.log(weights[w][j]) - math.log1p(-weights[w][j]) for w in words_of(t) if w in weights) for j in range(3)])
        e = np.exp(x - x.max())
        out[i] = (len(split(t)), e / e.sum())
    t, p = np.array([v[0] for v in out.values()], float), np.array([v[1] for v in out.values()])
    goal = np.array(targets) * (t @ p[:, 0])
    step, rate, before = 1 / max((p.T * t @ p).sum(1)), np.ones(len(t)), None
    for _ in range(mixing.STEPS):
        error = (rate * t) @ p - goal
        if before is not None and max(abs(error - before)) < mixing.TOLERANCE * (t @ p[:, 0]) / mixing.STEPS:
            break
        before, rate = error, np.maximum(0, rate - step * p @ error)
    return {i: (v[0], v[1], r) for (i, v), r in zip(out.items(), rate)}


@pytest.mark.parametrize("targets", [mixing.TARGETS, (0.6, 0.3, 0.1)])
def test_mixing_by_brute_force(spark, targets):
    r = random.Random(3)
    own = lambda n: [r.choice(VOCABULARY) for _ in range(n)]
    kind = {i: "toxic" if i % 8 == 3 else "low" if i % 8 == 5 else "clean" for i in range(320)}
    tail = {"toxic": lambda: ["idiot", r.choice(["scum", "fool"])], "low": lambda: ["click", "here", "$$$", "win"], "clean": lambda: []}
    rows = [(i, " ".join(own(r.randrange(3, 60)) + tail[kind[i]]() * r.randrange(1, 3))) for i in kind] + [(400, None), (401, ""), (402, "idiot click")]
    rows += [(500 + i, rows[3][1]) for i in range(60)]  # copies
    labels = [(i, int(kind.get(i, "toxic") != "low"), int(kind.get(i, "toxic") == "toxic")) for i, _ in rows if i % 3 == 0]
    want = mix_by_brute_force(rows, labels, targets)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), targets).collect()
    assert len(got) == len(want)
    for x in got:
        tokens, p, rate = want[x.doc_id]
        assert x.tokens == tokens and [x.p_clean, x.p_low, x.p_toxic] == pytest.approx(p.tolist(), abs=1e-9) and x.rate == pytest.approx(rate, abs=1e-6), x.doc_id
    assert len({tuple(np.round(v[1], 6)) for v in want.values()}) > 3


def test_mixing_rare_language(spark):
    bad = {i for i in range(2000) if i % 10 == 0}
    insult = lambda i: " imbécile" if i % 200 == 0 else " idiot"
    more = spark.createDataFrame([(i, " ".join(words(20)) + (insult(i) if i in bad else "")) for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in range(2000)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mix(more, labels).collect()}
    assert all((got[i].p_toxic > 0.5) == (i in bad) for i in got)  # a twentieth of the toxic rows has the other word


def test_lm(docs, empty):
    tokens = {i: [*split(lower(t)), None] for i, t in TEXTS.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in TEXTS}
    c = collections.Counter(x for i, ts in tokens.items() if not held[i] for x in ts)
    n, v = sum(c.values()), len(c)
    for r in lm.score(docs).collect():
        ts = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ts), sum(c[x] > 0 for x in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts))
        assert r.score < 0
    assert lm.score(empty).collect() == []


def test_lm_filter():
    keys = np.random.default_rng(3).integers(0, 1 << 62, 2000).astype(np.uint64)
    counts = np.random.default_rng(4).integers(1, 5000, 2000)
    bits = np.zeros(1 << 14, np.uint64)
    for k, q in zip(keys, lm.level(counts)):
        at, b = lm._slots(np.repeat(k, q), np.arange(1, q + 1), len(bits))
        np.bitwise_or.at(bits, at, b)
    got = lm._VALUE[lm.levels(bits, keys)]
    assert (got >= counts / lm.RATIO**1.01).all() and (np.abs(np.log(got / counts)) < np.log(lm.RATIO) * 1.01).mean() > 0.98
    assert (lm.levels(bits, keys + np.uint64(1)) > 0).mean() < 0.02


def lm_by_brute_force(texts):
    """(n_known, base, score) of each text: all n-grams counted in one place, counts quantised by level."""
    tokens = {i: [*split(lower(t)), None] for i, t in texts.items()}
    one, two = collections.Counter(), collections.Counter()
    train = [ts for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    pairs = lambda ts: list(zip([None, *ts[:-1]], ts))
    for ts in train:
        one.update(ts)
        two.update(pairs(ts))
    value = lambda c: float(lm._VALUE[lm.level(c)]) if c else 0.0
    n, v, out = sum(one.values()), len(one), {}
    for i, ts in tokens.items():
        total = 0.0
        for a, b in pairs(ts):
            both = value(two[a, b])
            context = max(value(one[a]), both)
            weight = lm.WEIGHT * context / (context + lm.PRIOR)
            total += math.log10(weight * min(1, both / max(context, 1)) + (1 - weight) * (value(one[b]) + 1) / (n + v + 1))
        out[i] = (sum(one[x] > 0 for x in ts), sum(math.log10((one[x] + 1) / (n + v + 1)) for x in ts), total)
    return out


@pytest.mark.parametrize("head, frequent", [(1 << 20, 0), (1 << 20, 1 << 17), (40, 300), (3, 1 << 17), (0, 100)])
def test_lm_score_does_not_depend_on_the_filter(docs, monkeypatch, head, frequent):
    for name, x in (("HEAD_TOKENS", head), ("MAX_FREQUENT", frequent), ("SAMPLE", 1), ("OFTEN", 2), ("BITS_PER_ENTRY", 512), ("SHARD", 3000)):
        monkeypatch.setattr(lm, name, x)
    want = lm_by_brute_force(TEXTS)
    for r in lm.score(docs).collect():
        assert (r.n_known, r.base_score, r.score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1]), pytest.approx(want[r.doc_id][2], rel=1e-6)), r.doc_id


def test_lm_filters_hold_all_ngrams(docs):
    """At the bits that production uses, false positives move few scores, and these by little."""
    want = lm_by_brute_force(TEXTS)
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    trained = [i for i in got if zlib.crc32(str(i).encode()) % 7 != 2]
    assert all(got[i].n_known == want[i][0] and got[i].base_score == pytest.approx(want[i][1]) for i in got)
    assert np.mean([abs(got[i].score / want[i][2] - 1) < 1e-6 for i in trained]) > 0.8
    assert all(abs(got[i].score / want[i][2] - 1) < 0.01 for i in got)


def test_lm_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, "c"), (1, "a b a"), (1, None), (2, ""), (3, "a " * 5000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {None: 5, 1: 5, 2: 1, 3: 5001} and not got[None].held_out
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_mixing_keeps_null_ids(spark, tmp_path):
    import corpus_pipeline

    rows = spark.createDataFrame([(None, "one two"), (None, "three"), (1, "four five")], "doc_id long, text string")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.text for r in corpus_pipeline.mixing_stage(spark, rows, str(tmp_path)).collect()} == {"one two", "three", "four five"}


def test_bpe(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    c = bpe.coder()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, t in TEXTS.items():
        ids = own.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t))
    for t in ["<|endoftext|>", "I'm 's 'T  \n x", "ab" * 700, "　日本語" * 40, "² ½ ٣", "é" * 90, "\x1c\x85 \xa0"]:
        assert c.ids(t) == own.encode_ordinary(t) and c.decode(np.array(c.ids(t))).decode() == t
    assert bpe.round_trip(empty).collect() == []
    for n in (129, 1000, 5000, 65536):
        for t in ("a" * n, ("abc" * n)[:n], "".join(rnd.choice("aab\u00e9") for _ in range(n))):
            assert c.encode(t.encode()) == own._encode_single_piece(t.encode()), (n, t[:9])
    began = time.perf_counter()
    assert c.decode(np.array(c.ids("a" * 400_000))) == b"a" * 400_000 and time.perf_counter() - began < 60
    assert sorted((r.doc_id is None, r.n_tokens) for r in bpe.round_trip(docs.sparkSession.createDataFrame([(None, "one"), (1, None), (1, "")], "doc_id long, text string")).collect()) == [(False, 0), (False, 0), (True, 1)]
    decoded = {r.doc_id: bytes(r.data).decode() for r in bpe.decode(bpe.encode(docs)).collect()}
    assert decoded == TEXTS


def test_chat(spark):
    rows = [
        (1, 0, "system", "be [INST] kind \\", "x"), (1, 1, "user", "</s>[INST] ok [/INST]", "x"), (1, 2, "assistant", "<<SYS>>\\</s>", "x"),
        (2, 5, "user", None, "x"), (2, 5, "user", "", "x"), (3, 1, "assistant", "first", "x"), (4, 0, "tool: a\\", " [/TURN] ", "x"), (4, 1, None, "é", "x"), (5, None, "user", "n", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid string")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[conv].turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, role, t in turns)) and got[conv].n_turns == len(turns)
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert chat.format_conversations(df.where("conv_id > 9")).collect() == []


def test_html(spark):
    page = (
        '<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">Notice<div>x</div></div>'
        '<article><h1>Head &amp; tail&nbsp;x</h1><p>One <b>bold</b>\n two<br>three<p>Four<script>var t="</p>";</script><div class="ad">Buy</div><section id="comments"><p>me too</p></section></article>'
        "<aside>side</aside><form><p>mail?</p></form><footer>&copy; f</footer></body></html>"
    )
    host = "http://h.example.com/"
    plain = [f"<body><div>Start here or there or somewhere else</div><p>{i} own text of page</p>" for i in range(5)]
    rows = [(0, host, page, 1), (1, None, None, 1), (2, host, "", 1), (0, host, page, 1)] + [(10 + i, host + str(i), p, 1) for i, p in enumerate(plain)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.main_text(df).collect())
    article = "Head & tail x\nOne bold two three\nFour"
    want = [(0, article, len(article))] * 2 + [(1, "", 0), (2, "", 0)] + [(10 + i, f"{i} own text of page", 18) for i in range(5)]
    assert got == want
    assert html_text.main_text(df.where("page_id > 99")).collect() == []
    order, common = html_text.suffix_array(np.array([2, 1, 3, 1, 3, 1]))
    assert order.tolist() == [5, 3, 1, 0, 4, 2] and common.tolist() == [0, 1, 3, 0, 0, 2]


@pytest.mark.parametrize(
    "page, want, sure",
    [
        ("<html><head><title>x<meta><body><article><p>Hello", ["Hello"], True),
        ("<head><title>t</title><meta x><p>No body tag</p>", ["No body tag"], False),
        ('<article><p>Main text, a line of it</p></article><section class="comments"><article class="comment">me too</article></section>', ["Main text, a line of it"], True),
        ("<article><p>Main text, a line of it</p><article><p>me too</p></article></article>", ["Main text, a line of it"], True),
        ("<article><article><p>Main text, a line of it</p></article></article>", ["Main text, a line of it"], True),
        ('<aside class="ads"><article>Buy now</article></aside><article><p>Main</p></article><article class="teaser related">no</article>', ["Main"], True),
        ('<article><div class="table-header">one</div><section id="search-results">two</section><div class="cookie-notice">x</div><p>a<div class="ad">b</div>c</p></article>', ["one", "two", "a", "c"], True),
        ("<nav><ul><li>menu<article><p>Main<div>d</div></article>", ["Main", "d"], True),
        ("<form><div><article><p>Main</p><button>x</button> y <form>inner</form></article></div></form>", ["Main", "y"], True),
        ("<main><p>one<aside>no</aside><section><p>two</section></main>", ["one", "two"], True),
        ("<body><div><a href=x>link link link</a></div><p>text <a>x</a> more text</p>", ["text x more text"], False),
        ('<article><p>One <span class=ad>no</span> two &amp; three&nbsp;four<br>five</p><ul><li>a<li>b</ul><script>"<!--"</script>tail</article>', ["One two & three four five", "a", "b", "tail"], True),
        (None, [], False),
        ("<article>" + "<div>x" * 3000 + "</article>", ["x"] * 3000, True),
    ],
)
def test_html_structure(page, want, sure):
    assert html_text.blocks(page) == (want, sure)


@pytest.mark.parametrize("pages", [600, 2400])
def test_html_hosts_of_any_size(spark, pages):
    r = random.Random(pages)
    text = lambda n: [r.choice(VOCABULARY[:60]) + str(r.randrange(40)) for _ in range(n)]
    common, notices = text(12), [text(8) for _ in range(pages // 200)]
    bodies = {}
    for i in range(pages):
        w = text(30) + common + text(9)
        if i % 97 < 12 and i // 97 < len(notices):
            w += notices[i // 97]
        bodies[i] = w
    rows = spark.createDataFrame([(i, "http://one.example.com/x", f"<p>{' '.join(w)}</p>") for i, w in bodies.items()], "page_id long, url string, html string")
    count = collections.Counter(x for w in bodies.values() for x in {tuple(w[k : k + 6]) for k in range(len(w) - 5)})
    want = {}
    for i, w in bodies.items():
        gone = {j for k in range(len(w) - 5) if count[tuple(w[k : k + 6])] >= 3 for j in range(k, k + 6)}
        want[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    assert {x.page_id: x.text for x in html_text.main_text(rows).collect()} == want
    assert all(30 < len(want[i].split()) <= 39 for i in want)  # each common passage went, the rare notices too


def test_html_repeats_in_articles(spark):
    """The host's suffix array judges what is in boxes of articles, on pages with articles too."""
    line, other = "Read our weekly letter every Friday morning free", "This common line ends all texts of ours"
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(30))
    page = lambda k, more, outside="": f"<body>{outside}<article><h1>Head {k}</h1><p>{own(k)}</p>{more}</article></body>"
    text = lambda k, *more: "\n".join([f"Head {k}", own(k), *more])
    rows, want = [], {}

    def add(host, html, text):
        want[len(rows)] = text
        rows.append((len(rows), f"http://{host}.example.com/{len(rows)}", html))

    for k in range(3):
        add("a", page(k, f'<div class="box7"><p>{line}</p></div><p>{other}</p>'), text(k, other))  # a box goes, prose stays
        add("plain", page(k, f"<div>{line}</div>"), text(k, line))  # no kind of its own
        add("style", page(k, f'<div id="p1" class="para">{line}</div><div class="para" id="p2">more {own(k + 9)}</div>'), text(k, line, f"more {own(k + 9)}"))  # a kind that holds own text
        add("copies", page(7, f'<div class="box7">{line}</div>'), text(7, line))
        add("wrap", f'<article><div class="body">{page(k, f"<div class=box7>{line}</div>")[15:-17]}</div></article>', text(k))  # a box of the whole text stays
        add("two", page(k, "") + f"<article>{line} {other} {line}</article>", text(k))  # one article of several
        add("far", page(k, f'<div class="box7">{line}</div>') if k == 2 else page(k, "", f"<aside>{line}</aside>"), text(k))  # elsewhere it is in sidebars
    for k in range(2):
        add("b", page(k, f'<div class="box7">{line}</div>'), text(k, line))  # two pages only
    add("b", rows[-1][2], want[len(rows) - 1])
    rows[-1] = (rows[-2][0], *rows[-1][1:])  # one page by page_id
    got = collections.Counter((r.page_id, r.text) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == collections.Counter((rows[k][0], x) for k, x in want.items())


@pytest.mark.parametrize("pages", [512, 7])
def test_html_boxes_by_brute_force(spark, monkeypatch, pages):
    monkeypatch.setattr(html_text, "PAGES", pages)
    r = random.Random(8)
    lines = [[r.choice(VOCABULARY[:60]) + str(r.randrange(40)) for _ in range(r.randrange(5, 14))] for _ in range(12)]
    fresh = lambda: [f"{r.choice(VOCABULARY[:60])}{r.randrange(10**6)}" for _ in range(r.randrange(3, 25))]
    rows, shapes = [], {}
    for i in range(90):
        host = r.choice("abbbccccc")
        parts = [(r.choice(["", "x", "y", "z"]), r.choice(lines) if r.random() < 0.4 else fresh()) for _ in range(r.randrange(1, 6))]
        nav = r.choice(lines)
        body = "".join(f'<div class="{c}">{" ".join(w)}</div>' if c else f"<p>{' '.join(w)}</p>" for c, w in parts)
        rows.append((i, f"https://{host}.example.com/{i}?q", f"<nav>{' '.join(nav)}</nav><article>{body}</article>"))
        kept = [t for _, w in parts for t in w] if any(c for c, _ in parts) else []
        shapes[i] = host, parts, kept, nav
    six = lambda w: [tuple(w[k : k + 6]) for k in range(len(w) - 5)]
    count = collections.Counter((host, x) for host, _, kept, nav in shapes.values() for x in {*six(kept), *six(nav)})
    want = {}
    for i, (host, parts, kept, _) in shapes.items():
        gone = {j for k, x in enumerate(six(kept)) if count[host, x] >= 3 for j in range(k, k + 6)}
        at, own = 0, {""}
        for c, w in parts:
            if not gone.issuperset(range(at, at + len(w))):
                own.add(c)
            at += len(w)
        want[i] = "\n".join(" ".join(w) for c, w in parts if c in own or 2 * len(gone) > len(kept))
    assert {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want
    assert sum(want[i] != "\n".join(" ".join(w) for _, w in shapes[i][1]) for i in want) > 9


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in ROWS[::2]], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, step, str(tmp_path))
        assert after.columns == step.columns, name
        step = after.cache()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in step.collect())
    good = {r.doc_id for r in quality.measure(docs).collect() if r.kept}
    assert {r.doc_id for r in out} <= good
    # smallest of their group by the pipeline's own rule, on the texts that the stage was given
    docs_in = corpus_pipeline.line_stage(spark, corpus_pipeline.quality_stage(spark, docs, ""), "").collect()
    label = linked({r.doc_id: shingles(r.text, corpus_pipeline.SHINGLE) for r in docs_in}, corpus_pipeline.PERCENT)
    assert {i for i, low in label.items() if low == i} == {r.doc_id for r in out}


def test_helper_columns_clash_with_none_of_the_caller(spark, docs):
    """Every name that the stages of the pipeline give to helpers, as columns of the caller, in any case."""
    names = "_line_at _LINE_ID _line_text _line_count _lines_removed line_count lines_removed _mix_id _Mix_Copies _mix_copy _kept_id __line_at".split()
    more = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    plain = {(r.doc_id, r.text) for r in line_dedup.without_boilerplate(docs).collect()}
    out = line_dedup.without_boilerplate(more)
    assert out.columns == more.columns and {(r.doc_id, r.text) for r in out.collect()} == plain
    assert all(r[n] == i for r in out.select(*names).limit(3).collect() for i, n in enumerate(names))
    labels = spark.createDataFrame([(r[0], 1, 0) for r in ROWS[::2]], "doc_id long, quality int, toxic int")
    mixed = mixing.resample(more, labels)
    assert mixed.columns == more.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in mixing.resample(docs, labels).collect())


CHAT_TEMPLATES = [
    chat.TEMPLATE,
    chat.Template("<|begin|>", {"system": ("<|system|>\n", "<|end|>\n", False), "user": ("<|user|>\n", "<|end|>\n", False), "assistant": ("<|assistant|>\n", "<|end|>\n", True)}, ("<|role|>{role}|>\n", "<|end|>\n", False)),
    chat.Template("", {"user": ("Q", "|", False), "assistant": ("", "#", True)}, ("@{role}=", "|", False)),
]


@pytest.mark.parametrize("template", CHAT_TEMPLATES)
def test_chat_templates_with_planted_marks(spark, template):
    """Marks of any template in texts and roles: read back as they were, and never shown as they are."""
    r = random.Random(1)
    bits = [*template.controls(), "\\", "a", " ", "\n", ":", "=", "|", "<", "[", "role"]
    some = lambda n: "".join(r.choice(bits) for _ in range(r.randrange(n)))
    rows = [(c, t, r.choice(["system", "user", "assistant", "tool", "a:b", "", some(4)]), some(7)) for c in range(300) for t in range(r.randrange(1, 5))]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template).collect()
    for x in formatted:
        mine = [(role, text) for c, _, role, text in rows if c == x.conv_id]
        turns, loss = chat.read_back(x.formatted, [(s.start, s.end) for s in x.loss_spans], template)
        assert turns == mine and loss == [text for role, text in mine if role == "assistant"]
    long = [m for m in template.controls() if len(m) > 1]
    assert not any(m in template.escape(text) for *_, text in rows for m in long)
    with pytest.raises(ValueError):
        chat.Template(turns={"user": ("", "|", False), "assistant": ("", "#", True)})
