"""The inverted file against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.operators import vectors as V


def clustered(n, width, groups, seed=1):
    g = np.random.default_rng(seed)
    centres = g.standard_normal((groups, width)) * 6
    return centres[g.integers(0, groups, n)] + g.standard_normal((n, width))


def direct(rows, queries, k):
    out = set()
    for qid, q in queries:
        scored = []
        for i, v in rows:
            n = np.sqrt(np.dot(v, v)) or 1, np.sqrt(np.dot(q, q)) or 1
            scored.append((-np.floor(np.dot(np.divide(v, n[0]), np.divide(q, n[1])) * 1e6 + 0.5) / 1e6, i))
        out |= {(qid, i, r, round(-s, 6)) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def found(df):
    return {(r.query_id, r.id, r["rank"], round(r.score, 6)) for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 37])
def test_index_finds_what_brute_force_finds(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    x = clustered(1200, 12, 25).tolist()
    x += [x[5]] * 60 + [[0.0] * 12] * 3 + [[-a for a in x[7]]]  # copies, vectors without length, an opposite
    rows = list(enumerate(x))
    table = spark.createDataFrame(rows + [(9000, [float("nan")] * 12), (9001, []), (9002, None)], "id long, v array<double>").repartition(3)
    queries = [(i, x[i]) for i in range(0, 1200, 24)] + [(7000, [0.0] * 12), (7001, x[5])]
    asked = spark.createDataFrame(queries + [(7002, [1.0]), (7003, None)], "query_id long, qv array<double>")
    index = V.build_index(table)
    got = V.search(index, asked, 7).cache()
    assert found(got) == direct(rows, queries, 7)
    even = V.search(V.build_index(table.withColumn("even", F.col("id") % 2 == 0), ("even",)), asked, 7, F.col("even"))
    assert found(even) == direct([r for r in rows if r[0] % 2 == 0], queries, 7)
    assert V.search(index, asked.limit(0), 7).count() == 0 and V.search(V.build_index(table.limit(0)), asked, 7).count() == 0


def test_index_scores_few_pairs_of_clustered_vectors(spark, monkeypatch):
    x = clustered(4000, 16, 40).tolist()
    table = spark.createDataFrame(list(enumerate(x)), "id long, v array<double>")
    asked = spark.createDataFrame([(i, x[i]) for i in range(0, 4000, 100)], "query_id long, qv array<double>")
    seen = []
    monkeypatch.setattr(V, "top_k", lambda hits, k: seen.append(hits) or R.top_k(hits, k))
    V.search(V.build_index(table), asked, 10).count()
    scored = seen[-1].agg(F.sum("scored")).first()[0]
    assert 40 * 10 <= scored < 0.2 * 40 * 4000


def test_sizes_that_differ_raise(spark):
    with pytest.raises(ValueError):
        V.build_index(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"))


def test_time_of_cosine_grows_in_proportion_to_the_dimension(spark):
    """The norm is computed once a vector: four times the dimension must not cost sixteen times the time."""

    def seconds(width):
        v = spark.createDataFrame([(i, r) for i, r in enumerate(np.random.default_rng(width).standard_normal((400, width)).tolist())], "id long, v array<double>").cache()
        q = v.where("id < 4").select(F.col("id").alias("query_id"), F.col("v").alias("qv")).cache()
        v.count(), q.count()
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            assert R.cosine(v, q).where(F.col("score") > 2).count() == 0
            best = min(best, time.perf_counter() - began)
        return best

    seconds(64)
    assert seconds(1536) < 8 * seconds(384) + 1


def test_blocks_of_products_give_the_best_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "ELEMENTS", 64)
    r = np.random.default_rng(3)
    rows = [(i, x) for i, x in enumerate([*r.integers(-2, 3, (120, 4)).astype(float).tolist(), [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan")] * 4, [1.0, 2.0], [2.0, 4.0], []])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    for k in (1, 7, 200):
        want = {tuple(x) for x in R.top_k(R.cosine(v, q), k).select("query_id", "id", "score", "rank").collect()}
        assert {tuple(x) for x in V.cosine_top_k(v, q, k).select("query_id", "id", "score", "rank").collect()} == want
    assert V.cosine_top_k(v, q.where("query_id < 0"), 3).count() == V.cosine_top_k(v.where("id < 0"), q, 3).count() == 0


def test_products_within_a_window_of_dates(spark, monkeypatch):
    monkeypatch.setattr(V, "ELEMENTS", 64)
    r = np.random.default_rng(5)
    v = spark.createDataFrame([(i, x, f"2024-01-{i % 28 + 1:02d}" if i % 9 else None) for i, x in enumerate(r.integers(-2, 3, (120, 4)).astype(float).tolist())], "id long, v array<double>, event_date string")
    q = v.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.lit("2024-01-04").alias("date_from"), F.when(F.col("id") % 2 == 0, "2024-01-15").otherwise("2024-01-05").alias("date_to"))
    every = R.cosine(v, q).join(q, "query_id").join(v.select("id", "event_date"), "id").where("event_date >= date_from AND event_date < date_to")
    for k in (1, 7, 200):
        want = {tuple(x) for x in R.top_k(every.select("query_id", "id", "score"), k).select("query_id", "id", "score", "rank").collect()}
        assert want and {tuple(x) for x in V.cosine_top_k(v, q, k, True).select("query_id", "id", "score", "rank").collect()} == want
