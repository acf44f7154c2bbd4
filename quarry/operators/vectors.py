"""Exact nearest vectors by cosine from an inverted file.

Vectors are brought to unit length once and stored in lists, one for each cluster, with their distance from
the cluster's centre. By the triangle inequality no vector of a list is nearer to a query than the centre's distance less
the list's radius. A query first reads the lists nearest to it; its k-th best score there bounds which other
lists, and which vectors in them, can hold anything better. Centres come from a sample of SAMPLE vectors: they
decide how much is read, never what is found.

Lists and queries meet in blocks of BLOCK rows at most each, so that neither a large list nor many queries gather in
one task; a block is one product of two matrices and gives the k best of each query in it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .retrieval import finite, top_k, unit_length

#: Vectors that centres are fitted on, centres at most, rounds of fitting; rows of a block; vectors for each wanted hit that a query reads first.
SAMPLE, CENTRES, ROUNDS, BLOCK, PROBE = 8192, 1024, 8, 4096, 8
#: Slack for the rounding of distances.
SLACK = 1e-9


class VectorIndex(NamedTuple):
    """lists(cluster, id, v, far, ...): far is the distance to the cluster's centre; a row of centres for each cluster, with its rows, radius and the squared length of its vectors (0 or 1)."""

    lists: DataFrame
    centres: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    square: np.ndarray


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def fit_centres(sample: np.ndarray, n: int) -> np.ndarray:
    """n centres by Lloyd's rounds, from evenly spaced rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = _distances(sample, centres).argmin(1)
        for c in np.unique(nearest):
            centres[c] = sample[nearest == c].mean(0)
    return centres


def build_index(vectors: DataFrame, extra: tuple[str, ...] = (), centres: int | None = None) -> VectorIndex:
    """The index of vectors(id, v, and the columns `extra`); vectors that aren't finite or are empty are left out, those of several sizes raise."""
    rows = stored(unit_length(vectors, "v").select("id", "v", *extra))
    shape = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if shape["n"] and shape["least"] != shape["most"]:
        raise ValueError("embeddings of several sizes")
    sample = rows.where(F.exists("v", lambda x: x != 0)).select("v", F.xxhash64("id", "v").alias("o")).orderBy("o").limit(SAMPLE).select("v").toArrow()["v"]
    width = shape["most"] or 0
    points = _matrix(sample) if len(sample) else np.zeros((0, width))
    n = centres or min(CENTRES, max(1, int(shape["n"] ** 0.5)))
    # the last list is that of vectors without length
    points = np.vstack([fit_centres(points, n) if len(points) else points, np.zeros((1, width))])
    last = len(points) - 1

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = _matrix(part.column("v"))
                length = (v * v).sum(1) > 0
                near = _distances(v, points[:last]) if last else np.zeros((len(v), 0))
                cluster = np.where(length, near.argmin(1) if last else last, last)
                far = np.where(length, near[np.arange(len(v)), np.minimum(cluster, max(0, last - 1))] if last else 0.0, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(far), *part.columns], ["cluster", "far", *part.schema.names])

    schema = "cluster int, far double, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    lists = stored(rows.mapInArrow(assign, schema).repartition("cluster", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("cluster"))
    found = {r["cluster"]: r for r in lists.groupBy("cluster").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # one row a centre
    of = lambda name, none: np.array([found[c][name] if c in found else none for c in range(last + 1)], float)
    return VectorIndex(lists, points, of("n", 0), of("far", 0.0), np.array([1.0] * last + [0.0]))


def _block(k: int):
    """The k best of each query of a block among its vectors, by score in millionths and id; those that can't reach the query's floor are not scored."""

    def best(key, lists: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": queries["query_id"].slice(0, 0), "id": lists["id"].slice(0, 0), "score": pa.array([], pa.float64()), "scored": pa.array([], pa.int64())}
        if len(lists) and len(queries):
            far, away, floor, square = lists["far"].to_numpy(), queries["away"].to_numpy(), queries["floor"].to_numpy(), queries["square"].to_numpy()
            q, v = _matrix(queries["qv"]), _matrix(lists["v"])
            own = (q * q).sum(1) > 0
            order, at, scores, taken, scored = np.argsort(np.argsort(lists["id"].combine_chunks().to_numpy(zero_copy_only=False), kind="stable")), [], [], [], 0
            for i in range(len(q)):
                reach = (own[i] + square[i] - np.maximum(np.abs(away[i] - far) - SLACK, 0) ** 2) / 2
                open_ = np.flatnonzero(reach >= floor[i] - SLACK)
                scored += len(open_)
                if not len(open_):
                    continue
                s = v[open_] @ q[i]
                first = np.lexsort((order[open_], -np.floor(s * 1e6 + 0.5)))[:k]
                at.append(np.full(len(first), i))
                taken.append(open_[first])
                scores.append(s[first])
            if at:
                i, j = pa.array(np.concatenate(at)), pa.array(np.concatenate(taken))
                n = np.zeros(len(i), np.int64)
                n[0] = scored
                out = {"query_id": queries["query_id"].take(i), "id": lists["id"].take(j), "score": pa.array(np.concatenate(scores)), "scored": pa.array(n)}
        return pa.table(out)

    return best


def search(index: VectorIndex, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank, scored): the k best of each of queries(query_id, qv) among the index's vectors, of those where the condition on its columns holds.

    Exact: the rows are those of scoring all pairs. `scored` is the number of pairs that a block of this row scored, on one of its rows. Queries that aren't finite or of another size have no hits.
    """
    lists = index.lists if where is None else index.lists.where(where)
    width, centres, rows, radius, square = index.centres.shape[1], index.centres, index.rows, index.radius, index.square
    q = unit_length(queries, "qv").where(F.size("qv") == width).select("query_id", "qv")
    kinds = {f.name: f.dataType.simpleString() for f in [*lists.schema, *q.schema]}

    def pairs(first: bool):
        def of(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    v = _matrix(part.column("qv"))
                    away = _distances(v, centres)
                    order = np.argsort(away, 1, kind="stable")
                    before = np.cumsum(rows[order], 1) - rows[order]
                    probe = np.zeros(away.shape, bool)
                    np.put_along_axis(probe, order, before < PROBE * k, 1)
                    floor = np.full(len(v), -np.inf)
                    if not first:
                        floor = part.column("floor").to_numpy(zero_copy_only=False).astype(float)
                        floor = np.where(np.isnan(floor), -np.inf, floor)
                        reach = (((v * v).sum(1) > 0)[:, None] + square - np.maximum(away - radius - SLACK, 0) ** 2) / 2
                        probe = ~probe & (reach >= floor[:, None] - SLACK)
                    i, c = np.nonzero(probe & (rows > 0))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("query_id").take(pa.array(i)), part.column("qv").take(pa.array(i)), pa.array(c, pa.int32()), pa.array(away[i, c]), pa.array(floor[i]), pa.array(square[c])],
                        ["query_id", "qv", "cluster", "away", "floor", "square"],
                    )

        return of

    blocks = q.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks"))  # one row
    parts = F.coalesce(F.element_at(F.lit([max(1, int(-(-n // BLOCK))) for n in rows]), F.col("cluster") + 1), F.lit(1)).cast("int")
    cut = lists.select("cluster", "id", "v", "far", F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int").alias("part")).join(F.broadcast(blocks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def met(asked: DataFrame, first: bool) -> DataFrame:
        p = asked.mapInArrow(pairs(first), f"query_id {kinds['query_id']}, qv array<double>, cluster int, away double, floor double, square double")
        p = p.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).join(F.broadcast(blocks)).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit("block")), F.col("blocks")).cast("int")).drop("blocks")
        keys = ["cluster", "part", "block"]
        return cut.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(_block(k), f"query_id {kinds['query_id']}, id {kinds['id']}, score double, scored long")

    near = stored(met(q, True))
    rank = lambda hits: top_k(hits.withColumn("score", F.round("score", 6)), k)
    floor = rank(near).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score") - 1e-6).alias("floor"))
    return rank(near.union(met(q.join(floor, "query_id", "left").select("query_id", "qv", "floor"), False)))


#: Numbers of a block of vectors, of a block of queries, and of their products that are in memory at once.
ELEMENTS = 4 << 20


def _products(k: int, dated: bool = False):
    """The k best of each query of a block among a block of vectors, by score in millionths (halves away from zero, as `round` has it) and id; with `dated` among those in its half-open window."""

    def best(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        at, taken, scores = [], [], []
        if len(vectors) and len(queries):
            v, q = _matrix(vectors["v"]), _matrix(queries["qv"])
            order = np.argsort(np.argsort(vectors["id"].combine_chunks().to_numpy(zero_copy_only=False), kind="stable"))
            step = max(1, ELEMENTS // len(v))
            day, since, until = (np.array([x or "" for x in c.to_pylist()], "U") for c in (vectors["event_date"], queries["date_from"], queries["date_to"])) if dated else (None, None, None)
            for begin in range(0, len(q), step):
                s = q[begin : begin + step] @ v.T
                s = np.copysign(np.floor(np.abs(s) * 1e6 + 0.5), s)
                for i, row in enumerate(s):
                    if dated:
                        inside = (day != "") & (day >= since[begin + i]) & (day < until[begin + i])
                        row = np.where(inside, row, -np.inf)
                    near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                    near = near[inside[near]] if dated else near
                    first = near[np.lexsort((order[near], -row[near]))[:k]]
                    at.append(np.full(len(first), begin + i))
                    taken.append(first)
                    scores.append(row[first] / 1e6 + 0.0)
        i, j, score = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((at, np.int64), (taken, np.int64), (scores, np.float64)))
        return pa.table({"query_id": queries["query_id"].take(pa.array(i)), "id": vectors["id"].take(pa.array(j)), "score": pa.array(score)})

    return best


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, dated: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k best of each of queries(query_id, qv) among vectors(id, v), all pairs scored: top_k of `cosine`. With `dated`, among vectors whose event_date is from the query's date_from to before its date_to.

    Blocks of vectors meet blocks of queries, each pair of blocks as one product of matrices in a task, which gives its k best of each query; so a task holds two blocks, whatever the tables' sizes.
    """
    day, window = (["event_date"], ["date_from", "date_to"]) if dated else ([], [])
    v, q = (stored(unit_length(t.select(key, c, *more), c)) for t, key, c, more in ((vectors, "id", "v", day), (queries, "query_id", "qv", window)))
    many = lambda t, c: t.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size(c)) / ELEMENTS)).cast("int").alias("n"))  # noqa: E731  # one row
    parts, blocks = (F.broadcast(many(t, c).select(F.coalesce("n", F.lit(1)).alias(n))) for t, c, n in ((v, "v", "parts"), (q, "qv", "blocks")))
    deal = lambda key, n: F.pmod(F.xxhash64(key, F.lit(n)), F.col(n)).cast("int")
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    v = v.join(parts).join(blocks).select("id", "v", *day, F.size("v").alias("width"), deal("id", "parts").alias("part"), spread("blocks", "block"))
    q = q.join(parts).join(blocks).select("query_id", "qv", *window, F.size("qv").alias("width"), deal("query_id", "blocks").alias("block"), spread("parts", "part"))
    keys, kinds = ["width", "part", "block"], {f.name: f.dataType.simpleString() for f in [*v.schema, *q.schema]}
    return top_k(v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(_products(k, dated), f"query_id {kinds['query_id']}, id {kinds['id']}, score double"), k)
