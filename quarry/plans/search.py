"""Registered queries on text analysis and ranked retrieval, each with equivalent SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import text_index as X
from ..operators import vectors as V
from ..sources.store import shared_dir, stored
from ..sources.tables import UNITS_SQL, dated, read, transcript_units, units

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


TOKENS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
FOLD_SQL = "translate(lower({}), '" + T.ACCENTS[0] + "', '" + T.ACCENTS[1] + "')"


@register("SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, " + TOKENS_SQL.format("text") + " AS t FROM documents)")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokenize(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


TERMS_SQL = (
    f"list_distinct_ordered AS (SELECT item_id, t, min(k) AS k FROM (SELECT item_id, unnest(tok) AS t, generate_subscripts(tok, 1) AS k FROM (SELECT item_id, {TOKENS_SQL.format('text')} AS tok FROM benchmark)) "
    f"WHERE length(t) >= 2 AND t NOT IN ({quoted(T.STOPWORDS + T.TEMPORAL_CUES)}) GROUP BY item_id, t), "
    f"cued AS (SELECT item_id FROM benchmark WHERE list_has_any({TOKENS_SQL.format('text')}, [{quoted(T.QUANTITY_CUES)}])), "
    "terms AS (SELECT item_id, t, k FROM list_distinct_ordered UNION ALL SELECT c.item_id, 'percent', 1000000 FROM cued c WHERE NOT EXISTS (SELECT 1 FROM list_distinct_ordered l WHERE l.item_id = c.item_id AND l.t = 'percent'))"
)


@register(f"WITH {TERMS_SQL} SELECT b.item_id, coalesce(string_agg(t, ' ' ORDER BY k), '') AS terms FROM benchmark b LEFT JOIN terms USING (item_id) GROUP BY b.item_id")
def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.topic_terms(F.col("text")), " ").alias("terms"))


def _stem_sql(t: str) -> str:
    cut = "CASE " + " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) - {len(s)} >= {T.MIN_STEM} THEN left({t}, length({t}) - {len(s)})" for s in T.SUFFIXES) + " END"
    double = f"length({cut}) > 4 AND right({cut}, 1) = substr({cut}, length({cut}) - 1, 1) AND right({cut}, 1) NOT IN ('a', 'e', 'i', 'o', 'u')"
    return f"coalesce(CASE WHEN {double} THEN left({cut}, length({cut}) - 1) ELSE {cut} END, {t})"


@register(f"SELECT token, {_stem_sql('token')} AS stem FROM (SELECT DISTINCT unnest({TOKENS_SQL.format('text')}) AS token FROM documents)")
def light_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.explode(T.tokenize(F.col("text"))).alias("token")).distinct().select("token", T.light_stem(F.col("token")).alias("stem"))


@register(f"WITH {UNITS_SQL} SELECT evidence_id, regexp_matches(rtrim(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_text, '(?i)\\[Image removed by sender\\]', ' ', 'g'), '(?i)\\[cid:[^\\]]*\\]', ' ', 'g'), '(?i)Bild borttagen av avs[äa]ndaren', ' ', 'g'), '(^|[^A-Za-z])Image([^A-Za-z]|$)', '\\1 \\2', 'g'), '[ \t]+', ' ', 'g'))), '[—–]$') AS is_truncated FROM units")
def truncation_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("evidence_id", T.is_truncated(F.col("raw_text")).alias("is_truncated"))


@register(
    f"""WITH q AS (SELECT conv_id, turn, lower(text) || CASE turn % 5 WHEN 0 THEN ' is it still so in march 2024?' WHEN 1 THEN ' list all changes of 2023 and 2025' WHEN 2 THEN ' every single figure' WHEN 3 THEN ' december of 2024' ELSE '' END AS t FROM conversations)
SELECT conv_id, turn, regexp_matches(t, '{T.any_of(T.TEMPORAL_PHRASES)}') OR list_has_any({TOKENS_SQL.format('t')}, [{quoted(T.TEMPORAL_CUES)}]) AS temporal,
  regexp_matches(t, '{T.any_of(T.ENUMERATIVE_PHRASES)}') OR regexp_matches(t, '{T.ENUMERATIVE_QUANTIFIED}') AS enumerative,
  CASE turn % 5 WHEN 0 THEN '2024-03-01' WHEN 1 THEN '2023-01-01' WHEN 3 THEN '2024-12-01' END AS date_from, CASE turn % 5 WHEN 0 THEN '2024-04-01' WHEN 1 THEN '2026-01-01' WHEN 3 THEN '2025-01-01' END AS date_to FROM q"""
)
def query_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing of questions: conversations with a question put behind each turn."""
    tails = {0: " is it still so in march 2024?", 1: " list all changes of 2023 and 2025", 2: " every single figure", 3: " december of 2024"}
    tail = F.lit("")
    for k, v in tails.items():
        tail = F.when(F.col("turn") % 5 == k, v).otherwise(tail)
    q = read(spark, sf_dir, "conversations").withColumn("t", F.concat("text", tail))
    window = T.date_range(F.col("t"))
    return q.select("conv_id", "turn", T.is_temporal(F.col("t")).alias("temporal"), T.is_enumerative(F.col("t")).alias("enumerative"), window["from"].alias("date_from"), window["to"].alias("date_to"))


# --- BM25 over documents, with the benchmark's passages as queries -----------------------------


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole benchmark passage as a question."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_FIELDS = {"body": "text", "title": "source", "speaker": "lang"}


def _stored_index(spark: SparkSession, sf_dir: str) -> X.TextIndex:
    """The index of the documents, without placeholders of mail programs, kept in the shared folder: cut into tokens once, brought up to date when it is opened."""
    name = hashlib.md5(f"{sf_dir} {sorted(_FIELDS.items())}".encode()).hexdigest()
    return X.open_index(_indexed(spark, sf_dir), _FIELDS, f"{shared_dir(spark)}/indexes/{name}", cleaned={"body": T.index_text})


def _hits(spark: SparkSession, sf_dir: str) -> tuple[X.TextIndex, list[X.Round]]:
    """The index, and what the phrases of the questions hit."""
    index = _stored_index(spark, sf_dir)
    return index, X.hits(index, R.query_phrases(_questions(spark, sf_dir)))


def _best(spark: SparkSession, sf_dir: str, weights: dict[str, float], k: int) -> DataFrame:
    """The k best documents of each question by one weighting."""
    return X.best(*_hits(spark, sf_dir), {"": X.Ask(weights, k)}).drop("list")


def _bm25_sql(weights: dict[str, float], name: str) -> str:
    weight = " ".join(f"WHEN '{f}' THEN {w}" for f, w in weights.items())
    return f"""
{name}_hits AS (SELECT phrase, prefix, id, sum(CASE field {weight} END * tf) AS f FROM matched JOIN postings USING (token) GROUP BY ALL),
{name}_df AS (SELECT phrase, prefix, count(*) AS df FROM {name}_hits GROUP BY ALL),
{name} AS (SELECT query_id, id, round(sum(greatest(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END, 0) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean_size))), 6) AS score
  FROM phrases JOIN {name}_hits USING (phrase, prefix) JOIN {name}_df USING (phrase, prefix) JOIN sizes USING (id), stats GROUP BY ALL)"""


#: What the index reads of a text.
SEARCH_TEXT_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\[Image removed by sender\]', ' ', 'g'), '(?i)\[cid:[^\]]*\]', ' ', 'g'), '(?i)Bild borttagen av avs[äa]ndaren', ' ', 'g'), '(^|[^A-Za-z])Image($|[^A-Za-z])', '\1 \2', 'g')"""


def search_sql(questions: str = "SELECT item_id, text FROM benchmark", consumed: str = "false") -> str:
    """CTEs of BM25 over the documents for questions(item_id, text); `consumed` is a condition on terms t that don't count."""
    return f"""
asked AS ({questions}),
fields AS (SELECT doc_id AS id, 'body' AS field, {SEARCH_TEXT_SQL} AS t FROM documents UNION ALL SELECT doc_id, 'title', source FROM documents UNION ALL SELECT doc_id, 'speaker', lang FROM documents),
postings AS (SELECT id, field, token, count(*) AS tf FROM (SELECT id, field, unnest(regexp_extract_all({FOLD_SQL.format("coalesce(t, '')")}, '[\\p{{L}}\\p{{N}}]+')) AS token FROM fields) GROUP BY ALL),
sizes AS (SELECT id, sum(tf) AS size FROM postings GROUP BY id), stats AS (SELECT count(*) AS n_docs, avg(size) AS mean_size FROM sizes),
qterms AS (SELECT DISTINCT item_id AS query_id, t FROM (SELECT item_id, unnest({TOKENS_SQL.format('text')}) AS t FROM asked) WHERE NOT ({consumed}) AND length(t) >= 2 AND t NOT IN ({quoted(T.STOPWORDS + T.TEMPORAL_CUES)})
  UNION SELECT item_id, 'percent' FROM asked WHERE list_has_any({TOKENS_SQL.format('text')}, [{quoted(T.QUANTITY_CUES)}])),
stems AS (SELECT query_id, t, {_stem_sql('t')} AS v FROM qterms UNION SELECT query_id, t, CASE {_stem_sql('t')} WHEN 'decid' THEN 'decis' ELSE 'signat' END FROM qterms WHERE {_stem_sql('t')} IN ('decid', 'sign')),
phrases AS (SELECT DISTINCT query_id, CASE WHEN length(v) >= {T.MIN_STEM} THEN v ELSE t END AS phrase, length(v) >= {T.MIN_STEM} AS prefix FROM stems),
matched AS (SELECT p.phrase, p.prefix, token FROM (SELECT DISTINCT phrase, prefix FROM phrases) p JOIN (SELECT DISTINCT token FROM postings) v ON (p.prefix AND starts_with(v.token, p.phrase)) OR v.token = p.phrase),
{_bm25_sql(R.BODY_WEIGHTS, 'body')}, {_bm25_sql(R.TITLE_WEIGHTS, 'title')},
body_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM body) WHERE rank <= 15),
title_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM title) WHERE rank <= 15)"""


SEARCH_SQL = search_sql()


@register(f"WITH {SEARCH_SQL} SELECT query_id, id AS doc_id, score, rank FROM body_top")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, R.BODY_WEIGHTS, 15).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@register(f"WITH {SEARCH_SQL} SELECT query_id, id AS doc_id, score, rank FROM title_top")
def bm25_title_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, R.TITLE_WEIGHTS, 15).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


CAP_SQL = """
wide AS (SELECT b.*, d.source AS document_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS w FROM {} b JOIN documents d ON d.doc_id = b.id QUALIFY w <= {}),
capped AS (SELECT * FROM (SELECT query_id, id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY w) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY w) AS nth FROM wide) WHERE nth <= {}) WHERE rank <= {})"""


def _with_source(scored: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("document_id")), "id")


@register(f"WITH {SEARCH_SQL}, {CAP_SQL.format('body', 120, 2, 15)} SELECT query_id, id AS doc_id, document_id, score, rank FROM capped")
def per_document_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _with_source(_best(spark, sf_dir, R.BODY_WEIGHTS, 8 * 15).drop("rank"), spark, sf_dir)
    return R.capped_top_k(scored, 15, 2).select("query_id", F.col("id").alias("doc_id"), "document_id", "score", "rank")


@register(
    f"""WITH {SEARCH_SQL}, parts AS (SELECT query_id, id, CAST(1.0 AS DOUBLE) / (60 + rank) AS part FROM body_top UNION ALL SELECT query_id, id, CAST(1.5 AS DOUBLE) / (60 + rank) FROM title_top),
fused AS (SELECT query_id, id, round(sum(part), 9) AS score, count(*) AS n_lists FROM parts GROUP BY ALL)
SELECT query_id, id AS doc_id, score, n_lists, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 15"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(X.best(*_hits(spark, sf_dir), {"body": X.Ask(R.BODY_WEIGHTS, 15), "title": X.Ask(R.TITLE_WEIGHTS, 15)}))
    return R.fuse([(found.where("list = 'body'"), 1.0), (found.where("list = 'title'"), 1.5)], 15).select("query_id", F.col("id").alias("doc_id"), "score", "n_lists", "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = read(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


COSINE_SQL = """
cosines AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)"""


@register(f"WITH {COSINE_SQL} SELECT query_id, id AS vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cosines QUALIFY rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set, every hundredth vector, against all vectors."""
    return V.cosine_top_k(*_vectors(spark, sf_dir), 10).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@register(
    f"WITH {COSINE_SQL} SELECT query_id, id AS vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cosines "
    "WHERE strftime(DATE '2024-01-01' + CAST(id % 365 AS INTEGER), '%Y-%m-%d') >= '2024-03-01' AND strftime(DATE '2024-01-01' + CAST(id % 365 AS INTEGER), '%Y-%m-%d') < '2024-07-01' QUALIFY rank <= 10"
)
def cosine_topk_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered by date before scoring."""
    v, q = _vectors(spark, sf_dir)
    v = v.where((dated(F.col("id")) >= "2024-03-01") & (dated(F.col("id")) < "2024-07-01"))
    return V.cosine_top_k(v, q, 10).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@register(f"WITH {COSINE_SQL} SELECT query_id, id AS vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cosines QUALIFY rank <= 10")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the inverted file: lists that the triangle inequality rules out are not scored."""
    v, q = _vectors(spark, sf_dir)
    return V.search(V.build_index(v), q, 10).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@register(
    f"WITH {COSINE_SQL} SELECT query_id, id AS vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cosines "
    "WHERE strftime(DATE '2024-01-01' + CAST(id % 365 AS INTEGER), '%Y-%m-%d') >= '2024-03-01' AND strftime(DATE '2024-01-01' + CAST(id % 365 AS INTEGER), '%Y-%m-%d') < '2024-07-01' QUALIFY rank <= 10"
)
def vector_search_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted file, with a date stored beside each vector and filtered before scoring."""
    v, q = _vectors(spark, sf_dir)
    index = V.build_index(v.withColumn("event_date", dated(F.col("id"))), ("event_date",))
    return V.search(index, q, 10, F.col("event_date").between("2024-03-01", "2024-06-30")).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


HYBRID_SQL = f"""
{SEARCH_SQL}, {CAP_SQL.format('title', 120, 4, 15)},
semantic AS (SELECT b.item_id AS query_id, v.vec_id AS id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v),
semantic_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM semantic QUALIFY rank <= 15),
parts AS (SELECT query_id, id, CAST(1.0 AS DOUBLE) / (60 + rank) AS part FROM body_top UNION ALL SELECT query_id, id, CAST(1.5 AS DOUBLE) / (60 + rank) FROM capped UNION ALL SELECT query_id, id, CAST(1.0 AS DOUBLE) / (60 + rank) FROM semantic_top),
fused AS (SELECT query_id, id, round(sum(part), 9) AS score, count(*) AS n_lists FROM parts GROUP BY ALL),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 15)"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(X.best(*_hits(spark, sf_dir), {"body": X.Ask(R.BODY_WEIGHTS, 15), "title": X.Ask(R.TITLE_WEIGHTS, 8 * 15)}))
    lexical = found.where("list = 'body'")
    title = R.capped_top_k(_with_source(found.where("list = 'title'").drop("list", "rank"), spark, sf_dir), 15, 4)
    v, _ = _vectors(spark, sf_dir)
    q = read(spark, sf_dir, "benchmark").join(v, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("query_id"), F.col("v").alias("qv"))
    return stored(R.fuse([(lexical, 1.0), (title, 1.5), (V.cosine_top_k(v, q, 15), 1.0)], 15))


@register(f"WITH {HYBRID_SQL} SELECT query_id, rank, score, n_lists, d.doc_id, source AS document_id, lang, length(text) AS n_chars FROM hybrid JOIN documents d ON d.doc_id = id")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical, title and semantic lists fused by rank, then hydrated; ids without a live row drop out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document_id"), "lang", F.length("text").cast("long").alias("n_chars"))
    return hybrid(spark, sf_dir).join(docs, F.col("id") == F.col("doc_id")).select("query_id", "rank", "score", "n_lists", "doc_id", "document_id", "lang", "n_chars")


SWEEP_SQL = f"""{SEARCH_SQL},
after AS (SELECT query_id, min(strftime(DATE '2024-01-01' + CAST(id % 365 AS INTEGER), '%Y-%m-%d')) AS after_date FROM body_top WHERE rank <= 5 GROUP BY query_id),
sweep AS (SELECT b.query_id, id, score, after_date, row_number() OVER (PARTITION BY b.query_id ORDER BY score DESC, id) AS rank FROM body b JOIN after a ON a.query_id = b.query_id
  WHERE strftime(DATE '2024-01-01' + CAST(id % 365 AS INTEGER), '%Y-%m-%d') > after_date QUALIFY rank <= 10)"""


def _sweep(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index, rounds = _hits(spark, sf_dir)
    first = stored(X.best(index, rounds, {"": X.Ask(R.BODY_WEIGHTS, 15)}).drop("list"))
    after = stored(first.where("rank <= 5").groupBy("query_id").agg(F.min(dated(F.col("id"))).alias("after_date")))
    window = after.select("query_id", F.date_add(F.col("after_date").cast("date"), 1).cast("string").alias("date_from"), F.lit("9999").alias("date_to"))
    later = X.best(index, rounds, {"": X.Ask(R.BODY_WEIGHTS, 10, window)}, dated(F.col("id"))).drop("list")
    return first, later.join(after, "query_id")


@register(f"WITH {SWEEP_SQL} SELECT query_id, id AS doc_id, score, after_date, rank FROM sweep")
def temporal_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence strictly later than the earliest date of the five best hits."""
    return _sweep(spark, sf_dir)[1].select("query_id", F.col("id").alias("doc_id"), "score", "after_date", "rank")


@register(f"WITH {SWEEP_SQL} SELECT s.query_id, s.id AS doc_id, s.rank FROM sweep s LEFT JOIN body_top b ON b.query_id = s.query_id AND b.id = s.id WHERE b.id IS NULL")
def evidence_set_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a later sweep adds to the hits."""
    first, later = _sweep(spark, sf_dir)
    return later.join(first, ["query_id", "id"], "left_anti").select("query_id", F.col("id").alias("doc_id"), "rank")


@register(f"WITH {SWEEP_SQL} SELECT query_id, id AS doc_id, min(seq) AS seq FROM (SELECT query_id, id, rank AS seq FROM body_top UNION ALL SELECT query_id, id, 100 + rank FROM sweep) GROUP BY ALL")
def visible_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered union of hits and later evidence: each id at its first place."""
    first, later = _sweep(spark, sf_dir)
    both = first.select("query_id", "id", F.col("rank").cast("long").alias("seq")).union(later.select("query_id", "id", (100 + F.col("rank")).cast("long")))
    return both.groupBy("query_id", F.col("id").alias("doc_id")).agg(F.min("seq").alias("seq"))


@register(
    f"""WITH {SEARCH_SQL}, judged AS (SELECT b.item_id, min(rank) FILTER (contains(d.text, b.text)) AS first FROM benchmark b LEFT JOIN body_top t ON t.query_id = b.item_id LEFT JOIN documents d ON d.doc_id = t.id GROUP BY ALL)
SELECT count(*) AS topics, count(*) FILTER (first <= 5) AS in_top_5, count(*) FILTER (first <= 10) AS in_top_10, count(*) FILTER (first IS NOT NULL) AS visible, round(avg(1.0 / first), 6) AS mean_reciprocal_rank FROM judged"""
)
def benchmark_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval quality: a hit is relevant if it holds the whole passage of the question."""
    hits = _best(spark, sf_dir, R.BODY_WEIGHTS, 15).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    judged = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")).join(hits, "query_id", "left")
    first = judged.groupBy("query_id").agg(F.min(F.when(F.col("text").contains(F.col("passage")), F.col("rank"))).alias("first"))
    return first.agg(
        F.count("*").alias("topics"), F.count_if(F.col("first") <= 5).alias("in_top_5"), F.count_if(F.col("first") <= 10).alias("in_top_10"), F.count("first").alias("visible"),
        F.round(F.avg(1 / F.col("first")), 6).alias("mean_reciprocal_rank"),
    )


# --- windows ------------------------------------------------------------------------------------

_NEEDY = (
    r"len(list_filter(regexp_split_to_array(coalesce(raw_text, ''), '" + T.SPACE + r"+'), lambda w: w <> '')) <= 8 OR regexp_matches(coalesce(raw_text, ''), "
    r"'(?i)^[^\p{L}\p{N}_]*(yes|yeah|yep|no|nope|ok|okay|sure|right|exactly|correct|agreed|fine|sounds good|that works|let''?s do that|mm-?hm|good)($|[^\p{L}\p{N}_])')"
)


def _grow(r: int) -> str:
    return (
        f"NOT (nth - {r} <= 1 AND nth + {r} >= last) AND ((needy AND {r} < 2) OR (nth > 1 AND first_value(needy) OVER (PARTITION BY document_id ORDER BY unit_index ROWS BETWEEN {r} PRECEDING AND CURRENT ROW)) "
        f"OR (nth < last AND last_value(needy) OVER (PARTITION BY document_id ORDER BY unit_index ROWS BETWEEN CURRENT ROW AND {r} FOLLOWING)))"
    )


@register(
    f"""WITH u AS (SELECT 'c' || conv_id AS document_id, turn AS unit_index, text AS raw_text FROM conversations),
n AS (SELECT *, {_NEEDY} AS needy, row_number() OVER (PARTITION BY document_id ORDER BY unit_index) AS nth, count(*) OVER (PARTITION BY document_id) AS last FROM u),
g AS (SELECT *, CASE WHEN NOT ({_grow(1)}) THEN 1 WHEN NOT ({_grow(2)}) THEN 2 ELSE 3 END AS radius FROM n)
SELECT document_id, unit_index, radius, greatest(nth - radius, 1) AS lo, least(nth + radius, last) AS hi FROM g"""
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive windows in transcripts."""
    t = read(spark, sf_dir, "conversations")
    u = t.select(F.concat(F.lit("c"), "conv_id").alias("document_id"), F.lit("TRANSCRIPT").alias("document_type"), F.col("turn").alias("unit_index"), F.col("text").alias("raw_text"))
    return R.context_windows(u).select("document_id", "unit_index", "radius", "lo", "hi")


@register(
    """WITH u AS (SELECT conv_id AS document_id, turn AS unit_index, CASE WHEN turn % 4 < 2 THEN turn % 2 END AS s, CASE WHEN (conv_id + turn) % 2 = 0 THEN left(text, length(text) - 1) || ' and' ELSE text END AS t FROM conversations),
hop AS (SELECT u.document_id, u.unit_index, CASE WHEN NOT regexp_matches(rtrim(u.t), '[.?!]["'')\\]]*$') THEN coalesce((SELECT min(v.unit_index) FROM ranked v WHERE v.document_id = u.document_id AND v.nth BETWEEN u.nth + 1 AND u.nth + 6 AND v.s IS NOT DISTINCT FROM u.s), u.unit_index) ELSE u.unit_index END AS next FROM ranked u),
ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unit_index) AS nth FROM u)
SELECT a.document_id, a.unit_index, c.next AS ends_at FROM hop a JOIN hop b ON b.document_id = a.document_id AND b.unit_index = a.next JOIN hop c ON c.document_id = b.document_id AND c.unit_index = b.next""".replace(
        "hop AS (", "HOP", 1
    ).replace("ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unit_index) AS nth FROM u)", "RANKED", 1).replace("HOP", "ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unit_index) AS nth FROM u),\nhop AS (").replace(",\nRANKED", "")
)
def continuation_chase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an unfinished sentence ends, up to three turns of the same speaker on; half of the turns are left open and half of the speakers unnamed."""
    t = read(spark, sf_dir, "conversations")
    text = F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - 1), F.lit(" and"))).otherwise(F.col("text"))
    u = t.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("unit_index"), F.when(F.col("turn") % 4 < 2, (F.col("turn") % 2).cast("string")).alias("speaker_sender"), text.alias("raw_text"))
    return R.continuation(u)


@register(
    f"""WITH {UNITS_SQL} SELECT evidence_id, speaker_sender, md5(raw_text) AS text_md5, lag(evidence_id) OVER w AS before_id, lead(evidence_id) OVER w AS after_id, row_number() OVER w AS nth FROM transcript_units WINDOW w AS (PARTITION BY document_id ORDER BY unit_index)"""
)
def evidence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("document_id").orderBy("unit_index")
    return transcript_units(spark, sf_dir).select(
        "evidence_id", "speaker_sender", F.md5("raw_text").alias("text_md5"), F.lag("evidence_id").over(w).alias("before_id"), F.lead("evidence_id").over(w).alias("after_id"), F.row_number().over(w).cast("long").alias("nth")
    )
