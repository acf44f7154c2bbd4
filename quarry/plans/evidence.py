"""Registered queries on relations, identity, people, receipts and privacy, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import identity, people, privacy, receipts
from ..sources.tables import UNITS_SQL, dated, read, units

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- relations and serving ------------------------------------------------------------------

#: Customers are subjects, orders the evidence, the order's status the relation.
RELATION = {"F": "AUTHOR", "O": "SPEAKER", "P": "MENTIONED"}
EDGES_SQL = "edges AS (SELECT o_custkey AS subject_id, o_orderkey AS evidence_id, CASE o_orderstatus WHEN 'F' THEN 'AUTHOR' WHEN 'O' THEN 'SPEAKER' ELSE 'MENTIONED' END AS relation, o_orderdate AS ordered_at FROM orders)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = F.when(F.col("o_orderstatus") == "F", "AUTHOR").when(F.col("o_orderstatus") == "O", "SPEAKER").otherwise("MENTIONED")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("evidence_id"), relation.alias("relation"), F.col("o_orderdate").alias("ordered_at"))


@register(f"WITH {UNITS_SQL} SELECT document_type, count(*) AS n_units, count(DISTINCT document_id) AS n_documents, min(event_date) AS first_date, max(event_date) AS last_date FROM units GROUP BY document_type")
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).groupBy("document_type").agg(F.count("*").alias("n_units"), F.count_distinct("document_id").alias("n_documents"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


@register(f"WITH {UNITS_SQL} SELECT evidence_id, event_date FROM units WHERE event_date > '2024-09-30' AND event_date < '2024-12-01'")
def later_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly later than one date and before another; undated rows drop out."""
    return units(spark, sf_dir).where((F.col("event_date") > "2024-09-30") & (F.col("event_date") < "2024-12-01")).select("evidence_id", "event_date")


@register(f"WITH {EDGES_SQL} SELECT relation, count(*) AS n FROM edges GROUP BY relation")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n"))


@register(
    f"""WITH {EDGES_SQL} SELECT c_custkey AS subject_id, count(DISTINCT evidence_id) FILTER (relation = 'AUTHOR') AS n_author, count(DISTINCT evidence_id) FILTER (relation = 'SPEAKER') AS n_speaker,
count(DISTINCT evidence_id) FILTER (relation = 'MENTIONED') AS n_mentioned FROM customer LEFT JOIN edges ON subject_id = c_custkey GROUP BY c_custkey"""
)
def people_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivot = edges(spark, sf_dir).groupBy("subject_id").pivot("relation", ["AUTHOR", "SPEAKER", "MENTIONED"]).agg(F.count_distinct("evidence_id"))
    out = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id")).join(pivot, "subject_id", "left").fillna(0)
    return out.withColumnsRenamed({"AUTHOR": "n_author", "SPEAKER": "n_speaker", "MENTIONED": "n_mentioned"})


@register(f"WITH {EDGES_SQL} SELECT subject_id, evidence_id, relation, n_name, c_mktsegment, row_number() OVER (PARTITION BY subject_id ORDER BY ordered_at, evidence_id) AS nth FROM edges JOIN customer ON c_custkey = subject_id JOIN nation ON n_nationkey = c_nationkey")
def person_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nth = F.row_number().over(W.partitionBy("subject_id").orderBy("ordered_at", "evidence_id"))
    return edges(spark, sf_dir).join(c, F.col("c_custkey") == F.col("subject_id")).select("subject_id", "evidence_id", "relation", "n_name", "c_mktsegment", nth.cast("long").alias("nth"))


@register(
    """SELECT d.source AS document_id, count(DISTINCT d.doc_id) AS n_units, count(v.vec_id) AS n_embedded, count(l.doc_id) AS n_labelled
FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source"""
)
def index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    v, lab = read(spark, sf_dir, "embeddings").select(F.col("vec_id")), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"))
    both = d.join(v, d.doc_id == v.vec_id, "left").join(lab, d.doc_id == lab.l_id, "left")
    return both.groupBy(F.col("source").alias("document_id")).agg(F.count_distinct("doc_id").alias("n_units"), F.count("vec_id").alias("n_embedded"), F.count("l_id").alias("n_labelled"))


@register("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@register("SELECT c_custkey AS subject_id, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def orphan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), "c_name")
    return c.join(edges(spark, sf_dir).where("relation = 'AUTHOR'"), "subject_id", "left_anti")


@register("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def stale_index_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows without a live base row vanish in an inner join."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")


@register(
    f"""WITH {EDGES_SQL}, best AS (SELECT subject_id, min_by(evidence_id, CAST(CASE relation WHEN 'AUTHOR' THEN 1 WHEN 'SPEAKER' THEN 2 ELSE 3 END AS BIGINT) * 1000000000000 + evidence_id) AS evidence_id FROM edges GROUP BY subject_id)
SELECT c_custkey AS subject_id, c_name, evidence_id AS best_evidence_id FROM customer LEFT JOIN best ON subject_id = c_custkey"""
)
def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of the strongest relation for each subject, as an aggregate and a join."""
    priority = F.when(F.col("relation") == "AUTHOR", 1).when(F.col("relation") == "SPEAKER", 2).otherwise(3)
    best = edges(spark, sf_dir).groupBy("subject_id").agg(F.min(F.struct(priority.alias("p"), "evidence_id"))["evidence_id"].alias("best_evidence_id"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), "c_name").join(best, "subject_id", "left")


@register(
    """SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_second FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 180)) WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 30"""
)
def recent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of each key among the newest 180, then the newest 30: a top-k report."""
    newest = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(180)
    k = F.row_number().over(W.partitionBy("event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return newest.withColumn("k", k).where("k = 1").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at_second"))


@register(
    """WITH d AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS event_date FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(event_date, '9999-99-99'), event_id) AS nth FROM d"""
)
def timeline_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by date, undated ones last."""
    day = F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "yyyy-MM-dd"))
    nth = F.row_number().over(W.partitionBy("user_id").orderBy(F.coalesce(day, F.lit("9999-99-99")), "event_id"))
    return read(spark, sf_dir, "events").select("user_id", "event_id", nth.cast("long").alias("nth"))


@register("SELECT size, count(*) AS n_rows, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_invalid FROM (SELECT len(embedding) AS size, len(embedding) = 64 AND abs(sqrt(list_dot_product(embedding, embedding)) - 1) < 0.001 AND vec_id % 11 <> 0 AS ok FROM embeddings) GROUP BY size")
def vector_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the right dimension, finite and of unit length; every eleventh is spoilt by a NaN first."""
    spoilt = F.when(F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: F.lit(float("nan")))).otherwise(F.col("embedding").cast("array<double>"))
    finite = F.forall(spoilt, lambda x: ~F.isnan(x))
    norm = F.sqrt(F.aggregate(spoilt, F.lit(0.0), lambda s, x: s + x * x))
    ok = (F.size("embedding") == 64) & finite & (F.abs(norm - 1) < 0.001)
    v = read(spark, sf_dir, "embeddings").select(F.size("embedding").cast("long").alias("size"), ok.alias("ok"))
    return v.groupBy("size").agg(F.count("*").alias("n_rows"), F.count_if("ok").alias("n_valid"), F.count_if(~F.col("ok")).alias("n_invalid"))


# --- identity -------------------------------------------------------------------------------


@register(
    """WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, event_type, CASE WHEN event_id % 13 = 0 THEN 1 END AS starts, event_id FROM events),
m AS (SELECT *, sum(CASE WHEN event_type = lag_type AND coalesce(starts, 0) <> 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY position) AS turn FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY position) AS lag_type FROM f))
SELECT user_id, CAST(turn AS BIGINT) AS turn, min(position) AS first_position, max(position) AS last_position, min(event_type) AS speaker, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY position) AS ids FROM m GROUP BY user_id, turn"""
)
def turn_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events of one type merge into turns; every thirteenth has a recorded start."""
    position = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), position.alias("position"), F.col("event_type").alias("speaker"), F.when(F.col("event_id") % 13 == 0, 1).alias("starts_group"), F.col("event_id").cast("string").alias("text"))
    return identity.merge_turns(e).withColumnsRenamed({"document_id": "user_id", "text": "ids"})


@register(
    """WITH p AS (SELECT source, doc_id, substr(sha256(text), 1, 16) AS fp FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source, fp ORDER BY doc_id) AS k FROM p),
m AS (SELECT source, doc_id AS genesis, fp, row_number() OVER (PARTITION BY source, fp ORDER BY doc_id) AS k FROM p WHERE doc_id % 3 <> 0), h AS (SELECT source, max(genesis) AS high FROM m GROUP BY source),
j AS (SELECT n.source, n.doc_id, m.genesis FROM n LEFT JOIN m ON m.source = n.source AND m.fp = n.fp AND m.k = n.k)
SELECT source AS document_id, doc_id, printf('u%04d', genesis) AS source_locator, false AS minted FROM j WHERE genesis IS NOT NULL
UNION ALL SELECT j.source, doc_id, printf('u%04d', coalesce(high, -1) + row_number() OVER (PARTITION BY j.source ORDER BY doc_id)), true FROM j LEFT JOIN h ON h.source = j.source WHERE genesis IS NULL"""
)
def locator_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second parse of the documents takes the locators of a first one that lacked a third of them."""
    parsed = read(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("position"), T.text_hash(F.col("text")).alias("fingerprint"))
    manifest = parsed.where("position % 3 <> 0").select("document_id", F.col("position").alias("genesis_position"), "fingerprint", F.format_string("u%04d", "position").alias("source_locator"))
    return identity.reuse_locators(parsed, manifest).withColumnRenamed("position", "doc_id")


@register(
    """WITH s AS (SELECT doc_id, substr(sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END), 1, 16) AS text_hash FROM documents WHERE doc_id % 2 = 0), u AS (SELECT doc_id, substr(sha256(text), 1, 16) AS text_hash FROM documents)
SELECT s.doc_id, s.text_hash FROM s JOIN u ON u.doc_id = s.doc_id AND u.text_hash = s.text_hash"""
)
def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stashed rows whose unit has the same text still; every fifth text has changed, every second had no row."""
    d = read(spark, sf_dir, "documents").withColumn("evidence_id", F.col("doc_id"))
    stash = d.where("doc_id % 2 = 0").select("evidence_id", T.text_hash(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("text_hash"))
    return identity.reusable(stash, d.select("evidence_id", T.text_hash(F.col("text")).alias("text_hash"))).withColumnRenamed("evidence_id", "doc_id")


# --- people ---------------------------------------------------------------------------------

NAMES_SQL = r"""cand AS (SELECT unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])([A-ZÅÄÖØÆÉ][a-zåäöøæé''-]+(?:[ \t]+[A-ZÅÄÖØÆÉ][a-zåäöøæé''-]+){1,2})', 1)) AS name FROM documents),
names AS (SELECT name, count(*) AS n FROM cand WHERE trim(name) NOT IN ('Unknown Speaker') GROUP BY name)"""
WORDS_SQL = r"""w AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '\S+@\S+', ' ', 'g'), '[\p{L}\p{N}]+')) AS w FROM documents) GROUP BY w),
cases AS (SELECT lower(w) AS word, sum(CASE WHEN w = lower(w) THEN n ELSE 0 END)::BIGINT AS lower, sum(CASE WHEN w <> lower(w) AND w = upper(left(lower(w), 1)) || substr(lower(w), 2) THEN n ELSE 0 END)::BIGINT AS capital FROM w GROUP BY lower(w))"""
PARTS_SQL = r"parts AS (SELECT name, part, nth - 1 AS nth, np AS n_parts FROM (SELECT name, unnest(ps) AS part, generate_subscripts(ps, 1) AS nth, len(ps) AS np FROM (SELECT name, string_split(lower(regexp_replace(name, '\s+', ' ', 'g')), ' ') AS ps FROM {})))"
COMMON_SQL = ", ".join(f"'{w}'" for w in people.COMMON_WORD_NAMES)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.name_candidates(read(spark, sf_dir, "documents").withColumnRenamed("text", "raw_text"))


@register(f"WITH {NAMES_SQL} SELECT name, n FROM names")
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)


SINGLES_SQL = r"singles AS (SELECT DISTINCT regexp_extract(text, '^\p{L}+') AS name FROM documents WHERE regexp_matches(text, '^\p{L}'))"


@register(
    f"""WITH {NAMES_SQL}, {SINGLES_SQL}, every AS (SELECT name FROM names UNION SELECT name FROM singles), {PARTS_SQL.format('every')},
o AS (SELECT part, count(DISTINCT name) AS holders, count(DISTINCT name) FILTER (nth = 0) AS starts, min(name) FILTER (nth = 0) AS full_name FROM parts WHERE n_parts >= 2 GROUP BY part)
SELECT name, full_name FROM parts JOIN o USING (part) WHERE n_parts = 1 AND holders = 1 AND starts = 1 AND length(name) >= 3 AND part NOT IN ({COMMON_SQL}) AND name NOT IN ('Me', 'Them')"""
)
def name_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of documents as bare names, against the multi-word names in the texts."""
    singles = read(spark, sf_dir, "documents").select(F.regexp_extract("text", r"^\p{L}+", 0).alias("name")).where("name <> ''")
    return people.fold_single_names(_names(spark, sf_dir).select("name").union(singles).distinct())


_FORMS = r"list_distinct([string_split_regex(name, '\s+')[1], string_split_regex(name, '\s+')[-1], upper(array_to_string(list_transform(string_split_regex(name, '\s+'), lambda x: left(x, 1)), ''))])"


@register(f"WITH {NAMES_SQL}, t AS (SELECT name, unnest({_FORMS}) AS token FROM names) SELECT token, min(name) AS name FROM t GROUP BY token HAVING count(DISTINCT name) = 1")
def unique_short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.short_name_owners(_names(spark, sf_dir))


@register(f"WITH {NAMES_SQL}, t AS (SELECT name, unnest({_FORMS}) AS token FROM names), r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS token FROM benchmark) SELECT DISTINCT token FROM t WHERE token NOT IN (SELECT token FROM r)")
def unresolved_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short forms that no reviewed list (the words of the benchmark) holds."""
    w = F.split(F.trim("name"), r"\s+")
    forms = F.array(F.get(w, F.lit(0)), F.element_at(w, -1), F.upper(F.array_join(F.transform(w, lambda x: F.left(x, F.lit(1))), "")))
    reviewed = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("token"))
    return _names(spark, sf_dir).select(F.explode(forms).alias("token")).distinct().join(reviewed, "token", "left_anti")


@register(f"WITH {WORDS_SQL} SELECT word, lower, capital, lower > capital AS dominates FROM cases WHERE lower > 0 AND capital > 0")
def lowercase_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = people.case_counts(read(spark, sf_dir, "documents").withColumnRenamed("text", "raw_text"))
    return counts.where("lower > 0 AND capital > 0").withColumn("dominates", F.col("lower") > F.col("capital"))


@register(
    rf"""WITH {NAMES_SQL}, {WORDS_SQL}, {PARTS_SQL.format('names')}, o AS (SELECT part, count(DISTINCT name) AS owners FROM parts GROUP BY part)
SELECT name, part AS token, CASE WHEN NOT (regexp_matches(part, '^\p{{L}}[\p{{L}}''-]*$') AND length(part) >= 3) THEN 'too-short' WHEN part IN ('person', 'speaker') THEN 'reserved' WHEN owners > 1 THEN 'shared'
  WHEN part IN ({COMMON_SQL}) OR coalesce(lower > capital, false) THEN 'ordinary-word' END AS reason FROM parts JOIN o USING (part) LEFT JOIN cases ON word = part WHERE nth = 0 AND n_parts >= 2"""
)
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    counts = people.case_counts(read(spark, sf_dir, "documents").withColumnRenamed("text", "raw_text"), people.parts(names).select(F.col("part").alias("word")))
    return people.first_name_reasons(names, counts, ["person", "speaker"])


@register(r"WITH a AS (SELECT DISTINCT regexp_extract(text, '^[\p{L}\p{N}_]+') AS alias FROM benchmark) SELECT DISTINCT doc_id, alias FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS alias FROM documents) JOIN a USING (alias)")
def mention_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the first word of a benchmark passage as a whole word."""
    dictionary = read(spark, sf_dir, "benchmark").select(F.regexp_extract("text", r"^[\p{L}\p{N}_]+", 0).alias("alias"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("raw_text"))
    return people.mentions(d, dictionary).withColumnRenamed("evidence_id", "doc_id")


# --- receipts -------------------------------------------------------------------------------

#: A claim for each assistant turn; it cites the turn before, the turn after, and an id that exists nowhere.
CLAIMS_SQL = """claims AS (SELECT conv_id * 100 + turn AS claim_id, CASE WHEN turn % 4 = 3 THEN 'EV-' || conv_id ELSE text || ' [EV-c' || conv_id || '-' || turn || '] end' END AS claim_text,
  CASE WHEN conv_id % 6 = 0 THEN 'UNCERTAIN' ELSE 'DECISION' END AS stance, CASE conv_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, conv_id, turn FROM conversations WHERE role = 'assistant'),
cited AS (SELECT claim_id, conv_id * 100 + turn - 1 - CASE WHEN conv_id % 4 = 0 THEN 50 ELSE 0 END AS evidence_id FROM claims UNION ALL SELECT claim_id, conv_id * 100 + turn + 1 - CASE WHEN conv_id % 4 = 0 THEN 50 ELSE 0 END FROM claims UNION ALL SELECT claim_id, -claim_id - 1 FROM claims),
live AS (SELECT conv_id * 100 + turn AS evidence_id, conv_id % 5 = 0 AS is_truncated FROM conversations)"""


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = read(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    said = F.concat(F.col("text"), F.lit(" [EV-c"), F.col("conv_id"), F.lit("-"), F.col("turn"), F.lit("] end"))
    claims = t.where("role = 'assistant'").select(
        key.alias("claim_id"), F.when(F.col("turn") % 4 == 3, F.concat(F.lit("EV-"), "conv_id")).otherwise(said).alias("claim_text"), F.when(F.col("conv_id") % 6 == 0, "UNCERTAIN").otherwise("DECISION").alias("stance"),
        F.when(F.col("conv_id") % 3 == 0, "HIGH").when(F.col("conv_id") % 3 == 1, "MEDIUM").otherwise("LOW").alias("confidence"), "conv_id",
    )
    off = F.when(F.col("conv_id") % 4 == 0, 50).otherwise(0)
    ids = F.array(F.col("claim_id") - 1 - off, F.col("claim_id") + 1 - off, -F.col("claim_id") - 1)
    return claims.drop("conv_id"), claims.select("claim_id", F.explode(ids).alias("evidence_id")), t.select(key.alias("evidence_id"), (F.col("conv_id") % 5 == 0).alias("is_truncated"))


@register(f"WITH {CLAIMS_SQL} SELECT claim_id, evidence_id FROM cited WHERE evidence_id IN (SELECT evidence_id FROM live) AND evidence_id IN (SELECT evidence_id FROM live WHERE evidence_id % 7 <> 0)")
def valid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids that exist and were visible."""
    _, cited, live = _claims(spark, sf_dir)
    return receipts.valid_ids(cited, live, live.where("evidence_id % 7 <> 0")).select("claim_id", "evidence_id")


@register(r"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(text || ' [EV-x' || turn || '-1],  see EV-abc; ' || text, '\s*\[?\bEV-[^\s\]\[,;)]+\]?', '', 'g'), '\s{2,}', ' ', 'g'))) AS prose_md5 FROM conversations")
def clean_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit(" [EV-x"), F.col("turn"), F.lit("-1],  see EV-abc; "), "text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.clean_prose(text)).alias("prose_md5"))


@register(
    """WITH c AS (SELECT conv_id AS case_id, turn, role FROM conversations) SELECT DISTINCT case_id, 'EV-' || turn AS evidence_id, CASE role WHEN 'user' THEN 'SUPPORT' WHEN 'system' THEN 'TIMELINE' ELSE 'CONFLICT' END AS usage FROM c
UNION SELECT case_id, 'EV-' || turn, 'CONFLICT' FROM c WHERE turn % 2 = 0"""
)
def case_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each case uses the ids it cites."""
    ids = lambda c: F.collect_list(F.when(c, F.concat(F.lit("EV-"), "turn")))
    cases = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(
        ids(F.col("role") == "user").alias("support"), ids(~F.col("role").isin("user", "system")).alias("conflict"), ids(F.col("role") == "system").alias("timeline"), ids(F.col("turn") % 2 == 0).alias("counter")
    )
    return receipts.usage(cases)


_TAILS = ["who approved it", "was it signed off now", "what changed and who decided the final commitment", ""]
_TAIL_SQL = "CASE turn % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAILS)) + " END"
_TRIGGERS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN 'query: {r}' END" for p, r in receipts.QUERY_TRIGGERS) + "], lambda x: x IS NOT NULL)"


@register(f"WITH q AS (SELECT conv_id, turn, lower(text || ' ' || {_TAIL_SQL}) AS q FROM conversations), t AS (SELECT *, {_TRIGGERS_SQL} AS tr FROM q) SELECT conv_id, turn, array_to_string(tr, '; ') AS triggers, CASE WHEN len(tr) = 0 THEN 'LOW' WHEN len(tr) >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM t")
def risk_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a question behind them: the reasons for a deep check and the level."""
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("turn") % 4 + 1).cast("int"))
    triggers = receipts.query_triggers(F.concat_ws(" ", "text", tail))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(triggers, "; ").alias("triggers"), receipts.level(triggers).alias("level"))


@register(
    """WITH g AS (SELECT conv_id, list(turn ORDER BY turn) FILTER (role = 'user') AS proposal, list(turn ORDER BY turn) FILTER (role = 'assistant') AS outcome, list(turn ORDER BY turn) FILTER (role = 'system' OR turn = 3) AS blocker FROM conversations WHERE (conv_id + turn) % 5 <> 0 GROUP BY conv_id)
SELECT conv_id, len(proposal) AS n_proposal, len(outcome) AS n_outcome, len(blocker) AS n_blocker FROM g WHERE len(proposal) > 0 AND len(outcome) > 0 AND len(blocker) > 0"""
)
def radar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a live id each for the proposal, the outcome and the blocker; a fifth of the turns is gone."""
    t = read(spark, sf_dir, "conversations")
    cited = t.select("conv_id", "turn", F.explode(F.array_compact(F.array(F.when(F.col("role") == "user", "proposal"), F.when(F.col("role") == "assistant", "outcome"), F.when((F.col("role") == "system") | (F.col("turn") == 3), "blocker")))).alias("part"))
    live = t.where("(conv_id + turn) % 5 <> 0").select("conv_id", "turn")
    counted = cited.join(live, ["conv_id", "turn"], "left_semi").groupBy("conv_id").agg(*[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("proposal", "outcome", "blocker")])
    return counted.where("n_proposal > 0 AND n_outcome > 0 AND n_blocker > 0")


@register(
    """WITH c AS (SELECT user_id AS candidate_id, event_id % 9 + 1 AS chk, max(event_id % 2 = 0) AS passed FROM events WHERE event_id % 3 <> 0 GROUP BY ALL), u AS (SELECT DISTINCT candidate_id FROM c WHERE chk <= 7)
SELECT u.candidate_id, k.chk AS "check", c.passed IS NOT NULL AS answered, c.passed, coalesce(k.chk IN (1, 7) AND NOT c.passed, false) AS vetoed FROM u, (SELECT unnest(range(1, 8)) AS chk) k LEFT JOIN c ON c.candidate_id = u.candidate_id AND c.chk = k.chk"""
)
def radar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven checks for each candidate, skipped ones as unanswered, and the veto of the first and the last."""
    e = read(spark, sf_dir, "events").where("event_id % 3 <> 0").groupBy(F.col("user_id").alias("candidate_id"), (F.col("event_id") % 9 + 1).alias("check")).agg(F.max(F.col("event_id") % 2 == 0).alias("passed"))
    checks = e.where("check <= 7").select("candidate_id", F.col("check").cast("int").alias("check"), F.lit(True).alias("answered"), "passed")
    return receipts.seven_checks(checks)


@register(
    """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'WORTH_REASSESSING' WHEN 1 THEN 'PARTIALLY_CHANGED' WHEN 2 THEN 'STILL_BLOCKED' ELSE 'INSUFFICIENT_EVIDENCE' END AS a, user_id % 3 <> 0 AS r, event_type = 'click' AS f4, value > 50 AS f6 FROM events),
x AS (SELECT *, CASE WHEN a IN ('WORTH_REASSESSING', 'PARTIALLY_CHANGED') AND NOT r THEN 'INSUFFICIENT_EVIDENCE' ELSE a END AS b FROM e), y AS (SELECT *, CASE WHEN b = 'WORTH_REASSESSING' AND f4 THEN 'PARTIALLY_CHANGED' ELSE b END AS c FROM x)
SELECT event_id, CASE WHEN c IN ('WORTH_REASSESSING', 'PARTIALLY_CHANGED') AND f6 THEN 'STILL_BLOCKED' ELSE c END AS assessment FROM y"""
)
def radar_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.element_at(F.array(*map(F.lit, ["WORTH_REASSESSING", "PARTIALLY_CHANGED", "STILL_BLOCKED", "INSUFFICIENT_EVIDENCE"])), (F.col("event_id") % 4 + 1).cast("int"))
    shown = receipts.guard(a, F.col("user_id") % 3 != 0, F.col("event_type") == "click", F.col("value") > 50)
    return read(spark, sf_dir, "events").select("event_id", shown.alias("assessment"))


@register("WITH s AS (SELECT s_suppkey, unnest(CASE WHEN s_nationkey % 5 = 0 THEN range(0, 25) ELSE [s_nationkey] END) AS category FROM supplier) SELECT p_partkey, s_suppkey FROM part JOIN s ON category = p_size % 25")
def signal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals without a category go with every candidate, the others with their category's."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate"), (F.col("p_size") % 25).alias("category"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("signal"), F.col("s_nationkey").alias("category"), (F.col("s_nationkey") % 5 == 0).alias("general"))
    return receipts.signal_pairs(p, s, 25).select(F.col("candidate").alias("p_partkey"), F.col("signal").alias("s_suppkey"))


# --- privacy --------------------------------------------------------------------------------

NEEDLES = ["idiot", "password", "@example", "token"]
#: Words are set apart by doubled ends, so that neighbours can both match.
_WORDS_APART = r"regexp_replace(lower(coalesce(t, '')), '([^\p{L}\p{N}_])', '\1\1', 'g')"
_NEEDLE_SQL = [r"(?:^|[^\p{L}\p{N}_])" + n + r"(?:$|[^\p{L}\p{N}_])" if privacy.BARE.fullmatch(n) else "@@example" for n in NEEDLES]


@register(
    "WITH s AS (SELECT 'documents' AS surface, text AS t FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'pages', html FROM pages) "
    + " UNION ALL ".join(f"SELECT surface, '{n}' AS needle, sum(len(regexp_extract_all({_WORDS_APART}, '{p}')))::BIGINT AS hits, count(*) FILTER (regexp_matches({_WORDS_APART}, '{p}')) AS n_rows FROM s GROUP BY surface" for n, p in zip(NEEDLES, _NEEDLE_SQL, strict=True))
)
def needle_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leak verification: occurrences of each needle on each surface."""
    out = None
    for table, column in (("documents", "text"), ("conversations", "text"), ("pages", "html")):
        found = privacy.needle_counts(read(spark, sf_dir, table), column, NEEDLES, table)
        out = found if out is None else out.union(found)
    return out


@register(f"WITH {EDGES_SQL} SELECT evidence_id, subject_id, relation FROM edges WHERE evidence_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def relationship_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that a rebuild from returned line items would lose."""
    before = edges(spark, sf_dir)
    after = before.join(read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("evidence_id")), "evidence_id", "left_semi")
    return privacy.lost_relations(before, after)


@register(
    r"SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents) UNION SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])idiot([^\p{L}\p{N}_]|$)') OR doc_id % 50 IN (3, 4, 5)"
)
def affected_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units linked to a subject (the toxic label), or with its name or address in the text, the speaker or the title; each of the latter is planted, beside a near miss."""
    k = F.col("doc_id") % 50
    text = F.when(k == 5, F.concat("text", F.lit(" Ask WHO@example.org."))).when(k == 6, F.concat("text", F.lit(" idiots"))).otherwise(F.col("text"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), text.alias("raw_text"), F.when(k == 3, "An IDIOT").when(k == 7, "Idiotin").alias("speaker_sender"), F.when(k == 4, "re: idiot").alias("thread_context"))
    linked = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("evidence_id"), F.col("toxic").alias("subject_id")).join(d, "evidence_id", "left_semi")
    return privacy.affected(linked, d, 1, ["idiot"], ["who@example.org"]).withColumnRenamed("evidence_id", "doc_id")


@register(
    r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'admin@example\.com', 'person-amber@pseudonymised.invalid', 'gi'), '(^|[^\p{L}\p{N}_])(worthless|idiot|scum)([^\p{L}\p{N}_]|$)', '\1Person Amber\3', 'gi'), '(^|[^\p{L}\p{N}_])(worthless|idiot|scum)([^\p{L}\p{N}_]|$)', '\1Person Amber\3', 'gi')) AS text_md5 FROM documents"
)
def pseudonymise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = privacy.pseudonymise(F.col("text"), ["worthless", "idiot", "scum"], ["admin@example.com"], "Person Amber")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("text_md5"))


@register(f"WITH {EDGES_SQL} SELECT c_nationkey, count(DISTINCT subject_id) AS subjects, count(DISTINCT evidence_id) AS units, count(*) FILTER (relation = 'AUTHOR') AS authored FROM edges JOIN customer ON c_custkey = subject_id GROUP BY c_nationkey")
def privacy_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an operation on all subjects of a nation would touch."""
    e = edges(spark, sf_dir).join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), "c_nationkey"), "subject_id")
    return e.groupBy("c_nationkey").agg(F.count_distinct("subject_id").alias("subjects"), F.count_distinct("evidence_id").alias("units"), F.count_if(F.col("relation") == "AUTHOR").alias("authored"))


@register(
    f"""WITH {EDGES_SQL}, gone AS (SELECT evidence_id FROM edges WHERE subject_id % 100 = 7)
SELECT DISTINCT l_suppkey AS case_id, 'cited' AS reason FROM lineitem WHERE l_orderkey IN (SELECT evidence_id FROM gone) UNION SELECT s_suppkey, 'prose' FROM supplier WHERE regexp_matches(s_name, '7$')"""
)
def dependent_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that cite an affected unit, and cases whose prose names the subject."""
    gone = edges(spark, sf_dir).where("subject_id % 100 = 7").select(F.col("evidence_id").alias("l_orderkey"))
    cited = read(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_semi").select(F.col("l_suppkey").alias("case_id"), F.lit("cited").alias("reason")).distinct()
    return cited.union(read(spark, sf_dir, "supplier").where(F.col("s_name").rlike("7$")).select("s_suppkey", F.lit("prose")))
