"""Registered queries on the smaller rules: links, discovery, caps, contracts, serving order; each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import privacy
from ..operators import retrieval as R
from ..sources.store import stored
from ..sources.tables import UNITS_SQL, read, units
from .search import CAP_SQL, SEARCH_SQL, _best, _with_source

QUERIES, SQL = {}, {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@register(f"WITH {SEARCH_SQL}, {CAP_SQL.format('body', 240, 2, 30)} SELECT query_id, id AS doc_id, document_id, score, rank FROM capped")
def coverage_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide retrieval: thirty hits of a query, two of a document at most."""
    return R.capped_top_k(_with_source(_best(spark, sf_dir, "body", 8 * 30).drop("rank"), spark, sf_dir), 30, 2).select("query_id", F.col("id").alias("doc_id"), "document_id", "score", "rank")


@register(f"WITH {UNITS_SQL} SELECT evidence_id, speaker_sender, CASE document_type WHEN 'TRANSCRIPT' THEN 'SPEAKER' ELSE 'AUTHOR' END AS relation FROM units WHERE trim(speaker_sender) NOT IN ('system', 'Me', 'Them')")
def relation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of transcripts and authors of mail; labels that are nobody's get no link."""
    named = ~T.is_non_person(F.col("speaker_sender")) & (F.col("speaker_sender") != "system")
    return units(spark, sf_dir).where(named).select("evidence_id", "speaker_sender", F.when(F.col("document_type") == "TRANSCRIPT", "SPEAKER").otherwise("AUTHOR").alias("relation"))


@register(
    r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS email FROM documents), p AS (SELECT c_mktsegment AS name, c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS email FROM customer UNION ALL SELECT email, doc_id, email FROM m)
SELECT name, min_by(email, seq) FILTER (email IS NOT NULL) AS first_email, count(*) AS n FROM p GROUP BY name"""
)
def people_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural names from two sources; the first address of a name wins."""
    m = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._]+@[A-Za-z0-9.]+)"), F.lit(1))).alias("email"), F.col("doc_id").alias("seq"))
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("email"))
    all_ = c.union(m.select("email", "seq", "email"))
    return all_.groupBy("name").agg(F.min_by("email", F.when(F.col("email").isNotNull(), F.col("seq"))).alias("first_email"), F.count("*").alias("n"))


@register(
    """SELECT event_id, lower(trim(event_type || ' ' || user_id)) AS proposal FROM events QUALIFY row_number() OVER (PARTITION BY lower(trim(event_type || ' ' || user_id)) ORDER BY event_id) = 1 ORDER BY event_id LIMIT 10"""
)
def radar_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each proposal in any case, and of these the first ten that surface: a top-k report."""
    key = F.lower(F.trim(F.concat_ws(" ", "event_type", "user_id")))
    e = read(spark, sf_dir, "events").groupBy(key.alias("proposal")).agg(F.min("event_id").alias("event_id"))
    return e.orderBy("event_id").limit(10).select("event_id", "proposal")


@register(
    """WITH g AS (SELECT o_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o_orderkey AS finding_id, a, n, r FROM g WHERE a > 0 AND n > 0 AND r > 0"""
)
def radar_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings all of whose three groups of evidence still have a live unit."""
    live = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    groups = live.groupBy(F.col("l_orderkey").alias("finding_id")).agg(*[F.count_if(F.col("l_returnflag") == f).alias(f.lower()) for f in "ANR"])
    return groups.where("a > 0 AND n > 0 AND r > 0")


_FENCED = "CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN props ELSE left(props, 3) END"


@register(f"WITH e AS (SELECT event_id, trim(regexp_replace({_FENCED}, '^```(json)?\\s*|\\s*```$', '', 'g')) AS raw FROM events) SELECT event_id, CASE WHEN json_valid(raw) THEN CAST(json_extract(raw, '$.k') AS BIGINT) END AS k, json_valid(raw) AS valid FROM e")
def json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output without its fence, read by a schema; a missing required field makes it invalid."""
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.left("props", F.lit(3)))
    raw = F.trim(F.regexp_replace(given, r"^```(json)?\s*|\s*```$", ""))
    return read(spark, sf_dir, "events").select("event_id", F.from_json(raw, "k long")["k"].alias("k")).withColumn("valid", F.col("k").isNotNull())


@register("SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_items, (SELECT strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem WHERE l_suppkey = s_suppkey) AS last_shipped FROM supplier")
def upload_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated counts as one aggregate and a left join."""
    n = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_items"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_shipped"))
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    return s.join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n_items", F.lit(0)).alias("n_items"), "last_shipped")


@register(r"SELECT doc_id, regexp_matches(text, '(^|[^\p{L}\p{N}_])(idiot|moron)([^\p{L}\p{N}_]|$)') AS named, regexp_matches(regexp_replace(text, '(idiot|moron)( [^ ]+)', ' ', 'g'), '(^|[^\p{L}\p{N}_])(idiot|moron)([^\p{L}\p{N}_]|$)') AS independent FROM documents")
def independent_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a short form also stands where the longer form that holds it does not."""
    word = r"(^|[^\p{L}\p{N}_])(idiot|moron)([^\p{L}\p{N}_]|$)"
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(word).alias("named"), F.regexp_replace("text", "(idiot|moron)( [^ ]+)", " ").rlike(word).alias("independent"))


@register(
    r"""WITH d AS (SELECT doc_id, text || CASE doc_id % 9 WHEN 4 THEN ' of SCUM@example.org.' ELSE '' END AS text FROM documents)
SELECT a.doc_id, substr(sha256(a.text), 1, 16) AS text_hash, b.doc_id % 2 = 0 AS rewritten FROM d a JOIN embeddings v ON v.vec_id = a.doc_id JOIN d b USING (doc_id) WHERE doc_id % 2 = 1 AND NOT regexp_matches(a.text, '(?i)(^|[^\p{L}\p{N}_])(worthless|scum)([^\p{L}\p{N}_]|$)') AND NOT contains(lower(a.text), 'scum@example.org')"""
)
def embedding_stash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors over a rebuild that changes every other text: those of unchanged texts that bear neither name nor address come back by the hash of the text."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.when(F.col("doc_id") % 9 == 4, F.concat("text", F.lit(" of SCUM@example.org."))).otherwise(F.col("text")).alias("raw_text"))
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("evidence_id"), F.col("embedding").alias("v"))
    kept = stored(privacy.stash(v, d, ["worthless", "scum"], ["scum@example.org"]))
    after = d.select("evidence_id", F.when(F.col("evidence_id") % 2 == 0, F.concat("raw_text", F.lit(" again"))).otherwise(F.col("raw_text")).alias("raw_text"))
    back = privacy.unstash(kept, after).join(v.select("evidence_id"), "evidence_id", "left_semi").join(d, "evidence_id")
    return back.select(F.col("evidence_id").alias("doc_id"), T.text_hash(F.col("raw_text")).alias("text_hash"), (F.col("evidence_id") % 2 == 0).alias("rewritten"))


@register(
    f"""WITH {UNITS_SQL}, d AS (SELECT document_id, coalesce(min(event_date), '9999-99-99') AS first_date, count(*) AS n FROM units GROUP BY document_id)
SELECT document_id, first_date, n, rank() OVER (ORDER BY first_date, document_id) AS place FROM d"""
)
def render_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order in which evidence is shown: by first date, then id."""
    d = units(spark, sf_dir).groupBy("document_id").agg(F.coalesce(F.min("event_date"), F.lit("9999-99-99")).alias("first_date"), F.count("*").alias("n"))
    # Places without a window over all rows: a running sum over the days, and the place within the day.
    days = d.groupBy("first_date").agg(F.count("*").alias("k"))
    before = days.select("first_date", F.coalesce(F.sum("k").over(W.orderBy("first_date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("first_date").orderBy("document_id"))
    return d.join(before, "first_date").select("document_id", "first_date", "n", (F.col("before") + nth).alias("place"))


@register("SELECT o_custkey AS claim_id, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS INTEGER) AS spread_days, date_diff('day', min(o_orderdate), max(o_orderdate)) > 90 AS wide FROM orders GROUP BY o_custkey")
def date_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between the first and the last support of a claim."""
    days = F.datediff(F.max("o_orderdate"), F.min("o_orderdate"))
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("claim_id")).agg(days.alias("spread_days"), (days > 90).alias("wide"))


@register(
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier),
e AS (SELECT 'finding' AS kind, l_partkey AS id, 'unit' AS on_kind, l_orderkey AS on_id FROM lineitem UNION SELECT 'case', l_suppkey, 'unit', l_orderkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT 'case', p_partkey % n + 1, 'finding', p_partkey FROM part, n WHERE p_partkey % 3 = 0
  UNION SELECT 'finding', p_partkey, 'finding', p_partkey // 10 FROM part WHERE p_partkey % 10 = 0),
s AS (SELECT 'unit' AS kind, o_orderkey AS id FROM orders WHERE o_custkey % 250 = 3 UNION SELECT 'finding', p_partkey FROM part WHERE p_partkey % 400 = 9 UNION SELECT 'case', s_suppkey FROM supplier WHERE s_suppkey % 20 = 1),
r AS (SELECT kind, id FROM s UNION SELECT e.kind, e.id FROM e JOIN r ON e.on_kind = r.kind AND e.on_id = r.id) SELECT kind, id FROM r WHERE kind <> 'unit'"""
)
def reversal_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings (parts) and cases (suppliers) that a reversal makes stale: those that depend on units of some people or on rows that bear the alias, over findings that follow others too."""
    line, part, supplier = (read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    edge = lambda kind, ident, on_kind, on: [F.lit(kind).alias("kind"), ident.cast("long").alias("id"), F.lit(on_kind).alias("on_kind"), on.cast("long").alias("on_id")]
    key, n = F.col("p_partkey"), supplier.agg(F.count("*").alias("n"))
    edges = line.select(*edge("finding", F.col("l_partkey"), "unit", F.col("l_orderkey"))).union(line.where("l_linenumber = 1").select(*edge("case", F.col("l_suppkey"), "unit", F.col("l_orderkey"))))
    edges = edges.union(part.where(key % 3 == 0).join(F.broadcast(n)).select(*edge("case", key % F.col("n") + 1, "finding", key))).union(part.where(key % 10 == 0).select(*edge("finding", key, "finding", F.floor(key / 10))))
    findings = part.select(key.cast("long").alias("finding_id"), F.when(key % 400 == 9, "on Person Amber").otherwise("on person amber").alias("title"), F.lit("").alias("summary"), F.col("p_name").alias("body"))
    cases = supplier.select(F.col("s_suppkey").cast("long").alias("case_id"), F.col("s_name").alias("query"), F.when(F.col("s_suppkey") % 20 == 1, "Person Amber agreed").alias("receipt"))
    gone = read(spark, sf_dir, "orders").where("o_custkey % 250 = 3").select(F.col("o_orderkey").cast("long").alias("evidence_id"))
    return privacy.reversed_away(findings, cases, edges, gone, "Person Amber").select("kind", "id")
