"""Registered queries on parsing, manifests, uploads and locators, with equivalent SQL.

The given tables are written out as the files that the parsers read: conversations as mail threads
and transcripts, documents as status reports, customers as manifests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import identity, privacy
from ..sources import archive, manifests
from ..sources.tables import read
from ..streaming import uploads
from ..streaming.events import windowed_counts

QUERIES, SQL = {}, {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _joined(rows: DataFrame, order, text, separator: str) -> DataFrame:
    """(conv_id, text): the texts of each conversation in order."""
    parts = F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), separator).alias("text"))


# --- mail -----------------------------------------------------------------------------------


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a thread, newest message first; headers in English, German and Swedish by turn."""
    t = read(spark, sf_dir, "conversations")
    turn = F.col("turn")
    day = (turn % 28 + 1).cast("string")
    english = F.concat(F.lit("From: Ana Duarte <ana@example.org>\nTo: Bo\nSent: Monday, March "), day, F.lit(", 2024 10:05 AM\nSubject: Topic "), F.col("conv_id"))
    german = F.concat(F.lit("Von: Bo Li\nGesendet: Montag, "), day, F.lit(". März 2024 10:05\nBetreff: Topic "), F.col("conv_id"))
    swedish = F.concat(F.lit("Ämne: Topic "), F.col("conv_id"), F.lit("\nFrån: cai@example.org\nSkickat: den "), day, F.lit(" mars 2024 10:05"))
    head = F.when(turn % 3 == 0, english).when(turn % 3 == 1, german).otherwise(swedish)
    return _joined(t, -turn, F.concat(head, F.lit("\n\n"), F.col("text"), F.lit("\n")), "\n").select(F.concat(F.lit("m"), "conv_id").alias("document_id"), "text")


@register(
    r"""WITH m AS (SELECT 'm' || conv_id AS document_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS position, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body, 'Topic ' || conv_id AS thread_context FROM conversations)
SELECT document_id, position, CASE turn % 3 WHEN 0 THEN 'Ana Duarte' WHEN 1 THEN 'Bo Li' END AS speaker_sender, CASE turn % 3 WHEN 0 THEN 'ana@example.org' WHEN 2 THEN 'cai@example.org' END AS sender_email, strftime(make_date(2024, 3, CAST(turn % 28 + 1 AS INTEGER)), '%Y-%m-%d') AS event_date, thread_context, md5(body) AS body_md5 FROM m WHERE body <> ''"""
)
def mail_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of threads: senders, dates in three languages, subjects, bodies."""
    m = archive.mail(_threads(spark, sf_dir))
    return m.select("document_id", "position", "speaker_sender", "sender_email", "event_date", "thread_context", F.md5("raw_text").alias("body_md5"))


# --- transcripts ----------------------------------------------------------------------------


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even conversations as lines of Me and Them, odd ones as turns with names and times."""
    t = read(spark, sf_dir, "conversations")
    flat = F.array_join(F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    own = F.concat(F.when(F.col("turn") % 2 == 0, "Me: ").otherwise("Them: "), flat)
    said = F.concat(F.when(F.col("turn") % 2 == 0, "Ana Duarte").otherwise("Bo Li"), F.lit(" "), F.col("turn") + 1, F.lit(" minutes 5 seconds\nAD\nBo Li\n00:0100:01\n"), F.col("text"))
    line = F.when(F.col("conv_id") % 2 == 0, own).otherwise(said)
    head = F.lit("Meeting: Weekly\nDate: 2024-03-04\nAttendees: Ana Duarte (lead, of all), Bo Li\n\n")
    return _joined(t, F.col("turn"), line, "\n").select(F.concat(F.lit("t"), "conv_id").alias("document_id"), F.concat(head, "text").alias("text"))


_FLAT = r"array_to_string(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> ''), ' ')"


@register(
    f"""WITH f AS (SELECT conv_id, turn, {_FLAT} AS flat FROM conversations)
SELECT 't' || conv_id AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, CASE WHEN conv_id % 2 = 0 THEN CASE turn % 2 WHEN 0 THEN 'Me' ELSE 'Them' END ELSE CASE turn % 2 WHEN 0 THEN 'Ana Duarte' ELSE 'Bo Li' END END AS speaker_sender,
  CASE WHEN conv_id % 2 = 1 THEN 't' || ((turn + 1) * 60 + 5) END AS natural_locator, md5(flat) AS text_md5 FROM f WHERE flat <> ''"""
)
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of transcripts: speakers, time locators, texts without chrome."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("document_id").orderBy("position"))
    return archive.transcripts(_transcripts(spark, sf_dir)).select("document_id", nth.cast("long").alias("nth"), "speaker_sender", "natural_locator", F.md5("raw_text").alias("text_md5"))


# --- reports --------------------------------------------------------------------------------


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.lit("From: Ana Duarte <ana@example.org>\nDate: March 4, 2024 10:05 AM\nSubject: Status\n\n")
    tail = F.lit("\n\nTimeline green\n1. first step\n2. second step\n\nRisk none\n")
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("r"), "doc_id").alias("document_id"), F.concat(head, F.coalesce("text", F.lit("")), tail).alias("text"))


@register(
    r"""WITH p AS (SELECT 'r' || doc_id AS document_id, unnest(string_split_regex(regexp_replace(coalesce(text, '') || chr(10) || chr(10) || 'zz', '^\s+|\s+$', '', 'g'), '\n\s*\n')) AS p, generate_subscripts(string_split_regex(regexp_replace(coalesce(text, '') || chr(10) || chr(10) || 'zz', '^\s+|\s+$', '', 'g'), '\n\s*\n'), 1) AS k FROM documents),
q AS (SELECT document_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(p, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS t FROM p WHERE trim(p) <> '' AND p <> 'zz'),
u AS (SELECT document_id, t, 'Status' AS c FROM q WHERE t <> '' UNION ALL SELECT 'r' || doc_id, t, c FROM documents, (VALUES ('green', 'Status — Timeline'), ('first step', 'Status — Timeline'), ('second step', 'Status — Timeline'), ('none', 'Status — Risk')) v(t, c))
SELECT document_id, c AS thread_context, count(*) AS n_units, md5(string_agg(md5(t), '' ORDER BY md5(t))) AS texts_md5 FROM u GROUP BY ALL"""
)
def report_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of reports, and the bullets of their titled sections."""
    u = archive.reports(_reports(spark, sf_dir)).withColumn("h", F.md5("raw_text"))
    return u.groupBy("document_id", "thread_context").agg(F.count("*").alias("n_units"), F.md5(F.array_join(F.sort_array(F.collect_list("h")), "")).alias("texts_md5"))


# --- assembly -------------------------------------------------------------------------------

_ASSEMBLED = r"""
rp AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, '') || chr(10) || chr(10) || 'zz', '^\s+|\s+$', '', 'g'), '\n\s*\n') AS ps FROM documents),
rq AS (SELECT 'r' || doc_id AS document_id, k, 0 AS j, array_to_string(list_filter(list_transform(string_split(regexp_replace(p, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS body, 'Status' AS c
    FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM rp) WHERE trim(p) <> '' AND p <> 'zz'
  UNION ALL SELECT 'r' || doc_id, 1000000000, v.j, v.t, v.c FROM documents, (VALUES (1, 'green', 'Status — Timeline'), (2, 'first step', 'Status — Timeline'), (3, 'second step', 'Status — Timeline'), (4, 'none', 'Status — Risk')) v(j, t, c)),
m AS (SELECT 'm' || conv_id AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS position, strftime(make_date(2024, 3, CAST(turn % 28 + 1 AS INTEGER)), '%Y-%m-%d') AS event_date, 'Topic ' || conv_id AS thread_context,
  CASE turn % 3 WHEN 0 THEN 'Ana Duarte' WHEN 1 THEN 'Bo Li' END AS speaker, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM conversations),
t AS (SELECT 't' || conv_id AS document_id, turn AS position, NULL AS event_date, NULL AS thread_context, CASE WHEN conv_id % 2 = 0 THEN CASE turn % 2 WHEN 0 THEN 'Me' ELSE 'Them' END ELSE CASE turn % 2 WHEN 0 THEN 'Ana Duarte' ELSE 'Bo Li' END END AS speaker, """ + _FLAT + r""" AS body FROM conversations),
a AS (SELECT document_id, 'EMAIL' AS document_type, row_number() OVER (PARTITION BY document_id ORDER BY position) - 1 AS unit_index, event_date, thread_context, speaker, body FROM m WHERE body <> ''
  UNION ALL SELECT document_id, 'TRANSCRIPT', row_number() OVER (PARTITION BY document_id ORDER BY position) - 1, '2024-03-04', 'Weekly', speaker, body FROM t WHERE body <> ''
  UNION ALL SELECT document_id, 'REPORT', row_number() OVER (PARTITION BY document_id ORDER BY k, j) - 1, '2024-03-04', c, 'Ana Duarte', body FROM rq WHERE body <> '')"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files with their types; transcripts have a date and a title of their own."""
    null = F.lit(None).cast("string")
    kinds = {"EMAIL": _threads, "REPORT": _reports}
    out = _transcripts(spark, sf_dir).select("document_id", F.lit("TRANSCRIPT").alias("document_type"), "text", F.lit("2024-03-04").alias("document_date"), F.lit("Weekly").alias("title"))
    for kind, write in kinds.items():
        out = out.union(write(spark, sf_dir).select("document_id", F.lit(kind), "text", null, null))
    return out


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.parse_all(_files(spark, sf_dir))


@register(
    f"WITH {_ASSEMBLED} SELECT document_type, count(DISTINCT document_id) AS n_documents, count(*) AS n_units, md5(string_agg(md5(body), '' ORDER BY md5(body))) AS texts_md5 FROM a GROUP BY document_type"
)
def parse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all types parsed as their type says, into one table of units."""
    u = archive.parse_all(_files(spark, sf_dir)).withColumn("h", F.md5("raw_text"))
    return u.groupBy("document_type").agg(F.count_distinct("document_id").alias("n_documents"), F.count("*").alias("n_units"), F.md5(F.array_join(F.sort_array(F.collect_list("h")), "")).alias("texts_md5"))


@register(f"WITH {_ASSEMBLED} SELECT document_id, document_type, unit_index, event_date, thread_context, speaker AS speaker_sender, md5(body) AS text_md5 FROM a")
def unit_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed mail, transcripts and reports as one table of units, with their documents' dates and titles."""
    return _assembled(spark, sf_dir).select("document_id", "document_type", F.col("unit_index").cast("long"), "event_date", "thread_context", "speaker_sender", F.md5("raw_text").alias("text_md5"))


@register(f"WITH {_ASSEMBLED} SELECT document_type, count(DISTINCT document_id) AS n_documents, count(*) AS n_units, count(*) FILTER (speaker IS NULL OR speaker IN ('Me', 'Them')) AS n_anonymous, count(*) FILTER (regexp_matches(body, '[—–]$')) AS n_truncated FROM a GROUP BY document_type")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.ingest_report(_assembled(spark, sf_dir))


@register("SELECT user_id AS document_id, event_id AS position, coalesce(CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 2 AS INTEGER) END, CASE WHEN event_id % 4 <> 1 THEN 1 END) AS starts_group FROM events WHERE event_id % 3 = 0 OR event_id % 4 <> 1")
def group_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of groups recorded by a first parse of a third of the events, and by a second one of three quarters."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("position"))
    known = e.where("position % 3 = 0").withColumn("starts_group", (F.col("position") % 2).cast("int"))
    return archive.record_boundaries(known, e.where("position % 4 <> 1").withColumn("starts_group", F.lit(1)))


@register(
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, '') || ' [cid:a1.png]  Image removed [Image removed by sender] end', '(?i)\[Image removed by sender\]', ' ', 'g'), '(?i)\[cid:[^\]]*\]', ' ', 'g'), '(?i)Bild borttagen av avs[äa]ndaren', ' ', 'g'),
'(^|[^A-Za-z])Image($|[^A-Za-z])', '\1 \2', 'g'), '[ \t]+', ' ', 'g'), ' ')) AS search_md5 FROM documents"""
)
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index reads of a text with placeholders behind it."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" [cid:a1.png]  Image removed [Image removed by sender] end"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.search_text(text)).alias("search_md5"))


# --- manifests and uploads ------------------------------------------------------------------


@register(
    """WITH a AS (SELECT c_custkey AS k, CASE c_custkey % 12 WHEN 0 THEN ' ' WHEN 1 THEN 'Unknown Speaker' ELSE c_name END AS canonical_name, CASE c_custkey % 12 WHEN 2 THEN '' WHEN 3 THEN 'Guest 7' WHEN 5 THEN upper(c_name) WHEN 7 THEN 'no address' WHEN 8 THEN 'Common Alias' WHEN 9 THEN NULL ELSE 'Alias ' || c_custkey END AS alias,
  CASE c_custkey % 12 WHEN 4 THEN 'NICKNAME' WHEN 7 THEN 'EMAIL' WHEN 9 THEN NULL ELSE 'VARIANT' END AS alias_type, CASE WHEN c_custkey % 12 <> 6 THEN 'doc' END AS source_reference FROM customer),
s AS (SELECT alias AS key FROM a WHERE alias IS NOT NULL GROUP BY alias HAVING count(DISTINCT canonical_name) > 1)
SELECT canonical_name, alias, CASE k % 12 WHEN 0 THEN 'empty name' WHEN 1 THEN 'reserved name' WHEN 2 THEN 'empty alias' WHEN 3 THEN 'reserved alias' WHEN 4 THEN 'alias type' END AS problem FROM a WHERE k % 12 < 5
UNION ALL SELECT canonical_name, alias, 'alias of several people' FROM a WHERE alias IN (SELECT key FROM s)"""
)
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a manifest of the customers, one in twelve for each rule; names as aliases, missing sources and addresses of any form are allowed."""
    k = F.col("c_custkey") % 12
    name = F.when(k == 0, " ").when(k == 1, "Unknown Speaker").otherwise(F.col("c_name"))
    alias = F.when(k == 2, "").when(k == 3, "Guest 7").when(k == 5, F.upper("c_name")).when(k == 7, "no address").when(k == 8, "Common Alias").when(k != 9, F.concat(F.lit("Alias "), "c_custkey"))
    kind = F.when(k == 4, "NICKNAME").when(k == 7, "EMAIL").when(k != 9, "VARIANT")
    return manifests.violations(read(spark, sf_dir, "customer").select(name.alias("canonical_name"), alias.alias("alias"), kind.alias("alias_type"), F.when(k != 6, "doc").alias("source_reference")))


@register(
    """WITH e AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'Supplier ' || s_nationkey ELSE s_name END AS canonical_name, CASE WHEN s_suppkey % 7 <> 0 THEN 'seen' ELSE ' ' END AS note FROM supplier), t AS (SELECT canonical_name FROM e GROUP BY ALL HAVING count(*) > 1)
SELECT canonical_name, 'name comes twice' AS problem FROM t UNION SELECT canonical_name, 'no review note' FROM e WHERE note = ' ' UNION SELECT canonical_name, 'source documents' FROM e WHERE k % 3 = 0 OR k % 4 = 0"""
)
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    sources = F.when(k % 3 == 0, None).when(k % 4 == 0, F.array(F.lit("a"), F.lit(""))).otherwise(F.array(F.lit("a")))
    e = read(spark, sf_dir, "supplier").select(F.when(k % 5 == 0, F.concat(F.lit("Supplier "), "s_nationkey")).otherwise(F.col("s_name")).alias("canonical_name"), F.when(k % 7 != 0, "seen").otherwise(" ").alias("review_note"), sources.alias("source_documents"))
    return manifests.entry_violations(e)


@register(
    r"""WITH u AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'C:\tmp\Übersicht ' || doc_id || '.TXT' WHEN 1 THEN '.hidden' WHEN 2 THEN 'a/b/' || source || '.txt' ELSE 'né w__' || doc_id || '!.txt' END AS name, doc_id % 8 AS c FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Ubersicht-' || doc_id WHEN 1 THEN NULL WHEN 2 THEN regexp_extract(name, '([^/]+)\.txt$', 1) ELSE 'ne-w__' || doc_id END AS document_id, CASE WHEN doc_id % 6 = 1 THEN 'name' WHEN c = 0 THEN 'not UTF-8' WHEN c = 1 THEN 'NUL byte' WHEN c = 2 THEN 'empty' END AS problem FROM u"""
)
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded documents under odd names, some of them not text."""
    d, c = F.col("doc_id"), F.col("doc_id") % 8
    name = F.when(d % 6 == 0, F.concat(F.lit("C:\\tmp\\Übersicht "), d, F.lit(".TXT"))).when(d % 6 == 1, ".hidden").when(d % 6 == 2, F.concat(F.lit("a/b/"), "source", F.lit(".txt"))).otherwise(F.concat(F.lit("né w__"), d, F.lit("!.txt")))
    text = F.encode(F.concat("text", F.lit("x")), "utf-8")
    content = F.when(c == 0, F.unhex(F.lit("FFFE41"))).when(c == 1, F.concat(text, F.unhex(F.lit("00")))).when(c == 2, F.encode(F.lit(" \n"), "utf-8")).otherwise(text)
    return uploads.validated(read(spark, sf_dir, "documents").select("doc_id", name.alias("name"), content.alias("content"))).select("doc_id", "document_id", "problem")


@register(
    """WITH u AS (SELECT source AS document_id, CAST(doc_id AS VARCHAR) AS name, sha256(CAST(doc_id AS VARCHAR) || '|' || upper(hex(CAST(source AS BLOB)))) AS digest FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY name, digest) AS nth FROM u)
SELECT CASE WHEN nth = 1 AND document_id NOT IN ('src1', 'src2') THEN document_id ELSE document_id || '-' || left(sha256(digest || '|' || nth), 8) END AS document_id, name FROM n"""
)
def upload_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents uploaded under the names of their sources, two of which are taken already."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("name"), F.encode("source", "utf-8").alias("content"))
    taken = read(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2")).select(F.col("source").alias("document_id"))
    return uploads.without_collisions(d, taken).select("document_id", "name")


# --- locators and sealed identities ---------------------------------------------------------


@register(
    """WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 't' || turn END AS nat, substr(sha256(role), 1, 16) AS fp FROM conversations), m AS (SELECT conv_id, turn, fp, row_number() OVER (PARTITION BY conv_id, fp ORDER BY turn) AS k FROM p WHERE conv_id % 3 = 0 AND nat IS NULL AND turn % 4 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, fp ORDER BY turn) AS k FROM p WHERE nat IS NULL), j AS (SELECT r.*, m.turn AS genesis FROM r LEFT JOIN m USING (conv_id, fp, k)), h AS (SELECT conv_id, max(turn) AS high FROM p WHERE conv_id % 3 = 0 GROUP BY conv_id)
SELECT conv_id AS document_id, turn AS position, nat AS source_locator, conv_id % 3 <> 0 AS minted FROM p WHERE nat IS NOT NULL UNION ALL SELECT conv_id, turn, printf('u%04d', genesis), false FROM j WHERE genesis IS NOT NULL
UNION ALL SELECT j.conv_id, turn, printf('u%04d', coalesce(high, -1) + row_number() OVER (PARTITION BY j.conv_id ORDER BY turn)), true FROM j LEFT JOIN h ON h.conv_id = j.conv_id WHERE genesis IS NULL"""
)
def locator_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with natural locators and units without, against the manifest of a third of the documents, some of whose rows are revoked."""
    t = read(spark, sf_dir, "conversations")
    nat = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("t"), "turn"))
    parsed = t.select(F.col("conv_id").alias("document_id"), F.col("turn").cast("long").alias("position"), nat.alias("natural_locator"), T.text_hash(F.col("role")).alias("fingerprint"))
    locator = F.coalesce("natural_locator", F.format_string("u%04d", "position"))
    manifest = parsed.where("document_id % 3 = 0").select("document_id", locator.alias("source_locator"), F.col("position").alias("genesis_position"), "fingerprint", F.when(F.col("natural_locator").isNull() & (F.col("position") % 4 != 1), "2024-01-01").alias("revoked_at"))
    return identity.assign_locators(parsed, manifest)


@register("SELECT source AS document_id, 'u' || doc_id AS source_locator, CASE WHEN doc_id % 10 = 0 AND doc_id % 20 <> 0 THEN 'REVOKED' ELSE substr(sha256(text), 1, 16) END AS content_fingerprint, CASE WHEN doc_id % 20 = 0 THEN '2023-01-01' WHEN doc_id % 10 = 0 THEN '2024-05-01' END AS revoked_at FROM documents")
def locator_revocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the locators is revoked, half of them for the second time."""
    d = read(spark, sf_dir, "documents")
    m = d.select(F.col("source").alias("document_id"), F.concat(F.lit("u"), "doc_id").alias("source_locator"), T.text_hash(F.col("text")).alias("content_fingerprint"), F.when(F.col("doc_id") % 20 == 0, "2023-01-01").alias("revoked_at"))
    gone = d.where("doc_id % 10 = 0").select(F.col("source").alias("document_id"), F.concat(F.lit("u"), "doc_id").alias("source_locator"))
    return identity.revoke(m, gone, "2024-05-01").select("document_id", "source_locator", "content_fingerprint", "revoked_at")


@register("SELECT source AS document_id, substr(sha256(text), 1, 16) AS old_fingerprint, substr(sha256(text || '!'), 1, 16) AS new_fingerprint FROM documents WHERE doc_id % 4 = 0")
def locator_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new fingerprints where a rewrite changed a text: every fourth here."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("position"), "text")
    new = d.withColumn("text", F.when(F.col("position") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return identity.remap(*(x.select("document_id", "position", T.text_hash(F.col("text")).alias("fingerprint")) for x in (d, new)))


@register("SELECT c_custkey AS subject_id, md5(c_name || '|' || c_mktsegment) AS bundle_md5, true AS hidden FROM customer")
def sealed_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities sealed and opened again; what is stored shows nothing of them."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), F.concat_ws("|", "c_name", "c_mktsegment").alias("bundle"))
    sealed = privacy.seal(c, "0123456789abcdef0123456789abcdef")
    opened = privacy.unseal(sealed, "0123456789abcdef0123456789abcdef").withColumnRenamed("bundle", "opened")
    hidden = sealed.join(c, "subject_id").select("subject_id", (~F.contains("ciphertext", "bundle")).alias("hidden"))
    return opened.join(hidden, "subject_id").select("subject_id", F.md5("opened").alias("bundle_md5"), "hidden")


@register("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type by the hour, by the function that a stream uses."""
    return windowed_counts(read(spark, sf_dir, "events"))
