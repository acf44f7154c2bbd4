"""Registered queries on people and privacy, with equivalent SQL.

The names of two or three words in the documents are the people: each has an id, an alias, and some have reviewed
short forms. Texts in which nobody is named get a name behind them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import people, privacy
from ..sources import archive
from ..sources.store import stored
from ..sources.tables import read
from .evidence import NAMES_SQL, WORDS_SQL, _names
from .ingest import _threads, _transcripts

QUERIES, SQL = {}, {}


def register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PEOPLE_SQL = rf"""{NAMES_SQL},
fam AS (SELECT DISTINCT string_split_regex(c_mktsegment, '\s+')[1] AS seg FROM customer),
pp AS (SELECT DISTINCT name AS display_name FROM names UNION SELECT 'Ana ' || upper(left(n_name, 1)) || lower(substr(regexp_extract(n_name, '^[A-Za-z]+'), 2)) FROM nation UNION SELECT upper(left(r_name, 1)) || lower(substr(regexp_extract(r_name, '^[A-Za-z]+'), 2)) || ' Person' FROM region UNION SELECT 'Zorro Zorro'),
people AS (SELECT md5(display_name) AS subject_id, display_name, 'Person ' || left(md5(display_name), 6) AS display_alias FROM pp),
aliases AS (SELECT subject_id, display_name AS alias, 'FULL_NAME' AS alias_type FROM people UNION ALL SELECT subject_id, lower(replace(display_name, ' ', '.')) || '@example.org', 'EMAIL' FROM people WHERE subject_id < '8'
  UNION ALL SELECT subject_id, string_split_regex(display_name, '\s+')[1], 'FIRST_NAME' FROM people WHERE subject_id < '2' UNION ALL SELECT subject_id, 'Old ' || display_name, 'VARIANT' FROM people WHERE subject_id > 'c')"""


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """people(subject_id, display_name, display_alias) and aliases(subject_id, alias, alias_type)."""
    title = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(F.regexp_extract(c, "^[A-Za-z]+", 0), 2, 99)))
    names = _names(spark, sf_dir).select("name").union(read(spark, sf_dir, "nation").select(F.concat(F.lit("Ana "), title(F.col("n_name"))))).union(read(spark, sf_dir, "region").select(F.concat(title(F.col("r_name")), F.lit(" Person"))))
    names = stored(names.union(spark.range(1).select(F.lit("Zorro Zorro"))).distinct())
    p = names.select(F.md5("name").alias("subject_id"), F.col("name").alias("display_name"), F.concat(F.lit("Person "), F.left(F.md5("name"), F.lit(6))).alias("display_alias"))
    a = p.select("subject_id", F.col("display_name").alias("alias"), F.lit("FULL_NAME").alias("alias_type"))
    a = a.union(p.where("subject_id < '8'").select("subject_id", F.concat(F.lower(F.replace("display_name", F.lit(" "), F.lit("."))), F.lit("@example.org")), F.lit("EMAIL")))
    a = a.union(p.where("subject_id < '2'").select("subject_id", F.get(F.split("display_name", r"\s+"), F.lit(0)), F.lit("FIRST_NAME")))
    return p, a.union(p.where("subject_id > 'c'").select("subject_id", F.concat(F.lit("Old "), "display_name"), F.lit("VARIANT")))


_INDEX_SQL = rf"""{PEOPLE_SQL}, {WORDS_SQL},
nm AS (SELECT subject_id, display_name AS name FROM people UNION SELECT subject_id, alias FROM aliases WHERE alias_type IN ('FULL_NAME', 'VARIANT') AND trim(alias) LIKE '% %'),
fl AS (SELECT min(subject_id) AS subject_id, 'FULL' AS kind, key AS token, NULL AS reason FROM (SELECT DISTINCT subject_id, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS key FROM nm) GROUP BY key HAVING count(*) = 1),
ow AS (SELECT key, count(DISTINCT subject_id) AS owners FROM (SELECT subject_id, unnest(string_split(lower(trim(regexp_replace(name, '\s+', ' ', 'g'))), ' ')) AS key FROM nm) GROUP BY key),
gv AS (SELECT subject_id, replace(alias_type, '_NAME', '') AS kind, alias AS token FROM aliases WHERE alias_type IN ('FIRST_NAME', 'LAST_NAME')),
fm AS (SELECT subject_id, w[1] AS first, 'FIRST' AS kind, w[1] AS token FROM (SELECT subject_id, string_split_regex(trim(display_name), '\s+') AS w FROM people) WHERE len(w) > 1 UNION ALL SELECT subject_id, w[1], 'LAST', w[-1] FROM (SELECT subject_id, string_split_regex(trim(display_name), '\s+') AS w FROM people) WHERE len(w) > 1),
rs AS (SELECT DISTINCT unnest(string_split(lower(display_alias), ' ')) AS key FROM people),
jd AS (SELECT f.subject_id, f.kind, f.token, CASE WHEN NOT (regexp_matches(f.token, '^\p{{L}}[\p{{L}}''-]*$') AND length(f.token) >= 3) THEN 'too-short' WHEN lower(f.token) IN (SELECT key FROM rs) THEN 'reserved'
  WHEN owners > 1 OR lower(f.token) IN (SELECT lower(token) FROM gv) OR (f.kind = 'LAST' AND lower(first) = lower(f.token)) THEN 'shared' WHEN lower(f.token) IN ({", ".join(f"'{w}'" for w in people.COMMON_WORD_NAMES)}) OR coalesce(lower > capital, false) THEN 'ordinary-word' END AS reason
  FROM fm f LEFT JOIN ow ON ow.key = lower(f.token) LEFT JOIN cases ON word = lower(f.token) WHERE NOT EXISTS (SELECT 1 FROM gv WHERE gv.subject_id = f.subject_id AND gv.kind = f.kind)),
ix AS (SELECT * FROM fl UNION ALL SELECT *, NULL FROM gv UNION ALL SELECT * FROM jd)"""


def _index(spark: SparkSession, sf_dir: str, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    p, a = known or _people(spark, sf_dir)
    words = people.parts(p.select(F.col("display_name").alias("name"))).select(F.col("part").alias("word"))
    return people.strict_index(p, a, people.case_counts(read(spark, sf_dir, "documents").withColumnRenamed("text", "raw_text"), words))


@register(f"WITH {_INDEX_SQL} SELECT subject_id, kind, token, reason FROM ix")
def strict_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which full, first and last names stand for one person, and why the others don't."""
    return _index(spark, sf_dir)


@register(
    rf"""WITH {_INDEX_SQL}, q AS (SELECT display_name AS name FROM people UNION SELECT upper(display_name) FROM people UNION SELECT w FROM (SELECT unnest(string_split_regex(display_name, '\s+')) AS w FROM people)),
f AS (SELECT lower(token) AS k, min(subject_id) AS s FROM ix WHERE kind = 'FIRST' AND reason IS NULL GROUP BY lower(token))
SELECT q.name, coalesce(a.subject_id, f.s) AS subject_id, CASE WHEN a.subject_id IS NOT NULL THEN 'FULL_NAME' WHEN f.s IS NOT NULL THEN 'FIRST_NAME' END AS basis FROM q LEFT JOIN ix a ON a.kind = 'FULL' AND a.token = lower(trim(regexp_replace(q.name, '\s+', ' ', 'g'))) LEFT JOIN f ON f.k = lower(trim(regexp_replace(q.name, '\s+', ' ', 'g')))"""
)
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full names in any case, and single words of them."""
    p, a = _people(spark, sf_dir)
    asked = p.select(F.col("display_name").alias("name")).union(p.select(F.upper("display_name"))).union(p.select(F.explode(F.split("display_name", r"\s+")))).distinct()
    return people.resolve(asked, stored(_index(spark, sf_dir, (p, a))))


@register(
    f"""WITH {PEOPLE_SQL}, q AS (SELECT display_name AS name FROM people UNION SELECT display_alias FROM people UNION SELECT 'New ' || display_name FROM people)
SELECT q.name, coalesce(p.subject_id, a.subject_id, '?') AS subject_id, p.subject_id IS NULL AND a.subject_id IS NULL AS minted FROM q LEFT JOIN (SELECT display_alias, min(subject_id) AS subject_id FROM people GROUP BY display_alias) p ON p.display_alias = q.name LEFT JOIN (SELECT alias, min(subject_id) AS subject_id FROM aliases WHERE alias_type = 'FULL_NAME' GROUP BY alias) a ON a.alias = q.name"""
)
def resolve_or_mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, aliases and new names; a form of several people stands for the smallest id; the ids of new ones are random and shown as one mark."""
    p, a = _people(spark, sf_dir)
    asked = p.select(F.col("display_name").alias("name")).union(p.select("display_alias")).union(p.select(F.concat(F.lit("New "), "display_name")))
    return people.resolve_or_mint(asked, p, a).select("name", F.when(F.col("minted"), "?").otherwise(F.col("subject_id")).alias("subject_id"), "minted")


@register(f"WITH {PEOPLE_SQL} SELECT subject_id, alias, alias_type FROM aliases WHERE alias_type IN ('FULL_NAME', 'EMAIL') UNION SELECT subject_id, 'R' || left(display_name, 1), 'INITIALS' FROM people WHERE subject_id > 'a'")
def reviewed_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short forms are those of the last review alone."""
    p, a = _people(spark, sf_dir)
    return people.with_reviewed(a, p.where("subject_id > 'a'").select("subject_id", F.concat(F.lit("R"), F.left("display_name", F.lit(1))).alias("alias"), F.lit("INITIALS").alias("alias_type")))


@register(rf"WITH {PEOPLE_SQL} SELECT name, n FROM names WHERE name NOT IN (SELECT display_name FROM people WHERE subject_id < '4') AND len(list_distinct(string_split_regex(lower(name), '\s+'))) = len(string_split_regex(name, '\s+')) AND name NOT IN ('General Public License', 'Apache License')")
def free_text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for review: no known person, no title of the stoplist, no repeated word."""
    known = _people(spark, sf_dir)[0].where("subject_id < '4'").select(F.col("display_name").alias("name"))
    return people.free_text_names(read(spark, sf_dir, "documents").withColumnRenamed("text", "raw_text"), known, ["General Public License", "Apache License"])


@register(
    """WITH s AS (SELECT 'Ana Duarte' AS name, count(*) FILTER (turn % 3 = 0) + count(*) FILTER (conv_id % 2 = 1 AND turn % 2 = 0) AS n, 'ana@example.org' AS email FROM conversations UNION ALL SELECT 'Bo Li', count(*) FILTER (turn % 3 = 1) + count(*) FILTER (conv_id % 2 = 1 AND turn % 2 = 1), NULL FROM conversations)
SELECT name, email, n FROM s"""
)
def structural_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders of mail and speakers of transcripts that have a name; the first address of a name."""
    m = archive.messages(_threads(spark, sf_dir)).select(F.col("sender_name").alias("name"), F.col("sender_email").alias("email"), F.concat_ws("-", "document_id", "idx").alias("seq"))
    t = archive.transcripts(_transcripts(spark, sf_dir)).select(F.col("speaker_sender").alias("name"), F.lit(None).cast("string").alias("email"), F.concat_ws("-", "document_id", "position").alias("seq"))
    return people.structural_names(m.union(t))


_INITIALS = r"upper(array_to_string(list_transform(string_split_regex(trim(display_name), '\s+'), lambda x: left(x, 1)), ''))"


@register(
    rf"""WITH {_INDEX_SQL}, ws AS (SELECT subject_id, string_split_regex(trim(display_name), '\s+') AS w, {_INITIALS} AS i FROM people),
fo AS (SELECT subject_id, w[1] AS token, true AS word FROM ws WHERE len(w) > 1 UNION ALL SELECT subject_id, w[-1], true FROM ws WHERE len(w) > 1 UNION ALL SELECT subject_id, i, false FROM ws WHERE len(w) > 1),
d AS (SELECT subject_id, alias FROM aliases UNION SELECT subject_id, display_alias FROM people UNION SELECT subject_id, token FROM ix WHERE reason IS NULL AND kind IN ('FIRST', 'LAST')
  UNION SELECT min(subject_id), token FROM fo GROUP BY token HAVING count(DISTINCT subject_id) = 1 AND NOT bool_or(word)),
u AS (SELECT doc_id, text || CASE doc_id % 8 WHEN 0 THEN ' with Ana Nation' WHEN 2 THEN ' and Ana Nationville, zorro.zorro@example.orgs' WHEN 4 THEN ' with Ana Nation, ZZ' WHEN 5 THEN ' (Person ' || left(md5('Zorro Zorro'), 6) || ')' WHEN 6 THEN ' see old Zorro  Zorro or zorro.zorro@example.org' WHEN 7 THEN ' Old Africa Person.' ELSE '' END AS t FROM documents),
c AS (SELECT doc_id, t, unnest(list_distinct(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'))) AS head FROM u), h AS (SELECT subject_id, alias, list_reverse(list_sort(list_transform(regexp_extract_all(alias, '[\p{{L}}\p{{N}}_]+'), lambda x: {{'n': length(x), 'w': x}})))[1].w AS head FROM d)
SELECT DISTINCT doc_id, subject_id FROM c JOIN h USING (head) WHERE regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(alias) || '($|[^\p{{L}}\p{{N}}_])') AND NOT (doc_id % 16 = 0 AND subject_id = md5('Ana Nation'))"""
)
def mention_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases, display aliases, strict first and last names and initials in whole texts; authors are not mentioned in their own. Names of people that exist are planted, with near misses."""
    p, a = _people(spark, sf_dir)
    tails = {0: " with Ana Nation", 2: " and Ana Nationville, zorro.zorro@example.orgs", 4: " with Ana Nation, ZZ", 6: " see old Zorro  Zorro or zorro.zorro@example.org", 7: " Old Africa Person."}
    tail = F.when(F.col("doc_id") % 8 == 5, F.concat(F.lit(" (Person "), F.left(F.md5(F.lit("Zorro Zorro")), F.lit(6)), F.lit(")")))
    for k, v in tails.items():
        tail = tail.when(F.col("doc_id") % 8 == k, v)
    u = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.concat("text", tail.otherwise("")).alias("raw_text"))
    stronger = u.where("evidence_id % 16 = 0").select("evidence_id", F.md5(F.lit("Ana Nation")).alias("subject_id"))
    dictionary = stored(people.mention_dictionary(p, a, _index(spark, sf_dir, (p, a))))
    return people.link_mentions(u, dictionary, stronger).withColumnRenamed("evidence_id", "doc_id")


@register(
    rf"""WITH {PEOPLE_SQL}, p AS (SELECT DISTINCT string_split_regex(display_name, '\s+')[1] AS candidate, display_name AS full_name FROM people), c AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))) AS candidate FROM documents),
n AS (SELECT candidate, full_name, count(*) AS n FROM c JOIN p USING (candidate) WHERE regexp_matches(replace(text, full_name, chr(1)), '(^|[^\p{{L}}\p{{N}}_])' || candidate || '($|[^\p{{L}}\p{{N}}_])') GROUP BY ALL)
SELECT candidate, full_name, coalesce(n, 0) AS n_units FROM p LEFT JOIN n USING (candidate, full_name)"""
)
def independent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many texts the first word of a name stands outside the name."""
    pairs = _people(spark, sf_dir)[0].select(F.get(F.split("display_name", r"\s+"), F.lit(0)).alias("candidate"), F.col("display_name").alias("full_name")).distinct()
    u = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("raw_text"))
    return people.independent(u, pairs)


# --- privacy --------------------------------------------------------------------------------


@register(
    rf"""WITH {_INDEX_SQL}, f AS (SELECT subject_id, min(form) AS form FROM (SELECT subject_id, display_name AS form FROM people UNION ALL SELECT subject_id, alias FROM aliases WHERE alias_type <> 'EMAIL' UNION ALL SELECT subject_id, token FROM ix WHERE reason IS NULL AND kind IN ('FIRST', 'LAST')) GROUP BY subject_id, lower(form)),
n AS (SELECT subject_id, string_agg(form, '|' ORDER BY -length(form), form) AS names FROM f GROUP BY subject_id) SELECT n.subject_id, names, coalesce(string_agg(alias, '|' ORDER BY alias), '') AS emails FROM n LEFT JOIN aliases a ON a.subject_id = n.subject_id AND alias_type = 'EMAIL' GROUP BY n.subject_id, names"""
)
def privacy_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an operation on each person looks for: forms of the name, the longest first, and addresses."""
    t = privacy.targets(*_people(spark, sf_dir), _index(spark, sf_dir))
    return t.select("subject_id", F.array_join("names", "|").alias("names"), F.array_join("emails", "|").alias("emails"))


_TAIL = "text || chr(10) || '  Ana Duarte ' || chr(10) || 'Head of all' || chr(10) || 'ana@example.org' || chr(10) || chr(10) || 'AD' || chr(10) || 'told ana' || chr(10) || 'DUARTE and analysis, ANA@EXAMPLE.ORG'"


def _signed() -> F.Column:
    return F.concat(F.col("text"), F.lit("\n  Ana Duarte \nHead of all\nana@example.org\n\nAD\ntold ana\nDUARTE and analysis, ANA@EXAMPLE.ORG"))


_ANA = (["Ana Duarte", "Ana", "Duarte"], ["ana@example.org"], "Person Amber")


def _ana_sql(text: str) -> str:
    out = f"regexp_replace({text}, 'ana@example\\.org', 'person-amber@pseudonymised.invalid', 'gi')"
    for name in (r"Ana\s+Duarte", "Duarte", "Ana"):
        out = f"regexp_replace(regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}_]){name}($|[^\\p{{L}}\\p{{N}}_])', '\\1Person Amber\\2', 'gi'), '(^|[^\\p{{L}}\\p{{N}}_]){name}($|[^\\p{{L}}\\p{{N}}_])', '\\1Person Amber\\2', 'gi')"
    return out


@register(
    rf"""WITH t AS (SELECT doc_id, {_TAIL} AS t FROM documents), m AS (SELECT doc_id, regexp_replace(t, '(?i)(^|\n)[ \t]*(?:Ana[ \t]+Duarte|Duarte|Ana)[ \t]*(?:\n[^\n]*\S[^\n]*){{0,6}}(\n|$)', '\1Person Amber\2', 'g') AS mail, regexp_replace(t, '\n[ \t]*AD[ \t]*(\n|$)', '\1', 'g') AS said FROM t)
SELECT doc_id, md5({_ana_sql('mail')}) AS mail_md5, md5({_ana_sql('said')}) AS transcript_md5 FROM m"""
)
def rewrite_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents signed by a person, rewritten as mail and as transcripts."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(privacy.rewrite(_signed(), "EMAIL", *_ANA)).alias("mail_md5"), F.md5(privacy.rewrite(_signed(), "TRANSCRIPT", *_ANA, "AD")).alias("transcript_md5"))


@register("SELECT doc_id, md5(text || ' by Zoë $1 O''Neil\\, zoe@example.org') AS text_md5 FROM documents")
def restored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name with signs that patterns use, and its address, hidden and restored."""
    name, email = "Zoë $1 O'Neil\\", "zoe@example.org"
    hidden = privacy.pseudonymise(F.concat("text", F.lit(f" by {name}, {email}")), [name], [email], "Person Amber")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(privacy.restore(hidden, "Person Amber", name, email)).alias("text_md5"))


@register("SELECT c_name AS canonical_name, 'Alias ' || c_custkey AS alias FROM customer WHERE c_custkey NOT IN (3, 5, 8)")
def manifest_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest without three people: two by an alias, one by the name in capitals."""
    c = read(spark, sf_dir, "customer")
    manifest = c.select(F.col("c_name").alias("canonical_name"), F.concat(F.lit("Alias "), "c_custkey").alias("alias"))
    name = c.where("c_custkey = 8").select(F.upper("c_name")).first()
    return privacy.without_entries(manifest, ["alias 3", "ALIAS 5", *([name[0]] if name else [])])


_SURFACES = {"documents": "text", "conversations": "text", "pages": "html", "benchmark": "text"}


@register(
    "WITH h AS ("
    + " UNION ALL ".join(rf"SELECT '{t}' AS s, coalesce(sum(len(regexp_extract_all(regexp_replace(lower(coalesce({c}, '')), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])idiot(?:$|[^\p{{L}}\p{{N}}_])')) + len(regexp_extract_all(lower(coalesce({c}, '')), 'admin@example\.com'))), 0) AS hits FROM {t}" for t, c in _SURFACES.items())
    + " UNION ALL SELECT 'sealed identities', 0 UNION ALL SELECT 'file names', 0 UNION ALL SELECT 'labels', 0) SELECT 'surface: ' || s AS item, hits = 0 AS ok FROM h UNION ALL SELECT 'check: ' || c, ok FROM (VALUES ('subject_is_pseudonymised', true), ('display_alias_matches', true), ('display_name_cleared', true), ('no_original_aliases_remain', false), ('evidence_people_relationships_preserved', true)) v(c, ok)"
)
def verification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That no surface shows a person's name or address, and the checks; the aliases of this one were left behind."""
    hits = None
    for t, c in _SURFACES.items():
        found = privacy.content_hits(read(spark, sf_dir, t).select(c, F.lit("idiot").alias("kept_alias")), ["idiot", "admin@example.com"], t, ("kept_alias",))
        hits = found if hits is None else hits.union(found)
    c = read(spark, sf_dir, "customer").where("c_custkey = 1")
    sealed = privacy.seal(c.select(F.col("c_custkey").alias("subject_id"), F.lit("idiot, admin@example.com").alias("bundle")), "0123456789abcdef")
    for name, surface in (("sealed identities", sealed.select("ciphertext")), ("file names", privacy.file_names(read(spark, sf_dir, "documents"))), ("labels", read(spark, sf_dir, "labels"))):
        hits = hits.union(privacy.content_hits(surface, ["idiot", "admin@example.com"], name))
    person = c.select(F.col("c_custkey").alias("subject_id"), F.lit("PSEUDONYMISED").alias("privacy_state"), F.lit("Person Amber").alias("display_alias"), F.lit(None).cast("string").alias("display_name"))
    relations = read(spark, sf_dir, "orders").where("o_custkey = 1").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderstatus").alias("relation"))
    return privacy.verification(hits, person, c.select(F.col("c_custkey").alias("subject_id")), relations, relations, "Person Amber")


@register(
    """WITH t AS (SELECT 'documents' AS surface, lower(text) || ' from nation_' || doc_id % 30 || 'nation_1' AS t FROM documents UNION ALL SELECT 'conversations', lower(text) || ' Nation_' || turn FROM conversations)
SELECT s.surface, n_name AS needle, coalesce(sum((length(t) - length(replace(lower(t), lower(n_name), ''))) // length(n_name)), 0)::BIGINT AS hits, count(*) FILTER (contains(lower(t), lower(n_name))) AS n_rows FROM nation, (VALUES ('documents'), ('conversations')) s(surface) LEFT JOIN t ON t.surface = s.surface GROUP BY ALL"""
)
def needle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations as needles, searched by one automaton; names that are parts of other names are planted."""
    needles = [r["n_name"] for r in read(spark, sf_dir, "nation").collect()]  # one name a nation
    d = read(spark, sf_dir, "documents").select(F.concat(F.lower("text"), F.lit(" from nation_"), F.col("doc_id") % 30, F.lit("nation_1")).alias("t"))
    c = read(spark, sf_dir, "conversations").select(F.concat(F.lower("text"), F.lit(" Nation_"), "turn").alias("t"))
    return privacy.needle_counts(d, "t", needles, "documents").union(privacy.needle_counts(c, "t", needles, "conversations"))


@register(
    """WITH gone AS (SELECT o_orderkey FROM orders WHERE o_custkey % 40 = 3), f AS (SELECT p_partkey AS finding_id, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % (SELECT count(*) FROM supplier) + 1 END AS case_id, p_partkey % 50 = 7 AS named FROM part),
s AS (SELECT DISTINCT l_partkey AS id, 'cited' AS reason FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM gone) UNION ALL SELECT finding_id, 'prose' FROM f WHERE named)
SELECT 'finding' AS kind, id, reason FROM s UNION ALL SELECT DISTINCT 'case', l_suppkey, 'cited' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM gone) UNION ALL SELECT 'case', s_suppkey, 'prose' FROM supplier WHERE regexp_matches(s_name, '7$') UNION ALL SELECT DISTINCT 'case', case_id, 'linked' FROM f JOIN s ON s.id = finding_id WHERE case_id IS NOT NULL"""
)
def findings_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings (parts) and cases (suppliers) that cite units of some people, name them, or are linked with such a finding."""
    gone = read(spark, sf_dir, "orders").where("o_custkey % 40 = 3").select(F.col("o_orderkey").alias("evidence_id"))
    line = read(spark, sf_dir, "lineitem")
    cited = line.select(F.lit("finding").alias("kind"), F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("evidence_id")).union(line.select(F.lit("case"), "l_suppkey", "l_orderkey"))
    supplier = read(spark, sf_dir, "supplier")
    n = supplier.agg(F.count("*").alias("n"))
    key = F.col("p_partkey")
    findings = read(spark, sf_dir, "part").join(F.broadcast(n)).select(key.alias("finding_id"), F.when(key % 3 != 0, key % F.col("n") + 1).alias("case_id"), F.when(key % 50 == 7, "by Ana").otherwise("by no one").alias("prose"))
    cases = supplier.select(F.col("s_suppkey").alias("case_id"), F.when(F.col("s_name").rlike("7$"), "ANA said").otherwise("analysis").alias("prose"))
    return privacy.invalidated(findings, cases, cited, gone, privacy.whole("Ana"))
