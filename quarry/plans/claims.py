"""Registered queries on claims, reviews and cards, with equivalent SQL.

Conversations stand for cases: each assistant turn is a claim with its whole text, which cites the
turns around it and an id that exists nowhere; turns are the units. Words and marks that the rules
look for are put behind the whole texts, as the given ones never hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import nested, receipts
from ..sources.tables import read

QUERIES, SQL = {}, {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PROSE = r"trim(regexp_replace(regexp_replace({}, '\s*\[?\bEV-[^\s\]\[,;)]+\]?', '', 'g'), '\s{{2,}}', ' ', 'g'))"
CASES_SQL = r"""
cases AS (SELECT conv_id AS case_id, CASE conv_id % 4 WHEN 1 THEN 'CONFLICTING_EVIDENCE' WHEN 2 THEN 'PARTIALLY_SUPPORTED' ELSE 'SUPPORTED' END AS status, conv_id % 3 = 0 AS reviewed,
  min_by(text, turn) || CASE conv_id % 5 WHEN 0 THEN ' who approved it' WHEN 1 THEN ' how reliable is it now' WHEN 2 THEN ' what changed and who decided the final commitment' ELSE '' END AS query FROM conversations GROUP BY conv_id),
claims AS (SELECT conv_id AS case_id, conv_id * 100 + turn AS claim_id, CASE WHEN turn % 4 = 3 AND conv_id % 2 = 0 THEN 'EV-' || conv_id ELSE text || CASE conv_id % 3 WHEN 0 THEN ' and "signed" in full' WHEN 1 THEN ' at 12 percent' ELSE '' END || ' [EV-c' || conv_id || '-' || turn || '] end' END AS claim_text,
  CASE conv_id % 7 WHEN 0 THEN 'UNCERTAIN' WHEN 1 THEN 'PROPOSAL' ELSE 'DECISION' END AS stance, CASE conv_id % 8 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, CASE WHEN conv_id % 2 = 0 THEN 'as told in EV-x' END AS uncertainty, conv_id, turn FROM conversations WHERE role = 'assistant'),
cited AS (SELECT claim_id, claim_id - 1 - CASE WHEN conv_id % 6 = 0 THEN 50 ELSE 0 END AS evidence_id, false AS conflict FROM claims UNION ALL SELECT claim_id, claim_id + 1 - CASE WHEN conv_id % 6 = 0 THEN 50 ELSE 0 END, conv_id % 5 = 1 FROM claims UNION ALL SELECT claim_id, -claim_id - 1, false FROM claims WHERE conv_id % 9 <> 0),
units AS (SELECT conv_id * 100 + turn AS evidence_id, conv_id AS document_id, turn AS unit_index, strftime(DATE '2024-01-01' + CAST((conv_id * 7 + turn * 61) % 730 AS INTEGER), '%Y-%m-%d') AS event_date, CASE (conv_id + turn) % 3 WHEN 0 THEN 'REPORT' WHEN 1 THEN 'EMAIL' ELSE 'TRANSCRIPT' END AS document_type,
  conv_id % 5 = 0 AS is_truncated, role, text || CASE WHEN turn % 2 = 0 THEN ' please sign it' ELSE '' END AS raw_text FROM conversations)"""


def _pick(number, *values) -> F.Column:
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(number == i, v).otherwise(out)
    return out


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """cases, claims, cited, units."""
    t = read(spark, sf_dir, "conversations")
    conv, turn, key = F.col("conv_id"), F.col("turn"), F.col("conv_id") * 100 + F.col("turn")
    question = F.concat(F.min_by("text", "turn"), _pick(conv % 5, " who approved it", " how reliable is it now", " what changed and who decided the final commitment", ""))
    cases = t.groupBy("conv_id").agg(question.alias("query")).select(
        F.col("conv_id").alias("case_id"), _pick(conv % 4, "SUPPORTED", "CONFLICTING_EVIDENCE", "PARTIALLY_SUPPORTED", "SUPPORTED").alias("status"), (conv % 3 == 0).alias("reviewed"), "query"
    )
    said = F.concat(F.col("text"), _pick(conv % 3, ' and "signed" in full', " at 12 percent", ""), F.lit(" [EV-c"), conv, F.lit("-"), turn, F.lit("] end"))
    claims = t.where("role = 'assistant'").select(
        conv.alias("case_id"), key.alias("claim_id"), F.when((turn % 4 == 3) & (conv % 2 == 0), F.concat(F.lit("EV-"), conv)).otherwise(said).alias("claim_text"), _pick(conv % 7, "UNCERTAIN", "PROPOSAL", "DECISION").alias("stance"),
        _pick(conv % 8, "LOW", "MEDIUM", "HIGH").alias("confidence"), F.when(conv % 2 == 0, "as told in EV-x").alias("uncertainty"),
    )
    case, claim = F.col("case_id"), F.col("claim_id")
    off = F.when(case % 6 == 0, 50).otherwise(0)
    ids = F.array(F.struct((claim - 1 - off).alias("evidence_id"), F.lit(False).alias("conflict")), F.struct((claim + 1 - off).alias("evidence_id"), (case % 5 == 1).alias("conflict")), F.when(case % 9 != 0, F.struct((-claim - 1).alias("evidence_id"), F.lit(False).alias("conflict"))))
    cited = claims.select("claim_id", F.explode(F.array_compact(ids)).alias("c")).select("claim_id", "c.evidence_id", "c.conflict")
    units = t.select(
        key.alias("evidence_id"), conv.alias("document_id"), turn.alias("unit_index"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((conv * 7 + turn * 61) % 730).cast("int")), "yyyy-MM-dd").alias("event_date"),
        _pick((conv + turn) % 3, "REPORT", "EMAIL", "TRANSCRIPT").alias("document_type"), (conv % 5 == 0).alias("is_truncated"), "role", F.concat("text", F.when(turn % 2 == 0, " please sign it").otherwise("")).alias("raw_text"),
    )
    return cases, claims, cited, units


_QUERY_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(query), {quoted(p)}) THEN {quoted('query: ' + r)} END" for p, r in receipts.QUERY_TRIGGERS) + "], lambda x: x IS NOT NULL)"
_LATER_SQL = "later AS (SELECT c.case_id, max(u.event_date) > min(s.event_date) AS later FROM (SELECT DISTINCT case_id FROM claims) c LEFT JOIN units u ON u.document_id = c.case_id LEFT JOIN (SELECT case_id, event_date FROM claims JOIN cited USING (claim_id) JOIN units USING (evidence_id) WHERE NOT conflict) s ON s.case_id = c.case_id GROUP BY c.case_id)"


@register(
    rf"""WITH {CASES_SQL}, {_LATER_SQL},
bc AS (SELECT claim_id, count(DISTINCT evidence_id) FILTER (NOT conflict) AS n_support, bool_or(conflict) AS conflicts FROM cited GROUP BY claim_id),
lv AS (SELECT claim_id, date_diff('day', min(CAST(event_date AS DATE)) FILTER (NOT conflict), max(CAST(event_date AS DATE)) FILTER (NOT conflict)) AS spread FROM cited JOIN units USING (evidence_id) GROUP BY claim_id),
ty AS (SELECT case_id, coalesce(list_sort(list(DISTINCT document_type) FILTER (NOT conflict)), []) AS types, coalesce(list_sort(list(DISTINCT document_type) FILTER (conflict)), []) AS against FROM claims JOIN cited USING (claim_id) JOIN units USING (evidence_id) GROUP BY case_id),
sh AS (SELECT case_id, coalesce(bool_or(conflicts), false) AS conflicted, bool_or(stance IN ('PROPOSAL', 'ASSUMPTION', 'UNCERTAIN', 'SUPERSEDED')) AS ambiguous, bool_or(confidence <> 'HIGH') AS unsure, coalesce(bool_or(n_support = 1 AND stance <> 'UNCERTAIN'), false) AS single,
  bool_or(regexp_matches(claim_text, {quoted(receipts.SPECIFIC_VALUE)})) AS val, coalesce(bool_or(spread > 90), false) AS wide FROM claims LEFT JOIN bc USING (claim_id) LEFT JOIN lv USING (claim_id) GROUP BY case_id),
tr AS (SELECT case_id, list_concat({_QUERY_SQL}, list_filter([CASE WHEN status IN ('CONFLICTING_EVIDENCE', 'PARTIALLY_SUPPORTED') THEN 'model status is ' || status END, CASE WHEN conflicted THEN 'conflicting evidence was cited' END,
  CASE WHEN ambiguous THEN 'stance is ambiguous (proposal, assumption, uncertain, or superseded)' END, CASE WHEN unsure THEN 'a claim has medium or low confidence' END, CASE WHEN single THEN 'a claim rests on a single supporting unit' END,
  CASE WHEN val THEN 'a claim states a specific value that another source could contradict' END, CASE WHEN later THEN 'later relevant evidence exists' END, CASE WHEN wide THEN 'supporting evidence spans materially different dates' END,
  CASE WHEN len(against) > 0 AND len(types) > 0 AND against <> types THEN 'source types disagree' END, CASE WHEN list_contains(list_concat(types, against), 'REPORT') AND len(list_distinct(list_concat(types, against))) > 1 THEN 'a status report is set against other evidence' END,
  CASE WHEN sh.case_id IS NULL THEN 'no claim was produced' END], lambda x: x IS NOT NULL)) AS tr FROM cases LEFT JOIN sh USING (case_id) LEFT JOIN ty USING (case_id) LEFT JOIN later USING (case_id))
SELECT case_id, array_to_string(tr, '; ') AS triggers, CASE WHEN len(tr) = 0 THEN 'LOW' WHEN len(tr) >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM tr"""
)
def risk_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a case needs a deep check: the wording of its question, then the shape of its answer."""
    cases, claims, cited, units = _cases(spark, sf_dir)
    first = claims.join(cited.where("NOT conflict"), "claim_id").join(units, "evidence_id").groupBy("case_id").agg(F.min("event_date").alias("first"))
    later = units.groupBy(F.col("document_id").alias("case_id")).agg(F.max("event_date").alias("last")).join(first, "case_id").select("case_id", (F.col("last") > F.col("first")).alias("later"))
    shape = receipts.structural_triggers(cases.join(later, "case_id", "left"), claims, cited, units)
    all_ = cases.join(shape, "case_id").withColumn("triggers", F.array_distinct(F.concat(receipts.query_triggers(F.col("query")), "triggers")))
    return all_.select("case_id", F.array_join("triggers", "; ").alias("triggers"), receipts.level(F.col("triggers")).alias("level"))


_VALIDATED = rf"""
found AS (SELECT claim_id, count(*) FILTER (NOT conflict) AS n_support, count(*) FILTER (conflict) AS n_conflicts, bool_and(is_truncated) FILTER (NOT conflict) AS cut, bool_or(regexp_matches(raw_text, {quoted(receipts.DRAFT_MARKER)})) FILTER (NOT conflict) AS draft
  FROM (SELECT DISTINCT * FROM cited) JOIN units USING (evidence_id) GROUP BY claim_id),
pr AS (SELECT case_id, claim_id, {_PROSE.format('claim_text')} AS claim_text, stance, confidence AS given, {_PROSE.format('uncertainty')} AS uncertainty, coalesce(n_support, 0) AS n_support, coalesce(n_conflicts, 0) AS n_conflicts, coalesce(cut, false) AS cut, coalesce(draft, false) AS d FROM claims LEFT JOIN found USING (claim_id)),
dr AS (SELECT *, d AND regexp_matches(claim_text, {quoted(receipts.QUOTED)}) AND regexp_matches(claim_text, {quoted(receipts.EXECUTED_WORD)}) AS draft FROM pr),
vl AS (SELECT case_id, claim_id, claim_text, stance, n_support, n_conflicts, claim_text <> '' AND (n_support > 0 OR stance = 'UNCERTAIN') AS kept, given,
  CASE WHEN cut THEN 'LOW' WHEN draft AND given = 'HIGH' THEN 'MEDIUM' ELSE given END AS confidence, CASE WHEN draft THEN concat_ws(' ', nullif(uncertainty, ''), {quoted(receipts.DRAFT_NOTE)}) ELSE uncertainty END AS uncertainty FROM dr)"""


@register(f"WITH {CASES_SQL}, {_VALIDATED} SELECT case_id, claim_id, md5(claim_text) AS text_md5, stance, confidence, uncertainty, n_support, n_conflicts FROM vl WHERE kept")
def validate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims that stay, their prose without ids, with capped confidence."""
    _, claims, cited, units = _cases(spark, sf_dir)
    kept = receipts.validate_claims(claims, cited, units).where("kept")
    return kept.select("case_id", "claim_id", F.md5("claim_text").alias("text_md5"), "stance", "confidence", "uncertainty", "n_support", "n_conflicts")


@register(
    f"""WITH {CASES_SQL}, {_VALIDATED}, n AS (SELECT case_id, count(*) FILTER (kept) AS n_claims, count(*) FILTER (NOT kept) AS dropped, count(*) FILTER (kept AND confidence <> given) AS downgraded, count(*) FILTER (kept AND n_support > 0) AS supported FROM vl GROUP BY case_id)
SELECT case_id, CASE WHEN coalesce(supported, 0) = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN dropped > 0 AND status = 'SUPPORTED' THEN 'PARTIALLY_SUPPORTED' ELSE status END AS status, coalesce(n_claims, 0) AS n_claims, coalesce(dropped, 0) AS dropped, coalesce(downgraded, 0) AS downgraded FROM cases LEFT JOIN n USING (case_id)"""
)
def validated_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What validation leaves of each case's status."""
    cases, claims, cited, units = _cases(spark, sf_dir)
    return receipts.validated_status(cases.select("case_id", "status"), receipts.validate_claims(claims, cited, units))


@register(f"WITH {CASES_SQL} SELECT DISTINCT evidence_id FROM cited WHERE evidence_id NOT IN (SELECT evidence_id FROM units) OR evidence_id % 7 = 0")
def rejected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids that don't exist or were not visible."""
    _, _, cited, units = _cases(spark, sf_dir)
    return receipts.rejected_ids(cited, units, units.where("evidence_id % 7 <> 0"))


@register(
    f"""WITH {CASES_SQL}, g AS (SELECT claim_id, count(*) FILTER (NOT conflict) AS n_support, count(*) AS n_cited FROM (SELECT DISTINCT * FROM cited) WHERE evidence_id IN (SELECT evidence_id FROM units WHERE evidence_id % 3 <> 0) GROUP BY claim_id),
k AS (SELECT case_id, count(*) AS n_claims, sum(coalesce(n_cited, 0))::BIGINT AS n_citations, bool_or(coalesce(n_support, 0) > 0) AS supported FROM claims LEFT JOIN g USING (claim_id) WHERE n_support > 0 OR stance = 'UNCERTAIN' GROUP BY case_id)
SELECT case_id, CASE WHEN supported THEN status ELSE 'INSUFFICIENT_EVIDENCE' END AS status, coalesce(n_claims, 0) AS n_claims, coalesce(n_citations, 0) AS n_citations FROM cases LEFT JOIN k USING (case_id)"""
)
def serve_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored cases served after a third of the units is gone."""
    cases, claims, cited, units = _cases(spark, sf_dir)
    return receipts.serve(cases.select("case_id", "status"), claims, cited, units.where("evidence_id % 3 <> 0"))


@register(
    rf"""WITH {CASES_SQL}, o AS (SELECT conv_id AS case_id, turn AS n, CASE WHEN turn % 4 = 2 THEN '[EV-x1]' ELSE text || ' (EV-abc)' END AS text, CASE turn % 3 WHEN 0 THEN 'HIGH' ELSE 'LOW' END AS severity, [conv_id * 100 + turn + 1, -turn - 1, conv_id * 100 + turn - 1] AS ids FROM conversations WHERE role = 'user'),
c AS (SELECT case_id, n, {_PROSE.format('text')} AS text, severity, ids FROM o), i AS (SELECT case_id, n, unnest(ids) AS evidence_id, generate_subscripts(ids, 1) AS k FROM c), g AS (SELECT case_id, n, list(evidence_id ORDER BY k) AS good FROM i WHERE evidence_id IN (SELECT evidence_id FROM units) GROUP BY ALL)
SELECT case_id, n, md5(text) AS text_md5, severity, coalesce(array_to_string(good, ','), '') AS evidence_ids FROM c LEFT JOIN g USING (case_id, n) WHERE text <> ''"""
)
def review_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objections (the user turns) without ids in prose, with the ids that exist."""
    t = read(spark, sf_dir, "conversations").where("role = 'user'")
    key = F.col("conv_id") * 100 + F.col("turn")
    text = F.when(F.col("turn") % 4 == 2, "[EV-x1]").otherwise(F.concat("text", F.lit(" (EV-abc)")))
    o = t.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("n"), text.alias("text"), F.when(F.col("turn") % 3 == 0, "HIGH").otherwise("LOW").alias("severity"), F.array(key + 1, -F.col("turn") - 1, key - 1).alias("evidence_ids"))
    out = receipts.sanitize_review(o, _cases(spark, sf_dir)[3])
    return out.select("case_id", "n", F.md5("text").alias("text_md5"), "severity", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@register(
    f"""WITH {CASES_SQL} SELECT case_id, claim_id, CASE WHEN NOT reviewed AND confidence = 'HIGH' THEN 'MEDIUM' ELSE confidence END AS confidence, CASE WHEN NOT reviewed AND status = 'SUPPORTED' THEN 'PARTIALLY_SUPPORTED' ELSE status END AS status,
CASE WHEN NOT reviewed THEN {quoted(receipts.PROVISIONAL_NOTE)} END AS missing FROM claims JOIN cases USING (case_id)"""
)
def provisional_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, claims, _, _ = _cases(spark, sf_dir)
    return receipts.provisional(claims, cases).select("case_id", "claim_id", "confidence", "status", "missing")


@register(f"WITH {CASES_SQL} SELECT case_id, 'INSUFFICIENT_EVIDENCE' AS status, {quoted(receipts.NO_EVIDENCE_NOTE)} AS missing FROM cases WHERE case_id NOT IN (SELECT document_id FROM units WHERE document_type = 'REPORT')")
def insufficient_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases without a visible unit, where only reports are visible."""
    cases, _, _, units = _cases(spark, sf_dir)
    return receipts.short_circuit(cases, units.where("document_type = 'REPORT'").select(F.col("document_id").alias("case_id")))


_LIST = lambda words: "[" + ", ".join(quoted(w) for w in words) + "]"
_PROBES = ", ".join(f"topic || ' {p}'" for p in receipts.RELIABILITY_PROBES)


@register(
    rf"""WITH {CASES_SQL}, t AS (SELECT conv_id AS case_id, list(text ORDER BY turn) FILTER (role = 'user') AS qs, list(text ORDER BY turn) FILTER (role <> 'user') AS other FROM conversations GROUP BY conv_id),
k AS (SELECT case_id, query, regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+') AS tok FROM cases),
kt AS (SELECT case_id, query, tok, list_filter(tok, lambda x, i: length(x) >= 2 AND NOT list_contains({_LIST(T.STOPWORDS + T.TEMPORAL_CUES)}, x) AND list_position(tok, x) = i) AS kept FROM k),
p AS (SELECT case_id, query, CASE WHEN case_id % 4 = 3 THEN '' ELSE array_to_string(list_concat(kept, CASE WHEN list_has_any(tok, {_LIST(T.QUANTITY_CUES)}) AND NOT list_contains(kept, 'percent') THEN ['percent'] ELSE [] END)[1:2], ' ') END AS topic, [{{'s': CASE WHEN case_id % 10 = 1 THEN 'source_reliability' ELSE 'DIRECT_CONTRADICTION' END, 'q': list_concat([' '], coalesce(qs, []))}}, {{'s': 'CONFLICTING_VALUE', 'q': coalesce(other, [])}}, {{'s': 'ALTERNATIVE_STATE', 'q': coalesce(qs, [])}}] AS bs FROM kt JOIN t USING (case_id)),
b AS (SELECT case_id, CASE WHEN regexp_matches(query, {quoted(receipts.ASKS_RELIABILITY)}) AND bs[1].s <> 'source_reliability' AND topic <> '' THEN [bs[1], {{'s': 'SOURCE_RELIABILITY', 'q': [{_PROBES}]}}] ELSE bs[1:2] END AS bs FROM p)
SELECT case_id, k AS bundle, bs[k].s AS strategy, md5(array_to_string(list_filter(list_transform(bs[k].q, lambda x: trim(x)), lambda x: x <> '')[1:3], '|')) AS queries_md5 FROM (SELECT case_id, bs, unnest([1, 2]) AS k FROM b)"""
)
def skeptic_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter-searches of each case: two bundles of three whole queries at most, one of them of reliability where the question asks for it."""
    cases, _, _, _ = _cases(spark, sf_dir)
    texts = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("turn", "text")))), lambda x: x["text"])
    t = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(texts(F.col("role") == "user").alias("qs"), texts(F.col("role") != "user").alias("other"))
    p = cases.join(t, "case_id")
    bundle = lambda s, q: F.struct(s.alias("strategy"), q.alias("queries"))
    first = F.when(F.col("case_id") % 10 == 1, "source_reliability").otherwise("DIRECT_CONTRADICTION")
    bundles = F.array(bundle(first, F.concat(F.array(F.lit(" ")), "qs")), bundle(F.lit("CONFLICTING_VALUE"), F.col("other")), bundle(F.lit("ALTERNATIVE_STATE"), F.col("qs")))
    terms = F.when(F.col("case_id") % 4 == 3, F.array().cast("array<string>")).otherwise(T.topic_terms(F.col("query")))
    plan = p.select("case_id", F.posexplode(receipts.skeptic_plan(F.col("query"), terms, bundles)).alias("k", "b"))
    return plan.select("case_id", (F.col("k") + 1).alias("bundle"), "b.strategy", F.md5(F.array_join("b.queries", "|")).alias("queries_md5"))


@register(
    f"""WITH {CASES_SQL}, u AS (SELECT *, min(coalesce(event_date, '9999')) OVER (PARTITION BY document_id) AS first_date, CASE WHEN unit_index % 5 = 4 THEN '!' WHEN unit_index % 3 = 0 THEN '*' WHEN unit_index % 2 = 0 THEN '+' ELSE ' ' END AS marker FROM units)
SELECT evidence_id, row_number() OVER (PARTITION BY first_date ORDER BY document_id, unit_index) AS nth_of_date, md5(marker || '[' || evidence_id || '] ' || event_date || ' | ' || role || ': ' || CASE WHEN length(trim(raw_text)) > 1200 THEN left(trim(raw_text), 1200) || ' [cut for length]' ELSE trim(raw_text) END || CASE WHEN is_truncated THEN ' [TRUNCATED IN SOURCE]' ELSE '' END) AS line_md5 FROM u"""
)
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as the reasoner sees them, in the order of their documents' first dates; the cut of long lines is the feature."""
    from pyspark.sql import Window as W

    i = F.col("unit_index")
    line = receipts.evidence_line(receipts.marker(i % 5 == 4, i % 3 == 0, i % 2 == 0), F.col("evidence_id").cast("string"), F.col("event_date"), F.col("role"), F.col("raw_text"), F.col("is_truncated"))
    u = _cases(spark, sf_dir)[3].withColumn("first_date", F.min(F.coalesce("event_date", F.lit("9999"))).over(W.partitionBy("document_id")))
    nth = F.row_number().over(W.partitionBy("first_date").orderBy("document_id", "unit_index"))
    return u.select("evidence_id", nth.cast("long").alias("nth_of_date"), F.md5(line).alias("line_md5"))


_OVER = "regexp_matches(lower({}), " + quoted(receipts.OVERREACH) + ")"


@register(
    f"""WITH t AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' so we should proceed' WHEN 1 THEN ' and no budget is named' ELSE '' END AS text FROM conversations),
g AS (SELECT conv_id, list(text ORDER BY turn) AS un, list(turn ORDER BY turn) AS ts, count(*) AS n FROM t GROUP BY conv_id),
l AS (SELECT conv_id, n, list_concat(list_filter(un, lambda x: x <> '' AND NOT {_OVER.format('x')}), list_transform(list_filter(ts, lambda x: x % 3 = 1), lambda x: trim('Skeptic check ' || x || ' could not be answered: ' || CASE WHEN x % 2 = 0 THEN 'no source' ELSE '' END))) AS ls FROM g),
m AS (SELECT conv_id, list_distinct(list_concat(ls, list_filter([CASE WHEN conv_id % 2 = 0 AND len(list_filter(ls, lambda x: regexp_matches(x, '(?i)budget|owner|approv'))) = 0 THEN {quoted(receipts.DEFAULT_UNESTABLISHED)} END, CASE WHEN conv_id % 2 = 0 AND conv_id % 3 <> 0 AND conv_id % 5 <> 0 THEN {quoted(receipts.EXTERNAL_ONLY_UNESTABLISHED)} END], lambda x: x IS NOT NULL))) AS ms FROM l)
SELECT conv_id, len(ms) AS n_missing, md5(array_to_string(list_sort(ms), '|')) AS missing_md5, list_contains(ms, {quoted(receipts.DEFAULT_UNESTABLISHED)}) AS unestablished FROM m"""
)
def radar_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a card must say is not established: lines of the turns that don't overreach, unanswered checks, and what a changed assessment leaves open."""
    t = read(spark, sf_dir, "conversations")
    text = F.concat("text", _pick(F.col("turn") % 4, " so we should proceed", " and no budget is named", ""))
    check = F.struct(F.col("turn").alias("check"), (F.col("turn") % 3 != 1).alias("answered"), F.when(F.col("turn") % 2 == 0, "no source").alias("note"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", text.alias("x")))).alias("un"), F.sort_array(F.collect_list(check)).alias("checks"))
    assessment = F.when(F.col("conv_id") % 2 == 0, "WORTH_REASSESSING").otherwise("STILL_BLOCKED")
    missing = receipts.missing_information(F.transform("un", lambda x: x["x"]), F.col("checks"), assessment, F.col("conv_id") % 3 == 0, F.col("conv_id") % 5 != 0)
    m = g.select("conv_id", missing.alias("m"))
    return m.select("conv_id", F.size("m").cast("long").alias("n_missing"), F.md5(F.array_join(F.sort_array("m"), "|")).alias("missing_md5"), F.array_contains("m", receipts.DEFAULT_UNESTABLISHED).alias("unestablished"))


@register(f"WITH t AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' so we should proceed' WHEN 1 THEN ' which is now approved' ELSE '' END AS text FROM conversations) SELECT conv_id, turn, {_OVER.format('text')} AS withheld, md5(CASE WHEN {_OVER.format('text')} THEN {quoted(receipts.WITHHELD)} ELSE text END) AS shown_md5 FROM t")
def radar_overreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wording that says more than a card may is withheld."""
    text = F.concat("text", _pick(F.col("turn") % 4, " so we should proceed", " which is now approved", ""))
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t"), receipts.bounded(text).alias("shown"))
    return t.select("conv_id", "turn", (F.col("shown") == receipts.WITHHELD).alias("withheld"), F.md5("shown").alias("shown_md5"))


@register(
    f"""WITH {CASES_SQL}, p AS (SELECT evidence_id, event_date, CASE WHEN unit_index % 5 = 4 THEN 0 WHEN unit_index % 3 = 0 THEN 1 WHEN unit_index % 2 = 0 THEN 2 ELSE 3 END AS priority FROM units)
SELECT evidence_id, priority FROM p ORDER BY priority, event_date, evidence_id LIMIT 180"""
)
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 180 units that a reasoner is shown: a stable top-k by why they were found, then by date."""
    i = F.col("unit_index")
    u = _cases(spark, sf_dir)[3].select("evidence_id", F.col("event_date").alias("place"), (i % 5 == 4).alias("new"), (i % 3 == 0).alias("hit"), (i % 2 == 0).alias("later"))
    return receipts.within_budget(u).select("evidence_id", "priority")


@register(f"WITH {CASES_SQL}, s AS (SELECT claim_id, date_diff('day', min(CAST(event_date AS DATE)), max(CAST(event_date AS DATE)))::INTEGER AS spread_days FROM cited JOIN units USING (evidence_id) WHERE NOT conflict GROUP BY claim_id) SELECT claim_id, spread_days, spread_days > 90 AS wide FROM s")
def claim_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart in time the live support of each claim is."""
    _, _, cited, units = _cases(spark, sf_dir)
    return receipts.claim_spread(cited, units)


@register(
    """SELECT conv_id, turn, CASE turn % 5 WHEN 2 THEN 'status' WHEN 3 THEN 'not parseable as JSON' WHEN 4 THEN 'claims.stance' ELSE '' END AS problems, CASE WHEN turn % 5 NOT IN (3) THEN md5(text) END AS claim_md5, CASE WHEN turn % 5 <> 3 THEN 2 END AS n_ids FROM conversations"""
)
def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with fences, read by a nested schema: unknown values and broken ones are named."""
    t = read(spark, sf_dir, "conversations")
    kind = F.col("turn") % 5
    claim = F.struct(F.col("text").alias("claim_text"), F.when(kind == 4, "GUESS").otherwise("DECISION").alias("stance"), F.array(F.lit("EV-1"), F.concat(F.lit("EV-"), "turn")).alias("supporting_evidence_ids"))
    body = F.to_json(F.struct(F.when(kind == 2, "FINE").otherwise("SUPPORTED").alias("status"), F.array(claim).alias("claims")))
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\nthat is all"))).when(kind == 3, F.concat(F.lit("{'status' "), "text")).otherwise(F.concat(F.lit(" "), body, F.lit("\n")))
    p = t.select("conv_id", "turn", receipts.parsed_output(raw).alias("p")).select("conv_id", "turn", "p.*")
    first = F.get("output.claims", F.lit(0))
    return p.select("conv_id", "turn", F.array_join("problems", ", ").alias("problems"), F.md5(first["claim_text"]).alias("claim_md5"), F.size(first["supporting_evidence_ids"]).alias("n_ids"))


# --- whole receipts ---------------------------------------------------------------------------

#: Events: each claim's text, on what the claim cites, in the order of claims from the last to the first.
_RECEIPT_SQL = rf"""{CASES_SQL}, {_VALIDATED},
ev AS (SELECT case_id, claim_id, -claim_id AS n, claim_text, min(event_date) AS d, count(u.evidence_id) AS live FROM pr LEFT JOIN (SELECT DISTINCT claim_id, evidence_id FROM cited) c USING (claim_id) LEFT JOIN units u USING (evidence_id) GROUP BY ALL),
eo AS (SELECT case_id, string_agg(claim_id::VARCHAR, ',' ORDER BY coalesce(d, '9999-99-99'), n) FILTER (live > 0 AND claim_text <> '') AS event_order, count(*) FILTER (NOT (live > 0 AND claim_text <> '')) AS dropped_events FROM ev GROUP BY case_id),
rj AS (SELECT case_id, count(DISTINCT evidence_id) AS rejected FROM claims JOIN cited USING (claim_id) WHERE evidence_id NOT IN (SELECT evidence_id FROM units) GROUP BY case_id),
n AS (SELECT case_id, string_agg(claim_id::VARCHAR || ':' || vl.confidence || ':' || n_support || ':' || n_conflicts, ',' ORDER BY claim_id) FILTER (kept) AS shown, count(*) FILTER (kept) AS n_claims, count(*) FILTER (NOT kept) AS dropped, count(*) FILTER (kept AND confidence <> given) AS downgraded, count(*) FILTER (kept AND n_support > 0) AS supported FROM vl GROUP BY case_id)"""


def _outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each case's nested output, and the units."""
    cases, claims, cited, units = _cases(spark, sf_dir)
    key = lambda c: F.col(c).cast("string")
    ids = cited.groupBy("claim_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("conflict") == against, key("evidence_id")))).alias(name) for name, against in (("support", False), ("conflicts", True))])
    each = claims.join(ids, "claim_id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("support", "conflicts")})
    claim = F.struct("claim_id", "claim_text", "stance", "confidence", "support", "conflicts", "uncertainty")
    # the claim's number is the event's state
    event = F.struct((-F.col("claim_id")).alias("n"), F.col("claim_text").alias("event_text"), key("claim_id").alias("state"), "confidence", F.concat("support", "conflicts").alias("evidence_ids"))
    both = each.groupBy("case_id").agg(F.array_sort(F.collect_list(claim)).alias("c"), F.array_sort(F.collect_list(event)).alias("e"))
    out = cases.join(both, "case_id", "left").select(
        "case_id", "status", F.lit("EV-1").alias("answer_summary"), F.transform("c", lambda x: x.dropFields("claim_id")).alias("claims"), F.transform("e", lambda x: x.dropFields("n")).alias("timeline_events"),
        F.lit(None).cast("string").alias("conflict_resolution"), F.array(F.lit("what [EV-2] says"), F.lit("EV-3")).alias("missing_information"), F.array(F.col("query")).alias("related_questions"),
    )
    return out, units.withColumn("evidence_id", key("evidence_id"))


@register(
    f"""WITH {_RECEIPT_SQL} SELECT case_id, CASE WHEN coalesce(supported, 0) = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN dropped > 0 AND status = 'SUPPORTED' THEN 'PARTIALLY_SUPPORTED' ELSE status END AS status, CASE WHEN coalesce(supported, 0) = 0 THEN 'none' ELSE 'empty' END AS summary,
  coalesce(n_claims, 0)::INTEGER AS n_claims, coalesce(dropped, 0)::INTEGER AS dropped, coalesce(downgraded, 0)::INTEGER AS downgraded, coalesce(event_order, '') AS event_order, coalesce(dropped_events, 0)::INTEGER AS dropped_events, coalesce(rejected, 0)::INTEGER AS rejected, 'what says' AS missing FROM cases LEFT JOIN n USING (case_id) LEFT JOIN eo USING (case_id) LEFT JOIN rj USING (case_id)"""
)
def nested_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole outputs checked: claims, events by their earliest cited date, status, summary, lists, rejected ids."""
    r = nested.validate(*_outputs(spark, sf_dir))
    summary = F.when(F.col("answer_summary") == nested.NO_SUPPORT_SUMMARY, "none").when(F.col("answer_summary") == nested.EMPTY_SUMMARY, "empty").otherwise(F.col("answer_summary"))
    return r.select(
        "case_id", "status", summary.alias("summary"), F.size("claims").alias("n_claims"), F.col("report.dropped_claims").alias("dropped"), F.col("report.downgraded_claims").alias("downgraded"),
        F.array_join(F.transform("timeline_events", lambda x: x["state"]), ",").alias("event_order"), F.col("report.dropped_timeline_events").alias("dropped_events"), F.size("report.rejected_evidence_ids").alias("rejected"), F.array_join("missing_information", "|").alias("missing"),
    )


@register(
    f"""WITH {_RECEIPT_SQL}, lu AS (SELECT * FROM units WHERE evidence_id % 3 <> 0),
cl AS (SELECT v.case_id, v.claim_id, stance, (SELECT count(DISTINCT c.evidence_id) FROM cited c JOIN lu USING (evidence_id) WHERE c.claim_id = v.claim_id AND NOT conflict) AS s, (SELECT count(DISTINCT c.evidence_id) FROM cited c JOIN lu USING (evidence_id) WHERE c.claim_id = v.claim_id AND conflict) AS k FROM vl v WHERE kept),
cn AS (SELECT case_id, count(*) FILTER (s > 0 OR stance = 'UNCERTAIN') AS n_claims, coalesce(sum(s + k) FILTER (s > 0 OR stance = 'UNCERTAIN'), 0) AS n_citations, count(*) FILTER (s > 0) AS sup FROM cl GROUP BY case_id),
en AS (SELECT case_id, count(DISTINCT e.claim_id) AS n_events, min(lu.event_date) AS first_date FROM ev e JOIN cited USING (claim_id) JOIN lu USING (evidence_id) WHERE live > 0 AND claim_text <> '' GROUP BY case_id)
SELECT case_id, CASE WHEN coalesce(sup, 0) = 0 OR coalesce(supported, 0) = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN dropped > 0 AND status = 'SUPPORTED' THEN 'PARTIALLY_SUPPORTED' ELSE status END AS status, coalesce(cn.n_claims, 0)::INTEGER AS n_claims, coalesce(n_citations, 0)::INTEGER AS n_citations, coalesce(n_events, 0)::INTEGER AS n_events, first_date
FROM cases LEFT JOIN n USING (case_id) LEFT JOIN cn USING (case_id) LEFT JOIN en USING (case_id)"""
)
def served_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts served after a third of the units has gone."""
    outputs, units = _outputs(spark, sf_dir)
    r = nested.serve(nested.validate(outputs, units), units.where(F.col("evidence_id").cast("long") % 3 != 0))
    citations = F.aggregate("claims", F.lit(0), lambda n, x: n + F.size(x["support"]) + F.size(x["conflicts"]))
    return r.select("case_id", "status", F.size("claims").alias("n_claims"), citations.alias("n_citations"), F.size("timeline_events").alias("n_events"), F.array_min(F.transform("timeline_events", lambda x: x["event_date"])).alias("first_date"))
