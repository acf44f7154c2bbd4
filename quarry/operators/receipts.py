"""Risk routing, claim validation and radar rules over model outputs given as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Patterns over the lower-cased question and their reasons, in order; wording a card may not use.
QUERY_TRIGGERS = [
    (r"\bagree[ds]?\b|\bagreement\b", "asks what was agreed"),
    (r"\bdecid\w*|\bdecision\b", "asks what was decided"),
    (r"\bapprov\w*|\bauthori[sz]\w*", "asks about approval or authority"),
    (r"\bsign(?:ed)?[- ]?off\b|\bsigned\b", "asks about sign-off"),
    (r"\bcommit\w*", "asks about a commitment"),
    (r"\bfulfil\w*|\bnever done\b|\bwas it done\b|\bdelivered\b", "asks whether it was fulfilled"),
    (r"\bcurrent\w*|\bstill\b|\bnow\b|\blatest\b|\bfinal\w*|\bultimately\b", "asks about current state"),
    (r"\bsupersed\w*|\bno longer\b|\bover time\b|\bchanged?\b", "asks about supersession or change"),
    (r"\bassum\w*|\bproposed\b|\bwho (?:proposed|suggested)\b", "asks assumption vs decision"),
    (r"\bwho\b", "asks who"),
]
OVERREACH = (
    r"\b(?:should|must|ought)\b|\b(?:recommend|advis|suggest|urg)\w*|\b(?:pursue|proceed|greenlight|green[- ]?light|let'?s)\b|\bgo\s+(?:ahead|for\s+it)\b"
    r"|\bapprove\b|\bfund\s+(?:it|this)\b|\b(?:is|are|now)\s+(?:now\s+)?(?:approved|funded|safe|ready|justified|the\s+right)\b"
    r"|\bstrategic(?:ally)?\b|\bdefinitely\b|\bmakes\s+sense\s+to\b|\bthe\s+right\s+time\b"
)
SPECIFIC_VALUE = (
    r"(?i)\d[\d,.]*\s*(?:%|percent|months?|weeks?|days?|years?|hours?|tonnes?|stores?|articles?)"
    r"|\b(?:\d[\d,.]*)\b|\b(?:twelve|eighteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred)\b"
)
AMBIGUOUS_STANCES = ["PROPOSAL", "ASSUMPTION", "UNCERTAIN", "SUPERSEDED"]
DATE_SPREAD_DAYS = 90
DRAFT_MARKER = r"(?i)for (?:your )?(?:signature|signing|review)|please sign|\bdraft\b|proposed wording"
EXECUTED_WORD = r"(?i)\b(?:signed|executed)\b"
QUOTED = "[\"\u201c\u201d]"
DRAFT_NOTE = "The quoted wording is the text sent for signature; the executed document is not in the archive, so it cannot be confirmed as identical."
PROVISIONAL_NOTE = "The adversarial check of this answer could not be completed; treat it as provisional."
NO_EVIDENCE_NOTE = "No evidence in the archive matched this question."
ASKS_RELIABILITY = r"(?i)\b(?:reliab\w*|trustworth\w*|accura\w*|verified|validated|dependable|can we trust)\b"
RELIABILITY_PROBES = ["does not reconcile", "nobody has checked", "does not match"]
MAX_BUNDLES, MAX_QUERIES = 2, 3
MAX_UNIT_CHARS = 1200
WITHHELD = "Wording withheld: the Radar states only that a blocker may have changed."
DEFAULT_UNESTABLISHED = "No internal evidence establishes a budget, an owner, or an approval to reopen this idea."
EXTERNAL_ONLY_UNESTABLISHED = "No internal evidence shows the organization's current position on this idea."
CHANGED = ["WORTH_REASSESSING", "PARTIALLY_CHANGED"]
# Fixed values too: the searches of a discovery, three in each of its passes.
DISCOVERY_PASSES = [
    ["we decided against it", "proposal rejected not going to do that", "no we are not doing that turned down declined"],
    ["deferred until later postponed not now", "descoped moved to a separate workstream out of scope", "parked for a later phase"],
    ["on hold we will revisit this later", "wait until then before we do this", "instead of that we will do this other thing"],
    ["cannot do this because of capacity and resources", "not possible because of security compliance or data protection", "too expensive cost budget not approved not enough data"],
]


def query_triggers(query) -> Column:
    """The ordered reasons that a question's wording gives."""
    lower = F.lower(query)
    return F.array_compact(F.array(*[F.when(lower.rlike(p), F.lit(f"query: {reason}")) for p, reason in QUERY_TRIGGERS]))


def level(triggers) -> Column:
    return F.when(F.size(triggers) == 0, "LOW").when(F.size(triggers) >= 3, "HIGH").otherwise("MEDIUM")


def structural_triggers(cases: DataFrame, claims: DataFrame, cited: DataFrame, units: DataFrame) -> DataFrame:
    """(case_id, triggers): the ordered reasons that an answer's own shape gives.

    cases(case_id, status, later), claims(case_id, claim_id, claim_text, stance, confidence), cited(claim_id, evidence_id, conflict),
    units(evidence_id, event_date, document_type). Only dates and types of units that exist count.
    """
    support = ~F.col("conflict")
    by_claim = cited.groupBy("claim_id").agg(F.count_distinct(F.when(support, F.col("evidence_id"))).alias("n_support"), F.max("conflict").alias("conflicts"))
    day, kind = F.when(support, F.to_date("event_date")), F.col("document_type")
    live = cited.join(units, "evidence_id").groupBy("claim_id").agg(
        F.datediff(F.max(day), F.min(day)).alias("spread"), F.collect_set(F.when(support, kind)).alias("types"), F.collect_set(F.when(~support, kind)).alias("against")
    )
    both = claims.join(by_claim, "claim_id", "left").join(live, "claim_id", "left")
    any_of = lambda c, name: F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False)).alias(name)
    gathered = lambda c, name: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(name)
    shape = both.groupBy("case_id").agg(
        any_of(F.col("conflicts"), "conflicted"), any_of(F.col("stance").isin(AMBIGUOUS_STANCES), "ambiguous"), any_of(F.col("confidence") != "HIGH", "unsure"),
        any_of((F.col("n_support") == 1) & (F.col("stance") != "UNCERTAIN"), "single"), any_of(F.col("claim_text").rlike(SPECIFIC_VALUE), "value"),
        any_of(F.col("spread") > DATE_SPREAD_DAYS, "wide"), gathered("types", "types"), gathered("against", "against"), F.lit(True).alias("claimed"),
    )
    c = cases.join(shape, "case_id", "left")
    types, against = (F.coalesce(F.col(x), F.array().cast("array<string>")) for x in ("types", "against"))
    all_types = F.array_union(types, against)
    reasons = [
        (F.col("status").isin("CONFLICTING_EVIDENCE", "PARTIALLY_SUPPORTED"), F.concat(F.lit("model status is "), "status")),
        (F.col("conflicted"), "conflicting evidence was cited"),
        (F.col("ambiguous"), "stance is ambiguous (proposal, assumption, uncertain, or superseded)"),
        (F.col("unsure"), "a claim has medium or low confidence"),
        (F.col("single"), "a claim rests on a single supporting unit"),
        (F.col("value"), "a claim states a specific value that another source could contradict"),
        (F.col("later"), "later relevant evidence exists"),
        (F.col("wide"), "supporting evidence spans materially different dates"),
        ((F.size(against) > 0) & (F.size(types) > 0) & (against != types), "source types disagree"),
        (F.array_contains(all_types, "REPORT") & (F.size(all_types) > 1), "a status report is set against other evidence"),
        (F.col("claimed").isNull(), "no claim was produced"),
    ]
    return c.select("case_id", F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), r if not isinstance(r, str) else F.lit(r)) for when, r in reasons])).alias("triggers"))


def valid_ids(cited: DataFrame, *known: DataFrame) -> DataFrame:
    """Rows of cited(evidence_id, ...) whose id is in each of the given tables."""
    for table in known:
        cited = cited.join(table.select("evidence_id"), "evidence_id", "left_semi")
    return cited


def validate_claims(claims: DataFrame, cited: DataFrame, units: DataFrame) -> DataFrame:
    """claims(case_id, claim_id, claim_text, stance, confidence, uncertainty) with cited(claim_id, evidence_id, conflict) against units(evidence_id, is_truncated, raw_text).

    All claims with n_support and n_conflicts (live ids), `kept`, `downgraded`, and the confidence that they may have: a claim without text
    is not kept, nor is one without a live supporting unit, unless it is UNCERTAIN; support that is truncated throughout caps the
    confidence at LOW; wording that is quoted as executed from a draft caps it at MEDIUM, with a note.
    """
    good = cited.distinct().join(units.select("evidence_id", "is_truncated", F.col("raw_text").rlike(DRAFT_MARKER).alias("is_draft")), "evidence_id")
    support = ~F.col("conflict")
    found = good.groupBy("claim_id").agg(
        F.count_if(support).alias("n_support"), F.count_if(F.col("conflict")).alias("n_conflicts"), F.min(F.when(support, F.col("is_truncated"))).alias("cut"), F.max(F.when(support, F.col("is_draft"))).alias("draft")
    )
    out = claims.withColumns({"claim_text": T.clean_prose(F.col("claim_text")), "uncertainty": T.clean_prose(F.col("uncertainty"))}).join(found, "claim_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_support", "n_conflicts")})
    kept = (F.coalesce("claim_text", F.lit("")) != "") & ((F.col("n_support") > 0) | (F.col("stance") == "UNCERTAIN"))
    draft = F.coalesce(F.col("draft") & F.col("claim_text").rlike(QUOTED) & F.col("claim_text").rlike(EXECUTED_WORD), F.lit(False))
    low = F.coalesce(F.col("cut"), F.lit(False))
    confidence = F.when(low, "LOW").when(draft & (F.col("confidence") == "HIGH"), "MEDIUM").otherwise(F.col("confidence"))
    note = F.when(draft & ~F.coalesce(F.col("uncertainty").contains(DRAFT_NOTE), F.lit(False)), F.concat_ws(" ", F.nullif("uncertainty", F.lit("")), F.lit(DRAFT_NOTE))).otherwise(F.col("uncertainty"))
    out = out.withColumns({"kept": kept, "downgraded": kept & (confidence != F.col("confidence")), "uncertainty": note}).withColumn("confidence", confidence)
    return out.drop("cut", "draft")


def rejected_ids(cited: DataFrame, *known: DataFrame) -> DataFrame:
    """The ids of cited(evidence_id, ...) that one of the given tables lacks."""
    return cited.select("evidence_id").distinct().exceptAll(valid_ids(cited.select("evidence_id").distinct(), *known))


def validated_status(cases: DataFrame, validated: DataFrame) -> DataFrame:
    """cases(case_id, status) with n_claims, dropped, downgraded and the status that the claims that stay allow."""
    n = validated.groupBy("case_id").agg(F.count_if("kept").alias("n_claims"), F.count_if(~F.col("kept")).alias("dropped"), F.count_if("downgraded").alias("downgraded"), F.count_if(F.col("kept") & (F.col("n_support") > 0)).alias("supported"))
    out = cases.join(n, "case_id", "left").fillna(0, ["n_claims", "dropped", "downgraded", "supported"])
    status = F.when(F.col("supported") == 0, "INSUFFICIENT_EVIDENCE").when((F.col("dropped") > 0) & (F.col("status") == "SUPPORTED"), "PARTIALLY_SUPPORTED").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("supported")


def serve(cases: DataFrame, claims: DataFrame, cited: DataFrame, live: DataFrame) -> DataFrame:
    """Stored cases(case_id, status) as they may be shown now: claims that have lost all support go, and citations of units that no longer live; status, n_claims, n_citations."""
    good = valid_ids(cited.distinct(), live).groupBy("claim_id").agg(F.count_if(~F.col("conflict")).alias("n_support"), F.count("*").alias("n_cited"))
    kept = claims.join(good, "claim_id", "left").fillna(0, ["n_support", "n_cited"]).where((F.col("n_support") > 0) | (F.col("stance") == "UNCERTAIN"))
    n = kept.groupBy("case_id").agg(F.count("*").alias("n_claims"), F.sum("n_cited").alias("n_citations"), F.max(F.col("n_support") > 0).alias("supported"))
    out = cases.join(n, "case_id", "left").fillna(0, ["n_claims", "n_citations"])
    return out.withColumn("status", F.when(F.coalesce("supported", F.lit(False)), F.col("status")).otherwise("INSUFFICIENT_EVIDENCE")).drop("supported")


def sanitize_review(objections: DataFrame, *known: DataFrame) -> DataFrame:
    """objections(case_id, n, text, severity, evidence_ids) without ids in prose, without empty ones, and with the ids that each of the given tables has, in order."""
    rows = objections.withColumn("text", T.clean_prose(F.col("text"))).where(F.coalesce("text", F.lit("")) != "")
    ids = rows.select("case_id", "n", F.posexplode("evidence_ids").alias("k", "evidence_id"))
    good = valid_ids(ids, *known).groupBy("case_id", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "evidence_id"))), lambda x: x["evidence_id"]).alias("good"))
    return rows.join(good, ["case_id", "n"], "left").withColumn("evidence_ids", F.coalesce("good", F.array().cast(rows.schema["evidence_ids"].dataType))).drop("good")


def provisional(claims: DataFrame, cases: DataFrame) -> DataFrame:
    """claims(case_id, confidence, ...) joined with cases(case_id, status, reviewed): where the review did not finish, no confidence is HIGH, no status SUPPORTED, and `missing` says so."""
    open_ = ~F.coalesce("reviewed", F.lit(False))
    return claims.join(cases, "case_id").withColumns(
        {
            "confidence": F.when(open_ & (F.col("confidence") == "HIGH"), "MEDIUM").otherwise(F.col("confidence")),
            "status": F.when(open_ & (F.col("status") == "SUPPORTED"), "PARTIALLY_SUPPORTED").otherwise(F.col("status")),
            "missing": F.when(open_, F.lit(PROVISIONAL_NOTE)),
        }
    )


def short_circuit(cases: DataFrame, visible: DataFrame) -> DataFrame:
    """The answers of cases(case_id, ...) for which visible(case_id, ...) has no unit: no model is asked."""
    return cases.join(visible, "case_id", "left_anti").select("case_id", F.lit("INSUFFICIENT_EVIDENCE").alias("status"), F.lit(NO_EVIDENCE_NOTE).alias("missing"))


def skeptic_plan(query, terms, bundles) -> Column:
    """The bundles array<struct<strategy, queries>> to be searched: MAX_BUNDLES with MAX_QUERIES each; where a question of reliability has no bundle for it, one of the topic's terms and fixed probes takes the last place."""
    topic = F.trim(F.array_join(F.slice(terms, 1, 2), " "))
    has = F.exists(bundles, lambda b: F.upper(b["strategy"]) == "SOURCE_RELIABILITY")
    probe = F.struct(F.lit("SOURCE_RELIABILITY").alias("strategy"), F.transform(F.array(*map(F.lit, RELIABILITY_PROBES)), lambda p: F.concat(topic, F.lit(" "), p)).alias("queries"))
    planned = F.when(query.rlike(ASKS_RELIABILITY) & ~has & (topic != ""), F.concat(F.slice(bundles, 1, MAX_BUNDLES - 1), F.array(probe))).otherwise(F.slice(bundles, 1, MAX_BUNDLES))
    return F.transform(planned, lambda b: F.struct(b["strategy"].alias("strategy"), F.slice(F.filter(F.transform(b["queries"], lambda q: F.trim(q)), lambda q: q != ""), 1, MAX_QUERIES).alias("queries")))


def evidence_line(marker, evidence_id, when, who, text, truncated) -> Column:
    """A unit as the reasoner sees it; texts longer than MAX_UNIT_CHARS are cut, and say so."""
    text = F.trim(text)
    shown = F.when(F.length(text) > MAX_UNIT_CHARS, F.concat(F.left(text, F.lit(MAX_UNIT_CHARS)), F.lit(" [cut for length]"))).otherwise(text)
    return F.concat(marker, F.lit("["), evidence_id, F.lit("] "), F.coalesce(when, F.lit("")), F.lit(" | "), F.coalesce(who, F.lit("unknown")), F.lit(": "), shown, F.when(truncated, F.lit(" [TRUNCATED IN SOURCE]")).otherwise(""))


def marker(new, hit, later) -> Column:
    return F.when(new, "!").when(hit, "*").when(later, "+").otherwise(" ")


def within_budget(units: DataFrame, most: int = 180) -> DataFrame:
    """Of units(evidence_id, place, new, hit, later) the most that a reasoner is shown: found by the counter-search first, then hits, later evidence and context, each in order of place."""
    priority = F.when(F.col("new"), 0).when(F.col("hit"), 1).when(F.col("later"), 2).otherwise(3)
    return units.withColumn("priority", priority).orderBy("priority", "place", "evidence_id").limit(most)


def strip_fence(raw) -> Column:
    """A model's reply without the fence around it."""
    text = F.trim(raw)
    inside = F.regexp_replace(F.regexp_replace(text, r"(?s)^```[^\n]*\n?", ""), r"(?s)```(?!.*```).*$", "")
    return F.when(text.startswith("```"), F.regexp_replace(inside, r"(?s)^\s+|\s+$", "")).otherwise(text)


OUTPUT = "status string, claims array<struct<claim_text:string,stance:string,supporting_evidence_ids:array<string>>>"
STATUSES = ["SUPPORTED", "PARTIALLY_SUPPORTED", "CONFLICTING_EVIDENCE", "INSUFFICIENT_EVIDENCE"]
STANCES = ["DECISION", "AGREEMENT", "COMMITMENT", "PROPOSAL", "ASSUMPTION", "UNCERTAIN", "SUPERSEDED"]


def parsed_output(raw) -> Column:
    """struct<output, problems>: a reply read by its schema; problems name what a second try has to mend, and are empty for a valid one."""
    out = F.from_json(strip_fence(raw), OUTPUT)
    problems = F.array_compact(
        F.array(
            F.when(out.isNull() | (out["status"].isNull() & out["claims"].isNull()), "not parseable as JSON").when(~F.coalesce(out["status"].isin(STATUSES), F.lit(False)), "status"),
            F.when(out["status"].isNotNull() & out["claims"].isNull(), "claims"),
            F.when(F.exists(out["claims"], lambda c: c["claim_text"].isNull() | ~F.coalesce(c["stance"].isin(STANCES), F.lit(False))), "claims.stance"),
        )
    )
    return F.struct(out.alias("output"), problems.alias("problems"))


def claim_spread(cited: DataFrame, units: DataFrame) -> DataFrame:
    """(claim_id, spread_days, wide): days between the first and the last dated support of each claim of cited(claim_id, evidence_id, conflict)."""
    day = F.to_date("event_date")
    live = cited.where("NOT conflict").join(units.select("evidence_id", "event_date"), "evidence_id").groupBy("claim_id").agg(F.coalesce(F.datediff(F.max(day), F.min(day)), F.lit(0)).alias("spread_days"))
    return live.withColumn("wide", F.col("spread_days") > DATE_SPREAD_DAYS)


def usage(cited: DataFrame) -> DataFrame:
    """The distinct (case_id, evidence_id, usage) of cited(case_id, support, conflict, timeline, counter): arrays of ids; counter-evidence counts as conflict."""
    kinds = [("support", "SUPPORT"), ("conflict", "CONFLICT"), ("timeline", "TIMELINE"), ("counter", "CONFLICT")]

    def used(column: str, kind: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.struct(x.alias("evidence_id"), F.lit(kind).alias("usage")))

    pairs = F.flatten(F.array(*[used(*k) for k in kinds]))
    return cited.select("case_id", F.explode(F.array_distinct(pairs)).alias("p")).select("case_id", "p.evidence_id", "p.usage").distinct()


def seven_checks(checks: DataFrame) -> DataFrame:
    """checks(candidate_id, check, answered, passed) with an unanswered row for each missing number, and `vetoed`: check 1 or 7 answered and failed."""
    all_ = checks.select("candidate_id").distinct().select("candidate_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("check"))
    out = all_.join(checks, ["candidate_id", "check"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))
    return out.withColumn("vetoed", F.coalesce(F.col("check").isin(1, 7) & F.col("answered") & ~F.col("passed"), F.lit(False)))


def bounded(text) -> Column:
    """A card's wording, or that it was withheld where it says more than that a blocker may have changed."""
    return F.when(F.lower(text).rlike(OVERREACH), F.lit(WITHHELD)).otherwise(text)


def missing_information(unestablished, checks, assessment, internal, signals) -> Column:
    """The distinct lines of what is not established: those of the model that don't overreach, the checks array<struct<check, answered, note>> without an answer, and what a changed assessment leaves open."""
    given = F.filter(unestablished, lambda x: (F.coalesce(x, F.lit("")) != "") & ~F.lower(x).rlike(OVERREACH))
    unanswered = F.transform(F.filter(checks, lambda c: ~c["answered"]), lambda c: F.trim(F.concat(F.lit("Skeptic check "), c["check"].cast("string"), F.lit(" could not be answered: "), F.coalesce(c["note"], F.lit("")))))
    lines = F.concat(given, unanswered)
    changed = assessment.isin(CHANGED)
    default = F.when(changed & ~F.exists(lines, lambda x: x.rlike("(?i)budget|owner|approv")), F.lit(DEFAULT_UNESTABLISHED))
    outside = F.when(changed & ~internal & signals, F.lit(EXTERNAL_ONLY_UNESTABLISHED))
    return F.array_distinct(F.concat(lines, F.array_compact(F.array(default, outside))))


def guard(assessment, receipts, failed_4, failed_6) -> Column:
    """The assessment that may be shown, by ordered downgrades."""
    a = F.when(assessment.isin(CHANGED) & ~receipts, "INSUFFICIENT_EVIDENCE").otherwise(assessment)
    b = F.when((a == "WORTH_REASSESSING") & failed_4, "PARTIALLY_CHANGED").otherwise(a)
    return F.when(b.isin(CHANGED) & failed_6, "STILL_BLOCKED").otherwise(b)


#: Signals that are broadcast at once, blocks that they lie in, candidates of one task, and of one array.
SIGNALS, SIGNAL_BLOCKS, CANDIDATES, TOGETHER = 1 << 22, 64, 4096, 128


def signal_pairs(candidates: DataFrame, signals: DataFrame, categories: int) -> DataFrame:
    """(candidate, signal): each of candidates(candidate, category) with signals(signal, category, general) of its category, and those with a category in 0 to `categories` - 1 with all general ones.

    The pairs grow as candidates times signals. Candidates lie in arrays of about TOGETHER of a category, dealt to tasks by their number, not by their bytes; signals
    lie in arrays by category, general ones once, and are broadcast SIGNALS at a time. Pairs come signal by signal, each with all candidates of an
    array: runs of one signal and one short list over and over, which columnar files hold in a small part of a byte a pair.
    """
    spark = candidates.sparkSession
    rounds = max(1, -(-signals.count() // SIGNALS))
    arrays = candidates.groupBy("category").agg(F.ceil(F.count("*") / TOGETHER).alias("arrays")).where("category IS NOT NULL")
    some = candidates.join(arrays, "category").groupBy("category", F.pmod(F.xxhash64("candidate"), F.col("arrays")).alias("array"))
    dealt = some.agg(F.sort_array(F.collect_list("candidate")).alias("candidates")).repartition(max(4 * spark.sparkContext.defaultParallelism, -(-candidates.count() // CANDIDATES)), "category", "array")
    out = None
    for k in range(rounds):
        some = signals.where(F.pmod(F.xxhash64("signal"), F.lit(rounds)) == k).withColumn("block", F.pmod(F.xxhash64("signal", F.lit(1)), F.lit(SIGNAL_BLOCKS)))
        own = some.where("NOT general").groupBy("category", "block").agg(F.collect_list("signal").alias("signals"))
        general = some.where("general").groupBy("block").agg(F.collect_list("signal").alias("signals"))
        met = dealt.join(F.broadcast(own), "category").select("candidates", "signals")
        met = met.union(dealt.where(F.col("category").between(0, categories - 1)).crossJoin(F.broadcast(general)).select("candidates", "signals"))
        out = met if out is None else out.union(met)
    return out.select("candidates", F.explode("signals").alias("signal")).select(F.explode("candidates").alias("candidate"), "signal")
