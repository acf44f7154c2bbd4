"""Whole receipts: a model's nested output checked against the units that exist, and served again later.

An output cites ids in claims, timeline events and reviews. All ids of a case are taken out once, met with the units, and
come back as one map from id to record; all rules are then expressions over the nested row. A case's map is as large as its citations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .receipts import DRAFT_MARKER, DRAFT_NOTE, EXECUTED_WORD, QUOTED

# What a receipt says.
EMPTY_SUMMARY = "See the claims below for what the evidence supports."
NO_SUPPORT_SUMMARY = "No claim could be supported by verified evidence. See missing information for what the archive does not establish."
TRUNCATED_NOTE = "claim rests only on truncated evidence; confidence capped"
QUOTED_NOTE = "quoted wording is a draft sent for signature; confidence capped"
LOWERED_NOTE = "status lowered: unsupported claims were dropped"
REJECTED_NOTE = "cited ids that do not exist or were not visible were rejected"
NO_DATE = "9999-99-99"

IDS = "array<string>"
CLAIM = f"struct<claim_text:string,stance:string,confidence:string,support:{IDS},conflicts:{IDS},uncertainty:string>"
EVENT = f"struct<event_text:string,state:string,confidence:string,evidence_ids:{IDS}>"
OBJECTION = f"struct<text:string,severity:string,evidence_ids:{IDS}>"
#: The columns of an output beside case_id.
OUTPUT = f"status string, answer_summary string, claims array<{CLAIM}>, timeline_events array<{EVENT}>, conflict_resolution string, missing_information {IDS}, related_questions {IDS}"


def _list(column, kind: str) -> Column:
    return F.coalesce(column, F.array().cast(f"array<{kind}>"))


def _ids(column) -> Column:
    return _list(column, "string")


def _prose(lines) -> Column:
    """A list of lines without ids, and without the lines that were only ids."""
    return F.filter(F.transform(_ids(lines), T.clean_prose), lambda x: F.coalesce(x, F.lit("")) != "")


def _kept(ids, records) -> Column:
    """Ids that have a record, each once, in order."""
    return F.filter(F.array_distinct(_ids(ids)), lambda i: F.map_contains_key(records, F.coalesce(i, F.lit(""))))


def _first_date(ids, records) -> Column:
    return F.array_min(F.filter(F.transform(ids, lambda i: records[i]["event_date"]), lambda d: F.coalesce(d, F.lit("")) != ""))


def _with_records(rows: DataFrame, cited: Column, units: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """rows(case_id, ...) with `cited`, the distinct ids, and `records`, a map from those that exist (and are in visible(case_id, evidence_id), if given) to their unit."""
    rows = rows.withColumn("cited", F.array_distinct(cited))
    ids = rows.select("case_id", F.explode("cited").alias("evidence_id"))
    if visible is not None:
        ids = ids.join(visible.select("case_id", "evidence_id").distinct(), ["case_id", "evidence_id"], "left_semi")
    record = F.struct("is_truncated", "event_date", F.coalesce(F.col("raw_text").rlike(DRAFT_MARKER), F.lit(False)).alias("is_draft"), "raw_text")
    found = ids.join(units.select("evidence_id", "is_truncated", "event_date", "raw_text"), "evidence_id").groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("evidence_id", record.alias("r")))).alias("records"))
    empty = F.expr("cast(map() as map<string, struct<is_truncated:boolean,event_date:string,is_draft:boolean,raw_text:string>>)")
    return rows.join(found, "case_id", "left").withColumn("records", F.coalesce("records", empty))


def validate(outputs: DataFrame, units: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Receipts of outputs(case_id, and OUTPUT) against units(evidence_id, is_truncated, event_date, raw_text).

    Claims without words or without live support go, those that are UNCERTAIN apart; confidence is capped where all support is truncated or
    where quoted wording comes from a draft; events without live ids or words go, the others stand by their earliest cited date; status and summary
    say what is left; `report` counts what went, with the ids that were rejected and notes. case_id is unique.
    """
    c, e = _list("claims", CLAIM), _list("timeline_events", EVENT)
    cited = F.flatten(F.concat(F.transform(c, lambda x: F.concat(_ids(x["support"]), _ids(x["conflicts"]))), F.transform(e, lambda x: _ids(x["evidence_ids"]))))
    rows = _with_records(outputs, F.filter(cited, lambda i: i.isNotNull()), units, visible)
    records = F.col("records")

    def claim(x: Column) -> Column:
        support, text, uncertainty = _kept(x["support"], records), T.clean_prose(x["claim_text"]), T.clean_prose(x["uncertainty"])
        cut = (F.size(support) > 0) & F.forall(support, lambda i: F.coalesce(records[i]["is_truncated"], F.lit(False)))
        draft = F.coalesce(text.rlike(QUOTED) & text.rlike(EXECUTED_WORD), F.lit(False)) & F.exists(support, lambda i: records[i]["is_draft"])
        confidence = F.when(cut, "LOW").when(draft & (x["confidence"] == "HIGH"), "MEDIUM").otherwise(x["confidence"])
        noted = F.when(draft & ~F.coalesce(uncertainty.contains(DRAFT_NOTE), F.lit(False)), F.concat_ws(" ", F.nullif(uncertainty, F.lit("")), F.lit(DRAFT_NOTE))).otherwise(uncertainty)
        kept = (F.coalesce(text, F.lit("")) != "") & ((F.size(support) > 0) | F.coalesce(x["stance"] == "UNCERTAIN", F.lit(False)))
        notes = F.array_compact(F.array(F.when(cut & (x["confidence"] != "LOW"), F.lit(TRUNCATED_NOTE)), F.when(draft, F.lit(QUOTED_NOTE))))
        return F.struct(
            text.alias("claim_text"), x["stance"].alias("stance"), confidence.alias("confidence"), support.alias("support"), _kept(x["conflicts"], records).alias("conflicts"), noted.alias("uncertainty"),
            kept.alias("kept"), (confidence != x["confidence"]).alias("downgraded"), notes.alias("notes"),
        )

    def event(x: Column, n: Column) -> Column:
        ids = _kept(x["evidence_ids"], records)
        when = _first_date(ids, records)
        return F.struct(F.coalesce(when, F.lit(NO_DATE)).alias("order"), n.alias("n"), T.clean_prose(x["event_text"]).alias("event_text"), x["state"].alias("state"), x["confidence"].alias("confidence"), ids.alias("evidence_ids"), when.alias("event_date"))

    rows = rows.withColumn("judged", F.transform(c, claim)).withColumn("dated", F.array_sort(F.transform(e, event)))
    good = F.filter("judged", lambda x: x["kept"])
    events = F.filter("dated", lambda x: (F.size(x["evidence_ids"]) > 0) & (F.coalesce(x["event_text"], F.lit("")) != ""))
    rows = rows.withColumns({"good": good, "events": events, "rejected": F.array_sort(F.filter("cited", lambda i: ~F.map_contains_key(records, i)))})
    dropped, supported = F.size("judged") - F.size("good"), F.exists("good", lambda x: F.size(x["support"]) > 0)
    lowered = supported & (dropped > 0) & F.coalesce(F.col("status") == "SUPPORTED", F.lit(False))
    notes = F.concat(F.flatten(F.transform("good", lambda x: x["notes"])), F.array_compact(F.array(F.when(lowered, F.lit(LOWERED_NOTE)), F.when(F.size("rejected") > 0, F.lit(REJECTED_NOTE)))))
    summary = T.clean_prose(F.col("answer_summary"))
    return rows.select(
        "case_id", F.when(~supported, "INSUFFICIENT_EVIDENCE").when(lowered, "PARTIALLY_SUPPORTED").otherwise(F.col("status")).alias("status"),
        F.when(~supported, NO_SUPPORT_SUMMARY).when(F.coalesce(summary, F.lit("")) == "", EMPTY_SUMMARY).otherwise(summary).alias("answer_summary"),
        F.transform("good", lambda x: x.dropFields("kept", "downgraded", "notes")).alias("claims"), F.transform("events", lambda x: x.dropFields("order", "n")).alias("timeline_events"),
        T.clean_prose(F.col("conflict_resolution")).alias("conflict_resolution"), _prose("missing_information").alias("missing_information"), _prose("related_questions").alias("related_questions"),
        F.struct(
            dropped.alias("dropped_claims"), F.size(F.filter("good", lambda x: x["downgraded"])).alias("downgraded_claims"), (F.size("dated") - F.size("events")).alias("dropped_timeline_events"),
            F.col("rejected").alias("rejected_evidence_ids"), notes.alias("notes"),
        ).alias("report"),
    )


def sanitise_reviews(reviews: DataFrame, units: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """reviews(case_id, counter_evidence_ids, objections array<struct<text, severity, evidence_ids>>) with the ids that exist (and were shown), and objections that still have words."""
    o = _list("objections", OBJECTION)
    cited = F.concat(_ids("counter_evidence_ids"), F.flatten(F.transform(o, lambda x: _ids(x["evidence_ids"]))))
    rows, records = _with_records(reviews, F.filter(cited, lambda i: i.isNotNull()), units, visible), F.col("records")
    clean = F.transform(o, lambda x: F.struct(T.clean_prose(x["text"]).alias("text"), x["severity"].alias("severity"), _kept(x["evidence_ids"], records).alias("evidence_ids")))
    return rows.withColumns({"counter_evidence_ids": _kept(F.col("counter_evidence_ids"), records), "objections": F.filter(clean, lambda x: F.coalesce(x["text"], F.lit("")) != "")}).drop("cited", "records")


def serve(receipts: DataFrame, units: DataFrame) -> DataFrame:
    """Stored receipts of `validate` as they may be shown now: ids become citations struct<evidence_id, event_date, raw_text> of the units that still exist; claims and events that lose all of theirs go, status and summary follow."""
    cited = F.flatten(F.concat(F.transform("claims", lambda x: F.concat(x["support"], x["conflicts"])), F.transform("timeline_events", lambda x: x["evidence_ids"])))
    rows, records = _with_records(receipts, cited, units), F.col("records")
    cite = lambda ids: F.transform(_kept(ids, records), lambda i: F.struct(i.alias("evidence_id"), records[i]["event_date"].alias("event_date"), records[i]["raw_text"].alias("raw_text")))
    claims = F.transform("claims", lambda x: F.struct(x["claim_text"].alias("claim_text"), x["stance"].alias("stance"), x["confidence"].alias("confidence"), x["uncertainty"].alias("uncertainty"), cite(x["support"]).alias("support"), cite(x["conflicts"]).alias("conflicts")))
    events = F.transform("timeline_events", lambda x: F.struct(x["event_text"].alias("event_text"), x["state"].alias("state"), x["confidence"].alias("confidence"), _first_date(_kept(x["evidence_ids"], records), records).alias("event_date"), cite(x["evidence_ids"]).alias("citations")))
    rows = rows.withColumns({"claims": F.filter(claims, lambda x: (F.size(x["support"]) > 0) | F.coalesce(x["stance"] == "UNCERTAIN", F.lit(False))), "timeline_events": F.filter(events, lambda x: F.size(x["citations"]) > 0)})
    supported = F.exists("claims", lambda x: F.size(x["support"]) > 0)
    return rows.withColumns({"status": F.when(supported, F.col("status")).otherwise("INSUFFICIENT_EVIDENCE"), "answer_summary": F.when(supported, F.col("answer_summary")).otherwise(NO_SUPPORT_SUMMARY)}).drop("cited", "records")
