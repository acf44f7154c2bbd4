"""Text archives as evidence units: transcripts, mail threads and status reports.

Files are read whole, exploded into lines, and parsed by column expressions and windows over a
file's lines; a file is the unit of work, so an archive of any number of files spreads evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .store import stored

# Header labels by language, month names, section titles, transcript fields.
HEADERS = {
    "Subject": "Subject", "Betreff": "Subject", "Ämne": "Subject", "From": "From", "Von": "From", "Från": "From", "Sent": "Sent", "Gesendet": "Sent", "Skickat": "Sent", "Date": "Date", "Datum": "Date",
    "To": "To", "An": "To", "Till": "To", "Cc": "Cc", "Kopia": "Cc", "Messages in thread": "Messages in thread",
}
MONTHS = {
    "januar": "January", "februar": "February", "märz": "March", "marz": "March", "april": "April", "mai": "May", "juni": "June", "juli": "July", "august": "August", "september": "September", "oktober": "October",
    "november": "November", "dezember": "December", "januari": "January", "februari": "February", "mars": "March", "maj": "May", "augusti": "August",
}
SECTIONS = ["Timeline", "Risk", "Question", "Topics worked on last week", "Topics planned for this week", "Potential risk identified"]
FIELDS = ["Meeting", "Customer", "Date", "Phase", "Attendees"]
KINDS = {"transcripts": "TRANSCRIPT", "emails": "EMAIL", "reports": "REPORT"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, document_type, text) of the .txt files in the folders that hold evidence."""
    out = None
    for folder, kind in KINDS.items():
        read = spark.read.text(f"{path}/{folder}", wholetext=True, pathGlobFilter="*.txt").select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("document_id"), F.lit(kind).alias("document_type"), F.col("value").alias("text"))
        out = read if out is None else out.union(read)
    return out


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))


def name_key(name) -> Column:
    """Lower case without marks, letter for letter."""
    return T.without_marks(F.lower(name))


#: How deep brackets of an attendee list may stand in one another.
DEPTH = 6


def attendees(text) -> Column:
    """The names of a list that commas outside of brackets part, without what stands in brackets; what follows an open bracket belongs to it."""
    for _ in range(DEPTH):
        text = F.regexp_replace(text, r"\s*\([^()]*\)\s*", " ")
    text = F.regexp_replace(text, r"\s*\(.*$", "")
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def transcripts(docs: DataFrame) -> DataFrame:
    """(document_id, position, speaker_sender, timestamp_text, natural_locator, raw_text) fragments of docs(document_id, text).

    Me/Them lines make a fragment each. Otherwise a line of a known name and a time in minutes and
    seconds opens a fragment; bare names, doubled timestamps and initials are chrome, and what comes
    before the first such line is dropped.
    """
    doc = W.partitionBy("document_id")
    field = F.col("line").rlike(rf"^({'|'.join(FIELDS)}):")
    all_ = lines(docs).where("line <> ''").withColumn("is_field", field)
    all_ = all_.withColumn("first", F.min(F.when(F.col("is_field"), F.col("pos"))).over(doc))
    plain = ~F.col("is_field") & ~F.col("line").startswith("***") & (F.col("pos") > F.coalesce("first", F.lit(-1)))
    all_ = all_.withColumn("start", F.min(F.when(plain, F.col("pos"))).over(doc))
    header, body = all_.where("is_field AND pos < coalesce(start, 2147483647)"), all_.where("pos >= start")

    internal = F.max(F.col("line").rlike(r"^(Me|Them):")).over(doc)
    body = body.withColumn("internal", internal)
    own = body.where("internal").select("document_id", F.col("pos").alias("position"), F.regexp_extract("line", r"^(Me|Them):\s?(.*)$", 1).alias("speaker_sender"), F.trim(F.regexp_extract("line", r"^(Me|Them):\s?(.*)$", 2)).alias("raw_text"))
    own = own.where("speaker_sender <> '' AND raw_text <> ''").select("document_id", "position", "speaker_sender", F.lit(None).cast("string").alias("timestamp_text"), F.lit(None).cast("string").alias("natural_locator"), "raw_text")

    people = header.where(F.col("line").startswith("Attendees:")).select("document_id", F.explode(attendees(F.regexp_extract("line", r"^Attendees:\s*(.*)$", 1))).alias("name"))
    guests = body.where(F.col("line").rlike(r"^Guest [0-9]+$")).select("document_id", F.col("line").alias("name"))
    labels = docs.select("document_id", F.explode(F.array(F.lit("Unknown Speaker"), F.lit("[REDACTED SPEAKER]"))).alias("name"))
    names = people.union(guests).union(labels).where("name <> ''").groupBy("document_id", name_key(F.col("name")).alias("key")).agg(F.min("name").alias("name"))
    initials = F.upper(F.array_join(F.transform(F.split("name", r"\s+"), lambda w: F.left(w, F.lit(1))), ""))
    known = names.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "name"))).alias("names"), F.collect_set(initials).alias("initials"))

    timed = r"^(.*?)\s*((?:\d+\s+minutes?)?\s*(?:\d+\s+seconds?)?)$"
    teams = body.where("NOT internal").join(known, "document_id").withColumns({"said": name_key(F.trim(F.regexp_extract("line", timed, 1))), "time": F.trim(F.regexp_extract("line", timed, 2))})
    chrome = F.col("names")[name_key(F.col("line"))].isNotNull() | F.col("line").rlike(r"^(\d{1,2}:\d{2})\1$") | F.array_contains("initials", F.col("line"))
    teams = teams.where(~chrome).withColumn("opens", (F.col("time") != "") & F.col("names")[F.col("said")].isNotNull())
    number = lambda unit: F.coalesce(F.expr(f"try_cast(regexp_extract(time, '(\\\\d+)\\\\s+{unit}', 1) AS INT)"), F.lit(0))
    at = F.last(F.when(F.col("opens"), F.col("pos")), ignorenulls=True).over(doc.orderBy("pos"))
    teams = teams.withColumns({"at": at, "speaker": F.col("names")[F.col("said")], "seconds": number("minute") * 60 + number("second")}).where("at IS NOT NULL")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("opens"), F.struct("pos", "line")))), lambda x: x["line"]), " ")
    teams = teams.groupBy("document_id", F.col("at").alias("position")).agg(
        F.max(F.when(F.col("opens"), F.col("speaker"))).alias("speaker_sender"), F.max(F.when(F.col("opens"), F.col("time"))).alias("timestamp_text"),
        F.max(F.when(F.col("opens"), F.concat(F.lit("t"), F.col("seconds")))).alias("natural_locator"), said.alias("raw_text"),
    )
    return own.union(teams.where("raw_text <> ''").select(*own.columns))


def event_date(value) -> Column:
    """The ISO date of a header's date in English, German or Swedish; null if it is none."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(value), r"(?i)^den\s+", ""), r"^[^\d,]+,\s*", "")
    for name, month in sorted(MONTHS.items(), key=lambda x: -len(x[0])):
        plain = F.regexp_replace(plain, rf"(?i)(?<![A-Za-zÀ-ÿ]){name}(?![A-Za-zÀ-ÿ])", month)
    plain = F.regexp_replace(plain, r"^(\d{1,2})\.\s+", "$1 ")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in ("MMMM d, yyyy h:mm a", "MMMM d, yyyy H:mm", "d MMMM yyyy H:mm")]).cast("date").cast("string")


def messages(docs: DataFrame) -> DataFrame:
    """(document_id, idx, header map, sender_name, sender_email, event_date, natural_locator, body) of the messages of mail threads, newest first as they stand.

    A From line makes a message; the header lines around it, in any order, are its header; the body goes on to the next From line.
    """
    doc = W.partitionBy("document_id").orderBy("pos")
    pattern = rf"^({'|'.join(HEADERS)}):\s*(.*)$"
    u = lines(docs).withColumns({"label": F.regexp_extract("line", pattern, 1), "value": F.trim(F.regexp_extract("line", pattern, 2))})
    u = u.withColumns({"is_header": F.col("label") != "", "is_from": F.col("label").isin("From", "Von", "Från")})
    u = u.withColumn("run", F.sum(F.when(F.col("is_header") & F.coalesce(F.lag("is_header").over(doc), F.lit(False)), 0).otherwise(1)).over(doc))
    run = W.partitionBy("document_id", "run")
    u = u.withColumns({"run_from": F.max(F.when(F.col("is_from"), F.col("pos"))).over(run), "run_end": F.max("pos").over(run)})
    u = u.withColumns({"message": F.last(F.when(F.col("is_from"), F.col("pos")), ignorenulls=True).over(doc), "ends": F.last(F.when(F.col("is_from"), F.col("run_end")), ignorenulls=True).over(doc)})
    label = F.create_map(*[F.lit(x) for pair in HEADERS.items() for x in pair])[F.col("label")]
    # header lines and body lines of a message in one aggregation, which follows the windows' partitioning: lines are cut and shuffled once
    is_head = F.col("is_header") & F.col("run_from").isNotNull()
    is_body = F.col("message").isNotNull() & (F.col("pos") > F.col("ends")) & ~is_head
    u = u.where(is_head | is_body).select("document_id", F.when(is_head, F.col("run_from")).otherwise(F.col("message")).alias("message"), F.when(is_head, F.struct("pos", label.alias("k"), F.col("value").alias("v"))).alias("h"), F.when(is_body, F.struct("pos", "raw")).alias("b"))
    out = u.groupBy("document_id", "message").agg(F.sort_array(F.collect_list("h")).alias("h"), F.sort_array(F.collect_list("b")).alias("b")).where(F.size("h") > 0)
    keys = F.array_distinct(F.transform("h", lambda x: x["k"]))
    header = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter("h", lambda x: x["k"] == k), -1)["v"]))  # the last line of a label
    body = F.when(F.size("b") > 0, F.array_join(F.transform("b", lambda x: x["raw"]), "\n"))
    out = out.select("document_id", "message", header.alias("header"), body.alias("body")).withColumn("idx", F.row_number().over(W.partitionBy("document_id").orderBy("message")) - 1)
    sender, date = F.coalesce(F.col("header")["From"], F.lit("")), F.coalesce(F.col("header")["Date"], F.col("header")["Sent"], F.lit(""))
    both = r"^(.*?)\s*<([^>]+)>\s*$"
    named = sender.rlike(both)
    name = F.when(named, F.trim(F.regexp_extract(sender, both, 1))).when(sender.contains("@"), F.lit("")).otherwise(sender)
    email = F.when(named, F.trim(F.regexp_extract(sender, both, 2))).when(sender.contains("@"), sender)
    locator = F.coalesce(F.nullif(T.slug(date), F.lit("")), F.concat(F.lit("msg"), F.col("idx")))
    return out.select("document_id", "idx", "header", F.nullif(name, F.lit("")).alias("sender_name"), email.alias("sender_email"), event_date(date).alias("event_date"), locator.alias("natural_locator"), F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", "")).alias("body"))


def _subject() -> Column:
    """The subject of the document's newest message."""
    return F.first(F.col("header")["Subject"]).over(W.partitionBy("document_id").orderBy("idx"))


def mail(docs: DataFrame) -> DataFrame:
    """A unit for each message with a body; the title is the newest message's subject."""
    m = messages(docs)
    return m.withColumn("thread_context", _subject()).where("body <> ''").select("document_id", F.col("idx").alias("position"), F.col("sender_name").alias("speaker_sender"), "sender_email", "event_date", "thread_context", "natural_locator", F.col("body").alias("raw_text"), T.is_truncated(F.col("body")).alias("is_truncated"))


def reports(docs: DataFrame) -> DataFrame:
    """Units of status reports: a paragraph each, and in titled sections with two or more numbered bullets a bullet each."""
    m = messages(docs)
    p = m.withColumn("subject", _subject()).select("document_id", "idx", "subject", "sender_name", "sender_email", "event_date", F.posexplode(F.split("body", r"\n\s*\n")).alias("paragraph", "p")).where(F.trim("p") != "")
    kept = F.filter(F.transform(F.split(F.regexp_replace("p", r"^\s+|\s+$", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = rf"^({'|'.join(SECTIONS)})\b(.*)$"
    p = p.withColumn("rows", kept).withColumn("label", F.regexp_extract(F.get("rows", F.lit(0)), head, 1)).withColumn("status", F.trim(F.regexp_extract(F.get("rows", F.lit(0)), head, 2)))
    rest = F.slice("rows", 2, 1 << 30)
    bullets = F.filter(F.transform(F.filter(rest, lambda x: x.rlike(r"^\d+\.")), lambda x: F.trim(F.regexp_replace(x, r"^\d+\.\s*", ""))), lambda x: x != "")
    plain = F.filter(rest, lambda x: ~x.rlike(r"^\d+\."))
    status = F.filter(F.array("status"), lambda x: x != "")
    parts = F.concat(status, bullets, plain)
    units = F.when(F.col("label") == "", F.array(F.array_join("rows", " "))).when(F.size(bullets) >= 2, parts).otherwise(F.array(F.array_join(parts, " ")))
    out = p.select("*", F.posexplode(units).alias("k", "raw_text")).where("raw_text <> ''")
    context = F.when(F.col("label") == "", F.col("subject")).otherwise(F.concat_ws(" — ", "subject", "label"))
    return out.select("document_id", F.struct("idx", "paragraph", "k").alias("position"), F.col("sender_name").alias("speaker_sender"), "sender_email", "event_date", context.alias("thread_context"), "raw_text", T.is_truncated(F.col("raw_text")).alias("is_truncated"))


def assemble(units: DataFrame, documents: DataFrame) -> DataFrame:
    """Parsed units(document_id, position, event_date, thread_context, ...) as evidence: numbered from 0 in their document, with its date and title (documents(document_id, document_date, title)) where a unit has none of its own."""
    nth = F.row_number().over(W.partitionBy("document_id").orderBy("position")) - 1
    both = units.withColumn("unit_index", nth).join(documents.select("document_id", "document_date", "title"), "document_id", "left")
    return both.withColumns({"event_date": F.coalesce("event_date", "document_date"), "thread_context": F.coalesce("thread_context", "title")}).drop("document_date", "title", "position")


def record_boundaries(known: DataFrame, parsed: DataFrame) -> DataFrame:
    """(document_id, position, starts_group): what was recorded first stays, whatever a later parse says."""
    new = parsed.select("document_id", "position", F.col("starts_group").alias("_new"))
    both = known.select("document_id", "position", "starts_group").join(new, ["document_id", "position"], "full")
    return both.select("document_id", "position", F.coalesce("starts_group", "_new").alias("starts_group"))


def ingest_report(units: DataFrame) -> DataFrame:
    """Counters by document type: documents, units, units without a named speaker, truncated units."""
    nobody = F.col("speaker_sender").isNull() | T.is_non_person(F.col("speaker_sender"))
    return units.groupBy("document_type").agg(F.count_distinct("document_id").alias("n_documents"), F.count("*").alias("n_units"), F.count_if(nobody).alias("n_anonymous"), F.count_if("is_truncated").alias("n_truncated"))


def parse_all(docs: DataFrame) -> DataFrame:
    """All units of docs(document_id, document_type, text, document_date, title), each parsed as its type says, as one table: document_id, document_type, unit_index, speaker_sender, event_date, thread_context, natural_locator, raw_text, is_truncated."""
    of = lambda kind: docs.where(F.col("document_type") == kind).select("document_id", "text")
    null = F.lit(None).cast("string")
    said = transcripts(of("TRANSCRIPT")).select("document_id", "position", "speaker_sender", null.alias("event_date"), null.alias("thread_context"), "natural_locator", "raw_text", T.is_truncated(F.col("raw_text")).alias("is_truncated"))
    columns = ["document_id", "position", "speaker_sender", "event_date", "thread_context", "natural_locator", "raw_text", "is_truncated"]
    parsed = {"TRANSCRIPT": said, "EMAIL": mail(of("EMAIL")).select(*columns), "REPORT": reports(of("REPORT")).withColumn("natural_locator", null).select(*columns)}
    out, titles = None, stored(docs.select("document_id", "document_date", "title"))
    for kind, units in parsed.items():
        one = assemble(units, titles).select("document_id", F.lit(kind).alias("document_type"), F.col("unit_index").cast("long"), *columns[2:])
        out = one if out is None else out.union(one)
    return out
