"""Archive parsers and the upload stream on invented files."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.sources import archive
from quarry.streaming import uploads

TEAMS = """*** machine made ***
Meeting: Kick-off
Date: 2024-03-20
Attendees: Åse Sørlie (Acme, joins late), Ben Okoro

stray line
Ase Sorlie
1:041:04
ÅS
Ase Sorlie 1 minute 4 seconds
We planned to
move it.
Ben Okoro 2 minutes
Fine.
Guest 1
Guest 1 3 minutes 57 seconds
Hello from outside.
Unknown Speaker 4 minutes 1 second
Who is this
2 hours later
"""
INTERNAL = "Meeting: x\nDate: 2024-01-01\n\nMe: first\nThem:  second \nnoise\nMe:\n"
THREAD = """Subject: Go live
From: Ana Duarte <ana@x.org>
Date: October 30, 2025 12:02 PM
To: all

Newest text —

Von: Jörg Weiß
Gesendet: Mittwoch, 29. Juni 2026 10:15
An: Ana
Betreff: AW: Go live

Zweite Nachricht
mit zwei Zeilen

Från: kim@y.se
Skickat: den 4 maj 2025 14:20
Till: Ana

Tredje
"""
REPORT = """Subject: Weekly
From: Kim Lee
Date: September 4, 2025 14:20

Hello all,
as every week.

Topics worked on last week: green
1. imports
2. exports
see wiki

Risk none
1. only one
"""


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, text string")


def test_transcripts(spark):
    got = [(r.document_id, r.speaker_sender, r.timestamp_text, r.natural_locator, r.raw_text) for r in archive.transcripts(docs(spark, TEAMS, INTERNAL)).orderBy("document_id", "position").collect()]
    assert got == [
        ("d0", "Åse Sørlie", "1 minute 4 seconds", "t64", "We planned to move it."),
        ("d0", "Ben Okoro", "2 minutes", "t120", "Fine."),
        ("d0", "Guest 1", "3 minutes 57 seconds", "t237", "Hello from outside."),
        ("d0", "Unknown Speaker", "4 minutes 1 second", "t241", "Who is this 2 hours later"),
        ("d1", "Me", None, None, "first"),
        ("d1", "Them", None, None, "second"),
    ]


def test_mail(spark):
    got = archive.mail(docs(spark, THREAD)).orderBy("position").collect()
    assert [(r.speaker_sender, r.sender_email, r.event_date, r.natural_locator, r.is_truncated) for r in got] == [
        ("Ana Duarte", "ana@x.org", "2025-10-30", "october-30-2025-12-02-pm", True),
        ("Jörg Weiß", None, "2026-06-29", "mittwoch-29-juni-2026-10-15", False),
        (None, "kim@y.se", "2025-05-04", "den-4-maj-2025-14-20", False),
    ]
    assert [r.raw_text for r in got] == ["Newest text —", "Zweite Nachricht\nmit zwei Zeilen", "Tredje"] and {r.thread_context for r in got} == {"Go live"}


def test_reports(spark):
    got = [(r.raw_text, r.thread_context) for r in archive.reports(docs(spark, REPORT)).orderBy("position").collect()]
    last = "Weekly — Topics worked on last week"
    assert got == [("Hello all, as every week.", "Weekly"), (": green", last), ("imports", last), ("exports", last), ("see wiki", last), ("none only one", "Weekly — Risk")]


def test_files(spark, tmp_path):
    for folder in archive.KINDS:
        (tmp_path / folder).mkdir()
    (tmp_path / "emails" / "a.txt").write_text(THREAD)
    (tmp_path / "emails" / "a.md").write_text("no evidence")
    (tmp_path / "reports" / "b.txt").write_text(REPORT)
    assert sorted((r.document_id, r.document_type) for r in archive.files(spark, str(tmp_path)).collect()) == [("a", "EMAIL"), ("b", "REPORT")]


def test_uploads(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "Notes é.txt").write_bytes("﻿one\r\n\r\ntwo".encode())
    (inbox / "bad.txt").write_bytes(b"\xff\xfe")
    (inbox / "empty.txt").write_bytes(b" \n")
    args = (str(inbox), str(tmp_path / "units"), str(tmp_path / "state"))
    uploads.follow(spark, *args).awaitTermination(60)
    (inbox / "more.txt").write_text("three")
    uploads.follow(spark, *args).awaitTermination(60)
    got = sorted((r.document_id, r.unit_index, r.raw_text) for r in spark.read.parquet(args[1]).collect())
    assert got == [("Notes-e", 0, "one"), ("Notes-e", 1, "two"), ("more", 0, "three")]
    names = spark.createDataFrame([("../x/.hid", b"a"), ("..", b"a"), ("a/b c?.TXT", b"a\x00")], "name string, content binary")
    assert [(r.document_id, r.problem) for r in uploads.validated(names).collect()] == [(None, "name"), (None, "name"), ("b-c", "NUL byte")]


def test_manifests(spark, tmp_path):
    from quarry.sources import manifests

    (tmp_path / "m.json").write_text(
        '{"description": "d", "extra": 1, "entries": [{"canonical_name": "Ana Duarte", "verified_aliases": [{"alias": "Ana", "alias_type": "FIRST_NAME", "source_reference": "d1"}, {"alias": "ana  duarte", "alias_type": "VARIANT", "source_reference": "d1"}]},'
        '{"canonical_name": "Ana Berg", "verified_aliases": [{"alias": "ana", "alias_type": "FIRST_NAME", "source_reference": "d2"}, {"alias": "x", "alias_type": "FULL_NAME", "source_reference": "d2"}]}, {"canonical_name": "Me", "verified_aliases": []}]}'
    )
    got = sorted((r.canonical_name, r.problem) for r in manifests.violations(manifests.identities(spark, str(tmp_path / "m.json"))).collect())
    assert got == [("Ana Berg", "alias type"), ("Me", "reserved name")]  # aliases are told apart by case; an alias may repeat the name
    (tmp_path / "m.json").write_text((tmp_path / "m.json").read_text().replace('"ana"', '"Ana"'))
    got = sorted((r.canonical_name, r.problem) for r in manifests.violations(manifests.identities(spark, str(tmp_path / "m.json"))).collect())
    assert got == [("Ana Berg", "alias of several people"), ("Ana Berg", "alias type"), ("Ana Duarte", "alias of several people"), ("Me", "reserved name")]
    (tmp_path / "s.json").write_text('{"signals": [{"signal_id": "s1", "categories": []}]}')
    assert [r.signal_id for r in manifests.signals(spark, str(tmp_path / "s.json")).collect()] == ["s1"]


def stream_of(spark, path, rows):
    """One file a row, read one a batch."""
    schema = "ts timestamp, event_type string, value double, document_id string, fingerprint string"
    for i, r in enumerate(rows):
        if os.path.isdir(f"{path}/part{i:02d}"):
            continue
        spark.createDataFrame([r], schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(f"{path}/part{i:02d}")
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part*")


def run_stream(df, name, path, sink="memory"):
    writer = df.writeStream.format(sink).outputMode("append").option("checkpointLocation", f"{path}/ck-{name}").trigger(availableNow=True)
    (writer.queryName(name).start() if sink == "memory" else writer.start(f"{path}/{name}")).awaitTermination()


STREAM = [("2024-01-01 00:10:00", "a", 1.0, "d", "f1"), ("2024-01-01 00:50:00", "a", 2.0, "d", "f2"), ("2024-01-01 01:10:00", "b", 4.0, "e", "f1"), ("2024-01-02 00:00:00", "a", 8.0, "d", "f1")]


@pytest.fixture
def rocksdb(spark):
    """The state store that maps and values of a stream's keys need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_streams(spark, tmp_path, rocksdb):
    from quarry.streaming import events

    stream = stream_of(spark, tmp_path, [*STREAM, ("2024-01-02 05:00:00", "a", 1.0, "d", "f3"), ("2024-01-01 00:20:00", "a", 99.0, "d", "f0")])  # the last is too late
    for name, df in (("counts", events.windowed_counts(stream())), ("seen", events.first_seen(stream()))):
        run_stream(df, name, tmp_path)
    got = {(str(r.start)[:13], r.event_type): r.n for r in spark.table("counts").collect()}
    assert got[("2024-01-01 01", "b")] == 1 and got[("2024-01-01 00", "a")] in (2, 3)
    seen = {(r.document_id, r.fingerprint): r.locator for r in spark.table("seen").collect()}
    assert sorted(seen) == [("d", "f0"), ("d", "f1"), ("d", "f2"), ("d", "f3"), ("e", "f1")] and sorted(v for (d, _), v in seen.items() if d == "d") == ["u0000", "u0001", "u0002", "u0003"]


def test_first_seen_goes_on_after_a_restart(spark, tmp_path, rocksdb):
    from quarry.streaming import events

    run_stream(events.first_seen(stream_of(spark, tmp_path, STREAM)()), "seen", tmp_path, "parquet")
    run_stream(events.first_seen(stream_of(spark, tmp_path, [*STREAM, ("2024-01-03 00:00:00", "a", 1.0, "d", "f2"), ("2024-01-03 00:00:01", "a", 1.0, "d", "f9"), ("2024-01-03 00:00:02", "a", 1.0, "d", "f9")])()), "seen", tmp_path, "parquet")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/seen").collect()} == {("d", "f1", "u0000"), ("d", "f2", "u0001"), ("e", "f1", "u0000"), ("d", "f9", "u0002")}


def test_repeats_are_dropped_within_the_watermark(spark, tmp_path):
    from quarry.streaming import events

    rows = [("2024-01-01 00:00:00", "a", 1.0, "d", "f1"), ("2024-01-01 00:30:00", "a", 1.0, "d", "f1"), ("2024-01-01 09:00:00", "a", 1.0, "d", "f2"), ("2024-01-01 01:00:00", "a", 1.0, "d", "f3"), ("2024-01-01 09:10:00", "a", 1.0, "d", "f1")]
    for n in (3, 5):  # the watermark outlives a restart
        run_stream(events.without_repeats(stream_of(spark, tmp_path, rows[:n])(), "2 hours"), "fresh", tmp_path, "parquet")
    got = sorted((str(r.ts)[11:16], r.fingerprint) for r in spark.read.parquet(f"{tmp_path}/fresh").collect())
    assert got == [("00:00", "f1"), ("09:00", "f2"), ("09:10", "f1")]  # f3 is too late; f1 comes again when its state has gone


def test_lines_of_mail_and_reports_are_cut_once(spark):
    docs = spark.createDataFrame([("a", "Cc: x\nFrom: Ana <a@x.org>\nFrom: Bo\nSubject: one\nSubject: two\n\nbody\nFrom: Cai\n\n\nFrom: Di\nTo: Bo\n\nrest\nTo: no header of its own\n\nCc: none\nlast"), ("b", "no header\nTo: x"), ("c", None)], "document_id string, text string")
    got = {(r.document_id, r.idx): (r.header, r.sender_name, r.body) for r in archive.messages(docs).collect()}
    assert got[("a", 0)] == ({"Cc": "x", "From": "Bo", "Subject": "two"}, "Bo", "body")
    assert got[("a", 1)] == ({"From": "Cai"}, "Cai", "")
    assert got[("a", 2)] == ({"From": "Di", "To": "Bo"}, "Di", "rest\nTo: no header of its own\n\nCc: none\nlast") and len(got) == 3
    for parse in (archive.messages, archive.mail, archive.reports):
        plan = parse(docs)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("posexplode(split(text") == 1, plan
