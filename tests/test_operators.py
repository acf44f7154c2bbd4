"""Operators on small invented fixtures."""

import re
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import identity, people, privacy, receipts
from quarry.operators import retrieval as R


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, T.topic_terms(x), x="What share of the Plans was signed, and the plans?") == ["share", "plans", "signed", "percent"]
    for word, stem in {"agreed": "agre", "committed": "commit", "stations": "station", "decided": "decid", "ring": "ring", "falling": "fall"}.items():
        assert one(spark, T.light_stem(x), x=word) == stem
    got = one(spark, T.phrases(T.topic_terms(x)), x="decided go signing")
    assert [(p.phrase, p.prefix) for p in got] == [("decid", True), ("decis", True), ("go", False), ("sign", True), ("signat", True)]
    assert one(spark, T.date_range(x), x="between December 2024 and March of 2023").asDict() == {"from": "2023-03-01", "to": "2025-01-01"}
    assert one(spark, T.date_range(x), x="in 2022?").asDict() == {"from": "2022-01-01", "to": "2023-01-01"}
    assert one(spark, T.date_range(x), x="ever") is None
    assert one(spark, T.is_truncated(x), x="and then we [cid:a.png] —  ") is True
    assert one(spark, T.is_truncated(x), x="a - b") is False
    assert one(spark, T.clean_prose(x), x="It was [EV-d1-t4] agreed  EV-d2.") == "It was agreed"
    assert one(spark, T.is_context_dependent(x), x="Yes, " + "word " * 20) is True
    assert one(spark, T.is_non_person(x), x=" Guest 12 ") is True
    assert one(spark, T.is_non_person(x), x="Guest house") is False
    assert one(spark, T.words(x), x="  ") == 0


def test_bm25_equals_fts5(spark):
    texts = ["the bakery scope was agreed in may", "signed and attached", "scope creep and bakery bakery plans", "nothing here", "Agreement on the scope of signatures"]
    units = spark.createDataFrame([(i, t, "thread scope" if i % 2 else "minutes", "ana") for i, t in enumerate(texts)], "id long, body string, title string, who string")
    questions = spark.createDataFrame([(1, "was the bakery scope agreed?"), (2, "who signed the scope")], "query_id long, query string")
    index = R.postings(units, {"body": "body", "title": "title", "speaker": "who"})
    got = {(r.query_id, r.id): r.score for r in R.bm25(index, R.query_phrases(questions), R.BODY_WEIGHTS).collect()}
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(body, title, who)")
    con.executemany("INSERT INTO f(rowid, body, title, who) VALUES (?, ?, ?, ?)", [(i + 1, t, "thread scope" if i % 2 else "minutes", "ana") for i, t in enumerate(texts)])
    for q, match in ((1, '"bakery"* OR "scope"* OR "agre"*'), (2, '"sign"* OR "signat"* OR "scope"*')):
        want = {(q, r[0] - 1): round(-r[1], 6) for r in con.execute("SELECT rowid, bm25(f, 1.0, 0.4, 0.4) FROM f WHERE f MATCH ?", (match,))}
        assert {k: v for k, v in got.items() if k[0] == q} == pytest.approx(want, abs=2e-6)


def test_caps_and_fusion(spark):
    scored = spark.createDataFrame([(1, i, 10.0 - i, "a" if i < 4 else "b") for i in range(8)], "query_id long, id long, score double, document_id string")
    assert [(r.id, r["rank"]) for r in R.capped_top_k(scored, 4, 2).orderBy("rank").collect()] == [(0, 1), (1, 2), (4, 3), (5, 4)]
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 8, 1)], "query_id long, id long, rank int")
    fused = [(r.id, r.score, r.n_lists) for r in R.fuse([(a, 1.0), (b, 1.0)], 5).orderBy("rank").collect()]
    assert fused == [(8, round(1 / 62 + 1 / 61, 9), 2), (7, round(1 / 61, 9), 1)]


def test_windows_and_continuation(spark):
    long = "this turn holds more than eight words so it stands by itself"
    texts = [long + ".", long + ".", "Which one?", "Yes.", "Sounds good.", long + ".", long + "."]
    u = spark.createDataFrame([("d", "TRANSCRIPT", i, t) for i, t in enumerate(texts)], "document_id string, document_type string, unit_index long, raw_text string")
    got = {r.unit_index: (r.lo - 1, r.hi - 1) for r in R.context_windows(u).collect()}
    assert got[3] == (1, 5) and got[0] == (0, 1) and got[6] == (5, 6)
    mail = u.withColumn("document_type", F.lit("EMAIL"))
    assert {r.radius for r in R.context_windows(mail).collect()} == {1}
    turns = [("a", "we planned to"), ("b", "Okay."), ("a", "move it and"), ("b", "Yes."), ("a", "stop."), (None, "alone and"), ("b", "No."), (None, "done.")]
    c = spark.createDataFrame([("d", i, s, t) for i, (s, t) in enumerate(turns)], "document_id string, unit_index long, speaker_sender string, raw_text string")
    assert {r.unit_index: r.ends_at for r in R.continuation(c).collect()} == {0: 4, 1: 1, 2: 4, 3: 3, 4: 4, 5: 7, 6: 6, 7: 7}


def test_identity(spark):
    f = spark.createDataFrame([("d", 0, "a", None, "x"), ("d", 1, "a", 0, "y"), ("d", 2, "a", 1, "z"), ("d", 4, "a", None, "gap"), ("d", 5, "b", None, "q")], "document_id string, position int, speaker string, starts_group int, text string")
    assert [r.text for r in identity.merge_turns(f).orderBy("turn").collect()] == ["x y", "z", "gap", "q"]
    parsed = spark.createDataFrame([("d", i, h) for i, h in enumerate(["h1", "h1", "h2", "h1"])], "document_id string, position int, fingerprint string")
    manifest = spark.createDataFrame([("d", 3, "h1", "u0003"), ("d", 9, "h1", "u0009")], "document_id string, genesis_position int, fingerprint string, source_locator string")
    got = {r.position: (r.source_locator, r.minted) for r in identity.reuse_locators(parsed, manifest).collect()}
    assert got == {0: ("u0003", False), 1: ("u0009", False), 2: ("u0010", True), 3: ("u0011", True)}
    m = spark.createDataFrame([("d", "u1", "h", None), ("d", "u2", "REVOKED", "2020")], "document_id string, source_locator string, content_fingerprint string, revoked_at string")
    gone = {r.source_locator: (r.content_fingerprint, r.revoked_at) for r in identity.revoke(m, m.select("document_id", "source_locator"), "2024").collect()}
    with pytest.raises(Exception, match="unknown locator u9 of d"):
        identity.revoke(m, spark.createDataFrame([("d", "u9")], "document_id string, source_locator string"), "2024").collect()
    assert gone == {"u1": ("REVOKED", "2024"), "u2": ("REVOKED", "2020")}
    old = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b")], "document_id string, position int, fingerprint string")
    assert [tuple(r) for r in identity.remap(old, old.withColumn("fingerprint", F.when(F.col("position") == 1, "c").otherwise(F.col("fingerprint")))).collect()] == [("d", "b", "c")]
    with pytest.raises(Exception, match="changed the number of units"):
        identity.remap(old, old.where("position = 0")).collect()


def test_people(spark):
    names = spark.createDataFrame([(n,) for n in ["Ana Duarte", "Nadia Berg", "Nadia Holm", "Mark Duarte Lund", "Ana", "Nadia", "Will", "Will Stone", "Berg"]], "name string")
    assert {r.name: r.full_name for r in people.fold_single_names(names).collect()} == {"Ana": "Ana Duarte"}
    short = {r.token: r.name for r in people.short_name_owners(names).collect()}
    assert "Nadia" not in short and short["Ana"] == "Ana Duarte" and short["MDL"] == "Mark Duarte Lund"
    units = spark.createDataFrame([("will we go? Will said stone. a@Stone.x",)], "raw_text string")
    reasons = {r.name: r.reason for r in people.first_name_reasons(names, people.case_counts(units), ["ana"]).collect()}
    assert reasons == {"Ana Duarte": "reserved", "Nadia Berg": "shared", "Nadia Holm": "shared", "Mark Duarte Lund": "ordinary-word", "Will Stone": "shared"}


def test_receipts(spark):
    assert one(spark, receipts.level(receipts.query_triggers(F.col("x"))), x="who approved it, is it final now?") == "HIGH"
    assert one(spark, receipts.query_triggers(F.col("x")), x="the weather") == []
    rows = [("WORTH_REASSESSING", False, False, False, "INSUFFICIENT_EVIDENCE"), ("WORTH_REASSESSING", True, True, False, "PARTIALLY_CHANGED"), ("WORTH_REASSESSING", True, True, True, "STILL_BLOCKED"), ("STILL_BLOCKED", False, True, True, "STILL_BLOCKED")]
    df = spark.createDataFrame(rows, "a string, r boolean, f4 boolean, f6 boolean, want string")
    assert all(r.got == r.want for r in df.withColumn("got", receipts.guard(F.col("a"), F.col("r"), F.col("f4"), F.col("f6"))).collect())
    checks = spark.createDataFrame([(1, 1, True, False), (1, 4, True, True)], "candidate_id int, check int, answered boolean, passed boolean")
    got = receipts.seven_checks(checks).orderBy("check").collect()
    assert len(got) == 7 and got[0].vetoed and not got[3].vetoed and not got[6].answered and not got[6].vetoed


def test_privacy(spark):
    x = F.col("x")
    text = "Öberg met Ana\n Berg and berg; ANA BERG wrote from a.b@x.org"
    assert one(spark, privacy.pseudonymise(x, ["Berg", "Ana Berg"], ["a.b@x.org"], "Person Jade"), x=text) == "Öberg met Person Jade and Person Jade; Person Jade wrote from person-jade@pseudonymised.invalid"
    sealed = privacy.seal(spark.createDataFrame([(1, "Ana")], "subject_id int, bundle string"), "0123456789abcdef")
    assert privacy.unseal(sealed, "0123456789abcdef").first().bundle == "Ana"
    assert privacy.unseal(sealed, "fedcba9876543210").first().bundle is None


def test_privacy_signs_and_signatures(spark):
    x, ana = F.col("x"), (["Ana Berg", "Ana"], ["a.b@x.org"], "Person $1 \\Jade")
    assert one(spark, privacy.pseudonymise(x, *ana), x="Ana said") == "Person $1 \\Jade said"
    assert one(spark, privacy.restore(privacy.pseudonymise(x, *ana), ana[2], "A$0\\", "a.b@x.org"), x="ana, A.B@X.ORG") == "A$0\\, a.b@x.org"
    mail = "Dear all\n ana  BERG \nHead\nPhone\n\nAna\nx\n1\n2\n3\n4\n5\nsixth line of Ana\nbanana"
    assert one(spark, privacy.rewrite(x, "EMAIL", ["Ana Berg", "Ana"], [], "P"), x=mail) == "Dear all\nP\n\nP\nsixth line of P\nbanana"
    assert one(spark, privacy.rewrite(x, "TRANSCRIPT", ["Ana Berg"], [], "P", "AB"), x="AB\nAna\nBerg x\nAB\nABC\n AB") == "P x\nABC"
    rows = spark.createDataFrame([("management by Ana, ana-lysis; ANA ana",)], "t string")
    assert privacy.needle_counts(rows, "t", ["ana"], "s").first().hits == 4  # `ana-lysis` begins with the whole word
    assert privacy.needle_counts(rows, "t", ["a, ana"], "s").first().hits == 1


def test_locators_and_vectors_that_raise(spark):
    parsed = spark.createDataFrame([("d", 0, "t1", "f"), ("d", 1, None, "g")], "document_id string, position long, natural_locator string, fingerprint string")
    manifest = "document_id string, source_locator string, genesis_position long, fingerprint string, revoked_at string"
    got = {r.position: (r.source_locator, r.minted) for r in identity.assign_locators(parsed, spark.createDataFrame([("d", "u0004", 4, "g", "2024"), ("d", "t1", 0, "f", None)], manifest)).collect()}
    assert got == {0: ("t1", False), 1: ("u0005", True)}  # the revoked locator is not given again
    with pytest.raises(Exception, match="revoked locator t1"):
        identity.assign_locators(parsed, spark.createDataFrame([("d", "t1", 0, "f", "2024")], manifest)).collect()
    vectors = spark.createDataFrame([(1, [3.0, 4.0], "m"), (2, [1.0, 0.0], "m"), (3, [1.0], "n")], "id long, v array<double>, model string")
    live = spark.createDataFrame([(1,), (2,)], "id long")
    assert {r.id: r.v for r in R.load_vectors(vectors, live).collect()} == {1: [0.6, 0.8], 2: [1.0, 0.0]}
    for bad in ([(2, [1.0], "m")], [(2, [1.0, 2.0], "n")], [(2, [float("nan"), 1.0], "m")]):
        with pytest.raises(Exception, match="embeddings"):
            R.load_vectors(vectors.where("id = 1").union(spark.createDataFrame(bad, vectors.schema)), live).collect()


def test_minted_numbers_run_on(spark, monkeypatch):
    monkeypatch.setattr(identity, "RUN", 3)
    parsed = spark.createDataFrame([("d", i * 2, f"h{i}") for i in range(9)], "document_id string, position int, fingerprint string")
    none = spark.createDataFrame([], "document_id string, genesis_position int, fingerprint string, source_locator string")
    assert [r.source_locator for r in identity.reuse_locators(parsed, none).orderBy("position").collect()] == [f"u{i:04d}" for i in range(9)]


def test_claims(spark):
    claims = spark.createDataFrame([(1, 10, 'They "signed" it', "DECISION", "HIGH", None), (1, 11, "EV-1", "DECISION", "HIGH", None), (2, 20, "no one knows", "UNCERTAIN", "LOW", "x")], "case_id int, claim_id int, claim_text string, stance string, confidence string, uncertainty string")
    cited = spark.createDataFrame([(10, "a", False), (10, "zz", False), (11, "a", False)], "claim_id int, evidence_id string, conflict boolean")
    units = spark.createDataFrame([("a", False, "for your signature: ...")], "evidence_id string, is_truncated boolean, raw_text string")
    got = {r.claim_id: r for r in receipts.validate_claims(claims, cited, units).collect()}
    assert (got[10].confidence, got[10].uncertainty, got[10].n_support) == ("MEDIUM", receipts.DRAFT_NOTE, 1) and not got[11].kept and got[20].kept
    cases = spark.createDataFrame([(1, "SUPPORTED"), (2, "SUPPORTED"), (3, "SUPPORTED")], "case_id int, status string")
    states = {r.case_id: r.status for r in receipts.validated_status(cases, receipts.validate_claims(claims, cited, units)).collect()}
    assert states == {1: "PARTIALLY_SUPPORTED", 2: "INSUFFICIENT_EVIDENCE", 3: "INSUFFICIENT_EVIDENCE"}
    assert [r.evidence_id for r in receipts.rejected_ids(cited, units).collect()] == ["zz"]
    x = F.col("x")
    for text, fits in (("in 12 months", True), ("twenty of them", True), ("a1b", False), ("none", False)):
        assert one(spark, x.rlike(receipts.SPECIFIC_VALUE), x=text) is fits
    assert one(spark, receipts.strip_fence(x), x='```json\n{"a": "```"}\n```\nok') == '{"a": "```"}'
    assert one(spark, receipts.bounded(x), x="It MAKES sense to wait") == receipts.WITHHELD


def test_mentions_of_several_words(spark):
    units = spark.createDataFrame([(1, "Ana Berg and O'Neil (x)"), (2, "Ana Bergen"), (3, "by Ana")], "evidence_id int, raw_text string")
    d = spark.createDataFrame([("s1", "Ana Berg"), ("s1", "Ana"), ("s2", "O'Neil"), ("s3", "Bergen")], "subject_id string, alias string")
    none = spark.createDataFrame([(3, "s1")], "evidence_id int, subject_id string")
    assert {tuple(r) for r in people.link_mentions(units, d, none).collect()} == {(1, "s1"), (1, "s2"), (2, "s1"), (2, "s3")}


def test_mentions_by_the_rarest_word(spark, monkeypatch):
    monkeypatch.setattr(people, "SEGMENT", 16)
    fill = "of the and to " * 40
    texts = {1: fill + "Ana of the Hill " + fill, 2: "Ana of the Hills", 3: "say (Bo) now", 4: "say xx(Bo) now", 5: "a.b@x.org, c", 6: "a.b@x.orgs", 7: "Zoë  Ray", 8: "Zoë Ray's", 9: "(Bo)", 10: None, 11: "", 12: "Hill of the Ana", 13: fill * 3 + "Zoë Ray"}
    d = spark.createDataFrame([("s1", "Ana of the Hill"), ("s2", "(Bo)"), ("s3", "a.b@x.org"), ("s4", "Zoë Ray"), ("s5", "of the Moon"), ("s6", "--"), ("s4", "Ray")], "subject_id string, alias string")
    units = spark.createDataFrame(list(texts.items()), "evidence_id long, raw_text string")
    none = spark.createDataFrame([(13, "s4")], "evidence_id long, subject_id string")
    got = {tuple(r) for r in people.link_mentions(units, d, none).collect()}
    assert got == {(1, "s1"), (3, "s2"), (9, "s2"), (5, "s3"), (7, "s4"), (8, "s4")}


def test_mention_dictionary(spark):
    p = spark.createDataFrame([("1", "Ana Berg", "Person 1"), ("2", "Bo Berg", "Person 2"), ("3", "Cleo Nilsson Ek", "Person 3"), ("4", None, "Person 4"), ("5", "Solo", "Person 5"), ("6", "Nina Ana", "Person 6")], "subject_id string, display_name string, display_alias string")
    a = spark.createDataFrame([("1", "ana@x.org", "EMAIL")], "subject_id string, alias string, alias_type string")
    loose = {tuple(r) for r in people.mention_dictionary(p, a).collect()}
    assert loose == {*((str(i), f"Person {i}") for i in range(1, 7)), ("1", "ana@x.org"), ("1", "AB"), ("2", "Bo"), ("2", "BB"), ("3", "Cleo"), ("3", "Ek"), ("3", "CNE"), ("6", "Nina"), ("6", "NA")}
    index = spark.createDataFrame([("3", "FIRST", "Cleo", None), ("3", "LAST", "Ek", "too-short"), ("2", "FULL", "bo berg", None)], "subject_id string, kind string, token string, reason string")
    strict = {tuple(r) for r in people.mention_dictionary(p, a, index).collect()}
    assert strict == loose - {("2", "Bo"), ("3", "Ek"), ("6", "Nina")}


def test_one_automaton_finds_what_a_pattern_each_finds(spark):
    needles = ["ana", "Ana-Lisa", "ana berg", "@example", "ÅSA", "straße", "zz", "İ", "a", "", "nn-", "o'neil"]
    texts = ["Ana, ANA_ ana-lisa ana Berg analysis", "åsa ÅSA Straße STRASSE", "zzz zzzz o'NEIL O'Neils", "x@EXAMPLE.org ann-nn-", None, "", "i̇ İ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    walked = {r.needle: (r.hits, r.n_rows) for r in privacy.needle_counts(rows, "t", needles, "s").collect()}
    for n in needles:
        if n:
            one = privacy.needle_counts(rows, "t", [n], "s").first()
            assert walked[n] == (one.hits, one.n_rows), n
    assert privacy.content_hits(rows, needles, "s").first().hits == sum(h for h, _ in walked.values())


def test_ten_thousand_needles(spark):
    names = [f"Name{i} Family{i}" for i in range(10_000)]
    rows = spark.createDataFrame([(f"{i} by name{i * 7} FAMILY{i * 7} and name{i} x",) for i in range(1000)], "t string")
    got = {r.needle: r.hits for r in privacy.needle_counts(rows, "t", names, "s").where("hits > 0").collect()}
    # a name with digits counts inside longer ones: family7 ends no word
    want = {n: sum(f"name{i * 7} family{i * 7}".count(n.lower()) for i in range(1000)) for n in {names[j // 10**k] for j in range(0, 7000, 7) for k in range(4)}}
    assert got == {n: k for n, k in want.items() if k}


def test_closure_and_stash(spark):
    e = spark.createDataFrame([("f", 1, "u", 1), ("c", 1, "f", 1), ("f", 2, "c", 1), ("f", 1, "f", 2), ("c", 9, "f", 8)], "kind string, id long, on_kind string, on_id long")
    s = spark.createDataFrame([("u", 1)], "kind string, id long")
    assert sorted(map(tuple, privacy.closure(s, e).collect())) == [("c", 1, 2), ("f", 1, 1), ("f", 2, 3), ("u", 1, 0)]
    units = spark.createDataFrame([(1, "by Ana", None, None), (2, "x", "ANA", None), (3, "x", None, "re ana"), (4, "mail A@b.org", None, None), (5, "anal", "b", "c"), (6, None, None, None)], "evidence_id long, raw_text string, speaker_sender string, thread_context string")
    edges = spark.createDataFrame([(6, 1), (5, 2)], "evidence_id long, subject_id long")
    assert sorted(r[0] for r in privacy.affected(edges, units, 1, ["ana"], ["a@B.org"]).collect()) == [1, 2, 3, 4, 6]
    v = spark.createDataFrame([(i, [float(i)]) for i in range(1, 6)], "evidence_id long, v array<double>")
    kept = privacy.stash(v, units, ["ana"], ["a@b.org"])
    assert sorted((r.evidence_id, r.v) for r in privacy.unstash(kept, units).collect()) == [(2, [2.0]), (3, [2.0]), (5, [5.0])]


def test_nested_receipts(spark):
    from quarry.operators import nested

    units = spark.createDataFrame([("a", False, "2024-03-01", "plain"), ("b", True, "2024-01-01", "please sign"), ("c", True, None, None), ("h", False, "2023-01-01", "hidden")], "evidence_id string, is_truncated boolean, event_date string, raw_text string")
    claims = [
        ("Only a [EV-1]", "DECISION", "HIGH", ["a", "a", "zz"], ["b", None], None), ("EV-9", "DECISION", "HIGH", ["a"], [], None), ("gone", "DECISION", "HIGH", ["zz"], None, None), ("open", "UNCERTAIN", "HIGH", None, None, "EV-3 maybe"),
        ("cut", "DECISION", "HIGH", ["b", "c"], [], None), ('it is "signed"', "DECISION", "HIGH", ["a", "b"], [], ""), ("unseen", "DECISION", "LOW", ["h"], [], None),
    ]
    events = [("late", "s", "HIGH", ["a"]), ("early", "s", "HIGH", ["a", "b"]), ("undated", "s", "LOW", ["c"]), ("none", "s", "LOW", ["zz"]), ("EV-1", "s", "LOW", ["a"]), ("same day", "s", "LOW", ["b"])]
    row = [("k", "SUPPORTED", "EV-1", claims, events, "by EV-2 then", ["EV-1", "left"], None), ("n", "SUPPORTED", "all", None, None, None, None, None)]
    out = spark.createDataFrame(row, f"case_id string, {nested.OUTPUT}")
    visible = spark.createDataFrame([("k", i) for i in ("a", "b", "c")], "case_id string, evidence_id string")
    got = {r.case_id: r for r in nested.validate(out, units, visible).collect()}
    k = got["k"]
    assert [(c.claim_text, c.confidence, c.support, c.conflicts) for c in k.claims] == [("Only a", "HIGH", ["a"], ["b"]), ("open", "HIGH", [], []), ("cut", "LOW", ["b", "c"], []), ('it is "signed"', "MEDIUM", ["a", "b"], [])]
    assert k.claims[1].uncertainty == "maybe" and k.claims[3].uncertainty == nested.DRAFT_NOTE
    assert [(e.event_text, e.event_date) for e in k.timeline_events] == [("early", "2024-01-01"), ("same day", "2024-01-01"), ("late", "2024-03-01"), ("undated", None)]
    assert (k.status, k.answer_summary, k.conflict_resolution, k.missing_information, k.related_questions) == ("PARTIALLY_SUPPORTED", nested.EMPTY_SUMMARY, "by then", ["left"], [])
    assert k.report.asDict() == {"dropped_claims": 3, "downgraded_claims": 2, "dropped_timeline_events": 2, "rejected_evidence_ids": ["h", "zz"], "notes": [nested.TRUNCATED_NOTE, nested.QUOTED_NOTE, nested.LOWERED_NOTE, nested.REJECTED_NOTE]}
    assert (got["n"].status, got["n"].answer_summary, got["n"].claims) == ("INSUFFICIENT_EVIDENCE", nested.NO_SUPPORT_SUMMARY, [])
    served = {r.case_id: r for r in nested.serve(nested.validate(out, units, visible), units.where("evidence_id = 'b'")).collect()}["k"]
    assert [(c.claim_text, [x.evidence_id for x in c.support]) for c in served.claims] == [("open", []), ("cut", ["b"]), ('it is "signed"', ["b"])]
    assert [(e.event_text, e.event_date) for e in served.timeline_events] == [("early", "2024-01-01"), ("same day", "2024-01-01")] and served.status == "PARTIALLY_SUPPORTED"
    reviews = spark.createDataFrame([("k", ["zz", "a", "a"], [("EV-1", "HIGH", ["a"]), ("so EV-2 it is", "LOW", ["h", "b"])])], f"case_id string, counter_evidence_ids array<string>, objections array<{nested.OBJECTION}>")
    r = nested.sanitise_reviews(reviews, units, visible).first()
    assert r.counter_evidence_ids == ["a"] and [(o.text, o.evidence_ids) for o in r.objections] == [("so it is", ["b"])]


def test_long_documents_spread_over_tasks(spark, monkeypatch):
    """Runs of a few places give what a window over the whole document gives; gaps in the numbering too."""
    import random

    from quarry.operators import identity as I

    r = random.Random(8)
    numbers = sorted(r.sample(range(400), 260))
    turns = [("d", "TRANSCRIPT", i, r.choice([None, "a", "b"]), r.choice(["Yes.", "so we went and", "this turn holds more than eight words so it stands by itself.", "and on it went"]), r.choice([None, 0, 1])) for i in numbers] + [("e", "TRANSCRIPT", 3, "a", "alone", None)]
    t = spark.createDataFrame(turns, "document_id string, document_type string, unit_index long, speaker_sender string, raw_text string, starts_group int")
    fragments = t.select("document_id", F.col("unit_index").alias("position"), F.col("speaker_sender").alias("speaker"), "starts_group", F.col("raw_text").alias("text"))

    def results():
        frames = (R.context_windows(t).select("document_id", "unit_index", "lo", "hi"), R.continuation(t), R.continuation(t, forward=False), R.continued_windows(t), I.merge_turns(fragments))
        return [sorted(map(tuple, f.collect()), key=repr) for f in frames]

    whole = results()
    monkeypatch.setattr(I, "RUN", 16)
    assert results() == whole
    runs = I.in_runs(t, "unit_index", 3)
    assert runs.select("document_id", "run").distinct().count() > 15
    assert runs.groupBy("document_id", "run").count().agg(F.max("count")).first()[0] <= 16 + 2 * 3
    assert [x.unit_index for x in runs.where("own AND document_id = 'd'").orderBy("nth").collect()] == numbers


def test_independent_names_meet_only_units_that_have_them(spark):
    texts = ["Ana Berg came", "Ana Berg and Ana", "Ana Bergen", "XAna Berg", "AnaAna Berg, Ana Berg", "Bo Bo", "Bo Bo Bo", "Bo", "xBo Bo", "", None, "Öl Öl 𝒳 Ana Berg.", "na Bo Ana Bo", "Ana_Berg", "Ana Be Ana Berg"]
    names = [("Ana", "Ana Berg"), ("Ana", "Ana Be"), ("Bo", "Bo Bo"), ("Bo", "Ana Bo"), ("Öl", "Öl Öl"), ("Ana", "None Here"), ("Zed", "Zed Zed"), ("Ana", "na Bo")]
    units = spark.createDataFrame(list(enumerate(texts)), "evidence_id long, raw_text string")
    whole = lambda w, t: re.search(rf"(?<!\w){w}(?!\w)", t)
    want = {(c, f, sum(bool(t and whole(c, t) and whole(c, t.replace(f, "\0"))) for t in texts)) for c, f in names}
    assert {tuple(r) for r in people.independent(units, spark.createDataFrame(names, "candidate string, full_name string")).collect()} == want
    # names that share a first word in long texts: all pairs of text and name take minutes
    many = spark.range(4000).select(F.lit("Ana").alias("candidate"), F.concat(F.lit("Ana Berg"), "id").alias("full_name"))
    long = spark.range(300).select(F.col("id").alias("evidence_id"), F.concat(F.repeat(F.lit("of the and "), 2000), F.lit("Ana Berg"), "id").alias("raw_text"))
    began = time.perf_counter()
    got = {r.full_name: r.n_units for r in people.independent(long, many).collect()}
    assert got == {f"Ana Berg{i}": 300 - sum(str(u).startswith(str(i)) for u in range(300)) for i in range(4000)}
    assert time.perf_counter() - began < 60


def test_a_piece_costs_one_look_up_whatever_the_hits(spark):
    names = [f"Ana{i} Berg{i}" for i in range(300)]
    units = spark.createDataFrame([(u, " ".join(names[u:] + ["Ana0"])) for u in range(4)], "evidence_id long, raw_text string")
    d = spark.createDataFrame([(x, x) for x in names], "subject_id string, alias string")
    found = people.link_mentions(units, d, spark.createDataFrame([], "evidence_id long, subject_id string"))
    assert {tuple(r) for r in found.collect()} == {(u, x) for u in range(4) for x in names[u:]}
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_answer_has_the_windows_of_whole_documents(spark, monkeypatch):
    """It looks at neighbourhoods of hits only: places, ends of documents and sentences that go on are those of the whole document."""
    said = ["and so", "It ends.", "but then we", "yes", "a longer turn that says what it wants to say and goes on", "so on, and", "Fine by me, let us go there at once with all the others."]
    rows = [(1000 * d + i, f"d{d}", "EMAIL" if d == 2 else "TRANSCRIPT", 3 * i, [None, "a", "b"][(i * 5 + d) % 3], said[(i * i + d * i) % 7]) for d in range(3) for i in range([1, 90, 200][d])]
    units = spark.createDataFrame(rows, "id long, document_id string, document_type string, unit_index long, speaker_sender string, raw_text string").repartition(3).cache()
    hits = [(q, 1000 * d + i, r, 1.0 / r) for q in range(4) for r, (d, i) in enumerate([(0, 0), (1, q), (1, 89 - q), (1, 40 + 3 * q), (2, 0), (2, 199 - q), (2, 100 + q), (1, 20 + q), (1, 60), (1, 70)], 1)]
    fused = spark.createDataFrame(hits, "query_id long, id long, rank int, score double")
    questions = spark.createDataFrame([(q, q % 2 == 0) for q in range(4)], "query_id long, wide boolean")
    looked_at, windows = [], R.continued_windows
    monkeypatch.setattr(R, "continued_windows", lambda u: looked_at.append(u.groupBy("document_id").count().agg(F.max("count")).first()[0]) or windows(u))
    got = R.answer(fused, fused.where("rank < 3"), units, questions)
    assert looked_at == [2 * R.REACH + 1]
    places = {r.id: (r.document_id, n) for d in ("d0", "d1", "d2") for n, r in enumerate(sorted((x for x in units.collect() if x.document_id == d), key=lambda x: x.unit_index), 1)}
    whole = {(r.document_id, r.unit_index): (r.lo, r.hi) for r in windows(units).collect()}
    by_place, index = {p: i for i, p in places.items()}, {r[0]: r[3] for r in rows}
    want = {}
    for q, i, r, _ in hits:
        if r <= (12 if q % 2 == 0 else 8):
            d, _ = places[i]
            lo, hi = whole[d, index[i]]
            for n in range(lo, hi + 1):
                want[q, by_place[d, n]] = want.get((q, by_place[d, n]), 0) + 1
    found = got.collect()
    assert {(r.query_id, r.id): r.n_windows for r in found if r.n_windows} == want
    assert max(want.values()) > 1 and all(sorted(r.place for r in found if r.query_id == q) == list(range(1, 1 + sum(r.query_id == q for r in found))) for q in range(4))


def test_texts_with_mentions_are_not_shuffled(spark, monkeypatch):
    """Rounds of few words of the dictionary find the same; what is shuffled are runs, not texts or their pieces."""
    names = [f"Ana{i} of the Berg{i}" for i in range(40)]
    units = spark.createDataFrame([(u, ", ".join(names[u:]) + " (Ö- " + "𝒳 " * u + "Ana0)") for u in range(6)], "evidence_id long, raw_text string").repartition(2).cache()
    d = spark.createDataFrame([(x, x) for x in [*names, "(Ö-", "of the"]], "subject_id string, alias string")
    none = spark.createDataFrame([], "evidence_id long, subject_id string")
    want = {(u, x) for u in range(6) for x in [*names[u:], "(Ö-", "of the"]}
    for words in (1 << 18, 7):
        monkeypatch.setattr(people, "WORDS", words, raising=False)
        found = people.link_mentions(units, d, none)
        assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") > 1 and "Join Inner, ((evidence_id" not in plan and "pieces" not in plan.split("MapInArrow")[-1].split("Relation")[0]
