"""Reversible pseudonymisation: rewriting, affected rows, leak verification, sealed identities."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import stored


def whole(name: str) -> str:
    """A pattern for a name as whole words in any case, whatever white space stands between them."""
    return r"(?iU)(?<!\w)" + r"\s+".join(map(re.escape, name.split())) + r"(?!\w)"


def alias_address(alias: str) -> str:
    """An address that can't be anyone's."""
    return re.sub("[^a-z0-9]+", "-", alias.lower()).strip("-") + "@pseudonymised.invalid"


def literal(text: str) -> str:
    """A replacement that stands for itself."""
    return re.sub(r"([\\$])", r"\\\1", text)


def pseudonymise(text, names: list[str], emails: list[str], alias: str) -> Column:
    """E-mail addresses first, then names, the longest first, give way to the alias."""
    for address in emails:
        text = F.regexp_replace(text, "(?iu)" + re.escape(address), literal(alias_address(alias)))
    for name in sorted(names, key=len, reverse=True):
        text = F.regexp_replace(text, whole(name), literal(alias))
    return text


#: Lines below a line with a name alone that belong to its signature.
SIGNATURE_LINES = 6


def rewrite(text, kind: str, names: list[str], emails: list[str], alias: str, initials: str = "") -> Column:
    """A unit's source text with a person under an alias; kind is TRANSCRIPT, EMAIL or REPORT.

    Transcripts lose lines that hold the initials alone. In mail and reports a line with a name alone becomes the alias,
    and the signature below it goes, to the next blank line. Then addresses and names give way, over line ends too.
    """
    if kind == "TRANSCRIPT":
        if len(initials) > 1:
            text = F.array_join(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != initials), "\n")
    else:
        any_name = "|".join(r"[ \t]+".join(map(re.escape, n.split())) for n in sorted(names, key=len, reverse=True))
        text = F.regexp_replace(text, rf"(?imdU)^[ \t]*(?:{any_name})[ \t]*$(?:\n(?=[^\n]*\S)[^\n]*){{0,{SIGNATURE_LINES}}}", literal(alias))
    return pseudonymise(text, names, emails, alias)


def restore(text, alias: str, name: str, email: str | None = None) -> Column:
    """The alias gives way to the one name that is known, its address to the one address, where there is one."""
    if email:
        text = F.regexp_replace(text, "(?iu)" + re.escape(alias_address(alias)), literal(email))
    return F.regexp_replace(text, whole(alias), literal(name))


def targets(people: DataFrame, aliases: DataFrame, index: DataFrame) -> DataFrame:
    """(subject_id, names, emails) of people(subject_id, display_name): the display name, aliases and the first and last names that the strict index allows, the longest first; and the addresses."""
    own = people.select("subject_id", F.col("display_name").alias("form"))
    more = aliases.where("alias_type <> 'EMAIL'").select("subject_id", F.col("alias").alias("form"))
    short = index.where("reason IS NULL AND kind IN ('FIRST', 'LAST')").select("subject_id", F.col("token").alias("form"))
    forms = own.union(more).union(short).where("form IS NOT NULL").groupBy("subject_id", F.lower("form").alias("key")).agg(F.min("form").alias("form"))
    names = forms.groupBy("subject_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.length("form")).alias("n"), "form"))), lambda x: x["form"]).alias("names"))
    emails = aliases.where("alias_type = 'EMAIL'").groupBy("subject_id").agg(F.sort_array(F.collect_set("alias")).alias("emails"))
    return people.select("subject_id").join(names, "subject_id").join(emails, "subject_id", "left").withColumn("emails", F.coalesce("emails", F.array().cast("array<string>")))


def without_entries(manifest: DataFrame, names: list[str]) -> DataFrame:
    """manifest(canonical_name, alias, ...) without the entries of a person, whichever form of their name an entry has."""
    mine = [n.lower() for n in names]
    hit = F.lower("canonical_name").isin(mine) | F.coalesce(F.lower("alias").isin(mine), F.lit(False))
    gone = manifest.where(hit).select("canonical_name").distinct()
    return manifest.join(gone, "canonical_name", "left_anti")


#: A name of one word: it counts as a whole word only; all else counts inside longer words too.
BARE = re.compile(r"[^\W\d_]+(?:['\u2019-][^\W\d_]+)*")


def needle(text: str) -> str:
    """The pattern by which a needle counts, in any case."""
    return r"(?iU)(?<!\w)" + re.escape(text) + r"(?!\w)" if BARE.fullmatch(text) else "(?iu)" + re.escape(text)


class _Folded(dict):
    """Code points in lower case, one for one: each stays in its place."""

    def __missing__(self, point: int) -> int:
        upper = chr(point).upper()
        lower = (upper if len(upper) == 1 else chr(point)).lower()
        self[point] = ord(lower) if len(lower) == 1 else point
        return self[point]


_FOLDED = _Folded()


def _fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDED)


def _is_word(c: str) -> bool:
    return c == "_" or c.isalpha() or c.isdecimal() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Nl", "Pc")


class Needles:
    """One automaton of all needles: a text is read once, whatever their number."""

    def __init__(self, needles: list[str]) -> None:
        import ahocorasick

        self.automaton, same = ahocorasick.Automaton(), {}
        for i, n in enumerate(needles):
            if n:
                same.setdefault(_fold(n), []).append((i, BARE.fullmatch(n) is not None))
        for key, which in same.items():
            self.automaton.add_word(key, (len(key), which))
        if same:
            self.automaton.make_automaton()
        self.some = bool(same)

    def counts(self, text: str) -> dict[int, int]:
        """By the number of a needle, how often it comes, without overlaps with itself."""
        found, until = {}, {}
        if not self.some:
            return found
        text = _fold(text)
        for end, (size, which) in self.automaton.iter(text):
            start = end - size + 1
            for i, bare in which:
                if start < until.get(i, 0) or bare and (start and _is_word(text[start - 1]) or end + 1 < len(text) and _is_word(text[end + 1])):
                    continue
                found[i], until[i] = found.get(i, 0) + 1, end + 1
        return found


#: Needles up to which a pattern each, and beyond which one automaton, searches a text; needles of an automaton, which is sent to all tasks.
FEW, MOST = 8, 100_000


def _walked(surface: DataFrame, columns: list[str], needles: list[str]) -> DataFrame:
    """(i, hits, n_rows) of the needles with hits in some columns of a table: partial sums of each batch, added up."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Needles(needles)
        for batch in batches:
            hits, rows = {}, {}
            for column in batch.columns:
                for text in column.to_pylist():
                    for i, k in search.counts(text).items() if text else ():
                        hits[i], rows[i] = hits.get(i, 0) + k, rows.get(i, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.int32()), pa.array(list(hits.values()), pa.int64()), pa.array(list(rows.values()), pa.int64())], ["i", "hits", "n_rows"])

    texts = surface.select(*[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(columns)])
    return texts.mapInArrow(walk, "i int, hits long, n_rows long").groupBy("i").agg(F.sum("hits").alias("hits"), F.sum("n_rows").alias("n_rows"))


def needle_counts(surface: DataFrame, column: str, needles: list[str], label: str) -> DataFrame:
    """(surface, needle, hits, n_rows): occurrences of each needle, in any case; names of one word as whole words only. Many needles are searched at once, in parts of MOST."""
    if len(needles) > FEW:
        out = None
        for at in range(0, len(needles), MOST):
            some = needles[at : at + MOST]
            names = surface.sparkSession.createDataFrame(list(enumerate(some)), "i int, needle string")
            found = names.join(_walked(surface, [column], some), "i", "left").select(F.lit(label).alias("surface"), "needle", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "n_rows")])
            out = found if out is None else out.union(found)
        return out
    counts = F.array(*[F.struct(F.lit(n).alias("needle"), F.regexp_count(F.coalesce(column, F.lit("")), F.lit(needle(n))).alias("k")) for n in needles])
    rows = surface.select(F.explode(counts).alias("c")).groupBy(F.col("c.needle").alias("needle")).agg(F.sum("c.k").alias("hits"), F.count_if(F.col("c.k") > 0).alias("n_rows"))
    return rows.select(F.lit(label).alias("surface"), "needle", "hits", "n_rows")


def content_hits(table: DataFrame, needles: list[str], label: str, bookkeeping: tuple[str, ...] = ()) -> DataFrame:
    """(surface, hits) over all text columns of a table but those that keep aliases."""
    columns = [c for c, t in table.dtypes if t == "string" and c not in bookkeeping]
    if len(needles) > FEW:
        parts = [_walked(table, columns, needles[at : at + MOST]).select("hits") for at in range(0, len(needles), MOST)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.union(part)
        return rows.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")).select(F.lit(label).alias("surface"), "hits")
    found = [F.regexp_count(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(needle(n))) for c in columns for n in needles]
    return table.select(sum(found, F.lit(0)).cast("long").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("hits")).select(F.lit(label).alias("surface"), "hits")


def file_names(table: DataFrame) -> DataFrame:
    """(file_name) of the files that a table is read from: a surface too."""
    return table.select("_metadata.file_name").distinct()


def verification(surfaces: DataFrame, person: DataFrame, aliases: DataFrame, before: DataFrame, after: DataFrame, alias: str) -> DataFrame:
    """(item, ok): that no surface(surface, hits) shows a needle, and the five checks of person(subject_id, privacy_state, display_alias, display_name), of its aliases(subject_id) and of its relations before and after."""
    counts = surfaces.select(F.concat(F.lit("surface: "), "surface").alias("item"), (F.col("hits") == 0).alias("ok"))
    state = person.agg(
        F.coalesce(F.max(F.col("privacy_state") == "PSEUDONYMISED"), F.lit(False)).alias("subject_is_pseudonymised"), F.coalesce(F.max(F.col("display_alias") == alias), F.lit(False)).alias("display_alias_matches"),
        F.coalesce(F.max(F.col("display_name").isNull()), F.lit(False)).alias("display_name_cleared"),
    )
    left = aliases.join(person.select("subject_id"), "subject_id", "left_semi").agg((F.count("*") == 0).alias("no_original_aliases_remain"))
    kept = lost_relations(before, after).agg((F.count("*") == 0).alias("evidence_people_relationships_preserved"))
    checks = [t.select(F.lit(f"check: {c}").alias("item"), F.col(c).alias("ok")) for t in (state, left, kept) for c in t.columns]
    for c in checks:
        counts = counts.union(c)
    return counts


def bears(names: list[str], emails: list[str], *columns: str) -> Column:
    """Whether a name or an address stands in one of some columns."""
    blob = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
    hits = [blob.rlike(whole(n)) for n in names] + [F.lower(blob).contains(e.lower()) for e in emails]
    return F.greatest(*hits, F.lit(False), F.lit(False))


def affected(edges: DataFrame, units: DataFrame, subject, names: list[str], emails: list[str] = ()) -> DataFrame:
    """Distinct evidence_id linked to a subject in edges(evidence_id, subject_id), or of units(evidence_id, raw_text, speaker_sender, thread_context) that bear a name or an address in their text, speaker or title."""
    named = units.where(bears(list(names), list(emails), "raw_text", "speaker_sender", "thread_context"))
    return edges.where(F.col("subject_id") == subject).select("evidence_id").union(named.select("evidence_id")).distinct()


def closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, step): what depends on start(kind, id), over any number of edges(kind, id, on_kind, on_id), with the number of edges of the shortest way; what it starts from has 0.

    Each round joins the edges with what the last one added, and stores what is new; the driver sees whether anything is.
    """
    reached = new = stored(start.select("kind", "id").distinct().withColumn("step", F.lit(0)))
    step = 0
    while True:
        step += 1
        last = new.select(F.col("kind").alias("on_kind"), F.col("id").alias("on_id"))
        new = stored(edges.join(last, ["on_kind", "on_id"], "left_semi").select("kind", "id").distinct().join(reached.select("kind", "id"), ["kind", "id"], "left_anti").withColumn("step", F.lit(step)))
        if new.isEmpty():
            return reached
        reached = reached.union(new)


def reversed_away(findings: DataFrame, cases: DataFrame, edges: DataFrame, gone: DataFrame, alias: str) -> DataFrame:
    """(kind, id, step): findings and cases that a reversal makes stale. They depend, over any number of edges, on a unit of gone(evidence_id), whose text changes, or on a row that bears the alias in findings(finding_id, title, summary, body) or cases(case_id, query, receipt)."""
    holds = lambda *columns: F.concat_ws(" ", *columns).contains(alias)
    start = gone.select(F.lit("unit").alias("kind"), F.col("evidence_id").alias("id"))
    start = start.union(findings.where(holds("title", "summary", "body")).select(F.lit("finding"), "finding_id")).union(cases.where(holds("query", "receipt")).select(F.lit("case"), "case_id"))
    return closure(start, edges).where("kind <> 'unit'")


def stash(vectors: DataFrame, units: DataFrame, names: list[str], emails: list[str] = ()) -> DataFrame:
    """(text_hash, v): a vector for each text of units(evidence_id, raw_text) that has one in vectors(evidence_id, v) and bears no name and no address: what a rebuild may use again."""
    kept = units.where(~bears(list(names), list(emails), "raw_text")).select("evidence_id", T.text_hash(F.col("raw_text")).alias("text_hash"))
    return vectors.join(kept, "evidence_id").groupBy("text_hash").agg(F.min_by("v", "evidence_id").alias("v"))


def unstash(stashed: DataFrame, units: DataFrame) -> DataFrame:
    """(evidence_id, v) of the units(evidence_id, raw_text) after a rebuild whose text has a vector in the stash."""
    return units.select("evidence_id", T.text_hash(F.col("raw_text")).alias("text_hash")).join(stashed, "text_hash").select("evidence_id", "v")


def invalidated(findings: DataFrame, cases: DataFrame, cited: DataFrame, gone: DataFrame, pattern: str) -> DataFrame:
    """(kind, id, reason): what an operation on gone(evidence_id) makes stale, findings first.

    findings(finding_id, case_id, prose), cases(case_id, prose), cited(kind, id, evidence_id) with kind `finding` or `case`. A row goes if it cites
    what is gone, or if its prose matches the pattern; the case that a stale finding is linked with goes with it.
    """
    hit = cited.join(gone.select("evidence_id"), "evidence_id", "left_semi").select("kind", "id", F.lit("cited").alias("reason")).distinct()
    named = lambda table, kind, key: table.where(F.col("prose").rlike(pattern)).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.lit("prose").alias("reason"))
    stale = hit.where("kind = 'finding'").union(named(findings, "finding", "finding_id"))
    linked = findings.join(stale.select(F.col("id").alias("finding_id")).distinct(), "finding_id", "left_semi").where("case_id IS NOT NULL").select(F.lit("case"), "case_id", F.lit("linked")).distinct()
    return stale.union(hit.where("kind = 'case'")).union(named(cases, "case", "case_id")).union(linked)


def lost_relations(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("evidence_id", "subject_id", "relation").exceptAll(after.select("evidence_id", "subject_id", "relation"))


def seal(identities: DataFrame, key: str) -> DataFrame:
    """identities(subject_id, bundle) encrypted (AES-GCM); kept in a path of its own and never joined with other tables."""
    return identities.select("subject_id", F.base64(F.aes_encrypt(F.col("bundle"), F.lit(key), F.lit("GCM"))).alias("ciphertext"))


def unseal(sealed: DataFrame, key: str) -> DataFrame:
    return sealed.select("subject_id", F.try_aes_decrypt(F.unbase64("ciphertext"), F.lit(key), F.lit("GCM")).cast("string").alias("bundle"))
