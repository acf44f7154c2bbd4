"""Scalar text functions as Column -> Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lists and patterns that results depend on.
STOPWORDS = """
a an and are as at be been being but by did do does done for from had has have how i if in
into is it its me my no not of on or our so than that the their them then there these they
this those to us was we were what when where which who whom whose why will with would you
your about after again all also any because before between both can could each few more most
other over own same should some such too very just out came come
""".split()
TEMPORAL_CUES = """
current currently latest now still final finally ultimately eventually later
changed change changes supersede superseded superseding superseded evolution evolve
evolved history historically over time today anymore longer
""".split()
TEMPORAL_PHRASES = [
    "over time", "is it still", "no longer", "what is it now", "as of now", "where does it stand", "what happened next",
    "what happened afterwards", "what happened after", "was it done", "was it ever", "never done", "did it happen",
]
QUANTITY_CUES = "figure figures proportion proportions percentage percentages share rate rates ratio".split()
ENUMERATIVE_PHRASES = [
    "how did", "how has", "how have", "changed over time", "show how", "the trail", "trail from",
    "timeline", "history of", "evolution", "evolved", "list all", "list every",
]
ENUMERATIVE_QUANTIFIED = (
    r"\b(?:every|each|all)\s+(?:the\s+|of\s+the\s+)?(?:\w+\s+)?(?:figures?|numbers?|values?|percent(?:age)?s?|proportions?|mentions?|"
    r"instances?|versions?|meetings?|times?|decisions?|proposals?|changes?|updates?|reports?|statements?|occurrences?|dates?)\b"
)
MONTHS = "january february march april may june july august september october november december".split()
SUFFIXES = ["ations", "ation", "ings", "ing", "edly", "ed", "es", "s", "ly"]
MIN_STEM = 4
IRREGULAR = {"decid": "decis", "sign": "signat"}
#: Letters and digits of any script make a word, so that "Noé" is no "no".
DEPENDENT_OPENERS = r"(?iu)^[^\p{L}\p{N}_]*(yes|yeah|yep|no|nope|ok|okay|sure|right|exactly|correct|agreed|fine|sounds good|that works|let'?s do that|mm-?hm|good)(?![\p{L}\p{N}_])"
SHORT_WORDS = 8
ANONYMOUS_LABELS = ["Me", "Them", "Unknown Speaker", "[REDACTED PERSON]", "[REDACTED SPEAKER]", "[REDACTED SENDER]"]
PLACEHOLDERS = [r"(?i)\[Image removed by sender\]", r"(?i)\[cid:[^\]]*\]", r"(?i)Bild borttagen av avs[äa]ndaren", r"(?<![A-Za-z])Image(?![A-Za-z])"]
PROSE_ID = r"\s*\[?\bEV-[^\s\]\[,;)]+\]?"
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")

#: Latin letters with marks, and the plain letters that they decompose into (ø too, which has no decomposition).
LETTERS = {c: unicodedata.normalize("NFKD", c)[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.normalize("NFKD", c)[0].isascii() and unicodedata.normalize("NFKD", c)[0].isalpha() and len([x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]) == 1} | {"ø": "o", "Ø": "O"}

WORD = r"([\p{L}\p{N}]+)"
#: Listed, as engines' \s differ.
SPACE = r"[\t-\r\x1C-\x1F\x85\p{Z}]"


def any_of(phrases: list[str]) -> str:
    return "|".join(re.escape(p).replace(r"\ ", " ") for p in phrases)


def tokenize(text) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def fold_accents(text) -> Column:
    """Lower-cased; letters with a decomposition lose their marks (ø and ß, which have none, stay)."""
    return F.translate(F.lower(text), *ACCENTS)


def without_marks(text) -> Column:
    return F.translate(text, "".join(LETTERS), "".join(LETTERS.values()))


def index_tokens(text) -> Column:
    return F.regexp_extract_all(fold_accents(text), F.lit(WORD), F.lit(1))


def topic_terms(text) -> Column:
    """Distinctive tokens in order, each once; a quantity cue adds `percent`."""
    tokens = tokenize(text)
    kept = F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS + TEMPORAL_CUES)))
    cue = F.arrays_overlap(tokens, F.array(*map(F.lit, QUANTITY_CUES)))
    return F.when(cue, F.array_union(kept, F.array(F.lit("percent")))).otherwise(kept)


def is_temporal(text) -> Column:
    return F.lower(text).rlike(any_of(TEMPORAL_PHRASES)) | F.arrays_overlap(tokenize(text), F.array(*map(F.lit, TEMPORAL_CUES)))


def is_enumerative(text) -> Column:
    return F.lower(text).rlike(any_of(ENUMERATIVE_PHRASES)) | F.lower(text).rlike(ENUMERATIVE_QUANTIFIED)


def light_stem(term) -> Column:
    """The first suffix that leaves MIN_STEM characters goes; then a doubled last consonant is halved."""
    stem, cut = None, F.lit(None).cast("string")
    for suffix in reversed(SUFFIXES):
        fits = term.endswith(suffix) & (F.length(term) - len(suffix) >= MIN_STEM)
        cut = F.when(fits, F.substring(term, F.lit(1), F.length(term) - len(suffix))).otherwise(cut)
    stem = F.when(cut.rlike(r"^.{3,}([^aeiou])\1$"), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)
    return F.coalesce(stem, term)


def phrases(terms) -> Column:
    """array<struct<phrase, prefix>>: what to match for an array of terms; stems of MIN_STEM letters match as prefixes, shorter ones stand for the term itself."""
    stems = F.flatten(F.transform(terms, lambda t: F.array_compact(F.array(F.struct(t.alias("t"), light_stem(t).alias("v")), *[F.when(light_stem(t) == a, F.struct(t.alias("t"), F.lit(b).alias("v"))) for a, b in IRREGULAR.items()]))))
    return F.array_distinct(F.transform(stems, lambda s: F.struct(F.when(F.length(s["v"]) >= MIN_STEM, s["v"]).otherwise(s["t"]).alias("phrase"), (F.length(s["v"]) >= MIN_STEM).alias("prefix"))))


def date_range(text) -> Column:
    """struct<from, to>: the half-open window of all months with a year, else of all years, that a text names; null without any."""
    lower = F.lower(text)
    named = F.regexp_extract_all(lower, F.lit(rf"\b(?:{'|'.join(MONTHS)})\s+(?:of\s+)?20\d{{2}}\b"), F.lit(0))
    month = lambda x: F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(x, r"^(\w+)", 1)).cast("int")
    first = F.transform(named, lambda x: F.make_date(F.right(x, F.lit(4)).cast("int"), month(x), F.lit(1)))
    years = F.transform(F.regexp_extract_all(lower, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(1)))
    by_month = F.struct(F.array_min(first).cast("string").alias("from"), F.add_months(F.array_max(first), 1).cast("string").alias("to"))
    by_year = F.struct(F.array_min(years).cast("string").alias("from"), F.add_months(F.array_max(years), 12).cast("string").alias("to"))
    return F.when(F.size(first) > 0, by_month).when(F.size(years) > 0, by_year)


def date_tokens(text) -> Column:
    """The words of a text that `date_range` reads: months and their years, else years."""
    lower = F.lower(text)
    named = F.regexp_extract_all(lower, F.lit(rf"\b(?:{'|'.join(MONTHS)})\s+(?:of\s+)?20\d{{2}}\b"), F.lit(0))
    months = F.flatten(F.transform(named, lambda x: F.array(F.regexp_extract(x, r"^(\w+)", 1), F.right(x, F.lit(4)))))
    return F.when(F.size(named) > 0, months).otherwise(F.regexp_extract_all(lower, F.lit(r"\b(20\d{2})\b"), F.lit(1)))


def words(text) -> Column:
    """Number of words that white space of any script separates."""
    return F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""))


def is_context_dependent(text) -> Column:
    """Short, or opening with an answer; no text is a short one."""
    text = F.coalesce(text, F.lit(""))
    return (words(text) <= SHORT_WORDS) | text.rlike(DEPENDENT_OPENERS)


def unfinished(text) -> Column:
    return ~F.rtrim(text).rlike(r"[.?!][\"')\]]*$")


def starts_mid_sentence(text) -> Column:
    return F.ltrim(text).rlike(r"^\p{Ll}")


def is_non_person(label) -> Column:
    return F.coalesce(F.trim(label).isin(ANONYMOUS_LABELS) | F.trim(label).rlike(r"^Guest [0-9]+$"), F.lit(False))


def strip_placeholders(text) -> Column:
    for pattern in PLACEHOLDERS:
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "))


def index_text(text) -> Column:
    """The text as an index cuts it: as `search_text`, but that white space stays; patterns with a bracket are looked for only in texts that have one."""
    for pattern in PLACEHOLDERS:
        cut = F.regexp_replace(text, pattern, " ")
        text = F.when(F.contains(text, F.lit("[")), cut).otherwise(text) if r"\[" in pattern[:6] else cut
    return text


def search_text(text, banner: str | None = None) -> Column:
    """What the index reads: without the mail gateway's banner (a pattern of the archive) and without placeholders."""
    return strip_placeholders(F.regexp_replace(text, "(?is)" + banner, " ") if banner else text)


def is_truncated(text) -> Column:
    return F.rtrim(strip_placeholders(text)).rlike("[—–]$")


def clean_prose(text) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, PROSE_ID, ""), r"\s{2,}", " "))


def text_hash(text) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def name_key(text) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
