"""Line dedup by distinct-site spread.

A line that many sites show is boilerplate. For each line (two independent 64-bit hashes) a
HyperLogLog sketch of its sites is aggregated; sketches merge map-side, so a line may occur in
any share of the documents. Lines whose estimate is near the threshold get an exact count of
distinct sites; the others are decided by the sketch, whose error is far smaller than the band.
Boilerplate lines are then removed from every document.

`without_boilerplate`, for pipelines, leaves copies of whole documents to the duplicate operators,
as they would lose their content on all sites: a document keeps its lines if no other would remain, or if COPY_LINES lines or more,
and more than COPY_SHARE of its characters, are boilerplate.
Lines are cut at \\n and compared as they are; lines of white space only are no lines and stay.
The site is `source`; null is a site of its own. Null texts stay null. doc_id identifies a row; rows that repeat it lose the
lines at the same places only where these are boilerplate in their own text (rows are matched by doc_id and a hash of the text; a null
doc_id matches too). An empty table has an empty result. Columns of the caller may have any names.
Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise, read, unused

#: Sites from which on a line is boilerplate; the band around it, as a share, within which sites are counted exactly.
MIN_SITES, BAND = 10, 0.25
#: What a copy of a whole document is known by: boilerplate lines, and their share of its characters.
COPY_LINES, COPY_SHARE = 4, 0.5
#: log2 of the sketches' registers: a standard error of 1.6 %.
LG_K = 12


def _blank(line) -> Column:
    return F.translate(line, " \t\n\x0b\f\r", "") == ""


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, text_hash, site, at, a, b): the lines of docs, by hash."""
    cut = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n"))
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), F.coalesce("source", F.lit("")).alias("site"), cut.alias("at", "line")).where(~_blank(F.col("line")))
    return lines.select("id", "text_hash", "site", "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), "line").alias("b"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b) of the lines that at least min_sites sites show."""
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    spread = materialise(spread.where(F.col("sites") >= min_sites * (1 - BAND)))
    sure = spread.where(F.col("sites") > min_sites * (1 + BAND)).select("a", "b")
    near = spread.where(F.col("sites") <= min_sites * (1 + BAND)).select("a", "b")
    exact = lines.join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return sure.union(exact.select("a", "b"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, spare_copies: bool = False) -> DataFrame:
    """docs with `text` (and `n_chars`, where there is one) after removal, and the further columns line_count and lines_removed."""
    at_, id_, text_ = unused(docs, "line_at", "line_id", "line_text")
    lines = lines_of(docs)
    hits = lines.join(boilerplate(lines, min_sites), ["a", "b"]).groupBy(F.col("id").alias(id_), F.col("text_hash").alias(text_))
    hits = hits.agg(F.sort_array(F.collect_set("at")).alias(at_))
    cut = F.split(F.coalesce("text", F.lit("")), "\n")
    full = F.filter(cut, lambda x: ~_blank(x))
    both = docs.join(hits, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(text_)), "left").drop(id_, text_)
    if spare_copies:
        lost = F.aggregate(F.filter(cut, lambda x, i: F.array_contains(at_, i)), F.lit(0), lambda s, x: s + F.length(x))
        total = F.aggregate(full, F.lit(0), lambda s, x: s + F.length(x))
        copy = (F.size(at_) == F.size(full)) | (F.size(at_) >= COPY_LINES) & (lost > COPY_SHARE * total)
        both = both.withColumn(at_, F.when(~copy, F.col(at_)))
    # the lines between those that go, by slices: their number is that of removed lines, not its product with all lines
    ends = F.concat(F.col(at_), F.array(F.size(cut)))
    starts = F.concat(F.array(F.lit(0)), F.transform(at_, lambda x: x + 1))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("x"), ends.alias("y")), lambda z: F.slice(cut, z["x"] + 1, z["y"] - z["x"])))
    text = F.when(F.col(at_).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(F.col(at_).isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return both.select(
        *[new[c].alias(c) if new.get(c) is not None else F.col(f"`{c}`") for c in docs.columns],
        F.size(full).cast("long").alias("line_count"),
        F.coalesce(F.size(at_), F.lit(0)).cast("long").alias("lines_removed"),
    )


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """docs, cut, with its own columns only; copies of whole documents are left to the duplicate operators."""
    further = unused(docs, "line_count", "lines_removed")
    return line_dedup(docs, spare_copies=True).toDF(*docs.columns, *further).drop(*further)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup(docs).select("doc_id", F.col("line_count").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
f AS (SELECT *, regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') <> '' AS full_line FROM l),
s AS (SELECT line FROM f WHERE full_line GROUP BY line HAVING count(DISTINCT site) >= 10),
m AS (SELECT f.*, full_line AND s.line IS NOT NULL AS hit FROM f LEFT JOIN s ON f.line = s.line)
SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (hit) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT hit), '')) AS text_sha256
FROM m GROUP BY doc_id
"""
