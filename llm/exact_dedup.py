"""Exact dedup by distributed MSD radix partitioning.

Texts are normalised (white space `[\\x20\\x09-\\x0D]` deleted) and split into groups by
successive runs of their UTF-8 bytes, most significant first. A group with one document is
settled; so is a group whose texts have all ended; only the others go on to the next, longer
run. Two documents stay together exactly as long as their bytes agree, so equality never
rests on a digest, and a level moves only the documents that are still tied.

A group is named by its smallest doc_id and the path of runs that led to it; sizes are aggregated with map-side combining,
and the few groups that hold a large share of the rows are broadcast, so a group may be of any size. Nulls count as empty;
empty texts are all equal. Only texts are compared: a doc_id that several rows have, or a null one, joins no groups. Of a group
the longest text stays, then the smallest doc_id, nulls last; if rows repeat that doc_id, the one with this text (equal rows are
all kept). An empty table has an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import HOT, join_groups, materialise, read

#: Bytes that the first level compares; each later level compares GROWTH times as many.
FIRST_BYTES, GROWTH = 48, 16
#: Bytes of the runs that are broadcast at once, at most: where runs are long, fewer groups count as large.
BROADCAST_BYTES = 8 << 20


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def identity() -> list:
    """id: doc_id for comparisons, nulls last; text_hash tells rows of one doc_id apart."""
    return [F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("text_hash")]


def radix_groups(docs: DataFrame, first: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """(id, text_hash, group_id, path) for docs(doc_id, text): rows with equal normalised texts share group_id, the smallest doc_id, and path. Rows that are alone have none."""
    state = docs.select(*identity(), F.lit(0).cast("long").alias("group_id"), F.lit(0).cast("long").alias("path"), F.encode(normalised(F.col("text")), "utf-8").alias("rest"))
    settled, width, rows = None, first, docs.count()
    while True:
        # An ended text is padded by nothing: its run is shorter than any run that goes on, so it never meets one.
        run = state.select("id", "text_hash", "group_id", "path", F.substring("rest", 1, width).alias("run"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        tied = run.groupBy("group_id", "path", "run").agg(F.min("id").alias("next_id"), F.count("*").alias("n")).where("n > 1")
        run = join_groups(run, tied, ["group_id", "path", "run"], "n", rows, ["id", "text_hash"], max(HOT, width / BROADCAST_BYTES)).where("n IS NOT NULL")
        run = materialise(run.select("id", "text_hash", F.col("next_id").alias("group_id"), F.xxhash64("path", "run").alias("path"), (F.length("run") < width).alias("ended"), "rest"))
        done = run.where("ended").select("id", "text_hash", "group_id", "path")
        settled = done if settled is None else settled.union(done)
        state = run.where("NOT ended").drop("ended")
        if not (rows := state.count()):
            return settled
        width *= growth


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256. The longest original text stays, then the smallest doc_id."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    groups = radix_groups(docs).distinct()
    rows = docs.select("doc_id", *identity(), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    rows = materialise(rows.join(groups, ["id", "text_hash"], "left"))
    best = rows.where("path IS NOT NULL").groupBy("group_id", "path").agg(F.min(F.struct((-F.col("chars")).alias("short"), "id", "text_hash")).alias("keep"), F.count("*").alias("group_size"))
    out = join_groups(rows, best, ["group_id", "path"], "group_size", rows.count(), ["id", "text_hash"])
    alone = F.col("path").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.nullif(F.col("keep.id"), F.lit((1 << 63) - 1)))
    kept = alone | (F.col("keep.id") == F.col("id")) & (F.col("keep.text_hash") == F.col("text_hash"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""
