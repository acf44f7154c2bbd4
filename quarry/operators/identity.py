"""Stable identity of rows: turn merging, locators of duplicates, reuse of derived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Positions that one window task looks at.
RUN = 4096


def in_runs(rows: DataFrame, by: str, reach: int) -> DataFrame:
    """rows(document_id, ...) with nth, their place in the document in order of the column `by`, last, the number of its rows, run, and own.

    Places are counted in runs of RUN values of `by` and added up over the runs. A run of RUN places also has the `reach` rows before and
    after it, with own false: windows over (document_id, run) that look no farther see what they would in the whole document, and a document of any length spreads over tasks.
    """
    part = rows.withColumn("_part", F.floor(F.col(by) / RUN))
    sizes = part.groupBy("document_id", "_part").agg(F.count("*").alias("_n"))
    whole = W.partitionBy("document_id")
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "last": F.sum("_n").over(whole)}).drop("_n")
    placed = part.join(sizes, ["document_id", "_part"]).withColumn("nth", F.col("_before") + F.row_number().over(W.partitionBy("document_id", "_part").orderBy(by))).drop("_part", "_before")
    run = lambda place: F.floor((place - 1) / RUN)
    runs = placed.withColumn("_home", run(F.col("nth"))).withColumn("run", F.explode(F.sequence(run(F.greatest(F.lit(1), F.col("nth") - reach)), run(F.least("last", F.col("nth") + reach)))))
    return runs.withColumn("own", F.col("run") == F.col("_home")).drop("_home")


def merge_turns(fragments: DataFrame) -> DataFrame:
    """Gaps and islands over fragments(document_id, position, speaker, starts_group, text).

    Neighbours merge if the speaker is the same, positions follow one another and the later one has
    no recorded start (starts_group: 1, 0 or null). Returns document_id, turn, first and last
    position, speaker and the texts joined by spaces. Starts are counted in runs of places, and the counts of the runs before are added.
    """
    w = W.partitionBy("document_id", "run").orderBy("nth")
    same = F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) & (F.lag("position").over(w) == F.col("position") - 1) & (F.coalesce("starts_group", F.lit(0)) != 1)
    marked = in_runs(fragments, "position", 1).withColumn("begins", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).where("own")
    begun = marked.groupBy("document_id", "run").agg(F.sum("begins").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("document_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = marked.join(begun.select("document_id", "run", before.alias("before")), ["document_id", "run"])
    marked = marked.withColumn("turn", F.col("before") + F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("document_id", "turn").agg(
        F.min("position").alias("first_position"), F.max("position").alias("last_position"), F.first("speaker").alias("speaker"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


def reuse_locators(parsed: DataFrame, manifest: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """The k-th occurrence of a fingerprint in parsed(document_id, position, fingerprint) takes the locator of the k-th row of manifest(document_id, genesis_position, fingerprint, source_locator).

    The rest get u0000-style locators counted on from the highest position of `every` row of the manifest, revoked ones too
    (by default the manifest itself), so that none is given twice.
    """
    nth = lambda order: F.row_number().over(W.partitionBy("document_id", "fingerprint").orderBy(order))
    old = manifest.withColumn("k", nth("genesis_position")).select("document_id", "fingerprint", "k", "source_locator")
    met = parsed.withColumn("k", nth("position")).join(old, ["document_id", "fingerprint", "k"], "left")
    high = (manifest if every is None else every).groupBy("document_id").agg(F.max("genesis_position").alias("high"))
    fresh = met.where("source_locator IS NULL").join(high, "document_id", "left")
    # numbered in runs of positions, so that no task holds a document of any size
    fresh = fresh.withColumn("run", F.floor(F.col("position") / RUN))
    sizes = fresh.groupBy("document_id", "run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("document_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = fresh.join(sizes.select("document_id", "run", before.alias("before")), ["document_id", "run"])
    number = F.coalesce("high", F.lit(-1)) + F.col("before") + F.row_number().over(W.partitionBy("document_id", "run").orderBy("position"))
    fresh = fresh.select("document_id", "position", F.format_string("u%04d", number.cast("long")).alias("source_locator"), F.lit(True).alias("minted"))
    return met.where("source_locator IS NOT NULL").select("document_id", "position", "source_locator", F.lit(False).alias("minted")).union(fresh)


def revoke(manifest: DataFrame, locators: DataFrame, when: str) -> DataFrame:
    """The manifest with the given (document_id, source_locator) tombstoned; what is revoked already stays as it is; a locator that the manifest lacks raises when the result is read."""
    hit = manifest.withColumn("known", F.lit(True)).join(locators.select("document_id", "source_locator").distinct().withColumn("hit", F.lit(True)), ["document_id", "source_locator"], "full")
    unknown = F.raise_error(F.concat(F.lit("unknown locator "), F.coalesce("source_locator", F.lit("null")), F.lit(" of "), F.coalesce(F.col("document_id").cast("string"), F.lit("null")))).cast("boolean")
    hit = hit.where(F.when(F.col("known").isNull(), unknown).otherwise(F.lit(True)))
    gone = F.col("hit") & F.col("revoked_at").isNull()
    marked = hit.withColumns({"content_fingerprint": F.when(gone, F.lit("REVOKED")).otherwise(F.col("content_fingerprint")), "revoked_at": F.when(gone, F.lit(when)).otherwise(F.col("revoked_at"))})
    return marked.select(*manifest.columns)


def remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, old_fingerprint, new_fingerprint) of rows changed by a rewrite, aligned by position; a missing partner raises when the result is read."""
    both = old.withColumnRenamed("fingerprint", "old_fingerprint").join(new.withColumnRenamed("fingerprint", "new_fingerprint"), ["document_id", "position"], "full")
    lone = F.col("old_fingerprint").isNull() | F.col("new_fingerprint").isNull()
    problem = F.raise_error(F.concat(F.lit("rewrite changed the number of units of "), F.col("document_id").cast("string"))).cast("boolean")
    return both.where(F.when(lone, problem).otherwise(F.col("old_fingerprint") != F.col("new_fingerprint"))).select("document_id", "old_fingerprint", "new_fingerprint")


def live(manifest: DataFrame) -> DataFrame:
    """The rows of a manifest that are not revoked."""
    return manifest.where("revoked_at IS NULL")


def natural_locators(parsed: DataFrame, manifest: DataFrame) -> DataFrame:
    """(document_id, position, source_locator, minted) for parsed(document_id, position, natural_locator): a natural locator is its own; minted where manifest(document_id, source_locator, revoked_at) lacks it, and an error if it was revoked."""
    old = manifest.select("document_id", F.col("source_locator").alias("natural_locator"), F.lit(True).alias("known"), F.col("revoked_at").isNotNull().alias("revoked")).distinct()
    both = parsed.join(old, ["document_id", "natural_locator"], "left")
    locator = F.when(F.col("revoked"), F.raise_error(F.concat(F.lit("revoked locator "), F.col("natural_locator")))).otherwise(F.col("natural_locator"))
    return both.select("document_id", "position", locator.alias("source_locator"), F.col("known").isNull().alias("minted"))


def assign_locators(parsed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Locators of parsed(document_id, position, natural_locator, fingerprint): natural ones by themselves, the rest by their fingerprints among the live rows of manifest(document_id, source_locator, genesis_position, fingerprint, revoked_at)."""
    own = natural_locators(parsed.where("natural_locator IS NOT NULL"), manifest)
    rest = parsed.where("natural_locator IS NULL").select("document_id", "position", "fingerprint")
    return own.union(reuse_locators(rest, live(manifest).select("document_id", "genesis_position", "fingerprint", "source_locator"), manifest))


def reusable(stash: DataFrame, units: DataFrame) -> DataFrame:
    """Rows of stash(evidence_id, text_hash, ...) whose unit still has the same text."""
    return stash.join(units.select("evidence_id", "text_hash"), ["evidence_id", "text_hash"], "left_semi")
