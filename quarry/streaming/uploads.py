"""Uploads as a file stream: each file once, validated, appended to the unit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def clean_name(name) -> F.Column:
    """A safe document id: no path, no control characters, ASCII letters, digits, dot, dash and underscore, 80 at most; null for hidden or empty names."""
    base = F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1f]", ""), r"^.*[/\\]", "")
    stem = T.without_marks(F.regexp_replace(base, r"(?i)\.txt$", ""))
    safe = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
    return F.when(~base.startswith(".") & (safe != ""), F.substring(safe, 1, 80))


def validated(uploads: DataFrame) -> DataFrame:
    """uploads(name, content binary) with document_id, text and problem (null for a good file)."""
    text = F.regexp_replace(F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^﻿", ""), "\r\n", "\n")
    out = uploads.withColumns({"document_id": clean_name(F.col("name")), "text": text})
    problem = F.when(F.col("document_id").isNull(), "name").when(F.col("text").isNull(), "not UTF-8").when(F.col("text").contains("\x00"), "NUL byte").when(~F.col("text").rlike(r"\S"), "empty")
    return out.withColumn("problem", problem)


def without_collisions(uploads: DataFrame, taken: DataFrame) -> DataFrame:
    """uploads(document_id, name, content) whose ids are nobody else's: where taken(document_id) or an earlier upload (by name, then content) has the id, a suffix from the name, the content and the number of the copy follows it."""
    digest = F.sha2(F.concat_ws("|", "name", F.hex("content")), 256)
    nth = F.row_number().over(W.partitionBy("document_id").orderBy("name", digest))
    both = uploads.withColumns({"_nth": nth, "_digest": digest}).join(taken.select(F.col("document_id"), F.lit(1).alias("_taken")).distinct(), "document_id", "left")
    fresh = F.col("_taken").isNull() & (F.col("_nth") == 1)
    suffix = F.substring(F.sha2(F.concat_ws("|", "_digest", F.col("_nth").cast("string")), 256), 1, 8)
    return both.withColumn("document_id", F.when(fresh | F.col("document_id").isNull(), F.col("document_id")).otherwise(F.concat_ws("-", "document_id", suffix))).drop("_nth", "_digest", "_taken")


def follow(spark: SparkSession, inbox: str, units_path: str, checkpoint: str) -> StreamingQuery:
    """Append a unit for each paragraph of each new file; a restart goes on after the last committed batch, and a batch that is run again replaces its own part."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").load(inbox)
    uploads = stream.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")

    def write(batch: DataFrame, number: int) -> None:
        good = validated(batch).where("problem IS NULL")
        units = good.select("document_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("unit_index", "raw_text")).where(F.col("raw_text").rlike(r"\S"))
        units.withColumn("text_hash", T.text_hash(F.col("raw_text"))).write.mode("overwrite").parquet(f"{units_path}/batch={number}")

    return uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
