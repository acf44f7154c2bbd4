"""The evidence model over Parquet tables.

Conversations are transcripts (a unit a turn), documents are mail (a thread a source), and
dates are derived from ids, so that both have an order in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dated(number) -> F.Column:
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (number % 365).cast("int")), "yyyy-MM-dd")


def transcript_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "conversations")
    document = F.concat(F.lit("c"), F.col("conv_id"))
    return t.select(
        F.concat_ws("-", F.lit("EV"), document, "turn").alias("evidence_id"), document.alias("document_id"), F.lit("TRANSCRIPT").alias("document_type"), F.col("turn").cast("long").alias("unit_index"),
        F.col("role").alias("speaker_sender"), dated(F.col("conv_id")).alias("event_date"), F.col("text").alias("raw_text"),
    )


def mail_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "documents")
    return t.select(
        F.concat_ws("-", F.lit("EV"), "source", "doc_id").alias("evidence_id"), F.col("source").alias("document_id"), F.lit("EMAIL").alias("document_type"), F.col("doc_id").alias("unit_index"),
        F.col("lang").alias("speaker_sender"), dated(F.col("doc_id")).alias("event_date"), F.col("text").alias("raw_text"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript_units(spark, sf_dir).union(mail_units(spark, sf_dir))


#: The same views for SQL; queries put their own CTEs behind them.
UNITS_SQL = """
transcript_units AS (SELECT 'EV-c' || conv_id || '-' || turn AS evidence_id, 'c' || conv_id AS document_id, 'TRANSCRIPT' AS document_type, turn AS unit_index, role AS speaker_sender,
  strftime(DATE '2024-01-01' + CAST(conv_id % 365 AS INTEGER), '%Y-%m-%d') AS event_date, text AS raw_text FROM conversations),
mail_units AS (SELECT 'EV-' || source || '-' || doc_id AS evidence_id, source AS document_id, 'EMAIL' AS document_type, doc_id AS unit_index, lang AS speaker_sender,
  strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS event_date, text AS raw_text FROM documents),
units AS (SELECT * FROM transcript_units UNION ALL SELECT * FROM mail_units)
"""
