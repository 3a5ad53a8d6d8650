"""Records, signals and matrices that the queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.sequence import CANONICAL
from cadenza.session import table

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def raw_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, raw: the letters of each whole document, some with stop marks."""
    letters = F.regexp_replace(F.translate("text", _LOW, _UP), "[^A-Z]", "")
    marks = F.when(F.col("doc_id") % 7 == 0, "**").when(F.col("doc_id") % 3 == 0, "*").otherwise("")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.concat(letters, marks).alias("raw"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, sequence, length: the canonical letters of each whole document."""
    kept = F.regexp_replace(F.translate("text", _LOW, _UP), f"[^{CANONICAL}]", "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), kept.alias("sequence")).withColumn("length", F.length("sequence"))


RAW_SQL = f"""raw AS (SELECT doc_id AS record_id, regexp_replace(translate(text, '{_LOW}', '{_UP}'), '[^A-Z]', '', 'g') ||
  CASE WHEN doc_id % 7 = 0 THEN '**' WHEN doc_id % 3 = 0 THEN '*' ELSE '' END AS raw FROM documents)"""
SEQ_SQL = f"""seqs AS (SELECT record_id, sequence, len(sequence)::INT AS length FROM (
  SELECT doc_id AS record_id, regexp_replace(translate(text, '{_LOW}', '{_UP}'), '[^{CANONICAL}]', '', 'g') AS sequence FROM documents))"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, hour (from 0, without gaps inside), n: events an hour, a signal per type."""
    events = table(spark, sf_dir, "events").withColumn("h", F.floor(F.unix_timestamp("ts") / 3600))
    first = events.agg(F.min("h").alias("h0"), F.max("h").alias("h1"))
    grid = events.select("event_type").distinct().crossJoin(F.broadcast(first)).select("event_type", "h0", F.explode(F.sequence("h0", "h1")).alias("h"))
    counts = events.groupBy("event_type", "h").agg(F.count("*").alias("n"))
    return grid.join(counts, ["event_type", "h"], "left").select("event_type", (F.col("h") - F.col("h0")).cast("int").alias("hour"), F.coalesce("n", F.lit(0)).alias("n"))


HOURLY_SQL = """e AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS h FROM events),
b AS (SELECT min(h) AS h0, max(h) AS h1 FROM e),
hourly AS (SELECT t.event_type, (g.h - h0)::INT AS hour, count(e.h) AS n FROM (SELECT DISTINCT event_type FROM events) t
  CROSS JOIN (SELECT unnest(range(h0, h1 + 1)) AS h, h0 FROM b) g LEFT JOIN e ON e.event_type = t.event_type AND e.h = g.h GROUP BY 1, 2)"""


def state_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record, pos, value: labels' quality in blocks of 64 documents, a 0..1 track."""
    rows = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 64).cast("long").alias("record"), "doc_id", ((F.col("doc_id") * 37 % 101) / 200 + F.col("quality") * 0.495).alias("value"))
    from pyspark.sql import Window

    return rows.select("record", (F.row_number().over(Window.partitionBy("record").orderBy("doc_id")) - 1).alias("pos"), "value")


TRACK_SQL = """track AS (SELECT record, (row_number() OVER (PARTITION BY record ORDER BY doc_id) - 1)::INT AS pos, value FROM (
  SELECT floor(doc_id / 64)::BIGINT AS record, doc_id, (doc_id * 37 % 101)::DOUBLE / 200 + quality * 0.495::DOUBLE AS value FROM labels))"""
