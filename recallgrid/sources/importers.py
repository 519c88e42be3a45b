"""Importers of nested JSON and an access log in JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.operators.skew import checkpoint_folder

CONVERSATION = "conv_id long, messages array<struct<seq: int, role: string, content: string, turn_id: long>>"
PULSE = "schema string, topic string, memories array<struct<label: string, kind: string, content: string, entities: array<string>, source_urls: array<string>, salience: double, dedup_key: string>>"


def conversation_rows(json: DataFrame, col: str = "json") -> DataFrame:
    """One row per message of nested conversations: conv_id, seq, role, content, turn_id.  Broken JSON gives no row."""
    x = json.select(F.from_json(col, CONVERSATION).alias("c"))
    return x.select("c.conv_id", F.inline("c.messages"))


def pulse_rows(json: DataFrame, col: str = "json") -> DataFrame:
    """Memories of pulse documents: label, content with topic, kind and sources, salience, entities; the first of equal labels counts."""
    x = json.select(F.from_json(col, PULSE).alias("p")).where(F.col("p.schema") == "pulse.for-memory.v1")
    m = x.select("p.topic", F.inline("p.memories")).where(F.trim("content") != "")
    label: Column = F.coalesce("label", F.concat(F.lit("pulse:"), F.regexp_replace(F.lower(F.coalesce("dedup_key", "topic")), "[^a-z0-9]+", "-")))
    text = F.concat_ws("\n", F.concat(F.lit("["), F.coalesce("kind", F.lit("note")), F.lit("] "), F.col("content")), F.when(F.size("source_urls") > 0, F.concat(F.lit("Sources: "), F.array_join("source_urls", ", "))))
    return m.groupBy(label.alias("label")).agg(F.min(F.struct("topic", text.alias("content"), F.coalesce("salience", F.lit(1.0)).alias("salience"), "entities")).alias("r")).select("label", "r.*")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the session's checkpoints, which every executor can reach."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def through_json_lines(rows: DataFrame) -> DataFrame:
    """Writes rows as JSON lines to the shared folder and reads them with their own schema: an access log's round trip."""
    path = shared_folder(rows.sparkSession, "log")
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def through_snapshot(rows: DataFrame) -> DataFrame:
    """A columnar snapshot of a table in the shared folder, read again: what a cache file is elsewhere."""
    path = shared_folder(rows.sparkSession, "snapshot")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)
