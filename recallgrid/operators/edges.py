"""The weighted, typed, time-valid edge table: cleaning, canonical form, upsert, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("similar", "causal", "supersedes", "bridge", "derived_from", "supports", "synthesis_of", "before")
FLOOR = 0.05


def edge_type(c: Column) -> Column:
    """The type in one spelling; unknown and missing types are 'similar'."""
    t = F.translate(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "- ", "__")
    return F.when(t.isin(*TYPES), t).otherwise("similar")


def clean_weight(c: Column) -> Column:
    """Clamped to [0, 1]; null for null and NaN."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def clean_edges(connections: DataFrame) -> DataFrame:
    """Edges with two different ends and a weight, as s, t, weight, edge_type and their times.

    Undirected types are put as s < t; 'supersedes' keeps its direction from old to new.
    """
    kind = edge_type(F.col("edge_type"))
    a, b = F.col("source_id"), F.col("target_id")
    w = clean_weight(F.col("weight"))
    keep = kind == "supersedes"
    return connections.where(a.isNotNull() & b.isNotNull() & (a != b) & w.isNotNull()).select(
        "id", F.when(keep, a).otherwise(F.least(a, b)).alias("s"), F.when(keep, b).otherwise(F.greatest(a, b)).alias("t"), w.alias("weight"), kind.alias("edge_type"),
        "created_at", "event_time", "ingestion_time", "valid_from", "valid_to",
    )


def upsert(edges: DataFrame) -> DataFrame:
    """One edge per (s, t, type) with the largest weight and the latest times: what writing them one by one would leave."""
    return edges.groupBy("s", "t", "edge_type").agg(F.max("weight").alias("weight"), F.max("created_at").alias("created_at"), F.max("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"))


def insert_absent(edges: DataFrame, new: DataFrame, any_type: bool = False) -> DataFrame:
    """The rows of ``new`` (s, t, edge_type, weight) that ``edges`` lacks, the first of each key by weight descending."""
    key = ["s", "t"] if any_type else ["s", "t", "edge_type"]
    best = new.groupBy(*key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in key]), "weight").alias("r")).select(*key, "r.*")
    return best.join(edges.select(*key).distinct(), key, "left_anti")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: src, dst, weight, edge_type.  Read once, no join with OR."""
    return edges.select(F.inline(F.array(
        F.struct(F.col("s").alias("src"), F.col("t").alias("dst"), "weight", "edge_type"),
        F.struct(F.col("t").alias("src"), F.col("s").alias("dst"), "weight", "edge_type"),
    )))


def valid_at(at: Column) -> Column:
    """Whether an edge is valid at a time, both ends included."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (F.coalesce("valid_from", "event_time", "created_at", epoch) <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))


def pair_weights(edges: DataFrame) -> DataFrame:
    """The simple graph: one undirected edge per pair (a < b) with its largest weight."""
    return edges.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.max("weight").alias("w"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(src, dst, w) of both directions of ``pair_weights``."""
    return pairs.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))))
