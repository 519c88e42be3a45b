"""Readers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallgrid.sources.shipping import ship_package


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder) under ``root``."""
    ship_package(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


TABLES = ("memories", "connections", "memory_revisions", "dream_sessions", "dream_insights", "turns", "documents", "eval_items", "embeddings", "events")


def register_views(spark: SparkSession, root: str, names: tuple[str, ...] = TABLES) -> list[str]:
    """Registers the tables under ``root`` as views for ``spark.sql``, and the cleaned graph as edges and graph; the names of all."""
    from recallgrid.operators import edges as E

    for n in names:
        table(spark, root, n).createOrReplaceTempView(n)
    if "connections" in names:
        clean = E.clean_edges(table(spark, root, "connections"))
        E.upsert(clean).createOrReplaceTempView("edges")
        E.both_ways(E.pair_weights(clean)).createOrReplaceTempView("graph")
        names = (*names, "edges", "graph")
    return list(names)


def usable_vectors(memories: DataFrame, dim: int = 64, *keep: str) -> DataFrame:
    """id, embedding (and ``keep``) of the rows whose embedding can be compared: not null, ``dim`` numbers, none null,
    NaN or infinite, not all zero."""
    from pyspark.sql import functions as F

    e = F.col("embedding")
    ok = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return memories.select("id", "embedding", *keep).where(
        F.col("id").isNotNull() & (F.size(e) == dim) & ok.isNotNull() & (ok > 0) & (ok < float("inf"))
    )
