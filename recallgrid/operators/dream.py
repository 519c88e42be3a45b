"""The consolidation cycle as functions of an immutable state: each phase returns new tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.operators import edges as E
from recallgrid.operators.components import connected_components
from recallgrid.operators.skew import shared_checkpoint

#: Fixed values of the cycle.
STRENGTHEN, WEAKEN, PRUNE_BELOW, BRIDGE_LOW, BRIDGE_HIGH, BRIDGE_SHARE = 0.05, 0.01, 0.05, 0.3, 0.95, 0.3


@dataclass(frozen=True)
class State:
    """memories; edges (s, t, edge_type, weight); history (s, t, old_weight, new_weight, reason); insights."""

    memories: DataFrame
    edges: DataFrame
    history: DataFrame | None = None
    insights: DataFrame | None = None


def strengthen(edges: DataFrame, pairs: DataFrame, delta: float = STRENGTHEN) -> DataFrame:
    """Edges whose pair (s, t) was active gain ``delta``, at most 1."""
    active = pairs.select("s", "t").distinct().withColumn("_on", F.lit(True))
    return edges.join(active, ["s", "t"], "left").withColumn("weight", F.when(F.col("_on"), F.least(F.lit(1.0), F.col("weight") + delta)).otherwise(F.col("weight"))).drop("_on")


def weaken(edges: DataFrame, delta: float = WEAKEN, above: float = PRUNE_BELOW) -> DataFrame:
    w = F.col("weight")
    return edges.withColumn("weight", F.when(w > above, F.greatest(F.lit(0.0), w - delta)).otherwise(w))


def prune(edges: DataFrame, below: float = PRUNE_BELOW) -> DataFrame:
    """Without weak edges; superseding ones stay."""
    return edges.where((F.col("weight") >= below - 1e-12) | (F.col("edge_type") == "supersedes"))


def nrem(state: State, active: DataFrame) -> State:
    """Strengthen the active pairs, weaken all edges, prune; the history keeps what was strengthened."""
    before = state.edges
    strong = strengthen(before, active)
    rows = before.select("s", "t", "edge_type", F.col("weight").alias("old_weight")).join(strong.select("s", "t", "edge_type", F.col("weight").alias("new_weight")), ["s", "t", "edge_type"])
    history = rows.where(F.col("new_weight") != F.col("old_weight")).withColumn("reason", F.lit("strengthened"))
    history = history if state.history is None else state.history.unionByName(history)
    return replace(state, edges=shared_checkpoint(prune(weaken(strong))), history=history)


def bridges(hits: DataFrame, edges: DataFrame, low: float = BRIDGE_LOW, high: float = BRIDGE_HIGH, share: float = BRIDGE_SHARE) -> DataFrame:
    """New bridge edges from search hits (query_id, id, sim) within a band, where no edge of any type joins the two."""
    a, b = F.least("query_id", "id"), F.greatest("query_id", "id")
    new = hits.where(F.col("sim").between(low, high)).select(a.alias("s"), b.alias("t"), F.lit("bridge").alias("edge_type"), F.round(F.col("sim") * share, 3).alias("weight"))
    known = edges.select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"))
    return E.insert_absent(known.withColumn("edge_type", F.lit("")), new, any_type=True).select("s", "t", "edge_type", "weight")


def rem(state: State, hits: DataFrame) -> State:
    return replace(state, edges=shared_checkpoint(state.edges.unionByName(bridges(hits, state.edges), allowMissingColumns=True)))


def supersedes(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Superseding edges for similar pairs (a, b, sim) whose numbers differ: from the older row to the newer.

    rows: id, numbers (sorted array), created_at.  A pair without times goes by id.
    """
    left = rows.select(F.col("id").alias("a"), F.col("numbers").alias("na"), F.col("created_at").alias("ta"))
    right = rows.select(F.col("id").alias("b"), F.col("numbers").alias("nb"), F.col("created_at").alias("tb"))
    p = pairs.join(left, "a").join(right, "b").where((F.size("na") > 0) & (F.size("nb") > 0) & (F.col("na") != F.col("nb")))
    return older_to_newer(p)


def older_to_newer(p: DataFrame) -> DataFrame:
    """The superseding edges of pairs (a, b, sim) with their times ta and tb."""
    newer_b = (F.col("ta") < F.col("tb")) | (F.coalesce(F.col("ta") == F.col("tb"), F.lit(True)) & (F.col("a") < F.col("b")))
    return p.select(F.when(newer_b, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(newer_b, F.col("b")).otherwise(F.col("a")).alias("t"), F.lit("supersedes").alias("edge_type"), F.col("sim").alias("weight"))


def communities(edges: DataFrame, floor: float = 0.05) -> DataFrame:
    """(id, root) of the graph of edges at or above ``floor``, derived ones left out."""
    return connected_components(edges.where((F.col("weight") >= floor) & (F.col("edge_type") != "derived_from")).select(F.col("s").alias("a"), F.col("t").alias("b")))


def insights(members: DataFrame, least: int = 10, seen: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """One insight per community (id, root) of at least ``least`` members: anchor, size, confidence min(size / 10, 1).

    Communities whose anchor, the smallest id, is in ``seen`` (anchor) give none; ``most`` keeps the largest of the others.
    """
    found = members.groupBy("root").agg(F.min("id").alias("anchor"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    if seen is not None:
        found = found.join(seen.select("anchor").distinct(), "anchor", "left_anti")
    if most is not None:
        found = found.orderBy(F.desc("size"), "anchor").limit(most)
    return found.select("anchor", "size", F.least(F.col("size") / 10.0, F.lit(1.0)).alias("confidence"))


def bridge_nodes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, others): nodes with edges into at least two communities other than their own (labels: id, label)."""
    both = edges.select(F.inline(F.array(F.struct(F.col("s").alias("id"), F.col("t").alias("o")), F.struct(F.col("t").alias("id"), F.col("s").alias("o")))))
    x = both.join(labels, "id").join(labels.select(F.col("id").alias("o"), F.col("label").alias("lo")), "o")
    return x.where(F.col("label") != F.col("lo")).groupBy("id").agg(F.count_distinct("lo").alias("others")).where(F.col("others") >= 2)


def smoothed(rows: DataFrame, edges: DataFrame, own: float = 0.4, most: int = 20, dim: int = 64) -> DataFrame:
    """(id, vec): the unit vector of own * self + (1 - own) * weighted mean of the ``most`` heaviest neighbours.

    rows: id, vec (array<double> of ``dim``); edges: src, dst, w.  Rows without neighbours keep their vector.
    """
    from pyspark.sql import Window as W

    top = edges.join(rows.select(F.col("id").alias("dst"), F.col("vec").alias("n")), "dst").withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("k") <= most)
    mean = top.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("_w"), F.array(*[F.sum(F.col("w") * F.element_at("n", i + 1)) for i in range(dim)]).alias("_s")).where(F.col("_w") > 0)
    x = rows.select("id", "vec").join(mean, "id", "left")
    mixed: Column = F.zip_with("vec", "_s", lambda a, b: a * own + b * (1 - own) / F.col("_w"))
    length = F.sqrt(F.aggregate("mix", F.lit(0.0), lambda acc, v: acc + v * v))
    x = x.withColumn("mix", F.when(F.col("_s").isNotNull(), mixed))
    return x.select("id", F.when(F.col("mix").isNull(), F.col("vec")).otherwise(F.transform("mix", lambda v: v / length)).alias("vec"))
