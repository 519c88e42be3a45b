"""Graph reads on an edge list (src, dst, w) that holds both directions of every edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.skew import shared_checkpoint

EVERY = 5


def _cut(df: DataFrame, round_no: int) -> DataFrame:
    """Cuts the lineage every few rounds."""
    return shared_checkpoint(df) if round_no % EVERY == EVERY - 1 else df


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hop): the nodes within ``depth`` hops of any seed (id), with the fewest hops."""
    seen = seeds.select("id", F.lit(0).alias("hop")).distinct()
    front = seen
    for d in range(1, depth + 1):
        step = front.select(F.col("id").alias("src")).join(edges, "src").select(F.col("dst").alias("id")).distinct()
        front = shared_checkpoint(step.join(seen, "id", "left_anti").select("id", F.lit(d).alias("hop")))
        seen = seen.unionByName(front)
        if front.limit(1).count() == 0:
            break
    return seen


def activation(edges: DataFrame, seeds: DataFrame, decay: float = 0.85, least: float = 0.01, depth: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, id, act): spreading activation, the best product of weight and decay over paths of at most ``depth`` edges.

    seeds: (*by, id, act); activations of different ``by`` don't meet.  Nodes below ``least`` don't spread; seeds are left
    out of the result.  Every step is the step before joined with the edges, so that up to ``EVERY`` steps are one job.
    """
    key = [*by, "id"]
    front = seeds.select(*key, F.col("act").cast("double").alias("act")).where(F.col("act") >= least)
    steps = None
    for d in range(depth):
        spread = front.withColumnRenamed("id", "src").join(edges, "src").select(*by, F.col("dst").alias("id"), (F.col("act") * F.col("w") * decay).alias("act"))
        front = _cut(spread.where(F.col("act") >= least).groupBy(*key).agg(F.max("act").alias("act")), d)
        steps = front if steps is None else steps.unionByName(front)
    best = steps.groupBy(*key).agg(F.max("act").alias("act"))
    return best.join(seeds.select(*key).distinct(), key, "left_anti")


def think(edges: DataFrame, start: DataFrame, decay: float = 0.85, least: float = 0.01, depth: int = 3) -> DataFrame:
    """(id, act): activation in which a node spreads only once, with what it got in the step that first reached it.

    start: (id).  Later steps may still raise a node's own activation.
    """
    front = start.select("id", F.lit(1.0).alias("act"))
    seen, steps = start.select("id"), None
    for d in range(depth):
        got = front.withColumnRenamed("id", "src").join(edges, "src").select(F.col("dst").alias("id"), (F.col("act") * F.col("w") * decay).alias("act")).where(F.col("act") >= least)
        got = _cut(got.groupBy("id").agg(F.max("act").alias("act")), d)
        steps = got if steps is None else steps.unionByName(got)
        front = got.join(seen, "id", "left_anti")
        seen = seen.unionByName(front.select("id"))
    return steps.groupBy("id").agg(F.max("act").alias("act")).join(start.select("id"), "id", "left_anti")


def paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, hop, path): a shortest path from a node of ``start`` to every node within ``depth`` edges.

    Of several shortest paths the one that is first when compared node by node.
    """
    front = start.select("id", F.lit(0).alias("hop"), F.array("id").alias("path"))
    out = front
    for d in range(1, depth + 1):
        step = front.select(F.col("id").alias("src"), "path").join(edges, "src").select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = shared_checkpoint(step.join(out.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")).select("id", F.lit(d).alias("hop"), "path"))
        out = out.unionByName(front)
        if front.limit(1).count() == 0:
            break
    return out


def _transitions(edges: DataFrame) -> DataFrame:
    """(src, dst, p): where a walk goes from a node."""
    out = edges.groupBy("src").agg(F.sum("w").alias("total")).where(F.col("total") > 0)
    return edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p"))


def walks(edges: DataFrame, seeds: DataFrame, top: int = 20, rounds: int = 3, alpha: float = 0.15, least: float = 1e-3) -> DataFrame:
    """(seed, id, score, rank): the ``top`` nodes of a personalised PageRank of each seed (id), the seed left out.

    The walks of all seeds are taken together, ``rounds`` steps far; a step that carries less than ``least`` of a seed's
    mass is not taken, so that a seed keeps at most 1 / ``least`` nodes a round, whatever the degrees it meets.  No seed
    has a mass above 1, so edges that carry less of a whole are left out before: a hub's don't meet each seed beside it.
    """
    from pyspark.sql import Window as W

    step = shared_checkpoint(_transitions(edges).where(F.col("p") * (1 - alpha) >= least))
    mass = seeds.select(F.col("id").alias("seed"), "id", F.lit(1.0).alias("m"))
    reached = None
    for _ in range(rounds):
        moved = mass.withColumnRenamed("id", "src").join(step, "src").select("seed", F.col("dst").alias("id"), (F.col("m") * F.col("p") * (1 - alpha)).alias("m"))
        mass = moved.where(F.col("m") >= least).groupBy("seed", "id").agg(F.sum("m").alias("m"))
        reached = mass if reached is None else reached.unionByName(mass)
    scored = reached.where(F.col("id") != F.col("seed")).groupBy("seed", "id").agg(F.round(F.sum("m") * alpha, 9).alias("score"))
    w = W.partitionBy("seed").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 20, alpha: float = 0.15) -> DataFrame:
    """(id, score): personalised PageRank with restart ``alpha``, scaled to maximum 1.

    seeds: (id, share) with shares that sum to 1.  The rounds are linear, so that they need no scaling in between; mass
    of nodes without edges is dropped.
    """
    step = shared_checkpoint(_transitions(edges))
    base = seeds.select("id", (F.col("share") * alpha).alias("m"))
    rank = seeds.select("id", F.col("share").alias("score"))
    for r in range(rounds):
        moved = rank.withColumnRenamed("id", "src").join(step, "src").select(F.col("dst").alias("id"), (F.col("score") * F.col("p") * (1 - alpha)).alias("m"))
        rank = _cut(moved.unionByName(base).groupBy("id").agg(F.sum("m").alias("score")), r)
    rank = shared_checkpoint(rank)
    return rank.join(F.broadcast(rank.agg(F.max("score").alias("_top")))).select("id", (F.col("score") / F.col("_top")).alias("score"))  # one row


def _adamic(edges: DataFrame) -> DataFrame:
    """(m, d, v): degree of each node and 1 / ln degree (0 for degree 1)."""
    deg = edges.groupBy(F.col("src").alias("m")).agg(F.count(F.lit(1)).alias("d"))
    return deg.select("m", "d", F.when(F.col("d") > 1, 1 / F.log(F.col("d").cast("double"))).otherwise(0.0).alias("v"))


def two_hop(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, common, aa): what each asked node (id) shares with the nodes two hops away that it isn't joined to.

    common counts the shared neighbours, aa is Adamic-Adar (the sum of 1 / ln degree).  The work is the sum of the
    degrees of the asked nodes' neighbours; pairs of a hub's neighbours among each other are never formed.
    """
    near = edges.join(asked.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("query_id"), F.col("dst").alias("m"))
    far = near.join(_adamic(edges), "m").join(edges.select(F.col("src").alias("m"), F.col("dst").alias("id")), "m").where(F.col("id") != F.col("query_id"))
    shared = far.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("common"), F.sum("v").alias("aa"))
    return shared.join(near.select("query_id", F.col("m").alias("id")), ["query_id", "id"], "left_anti")


def shared_by_edge(pairs: DataFrame) -> DataFrame:
    """(a, b, common, aa): for edges a < b in a triangle, the neighbours that both ends share, and their Adamic-Adar.

    Triangles are found from their end of the lowest degree: edges point from lower to higher degree, where no node has
    more than the root of twice the edges, so that a hub's neighbours are never paired.
    """
    deg = _adamic(pairs.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))))
    e = pairs.join(deg.select(F.col("m").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("m").alias("b"), F.col("d").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = shared_checkpoint(e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi")))
    wedge = out.select("lo", F.col("hi").alias("x")).join(out.select("lo", F.col("hi").alias("y")), "lo").where(F.col("x") < F.col("y"))
    closed = wedge.join(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"])
    side = lambda p, q, m: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.col(m).alias("m"))
    sides = closed.select(F.inline(F.array(side("x", "y", "lo"), side("lo", "x", "y"), side("lo", "y", "x"))))
    return sides.join(deg.select("m", "v"), "m").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum("v").alias("aa"))


def modularity(pairs: DataFrame, labels: DataFrame) -> float:
    """Weighted modularity of a labelling (id, label) of the simple graph ``pairs`` (a, b, w)."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    e = pairs.join(la, "a").join(lb, "b")
    m = e.agg(F.sum("w")).first()[0]
    if not m:
        return 0.0
    inside = e.where(F.col("la") == F.col("lb")).agg(F.sum("w")).first()[0] or 0.0
    ends = e.select(F.explode(F.array("la", "lb")).alias("l"), "w").groupBy("l").agg(F.sum("w").alias("k"))
    squares = ends.agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / m - squares / (4 * m * m)


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): synchronous propagation; a node takes the label of the greatest weight around it, ties to the smallest."""
    labels = edges.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("label"))
    for r in range(rounds):
        votes = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("v"))
        labels = _cut(votes.groupBy("id").agg(F.max_by("label", F.struct(F.round("v", 9), -F.col("label"))).alias("label")), r)
    return labels
