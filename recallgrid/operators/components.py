"""Connected components by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.skew import shared_checkpoint


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) of every end of ``links`` (a, b): root is the smallest id of the component.

    Each round every node takes the least root among itself and its neighbours, then the root of that root: long chains
    shrink to half per round.  Null ends and self-loops link nothing.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = shared_checkpoint(links.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))).distinct())
    roots = shared_checkpoint(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("root")))
    for _ in range(max_rounds):
        near = both.join(roots.select(F.col("id").alias("dst"), F.col("root").alias("r")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("r").alias("r"))
        took = roots.join(near, "id").select("id", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved"))
        took = shared_checkpoint(took)
        if took.where("moved").limit(1).count() == 0:
            return took.select("id", "root")
        up = took.select(F.col("id").alias("root"), F.col("root").alias("upper"))
        roots = took.select("id", "root").join(up, "root", "left").select("id", F.coalesce("upper", "root").alias("root"))
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
