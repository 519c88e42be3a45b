"""Helpers that keep a hot key, a long chain of stages or a lost executor from hurting a job."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 1 / 128


def shared_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one that the cluster names in spark.checkpoint.dir.  A session on a cluster without it is an
    error; a session on one machine gets a folder of its own, which is removed when the process ends.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints, which every executor can reach."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="recallgrid-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """The keys that hold at least ``share`` of the rows of ``df``: never more than 1 / share of them, whatever its size."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    least = max(1, int(df.count() * share))
    return counts.where(F.col("_n") >= least).select(key)


def lookup_join(left: DataFrame, right: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Left outer join of ``left`` with ``right`` (unique in ``key``) that no hot key of ``left`` can slow down.

    Rows of hot keys are joined with the few matching rows of ``right`` by broadcast (at most 1 / share rows), the rest
    by a shuffle on the key.  Null keys match nothing and never enter the shuffle.
    """
    hot = F.broadcast(hot_keys(left, key, share).withColumn("_hot", F.lit(True)))
    marked = left.join(hot, key, "left")
    is_hot = F.col("_hot").isNotNull()
    few = F.broadcast(right.join(hot, key, "left_semi"))
    by_broadcast = marked.where(is_hot | F.col(key).isNull()).drop("_hot").join(few, key, "left")
    by_shuffle = marked.where(~is_hot & F.col(key).isNotNull()).drop("_hot").join(right, key, "left")
    return by_broadcast.unionByName(by_shuffle)


def global_order(df: DataFrame, keys: list[str], name: str = "pos") -> DataFrame:
    """``df`` with a dense number from 0 in the order of ``keys`` over all rows.

    A range partitioning on the whole key spreads a hot prefix of it over many tasks; the driver sees one count per
    partition only.
    """
    spread = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    fixed = shared_checkpoint(spread.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    counts = sorted((r[0], r[1]) for r in fixed.groupBy(part.alias("p")).count().collect())
    if not counts:
        return fixed.withColumn(name, F.col("_mid")).drop("_mid")
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = F.create_map(*[F.lit(int(x)) for pair in starts for x in pair])
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return fixed.withColumn(name, local + F.element_at(offsets, part.cast("int")).cast("long")).drop("_mid")


def session_parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def by_slots(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than tasks run at once, for what hands over the best of each partition.

    A query's best of every split of a table would grow with queries times splits, which is the square of the table.
    """
    return df.coalesce(session_parallelism(df.sparkSession))
