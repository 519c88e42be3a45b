"""Running a streaming query over what is there, and reading its result.

Sources are folders of Parquet files; results go to the shared folder beside the checkpoints, never through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recallgrid.sources.importers import shared_folder


def stream(spark: SparkSession, root: str, name: str, files_per_trigger: int = 4) -> DataFrame:
    """A table as a stream; its schema is read from the files themselves."""
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    # a file or a folder: the glob matches either
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(f"{root}/{name}.parquet*")


def settle(df: DataFrame, mode: str = "complete", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs ``df`` until its input is used up.  complete: each batch replaces the result; append: batches add to it."""
    spark = df.sparkSession
    out, state = shared_folder(spark, "stream"), shared_folder(spark, "state")

    def write(batch: DataFrame, batch_id: int) -> None:
        done = each(batch) if each else batch
        target = out if mode == "complete" else f"{out}/batch={batch_id}"
        done.write.mode("overwrite").parquet(target)

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(out)
    return got.drop("batch") if mode != "complete" else got
