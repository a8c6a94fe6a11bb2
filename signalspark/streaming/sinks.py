"""A table that a stream keeps up to date, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_batch(path: str, keys: list[str], run: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch's rows to its own folder of `path`, by run and batch.

    A batch that is replayed overwrites its folder and no other, so nothing is doubled. Of each key's rows in a batch all
    are kept: what is current is decided on reading, by `current_rows`.
    """

    def write(rows: DataFrame, batch: int) -> None:
        marked = rows.withColumn("run", F.lit(run)).withColumn("batch", F.lit(batch).cast("long"))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch").parquet(path)

    if {"run", "batch"} & set(keys):
        raise ValueError("run and batch are columns of the sink's own")
    return write


def current_rows(written: DataFrame, keys: list[str], time: str) -> DataFrame:
    """For each key the row of the latest time in the newest run that has the key; ties go to the later batch.

    A run that was superseded changes nothing, however late its batches come. Rows of the newest run win even where an
    older run has a later time.
    """
    order = F.struct("run", time, "batch", F.xxhash64(*(c for c in written.columns if c not in ("run", "batch"))))
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*written.columns), order).alias("r"))
    return latest.select("r.*").drop("run", "batch")


def superseded(written: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of runs that a newer run of their key has replaced."""
    newest = F.max("run").over(Window.partitionBy(*keys))
    return written.withColumn("_newest", newest).filter(F.col("run") < F.col("_newest")).drop("_newest")
