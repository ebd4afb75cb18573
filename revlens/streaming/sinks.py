"""Sinks: idempotent micro-batch writes and merge-on-read tables.

A table is a directory with a folder `batch_id=<n>` per micro-batch. A batch
replaces its own folder whole, so a replayed batch (after a failure) leaves what
it writes now and nothing else, also where it has fewer rows or none:
exactly-once with the streaming checkpoint. Readers take the latest write per key
(`read_latest`), which is how `put_item` last-write-wins is expressed without
an in-place update. All paths live under the shared folder the cluster names
in `spark.checkpoint.dir`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.operators.ordering import first_by_order
from revlens.session import scratch_path


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: list[str] | None = None) -> None:
    """Write one micro-batch into its own `batch_id` folder (idempotent).

    A failed write raises and fails the batch, so the stream retries it: no
    write is silently dropped.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/batch_id={int(batch_id)}")


def read_latest(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Merge on read: the newest row per key by `order` (then batch_id)."""
    df = spark.read.parquet(path)
    return first_by_order(df, keys, [*order, "batch_id"], descending=True).drop("batch_id")


def table_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
