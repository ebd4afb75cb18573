"""Running streaming queries: checkpointed, trigger-configurable, and a
replay helper that drains what is available (tests and the registered
queries use it to compare a stream with its batch equivalent)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.session import scratch_path

# Keyed processors need a state store with column families, which the heap's (Spark's
# default) has not; state off the JVM heap suits all others too. Any other provider that
# the session names is kept.
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_HEAP_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(
    stream: DataFrame,
    name: str,
    sink: Callable[[DataFrame, int], None] | None = None,
    output_mode: str = "append",
    trigger: dict | None = None,
    timeout_s: float | None = None,
    resume: bool = False,
    idle_batches: bool = True,
) -> str:
    """Start `stream` with its checkpoint under spark.checkpoint.dir and wait
    for its end. `trigger` defaults to availableNow (drain and stop); pass
    {"processingTime": "30 seconds"} for a long-running refresh, which ends
    when it is stopped from outside. A stream that outlasts a caller's own
    `timeout_s` is stopped and raises: partial output is never returned.

    `resume=True` uses the stable folder `stream-<name>`, so a restarted driver
    continues from the last committed batch (exactly-once with the idempotent
    sinks); the default is a fresh folder per run (one-off replays). Returns
    the run's folder (default sink output goes to `<folder>/out`).

    `idle_batches=False` runs no micro-batch without data. State with a time to live asks
    for one at every trigger, so a stream of it that only drains would never end."""
    spark = stream.sparkSession
    if spark.conf.get(_STORE, None) in (None, _HEAP_STORE):
        spark.conf.set(_STORE, _ROCKSDB)
    suffix = "" if resume else f"-{uuid.uuid4().hex[:12]}"
    folder = scratch_path(spark, f"stream-{name}{suffix}")
    out = f"{folder}/out"
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", f"{folder}/checkpoint")
    if sink is None:
        from revlens.streaming.sinks import write_batch

        def sink(df, batch_id):  # noqa: ANN001
            write_batch(df, out, batch_id)

    writer = writer.foreachBatch(lambda df, batch_id: sink(df, batch_id))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    before = spark.conf.get(_IDLE)
    spark.conf.set(_IDLE, str(idle_batches and before == "true").lower())
    try:
        query = writer.start()  # the query keeps the settings of its start
    finally:
        spark.conf.set(_IDLE, before)
    ended = query.awaitTermination() if timeout_s is None else query.awaitTermination(timeout_s)
    if ended is False:
        query.stop()
        raise TimeoutError(f"stream {name} did not end within {timeout_s} s; its output is not complete")
    if query.exception() is not None:
        raise RuntimeError(f"stream {name} failed: {query.exception()}")
    return folder



def replay(drops: list[DataFrame], name: str, build: Callable[[DataFrame], DataFrame], sink=None,
           files: int | None = None, **options) -> str:
    """Land `drops` one after the other, each in `files` files (the shuffle partitions by
    default), and drain the stream `build(landed)`, so many files to a micro-batch. Rows of
    a later drop may be older than all rows before. A drop of fewer rows than files shares
    its micro-batch with the next one. Returns the run's folder; `options` as in `run`."""
    spark = drops[0].sparkSession
    land = scratch_path(spark, f"landing-{name}-{uuid.uuid4().hex[:12]}")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i, drop in enumerate(drops):
        drop.repartition(files).write.parquet(f"{land}/{i}")
    stream = spark.readStream.schema(drops[0].schema).option("maxFilesPerTrigger", files).parquet(f"{land}/*")
    return run(build(stream), name, sink=sink, **options)


def in_drops(df: DataFrame, key: Column, n: int = 3) -> list[DataFrame]:
    """`df` dealt by a hash of `key` into `n` drops: each spans all times, so after the
    first one nearly every row comes late."""
    part = F.pmod(F.xxhash64(key), F.lit(n))
    return [df.where(part == i) for i in range(n)]
