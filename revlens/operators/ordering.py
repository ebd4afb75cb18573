"""Skew-safe ordering primitives.

`row_number() OVER (PARTITION BY k ORDER BY o)` sends every row of a key to one
task. With one review holding a third of all rows that is a single-task sort of
a third of the data. The helpers here number rows and pick first/last rows
without ever gathering a key in one place:

* `first_by_order`: keep one row per key by an order. A `min_by` aggregate, so
  Spark combines partially on the map side before the shuffle.
* `row_position`: 0-based position inside a key. A range-partitioned sort
  spreads even a single hot key over many tasks; each task then counts its
  rows per key, a tiny prefix sum over (task, key) counts gives every task its
  offset, and the position is offset + index within the task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import materialise


def first_by_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], descending: bool = False
) -> DataFrame:
    """One row per `keys`: the row with the smallest (largest if `descending`)
    `order` tuple, which should be unique within a key. Only the order columns
    are compared, so the other columns may be of any type, maps included."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    payload = [c for c in df.columns if c not in keys]
    place = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order_cols)])
    row = F.struct(*[F.col(c).alias(c) for c in payload])
    agg = F.max_by(row, place) if descending else F.min_by(row, place)
    return df.groupBy(*keys).agg(agg.alias("__w")).select(*keys, *[F.col(f"__w.{c}").alias(c) for c in payload])


def row_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "position",
    num_partitions: int | None = None,
    materialise_input: bool = False,
) -> DataFrame:
    """Add `out`, the 0-based position of each row within `keys` by `order`.

    `order` must make rows unique within a key (ties would make the numbering
    depend on the input order, which is not stable across task retries); rows
    that tie raise an error when they are read.
    Only the slim projection (keys + order) is numbered and stored; positions
    are joined back on (keys + order), a key that is unique per row, so even a
    hot key spreads over many tasks in that join. Set `materialise_input` when
    the input is costly to recompute: the range partitioner samples it in a
    separate job (only the slim projection is stored for that).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [*keys, *order]
    slim = df.select(*sort_cols)
    if materialise_input:
        slim = materialise(slim)
    # The task id and in-task index are materialised once (reliable checkpoint
    # in spark.checkpoint.dir): the count branch and the join branch below
    # must see the same values, which re-running the range shuffle (with
    # adaptive coalescing or after an executor loss) does not guarantee.
    ranged = materialise(
        slim.repartitionByRange(n, *sort_cols)
        .sortWithinPartitions(*sort_cols)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__mono", F.monotonically_increasing_id())
    )
    # Per (task, key): how many rows and where they start. Bounded by
    # (#tasks x #keys), independent of how many rows one key has.
    counts = ranged.groupBy("__pid", *keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__mono").alias("__start"))
    w = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    positions = ranged.join(offsets.select("__pid", *keys, "__off", "__start"), ["__pid", *keys]).select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(sort_cols)],
        (F.col("__off") + F.col("__mono") - F.col("__start")).alias(out),
    )
    # the join below is dealt by the same columns, so this adds no shuffle
    names = [f"__k{i}" for i in range(len(sort_cols))]
    once = positions.groupBy(*names).agg(F.min(out).alias(out), F.count(F.lit(1)).alias("__rows"))
    tie = F.raise_error(F.lit(f"row_position: rows tie on {sort_cols}")).cast("long")
    positions = once.select(*names, F.when(F.col("__rows") == 1, F.col(out)).otherwise(tie).alias(out))
    cond = [df[c].eqNullSafe(positions[f"__k{i}"]) for i, c in enumerate(sort_cols)]
    return df.join(positions, cond).drop(*[f"__k{i}" for i in range(len(sort_cols))])
