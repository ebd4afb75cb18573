"""The stored status index: which reviews have a status, in the order of their creation.

A keys-only snapshot table of (status, created_at, review_id), in folders by status and
sorted by created_at, so a query reads one status' files and of them the row groups of its
time span. Keyed state turns writes of reviews into changes: a review that gets another
status (or turns out to be older) leaves its old place and takes the new one. Work follows
the micro-batch, not the number of reviews.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from revlens.streaming import snapshots

KEYS = ["status", "created_at", "review_id"]


class IndexEntry(StatefulProcessor):
    """The entry of each review: the status of its last write and its first time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "ord string, status string, created long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        old = self.entry.get()
        order, status, created = old if old is not None else (None, None, None)
        for r in rows:
            if r["__ts"] is not None and (created is None or r["__ts"] < created):
                created = r["__ts"]
            if r["status"] is not None and (order is None or (r["__ord"], r["status"]) >= (order, status)):
                order, status = r["__ord"], r["status"]
        if old is not None and (order, status, created) == tuple(old):
            return
        self.entry.update((order, status, created))
        before = None if old is None or old[1] is None else (old[1], old[2])
        now = None if status is None else (status, created)
        if before == now:
            return
        for place, change in ((before, -1), (now, 1)):
            if place is not None:
                yield Row(review_id=key[0], status=place[0], created=place[1], n=change)

    def close(self) -> None:
        pass


def index_changes(writes: DataFrame, order: Column) -> DataFrame:
    """Changes (status, created_at, review_id, n) of a stream of writes (review_id, status, ts).
    `order` is a string that sorts as the writes do (null sorts first); of equal ones the larger
    status stands, so the index does not depend on the order of arrival. A review without a status
    is not in the index, one without a time is under a null created_at."""
    timed = writes.select(
        "review_id", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("__ts"), F.coalesce(order.cast("string"), F.lit("")).alias("__ord")
    )
    changes = timed.groupBy("review_id").transformWithState(
        IndexEntry(), "review_id string, status string, created long, n long", "Append", "None"
    )
    return changes.select("status", F.timestamp_micros("created").alias("created_at"), "review_id", "n")


def index_micro_batches(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: bring the index at `path` up to date with a micro-batch of changes."""

    def run(changes: DataFrame, batch_id: int) -> None:
        summed = changes.groupBy(*KEYS).agg(F.sum("n").alias("n"))
        snapshots.commit(summed, path, batch_id, KEYS, merge="presence", partition=("status",))

    return run


def with_status(
    spark: SparkSession, path: str, status: str, after: datetime | None = None, before: datetime | None = None,
    limit: int | None = None, version: int | None = None,
) -> DataFrame:
    """Index rows (review_id, status, created_at) of `status`, created in [after, before) where
    given. With `limit` the first so many by (created_at, review_id), a top-k and no sort of all
    rows; without it all of them, in no order."""
    rows = snapshots.read(spark, path, version).where(F.col("status") == status)
    if after is not None:
        rows = rows.where(F.col("created_at") >= F.lit(after))
    if before is not None:
        rows = rows.where(F.col("created_at") < F.lit(before))
    rows = rows.select("review_id", "status", "created_at")
    return rows if limit is None else rows.orderBy("created_at", "review_id").limit(limit)
