"""Typed decoding with a quarantine: one pass over the messages, two tables.

Events that decode against the model go to `events`, the others to `quarantine` with their
text and what is wrong with them. When the model has changed, `replay` decodes the held
texts again: those that decode now become events (`replayed`) and leave the quarantine
(`released`), once, also if the replay is repeated or stops in between. All are snapshot
tables keyed by the message; the stream writes the first two, the replay the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.sources import landed
from revlens.streaming import snapshots


def typed_micro_batches(out_dir: str, fields: list, keys: list[str], text: str = "text") -> Callable[[DataFrame, int], None]:
    """foreachBatch function over messages (`keys`, `text`): decode and store each."""

    def run(rows: DataFrame, batch_id: int) -> None:
        typed = landed.typed_events(rows.select(*keys, text), text, fields).persist()  # both tables from one decoding
        snapshots.commit(_events(typed, text), f"{out_dir}/events", batch_id, keys)
        wrong = F.array_join("violations", ",").alias("violations"), F.size("violations").alias("n_violations")
        snapshots.commit(typed.where("NOT valid").select(*keys, text, *wrong), f"{out_dir}/quarantine", batch_id, keys)
        typed.unpersist()

    return run


def _events(typed: DataFrame, text: str) -> DataFrame:
    return typed.where("valid").drop("valid", "violations", text)


def events(spark: SparkSession, out_dir: str) -> DataFrame:
    """All events, replayed ones included; fields that a later model added are NULL in
    events of before."""
    out = snapshots.read(spark, f"{out_dir}/events")
    if snapshots.versions(spark, f"{out_dir}/replayed"):
        out = out.unionByName(snapshots.read(spark, f"{out_dir}/replayed"), allowMissingColumns=True)
    return out


def held(spark: SparkSession, out_dir: str) -> DataFrame:
    """Messages in quarantine: keys, text, violations, n_violations."""
    rows = snapshots.read(spark, f"{out_dir}/quarantine")
    if not snapshots.versions(spark, f"{out_dir}/released"):
        return rows
    released = snapshots.read(spark, f"{out_dir}/released")
    return rows.join(released, released.columns, "left_anti")


def replay(spark: SparkSession, out_dir: str, fields: list, keys: list[str], text: str = "text") -> None:
    """Decode the held messages against `fields`. Events are stored before their messages
    leave the quarantine: a replay that stopped in between stores them again under the
    same keys."""
    typed = landed.typed_events(held(spark, out_dir).select(*keys, text), text, fields).persist()
    for name, rows in (("replayed", _events(typed, text)), ("released", typed.where("valid").select(*keys))):
        path = f"{out_dir}/{name}"
        before = snapshots.manifest(spark, path) or {"parts": []}
        snapshots.commit(rows, path, 1 + max((p["last"] for p in before["parts"]), default=-1), keys)
    typed.unpersist()
