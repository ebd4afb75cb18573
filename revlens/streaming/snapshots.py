"""Snapshot tables: what a stream's micro-batches make of a table, in whole versions.

A table is a folder of Parquet parts and a manifest per version that names the live ones.
A commit writes its part first and then the next manifest, so a reader sees all of a
version or the one before, also while a part is rewritten, and may stay with a version it
has begun to read. A micro-batch that is replayed replaces its own part. When `fan` parts
of a level have come together, they are merged into one of the next level, dealt and sorted
by key ranges: after n micro-batches a key range stands in O(log n) parts, and a row is
rewritten O(log n) times.

Rows of a key merge by `latest` (the last write by the order columns, then by micro-batch),
by `sum` (additive changes) or by `presence` (sums, of which those that are zero are no rows).
With `partition` columns each part is dealt by key ranges into folders of their values. A table has one writer at a time, its stream. Paths live
under spark.checkpoint.dir; manifests are handled by Hadoop's file system, so any store that
Spark writes to will do.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.operators.ordering import first_by_order

FAN, KEEP = 8, 32
#: The micro-batch of a row, for ties of the order columns.
BATCH = "__batch"


def _fs(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for `path`."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that a reader can still take, oldest first."""
    fs, p = _fs(spark, f"{path}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of `version` (the newest one by default), None of a new table."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return None
        version = known[-1]
    fs, p = _fs(spark, f"{path}/manifest/v{version:020d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, new: dict) -> None:
    fs, final = _fs(spark, f"{path}/manifest/v{new['version']:020d}.json")
    _, draft = _fs(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"{path} has another writer: version {new['version']} exists")


def commit(
    df: DataFrame, path: str, batch_id: int, keys: list[str], order: list[str] | None = None, merge: str = "latest",
    replace: bool = False, fan: int = FAN, partition: tuple[str, ...] = (),
) -> int:
    """Add a micro-batch's rows to the table (as its whole content with `replace`) and
    return the new version. Replaying a batch_id replaces what it wrote before."""
    spark = df.sparkSession
    old = manifest(spark, path) or {"version": -1, "parts": []}
    if any(p["level"] > 0 and batch_id <= p["last"] for p in old["parts"]):
        raise ValueError(f"micro-batch {batch_id} of {path} has been merged; only the last one can be replayed")
    folder = f"data/{int(batch_id)}-{uuid.uuid4().hex[:12]}"
    marked = df.withColumn(BATCH, F.lit(int(batch_id)).cast("long"))
    if partition:
        marked = marked.repartitionByRange(*keys)
    marked.sortWithinPartitions(*keys).write.partitionBy(*partition).parquet(f"{path}/{folder}")
    kept = [] if replace else [p for p in old["parts"] if not (p["level"] == 0 and p["first"] == batch_id)]
    new = {
        "version": old["version"] + 1, "schema": json.loads(marked.schema.json()), "keys": keys, "order": order or [], "merge": merge, "partition": list(partition),
        "parts": [*kept, {"folder": folder, "first": int(batch_id), "last": int(batch_id), "level": 0}],
    }
    _publish(spark, path, new)
    new = _merged(spark, path, new, fan)
    vacuum(spark, path)
    return new["version"]


def _merged(spark: SparkSession, path: str, now: dict, fan: int) -> dict:
    """Merge each level that has `fan` parts, the newest micro-batch left out (it may be
    replayed)."""
    level = 0
    while True:
        newest = max(p["last"] for p in now["parts"])
        due = [p for p in now["parts"] if p["level"] == level and p["last"] < newest]
        if len(due) < fan:
            if not any(p["level"] > level for p in now["parts"]):
                return now
            level += 1
            continue
        folder = f"data/m{level + 1}-{uuid.uuid4().hex[:12]}"
        rows = _merge(_rows(spark, path, now, due), now)
        dealt = rows.repartitionByRange(*now["keys"]).sortWithinPartitions(*now["keys"])
        dealt.write.partitionBy(*now.get("partition", [])).parquet(f"{path}/{folder}")
        one = {"folder": folder, "first": min(p["first"] for p in due), "last": max(p["last"] for p in due), "level": level + 1}
        now = {**now, "version": now["version"] + 1, "parts": [one, *[p for p in now["parts"] if p not in due]]}
        _publish(spark, path, now)
        level += 1


def _rows(spark: SparkSession, path: str, of: dict, parts: list[dict]) -> DataFrame:
    schema = T.StructType.fromJson(of["schema"])
    if not parts:
        return spark.createDataFrame([], schema)
    if of.get("partition"):  # a reader takes the folders of one part at a time for values
        each = [spark.read.schema(schema).parquet(f"{path}/{p['folder']}").select(*schema.names) for p in parts]
        return reduce(DataFrame.unionByName, each)
    return spark.read.schema(schema).parquet(*[f"{path}/{p['folder']}" for p in parts])


def _merge(rows: DataFrame, of: dict) -> DataFrame:
    if of["merge"] in ("sum", "presence"):
        sums = [c for c in rows.columns if c not in (*of["keys"], BATCH)]
        summed = rows.groupBy(*of["keys"]).agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums], F.max(BATCH).alias(BATCH)).select(rows.columns)
        return summed if of["merge"] == "sum" else summed.where(" OR ".join(f"`{c}` <> 0" for c in sums))
    return first_by_order(rows, of["keys"], [*of["order"], BATCH], descending=True).select(rows.columns)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of `version` (the newest by default), one row per key. Filters on
    the keys reach the Parquet readers of the parts."""
    of = manifest(spark, path, version)
    if of is None:
        raise FileNotFoundError(f"{path} has no version yet")
    return _merge(_rows(spark, path, of, of["parts"]), of).drop(BATCH)


def vacuum(spark: SparkSession, path: str, keep: int = KEEP) -> None:
    """Delete all versions but the last `keep`, and the parts that none of those names."""
    known = versions(spark, path)
    if len(known) <= keep:
        return
    live = {p["folder"] for v in known[-keep:] for p in manifest(spark, path, v)["parts"]}
    for v in known[:-keep]:
        gone = {p["folder"] for p in manifest(spark, path, v)["parts"]} - live
        for folder in [*gone, f"manifest/v{v:020d}.json"]:
            fs, p = _fs(spark, f"{path}/{folder}")
            fs.delete(p, True)
