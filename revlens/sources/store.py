"""The review store as tables: reviews, findings, learnings and a generic
`items(pk, sk, attrs map<string,string>)` view for key / prefix queries.

Physical layout advice for the cluster: write `items` partitioned by a hash
bucket of `pk` and sorted by (pk, sk) so that `pk = ...` lookups prune files
and `sk LIKE 'FINDING#%'` prefix scans push down as StringStartsWith.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators.ordering import first_by_order


def reviews_from_events(review_events: DataFrame) -> DataFrame:
    """Review meta rows: one per review_id (one partial aggregation).

    Columns: review_id, repo, pr_number, pr_url, status, created_at,
    files_count, chunks_count.
    """
    return review_events.groupBy("review_id").agg(
        F.max("repo").alias("repo"),
        F.max("pr_number").alias("pr_number"),
        F.max("pr_url").alias("pr_url"),
        F.max("status").alias("status"),
        F.min("ts").alias("created_at"),
        F.count(F.lit(1)).alias("files_count"),
        F.count_if(F.col("event_type") == "view").alias("chunks_count"),
    )


def _attrs(*pairs: tuple[str, Column]) -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v.cast("string") for _, v in pairs])
    )


#: Attributes of a META item; a table that lacks some stores the others.
META_FIELDS = ("status", "repo", "pr_number", "pr_url", "sender", "head_sha", "created_at", "files_count", "chunks_count", "latency_ms")


def review_items(reviews: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`REV#<id>` / `META` items of the META_FIELDS that `reviews` has, with the columns
    `keep`."""
    shown = {"created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")}
    fields = [(k, shown.get(k, F.col(k))) for k in META_FIELDS if k in reviews.columns]
    return reviews.select(
        F.concat(F.lit("REV#"), F.col("review_id")).alias("pk"),
        F.lit("META").alias("sk"),
        F.map_filter(
            _attrs(*fields),
            lambda k, v: v.isNotNull(),
        ).alias("attrs"),
        *keep,
    )


def reviews_from_items(items: DataFrame) -> DataFrame:
    """META items back as review rows, for `review_projection`."""
    kinds = {"pr_number": "bigint", "files_count": "bigint", "chunks_count": "bigint", "latency_ms": "bigint", "created_at": "timestamp"}
    attrs = [F.try_element_at("attrs", F.lit(k)).try_cast(kinds.get(k, "string")).alias(k) for k in META_FIELDS]
    return items.where("sk = 'META'").select(F.regexp_replace("pk", "^REV#", "").alias("review_id"), *attrs)


def finding_items(findings: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`REV#<id>` / `FINDING#<agent>#<i>` items (needs `sk`), with the columns `keep`."""
    return findings.select(
        F.concat(F.lit("REV#"), F.col("review_id")).alias("pk"),
        F.col("sk"),
        _attrs(
            ("severity", F.col("severity")),
            ("category", F.col("category")),
            ("file", F.col("file")),
            ("line", F.col("line")),
            ("message", F.col("message")),
            ("suggestion", F.col("suggestion")),
            ("agent", F.col("agent")),
            ("repo", F.col("repo")),
            ("pr_number", F.col("pr_number")),
        ).alias("attrs"),
        *keep,
    )


def skip_missing_review_id(events: DataFrame, name: str = "missing_review_id"):
    """Events without a review_id are skipped, not failed, and counted: returns
    (kept rows, Observation). The counts are collected with the job that
    consumes the rows (no extra pass): `observation.get` after an action."""
    from pyspark.sql import Observation

    obs = Observation(name)
    missing = F.col("review_id").isNull() | (F.col("review_id") == "")
    observed = events.observe(obs, F.count_if(missing).alias("skipped"), F.count(F.lit(1)).alias("seen"))
    return observed.filter(~missing), obs


def learning_items(complete: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`TEAM#global` / `LEARNING#<id>` placeholder learning records from
    review.complete rows (review_id, verdict) with the columns `keep`; rows
    without review_id are skipped, not failed."""
    return complete.filter(F.col("review_id").isNotNull() & (F.col("review_id") != "")).select(
        F.lit("TEAM#global").alias("pk"),
        F.concat(F.lit("LEARNING#"), F.col("review_id")).alias("sk"),
        _attrs(
            ("review_id", F.col("review_id")),
            ("verdict", F.coalesce(F.col("verdict"), F.lit(""))),
            ("patterns_extracted", F.lit("false")),
        ).alias("attrs"),
        *keep,
    )


def item_buckets(spark) -> int:
    """Buckets of the items table: `spark.revlens.itemBuckets`, by default as many as
    the session's shuffle partitions, so that it grows with the cluster."""
    return int(spark.conf.get("spark.revlens.itemBuckets", None) or spark.conf.get("spark.sql.shuffle.partitions"))


def pk_bucket(pk: Column, buckets: int) -> Column:
    """Partition column of the items table: a stable hash bucket of `pk`."""
    return F.pmod(F.xxhash64(pk), F.lit(buckets)).cast("int")


def write_items(items: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store items partitioned by `pk_bucket` and sorted by (pk, sk) inside each
    file: a key lookup reads one partition, and row-group statistics on sk let
    prefix scans skip data. Rows are dealt by ranges of (bucket, pk, sk), so a hot
    review takes several tasks and files."""
    n = buckets or item_buckets(items.sparkSession)
    (
        items.withColumn("pk_bucket", pk_bucket(F.col("pk"), n))
        .repartitionByRange("pk_bucket", "pk", "sk")
        .sortWithinPartitions("pk_bucket", "pk", "sk")
        .write.mode("overwrite")
        .partitionBy("pk_bucket")
        .parquet(path)
    )


def read_items(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def key_lookup(items: DataFrame, pk: str, buckets: int | None = None) -> DataFrame:
    """Items with this pk. On a stored items table the bucket predicate prunes
    partitions (with the `buckets` it was written with) and the pk equality is
    pushed to the Parquet reader."""
    out = items.filter(F.col("pk") == pk)
    if "pk_bucket" in items.columns:
        out = out.filter(F.col("pk_bucket") == pk_bucket(F.lit(pk), buckets or item_buckets(items.sparkSession)))
    return out


def sk_prefix_scan(items: DataFrame, prefix: str, pk: str | None = None) -> DataFrame:
    """Items whose sk starts with `prefix` (pushed down as StringStartsWith),
    optionally for one pk."""
    out = items.filter(F.col("sk").startswith(prefix))
    return out if pk is None else key_lookup(out, pk)


def status_index(reviews: DataFrame, status: str) -> DataFrame:
    """Keys-only secondary index query: reviews with `status`, ordered by
    created_at (a range-partitioned global sort)."""
    return reviews.filter(F.col("status") == status).select("review_id", "status", "created_at").orderBy(
        "created_at", "review_id"
    )


def ttl_expire(items: DataFrame, now_epoch_s: int) -> DataFrame:
    """Drop items whose `ttl` attribute (epoch seconds) has passed."""
    ttl = F.try_element_at(F.col("attrs"), F.lit("ttl")).cast("bigint")
    return items.filter(ttl.isNull() | (ttl > F.lit(now_epoch_s)))


def upsert_latest(writes: DataFrame, keys: list[str] = ["pk", "sk"], order: list[str] = ["write_ts", "write_seq"]) -> DataFrame:  # noqa: B006
    """Last write wins per key: one `max_by` aggregate. `order` must differ between
    writes of a key."""
    return first_by_order(writes, keys, order, descending=True)


def review_projection(reviews: DataFrame) -> DataFrame:
    """Dashboard review row. repo = repo_full_name ?? repo; files count reads
    the field the writer actually stores (`files_count`) first - the original
    reader looked only at never-written names and always showed 0."""
    cols = set(reviews.columns)

    def opt(name: str) -> Column:
        return F.col(name) if name in cols else F.lit(None)

    return reviews.select(
        F.regexp_replace(F.concat(F.lit("REV#"), F.col("review_id")), "^REV#", "").alias("review_id"),
        F.coalesce(opt("repo_full_name"), opt("repo"), F.lit("")).alias("repo"),
        F.coalesce(opt("pr_number"), F.lit(0)).cast("bigint").alias("pr_number"),
        F.coalesce(opt("pr_url"), F.lit("")).alias("pr_url"),
        F.coalesce(opt("status"), F.lit("unknown")).alias("status"),
        F.coalesce(opt("timestamp"), opt("created_at")).alias("timestamp"),
        F.coalesce(opt("files_count"), opt("files_analyzed"), opt("total_files"), F.lit(0)).cast("bigint").alias("files_count"),
        F.coalesce(opt("chunks_count"), opt("total_chunks"), F.lit(0)).cast("bigint").alias("chunks_count"),
    )


def review_display(projected: DataFrame, zone: str = "UTC") -> DataFrame:
    """Review list row as shown: '—' for a missing repo, '#<pr>', status
    default 'pending', files default 0, time as 'MMM d, hh:mm a' in `zone`."""
    ts = F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), zone)
    return projected.select(
        "review_id",
        F.when(F.coalesce(F.col("repo"), F.lit("")) == "", F.lit("—")).otherwise(F.col("repo")).alias("repo_label"),
        F.when(F.coalesce(F.col("pr_number"), F.lit(0)) == 0, F.lit("#—"))
        .otherwise(F.concat(F.lit("#"), F.col("pr_number").cast("string")))
        .alias("pr_label"),
        F.when(F.coalesce(F.col("status"), F.lit("")) == "", F.lit("pending")).otherwise(F.col("status")).alias("status_label"),
        F.when(F.col("status") == "complete", F.lit("info")).otherwise(F.lit("warning")).alias("badge"),
        F.coalesce(F.col("files_count"), F.lit(0)).alias("files"),
        F.when(F.col("timestamp").isNull(), F.lit("—")).otherwise(F.date_format(ts, "MMM d, hh:mm a")).alias("time_label"),
    )
