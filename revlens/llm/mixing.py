"""Mixing sources to target weights (operator 4).

Every document gets a hash-random key. Keys are cut into equal ranges per source
(as many as keep a range near `range_rows` rows) and the ranges into blocks. Sizes are
summed per range and block, block sums give each block its start, range sums each range
inside its block, and a window inside each range gives every document its own start: a
prefix sum of three levels in which no task ever holds a source. A source whose target is k whole epochs and a rest takes every document k
times and cuts the (k+1)-th epoch exactly at the rest: documents before the cut
once more, the document on the cut for the words that are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import stored, word_count
from revlens.operators.ordering import row_position

WEIGHTS = (3.0, 1.0, 2.0)


def water_levels(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Targets for `sources` (source, source_size, weight): `share` of all sizes
    dealt by weight, where no target exceeds `cap` times its source's size and the
    excess is dealt again by weight among the others until none is above.

    Each round is one aggregate over the sources; only its scalars reach the
    driver. A round holds every source above its part at its cap, so there are at
    most as many rounds as sources, in practice a few.
    """
    limit = F.col("source_size") * F.lit(float(cap))
    level, before = None, -1
    while True:
        held = F.lit(False) if level is None else (F.col("weight") * F.lit(level) > limit)
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(held, limit)).alias("capped"),
            F.sum(F.when(~held, F.col("weight"))).alias("weight"),
            F.count(F.when(held, 1)).alias("n"),
        ).first()
        if row["n"] == before or not row["weight"]:
            break
        level, before = (float(share) * (row["total"] or 0) - (row["capped"] or 0.0)) / row["weight"], row["n"]
    level = 0.0 if level is None else level
    return sources.withColumn(
        "target", F.when(F.col("weight") * F.lit(level) > limit, limit).otherwise(F.col("weight") * F.lit(level))
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    range_rows: int = 1_000,
    size: Column | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of `docs`.

    Sources take `weights` in turn, by code point, null last. Rows with a null or
    empty text have size 0 and are taken for 0 words; a null source is a source of
    its own; a null doc_id is a document like others, and repeated rows each count
    (their order among each other follows size, equal ones are alike). An empty
    table gives an empty result. Columns besides doc_id, source and text are never
    read. The key is md5(seed:doc_id:md5(text)), so reruns agree whatever the partitions,
    and documents that share a doc_id, or have none, spread over the ranges like others.
    """
    parts = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))
    key = F.md5(F.concat_ws(":", F.lit(seed), *parts))
    narrow = stored(
        docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"), key.alias("k")),
        "mix",
    )
    # 2**bits equal ranges of the key space by its first 32 bits, in 2**(bits / 2) blocks
    bits = min(31, (narrow.count() // range_rows).bit_length())
    r = F.shiftright(F.conv(F.substring("k", 1, 8), 16, 10).cast("long"), 32 - bits)
    ranged = narrow.withColumn("r", r)
    sums = ranged.groupBy("source", "r").agg(F.sum("size").alias("range_size")).withColumn("block", F.shiftright("r", bits // 2))
    blocks = sums.groupBy("source", "block").agg(F.sum("range_size").alias("block_size"))
    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_range = Window.partitionBy("source", "block").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("block_start", F.coalesce(F.sum("block_size").over(by_block), F.lit(0))).alias("k")
    inside = sums.withColumn("inside", F.coalesce(F.sum("range_size").over(by_range), F.lit(0))).alias("i")
    starts = inside.join(blocks, F.expr("i.source <=> k.source AND i.block = k.block")).select(
        "i.source", "i.r", (F.col("block_start") + F.col("inside")).alias("range_start")
    )
    per_source = sums.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    named = stored(
        per_source.select("source", "source_size", F.lit(1).alias("one"), F.col("source").isNull().cast("int").alias("last")),
        "mix-sources",
    )
    ranked = row_position(named, ["one"], ["last", "source"], out="pos")
    turn = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    targets = water_levels(stored(ranked.select("source", "source_size", turn.alias("weight")), "mix-weights"), share, cap)
    inner = Window.partitionBy("source", "r").orderBy("k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    a, b, c = placed.alias("a"), starts.select("source", "r", "range_start").alias("b"), targets.alias("c")
    joined = a.join(b, F.expr("a.source <=> b.source AND a.r = b.r")).join(c, F.expr("a.source <=> c.source"))
    words = F.floor(F.col("c.target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("c.source_size") > 0, F.expr("floor(c.target + 0.5D) DIV c.source_size")).otherwise(F.lit(0)).cast("long")
    rest = words - epochs * F.col("c.source_size")
    part = F.least(F.greatest(rest - F.col("b.range_start") - F.col("a.before"), F.lit(0)), F.col("a.size"))
    return joined.select(
        F.col("a.doc_id").alias("doc_id"), F.col("a.source").alias("source"), F.col("a.size").alias("size"),
        F.col("c.source_size").alias("source_size"), F.col("c.target").alias("target"),
        (epochs * F.col("a.size") + part).cast("long").alias("taken"),
    )


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size,
        [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
level AS (
  SELECT 0 AS n, 1.5::DOUBLE * sum(source_size)::DOUBLE / sum(weight) AS lv FROM w
  UNION
  SELECT (SELECT count(*) FROM w WHERE weight * level.lv > source_size * 2.0::DOUBLE)::INTEGER,
         (SELECT (1.5::DOUBLE * sum(source_size)::DOUBLE
                  - coalesce(sum(CASE WHEN weight * level.lv > source_size * 2.0::DOUBLE THEN source_size * 2.0::DOUBLE END), 0.0))
                 / sum(CASE WHEN NOT weight * level.lv > source_size * 2.0::DOUBLE THEN weight END) FROM w)
  FROM level WHERE lv IS NOT NULL),
final AS (SELECT lv FROM level WHERE lv IS NOT NULL ORDER BY n DESC, lv DESC LIMIT 1),
t AS (SELECT source, source_size, least(weight * lv, source_size * 2.0::DOUBLE) AS target FROM w, final),
p AS (SELECT d.*, t.source_size, t.target,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
        floor(t.target + 0.5)::BIGINT AS words
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size
            + least(greatest(words % source_size - before, 0), size) END::BIGINT AS taken
FROM p
"""
