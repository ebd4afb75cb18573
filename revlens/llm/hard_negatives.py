"""Hard-negative mining over an STR-packed R-tree (operator 13).

Rows are sorted by label and first coordinate over all tasks, and every run of at most
`SHARD_ROWS` neighbours becomes one tree: sorted by one coordinate, cut into slabs, each
slab sorted by the next coordinate, and so on (sort-tile-recursive); leaves hold
`LEAF_ROWS` rows, inner boxes `FAN` boxes. A box knows the least and largest value of each
coordinate, so the inner product of an anchor with anything inside lies in an interval,
summed over the coordinates; it also knows the labels inside.

Anchors are searched in blocks, each tree with each block. A best-first queue takes the
box of the highest bound; boxes whose interval misses every score window, whose labels are
not asked for, or whose bound is strictly below the k-th score found go unread. A tree
gives its best k per window; the best k of all trees are one window function with a limit
on the map side. Two searches: the positives of each anchor, whose scores then make the
windows of its negatives.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import dropped, stored

POSITIVES, NEGATIVES = 5, 5
#: Hundredths of the positive's score that a negative has, at least and at most.
LEAST, MOST = 80, 100
SCALE = 256
#: Rows of a tree, rows of a leaf, children of a box, leaves that are read at once.
SHARD_ROWS, LEAF_ROWS, FAN, READ = 8_192, 64, 16, 8
#: Anchors of a block, and blocks that are broadcast in one pass (16 MB of 64 numbers).
BLOCK_ANCHORS, PASS_BLOCKS = 1_024, 32

_ROW = "uid long, vec_id long, label long, q array<long>"
_NONE = np.iinfo(np.int64).max


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, label, q) of the rows that take part: floor(scale * x) of every
    component, x as double. Rows with a null label or vector, or a component that is
    null or not finite, are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    q = F.transform(x, lambda c: F.floor(c * float(scale)).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), "label", q.alias("q"))


# ---- the tree ------------------------------------------------------------------------


def matrix(lists, width: int) -> np.ndarray:
    """Lists of whole numbers as rows; a shorter one is filled with 0."""
    out = np.zeros((len(lists), width), np.int64)
    for row, values in zip(out, lists, strict=True):
        row[: len(values)] = values
    return out


def str_order(q: np.ndarray, leaf: int = LEAF_ROWS) -> np.ndarray:
    """Order of rows that packs them sort-tile-recursively: slabs by the coordinate that
    spreads most, cut again by the next, until a slab fills a leaf."""
    leaves = -(-len(q) // leaf)
    if leaves <= 1:
        return np.arange(len(q))
    spread = np.argsort(-q.astype(float).var(0), kind="stable")
    cuts = int(min(max(1, np.ceil(np.log2(leaves) / 2)), q.shape[1] or 1))
    slabs = int(np.ceil(leaves ** (1 / cuts)))

    def tile(rows: np.ndarray, level: int) -> list[np.ndarray]:
        if level == cuts or len(rows) <= leaf:
            return [rows]
        rows = rows[np.argsort(q[rows, spread[level]], kind="stable")]
        size = leaf * int(np.ceil(-(-len(rows) // leaf) / slabs))
        return [x for i in range(0, len(rows), size) for x in tile(rows[i : i + size], level + 1)]

    return np.concatenate(tile(np.arange(len(q)), 0)) if q.shape[1] else np.arange(len(q))


class Tree:
    """Rows in packed order, and boxes by level (0: leaves), each level's box i covers
    boxes i * FAN to (i + 1) * FAN of the level below."""

    def __init__(self, uid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, q: np.ndarray):
        self.uid, self.vec_id, self.label, self.q = uid, vec_id, label, q
        self.levels, lo, hi, a, b, step = [], q, q, label, label, LEAF_ROWS
        while True:
            at = np.arange(0, len(lo), step)
            lo, hi = np.minimum.reduceat(lo, at, axis=0), np.maximum.reduceat(hi, at, axis=0)
            a, b = np.minimum.reduceat(a, at), np.maximum.reduceat(b, at)
            self.levels.append((lo, hi, a, b))
            step = FAN
            if len(lo) == 1:
                break
        self.largest = float(np.abs(q.astype(float)).max(initial=0))

    def exact(self, anchor: np.ndarray) -> type:
        """Arithmetic in which all products with `anchor` are exact."""
        bound = self.largest * float(np.abs(anchor.astype(float)).max(initial=0)) * max(1, len(anchor))
        return np.float64 if bound < 2**52 else np.int64 if bound < 2**62 else object

    def search(self, anchor, uid, label, other: bool, low, high, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window (low, high) of scores the best `k` rows (row numbers, scores) that
        have the anchor's label (another one, if `other`), without the anchor itself."""
        number = self.exact(anchor)
        anchor = anchor.astype(number)
        plus, minus = np.maximum(anchor, 0), np.minimum(anchor, 0)
        levels, rows = self._as(number)
        best = [(np.zeros(0, np.int64), np.zeros(0, number)) for _ in low]
        floor = np.array(low, dtype=number)  # a window's least score that can still enter
        top = np.array(high, dtype=number)

        def bounds(level: int, first: int, last: int):
            lo, hi, a, b = levels[level]
            lo, hi = lo[first:last], hi[first:last]
            most, least = hi @ plus + lo @ minus, lo @ plus + hi @ minus
            a, b = a[first:last], b[first:last]
            asked = (a != label) | (b != label) if other else (a <= label) & (label <= b)
            return most, least, asked

        def wanted(most, least) -> bool:
            return bool(((most >= floor) & (least <= top) & (floor <= top)).any())

        queue = [(-np.inf, len(levels) - 1, 0)] if len(self.q) else []
        leaves: list[int] = []
        spans: dict[tuple[int, int], tuple] = {}
        while queue or leaves:
            if queue:
                _, level, box = heapq.heappop(queue)
                span = spans.pop((level, box), None)
                if span is not None and not wanted(*span):
                    continue
                if level == 0:
                    leaves.append(box)
                    if len(leaves) < READ:
                        continue
                else:
                    first, last = box * FAN, min((box + 1) * FAN, len(levels[level - 1][0]))
                    most, least, asked = bounds(level - 1, first, last)
                    use = asked & ((most[:, None] >= floor) & (least[:, None] <= top) & (floor <= top)).any(1)
                    for i in np.flatnonzero(use):
                        spans[level - 1, first + int(i)] = (most[i], least[i])
                        # ordered by the best score that a window could still take
                        heapq.heappush(queue, (-float(min(most[i], top.max())), level - 1, first + int(i)))
                    continue
            at = np.concatenate([np.arange(i * LEAF_ROWS, min((i + 1) * LEAF_ROWS, len(self.q))) for i in leaves])
            leaves = []
            at = at[((self.label[at] != label) if other else (self.label[at] == label)) & (self.uid[at] != uid)]
            scores = rows[at] @ anchor
            for w in range(len(low)):
                good = (scores >= floor[w]) & (scores <= top[w])
                if good.any():
                    best[w] = self._first(np.concatenate((best[w][0], at[good])), np.concatenate((best[w][1], scores[good])), k)
                    if len(best[w][0]) == k:
                        floor[w] = max(floor[w], best[w][1][-1])
        return best

    def _as(self, number):
        if getattr(self, "_number", None) is not number:
            self._number = number
            self._levels = [(lo.astype(number), hi.astype(number), a, b) for lo, hi, a, b in self.levels]
            self._rows = self.q.astype(number)
        return self._levels, self._rows

    def _first(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first `k` by score, highest first, then by the smaller vec_id and uid."""
        order = np.lexsort((self.uid[at], self.vec_id[at], -scores if scores.dtype != object else np.array([-x for x in scores], object)))[:k]
        return at[order], scores[order]


# ---- trees as rows of a table --------------------------------------------------------

_TREE = "n int, width int, label_lo long, label_hi long, uids binary, vec_ids binary, labels binary, q binary"
_ANCHORS = "block int, anchors int, dims int, a_uids binary, a_labels binary, a_q binary, lows binary, highs binary, windows int"


def _packed(batches):
    """Cuts sorted rows into shards; each one packed and written as one row."""
    held: list[tuple] = []

    def pack(rows):
        width = max(len(r[3]) for r in rows)
        uid, label = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        vec_id = np.array([_NONE if r[1] is None else r[1] for r in rows], np.int64)
        q = matrix([r[3] for r in rows], width)
        # labels are apart first: a leaf mixes two only where they meet
        order = np.argsort(label, kind="stable")
        order = np.concatenate([g[str_order(q[g])] for g in np.split(order, np.flatnonzero(np.diff(label[order])) + 1)])
        uid, vec_id, label, q = uid[order], vec_id[order], label[order], q[order]
        parts = [[len(rows)], [width], [label.min()], [label.max()], *[[x.tobytes()] for x in (uid, vec_id, label, q)]]
        names = ["n", "width", "label_lo", "label_hi", "uids", "vec_ids", "labels", "q"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.record_batch([pa.array([int(v) if t != pa.binary() else v for v in x], t) for x, t in zip(parts, types, strict=True)], names=names)

    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("uid", "vec_id", "label", "q")), strict=True)
        while len(held) >= SHARD_ROWS:
            yield pack(held[:SHARD_ROWS])
            held = held[SHARD_ROWS:]
    if held:
        yield pack(held)


def packed_trees(rows: DataFrame, n_rows: int) -> DataFrame:
    """Trees over all of `rows`. The range sort spreads one label, or one vector that
    many rows share, over as many shards as it needs."""
    tasks = max(1, -(-n_rows // SHARD_ROWS))
    order = ["label", F.element_at(F.when(F.size("q") > 0, F.col("q")).otherwise(F.array(F.lit(0).cast("long"))), 1), "uid"]
    return rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_packed, _TREE)


def anchor_blocks(anchors: DataFrame, windows: int, size: int = BLOCK_ANCHORS) -> DataFrame:
    """`anchors` (uid, label, q, lows, highs: one number per window, high below low
    where there is none) in blocks of `size`, each one row."""

    def pack(batches):
        for batch in batches:
            q = batch.column("q").to_pylist()
            width = max((len(x) for x in q), default=0)
            lists = [np.array(batch.column(c).to_pylist(), np.int64) for c in ("uid", "label")]
            lows, highs = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("lows", "highs"))
            values = [*lists, matrix(q, width), lows, highs]
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in values]
            head = [pa.array([int(x)], pa.int32()) for x in (batch.column("block")[0].as_py(), len(q), width)]
            yield pa.record_batch(
                [*head, *blobs, pa.array([windows], pa.int32())],
                names=["block", "anchors", "dims", "a_uids", "a_labels", "a_q", "lows", "highs", "windows"],
            )

    def group(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(pack([table.combine_chunks().to_batches()[0]])))

    return anchors.groupBy("block").applyInArrow(group, _ANCHORS)


def _searched(other: bool, k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dims = max(r["width"], r["dims"])
                q = _numbers(r["q"], r["n"], r["width"], dims)
                tree = Tree(*(np.frombuffer(r[c], np.int64) for c in ("uids", "vec_ids", "labels")), q)
                uids, labels = (np.frombuffer(r[c], np.int64) for c in ("a_uids", "a_labels"))
                a = _numbers(r["a_q"], r["anchors"], r["dims"], dims)
                lows, highs = (np.frombuffer(r[c], np.int64).reshape(-1, r["windows"]) for c in ("lows", "highs"))
                found = []
                for i in range(r["anchors"]):
                    if (not other and not r["label_lo"] <= labels[i] <= r["label_hi"]) or (
                        other and r["label_lo"] == r["label_hi"] == labels[i]
                    ):
                        continue
                    use = np.flatnonzero(lows[i] <= highs[i])
                    if len(use):
                        best = tree.search(a[i], uids[i], labels[i], other, lows[i][use], highs[i][use], k)
                        for w, (at, scores) in zip(use, best, strict=True):
                            found += [(int(uids[i]), int(w), int(s), int(tree.uid[x]), int(tree.vec_id[x])) for x, s in zip(at, scores, strict=True)]
                if found:
                    a_uid, w, s, u, v = zip(*found, strict=True)
                    ids = pa.array([None if x == _NONE else x for x in v], pa.int64())
                    yield pa.record_batch(
                        [pa.array(a_uid, pa.int64()), pa.array(w, pa.int32()), pa.array(s, pa.int64()), pa.array(u, pa.int64()), ids],
                        names=["anchor", "window", "score", "uid", "vec_id"],
                    )

    return run


def _numbers(blob: bytes, n: int, width: int, dims: int) -> np.ndarray:
    q = np.frombuffer(blob, np.int64).reshape(n, width)
    return q if width == dims else np.pad(q, ((0, 0), (0, dims - width)))


def searched(trees: DataFrame, blocks: DataFrame, n_trees: int, n_blocks: int, other: bool, k: int) -> DataFrame:
    """(anchor, window, score, uid, vec_id, rank): the best `k` rows of every window of
    every anchor over all trees. Each pass takes at most PASS_BLOCKS blocks, whose size
    is bounded, to the trees; trees are dealt over the tasks and never gathered."""
    spark = trees.sparkSession
    width = max(1, min(n_trees, 4 * spark.sparkContext.defaultParallelism * PASS_BLOCKS))
    passes = []
    for first in range(0, n_blocks, PASS_BLOCKS):
        last = min(first + PASS_BLOCKS, n_blocks)
        found = _pairs(trees.repartition(width), blocks, first, last).mapInArrow(
            _searched(other, k), "anchor long, window int, score long, uid long, vec_id long"
        )
        passes.append(stored(_best(found, k), "negatives-pass"))
    if not passes:
        return spark.createDataFrame([], "anchor long, window int, score long, uid long, vec_id long, rank int")
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def _pairs(trees: DataFrame, blocks: DataFrame, first: int, last: int) -> DataFrame:
    """Every tree beside every block from `first` to before `last`."""
    dealt = trees.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
    return dealt.join(F.broadcast(blocks.where(F.col("block").between(first, last - 1))), "block").drop("block")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine_hard_negatives(
    embeddings: DataFrame,
    anchors: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    relabel: Column | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchors` says which rows are anchors, `relabel` may set a row's label (both of
    vec_id and label). Rows with a null label or vector, or a component that is null or
    not finite, take no part. A null vec_id is never an anchor by the default and comes
    last among ties; rows that repeat a vec_id are rows of their own, so an anchor has
    a row for each of its positives, copies included. A component that a shorter vector
    lacks counts as 0; an empty vector scores 0 with all. An empty table, or one
    without anchors, gives an empty result. Only vec_id, embedding and label are read.
    Scores are exact; a pair whose score is beyond 64 bits is left out.
    """
    spark = embeddings.sparkSession
    rows = quantised(embeddings.select("vec_id", "embedding", "label"))
    if relabel is not None:
        rows = rows.withColumn("label", relabel.cast("long"))
    rows = stored(rows, "negatives-rows")
    trees = stored(packed_trees(rows, rows.count()), "negatives-trees")
    is_anchor = F.col("vec_id") % 100 == 0 if anchors is None else anchors
    chosen = stored(_numbered(rows.where(F.coalesce(is_anchor, F.lit(False)))), "negatives-anchors")
    n_trees, n_anchors = trees.count(), chosen.agg(F.max("block")).first()[0]
    n_blocks = 0 if n_anchors is None else n_anchors + 1
    lowest, highest = -(2**63), 2**63 - 1
    asked = chosen.select("block", "uid", "label", "q", F.array(F.lit(lowest)).alias("lows"), F.array(F.lit(highest)).alias("highs"))
    first = stored(anchor_blocks(asked, 1), "negatives-blocks")
    found = searched(trees, first, n_trees, n_blocks, False, positives)

    # a window for each positive of an anchor: at most `positives` of them, by rank
    score = F.col("score")
    low = F.ceil(score.cast("decimal(20,0)") * least / 100).cast("long")
    high = F.floor(score.cast("decimal(20,0)") * most / 100).cast("long")
    per = found.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct(low.alias("low"), high.alias("high"))))).alias("w"))
    ranks = F.sequence(F.lit(1), F.lit(positives))

    def side(name: str, none: int) -> Column:
        return F.transform(ranks, lambda r: F.coalesce(F.try_element_at(F.col("w"), r)[name], F.lit(none).cast("long")))

    windows = chosen.join(per, chosen["uid"] == per["anchor"]).select(
        "block", "uid", "label", "q", side("low", 1).alias("lows"), side("high", 0).alias("highs")
    )
    second = stored(anchor_blocks(windows, positives), "negatives-blocks")
    negative = searched(trees, second, n_trees, n_blocks, True, negatives)
    p = found.select(F.col("anchor").alias("p_anchor"), (F.col("rank") - 1).alias("p_window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = chosen.select(F.col("uid").alias("a_uid"), F.col("vec_id").alias("anchor_id"))
    out = negative.join(p, F.expr("anchor = p_anchor AND window = p_window")).join(ids, F.expr("anchor = a_uid")).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
    out = stored(out, "negatives")
    dropped(rows, trees, chosen, first, second)
    return out


def _numbered(anchors: DataFrame) -> DataFrame:
    """`anchors` with a block number; a block has at most BLOCK_ANCHORS of them. Numbers
    follow the tasks that hold the rows: counts per task are summed, no sort is needed."""
    held = stored(anchors.withColumn("task", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id() % (1 << 33)), "negatives-dealt")
    counts = held.groupBy("task").agg((F.max("seq") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("start", before).drop("n")
    number = F.col("start") + F.col("seq")
    return held.join(F.broadcast(starts), "task").select("uid", "vec_id", "label", "q", F.floor(number / BLOCK_ANCHORS).cast("int").alias("block"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
       positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
