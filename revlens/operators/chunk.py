"""Order-preserving next-fit packing of files into review chunks.

Semantics: walk a review's files in order; start a new chunk when the current
chunk is non-empty and current_lines + file_lines > max_lines; files are never
split (an oversize file sits alone or starts a chunk). `total_chunks` is
back-filled on every chunk.

The walk is sequential, but all that a run of files does to it fits in a short
table. Before a file the open chunk holds `held` lines (max_lines + 1 stands for
"over" and for "no chunk yet": either way the next file opens one). A run then
adds its lines to the open chunk up to the first file whose running sum passes
max_lines - held; that file opens a chunk, and what follows depends on that file
only. So a run is (lines, steps): a step for each file that can be the first to
open, with its running sum (`reach`), the lines held after the run (`held`) and
the chunks opened (`opens`). Reaches grow strictly, and none follows one beyond
max_lines, so there are at most max_lines + 2 steps, in practice as many as files
fit in one chunk. Tables compose associatively, which gives a parallel prefix
scan that never puts a whole review in one task, however many files it has:

1. Files are cut into blocks of `block_files` consecutive ordinals; each block
   is folded into its table.
2. Block tables are composed up a tree with fan-in `fan_in` until each review
   has at most `fan_in` nodes; the top nodes are walked in order from "no chunk
   yet", and what each begins with is pushed back down the tree.
3. Each block is walked from its beginning to number its files.

No row gathers more than max(block_files, fan_in) items. Everything is higher-order
functions on arrays; no Python runs in the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import rules

_TABLE = "struct<lines: bigint, steps: array<struct<reach: bigint, held: bigint, opens: bigint>>>"
_ONE = "struct<reach: bigint, held: bigint, opens: bigint>"


def _long(value) -> Column:
    return F.lit(value).cast("bigint")


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _first(steps: Column) -> Column:
    return F.try_element_at(steps, F.lit(1))


def _empty_table() -> Column:
    return F.struct(_long(0).alias("lines"), F.array().cast(f"array<{_ONE}>").alias("steps")).cast(_TABLE)


def _after_file(held: Column, lines: Column, limit: int) -> tuple[Column, Column]:
    """(does the file open a chunk, lines held after it)."""
    opens = held + lines > limit
    return opens, F.when(opens, F.least(lines, _long(limit + 1))).otherwise(held + lines)


def _after_run(table: Column, held: Column, limit: int) -> Column:
    """What a run makes of an open chunk of `held` lines: struct(held, opens)."""
    hit = _first(F.filter(table["steps"], lambda s: s["reach"] > limit - held))
    return _let(
        hit,
        lambda h: F.struct(
            F.coalesce(h["held"], held + table["lines"]).alias("held"), F.coalesce(h["opens"], _long(0)).alias("opens")
        ),
    )


def _add_file(limit: int):
    """A run's table and one more file."""

    def run(table: Column, file: Column) -> Column:
        lines = file["lines"]

        def step(s: Column) -> Column:
            opens, held = _after_file(s["held"], lines, limit)
            return F.struct(s["reach"].alias("reach"), held.alias("held"), (s["opens"] + opens.cast("bigint")).alias("opens"))

        own = F.struct(
            (table["lines"] + lines).alias("reach"), F.least(lines, _long(limit + 1)).alias("held"), _long(1).alias("opens")
        )
        first_to_open = (table["lines"] <= limit) & ((lines > 0) | (F.size(table["steps"]) == 0))
        steps = F.transform(table["steps"], step)
        return F.struct(
            (table["lines"] + lines).alias("lines"), F.when(first_to_open, F.concat(steps, F.array(own))).otherwise(steps).alias("steps")
        ).cast(_TABLE)

    return run


def _compose(limit: int):
    """The table of one run followed by another."""

    def run(a: Column, node: Column) -> Column:
        b = node["table"]

        def step(s: Column) -> Column:
            return _let(
                _after_run(b, s["held"], limit),
                lambda r: F.struct(s["reach"].alias("reach"), r["held"].alias("held"), (s["opens"] + r["opens"]).alias("opens")),
            )

        later = F.transform(
            F.filter(b["steps"], lambda s: (s["reach"] > 0) | (F.size(a["steps"]) == 0)),
            lambda s: F.struct((s["reach"] + a["lines"]).alias("reach"), s["held"].alias("held"), s["opens"].alias("opens")),
        )
        # those within the limit and the first one beyond it
        reached = _let(
            later,
            lambda all_: F.concat(
                F.filter(all_, lambda s: s["reach"] <= limit), F.slice(F.filter(all_, lambda s: s["reach"] > limit), 1, 1)
            ),
        )
        steps = F.transform(a["steps"], step)
        return F.struct(
            (a["lines"] + b["lines"]).alias("lines"), F.when(a["lines"] <= limit, F.concat(steps, reached)).otherwise(steps).alias("steps")
        ).cast(_TABLE)

    return run


def _walk(nodes: Column, held: Column, opens: Column, limit: int) -> Column:
    """Walk the children of a node in order: struct(held, opens, starts), where starts has
    (node, held, opens) as each child begins."""
    begin = "array<struct<node: bigint, held: bigint, opens: bigint>>"
    kind = f"struct<held: bigint, opens: bigint, starts: {begin}>"

    def step(acc: Column, node: Column) -> Column:
        start = F.struct(node["node"].alias("node"), acc["held"].alias("held"), acc["opens"].alias("opens"))
        return _let(
            _after_run(node["table"], acc["held"], limit),
            lambda r: F.struct(
                r["held"].alias("held"), (acc["opens"] + r["opens"]).alias("opens"), F.concat(acc["starts"], F.array(start)).alias("starts")
            ),
        ).cast(kind)

    zero = F.struct(held.cast("bigint").alias("held"), opens.cast("bigint").alias("opens"), F.array().cast(begin).alias("starts")).cast(kind)
    return F.aggregate(nodes, zero, step)


def _gathered(nodes: DataFrame, *keys: str) -> DataFrame:
    """The nodes of each key in order, as one array."""
    return nodes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("node", "table"))).alias("nodes"))


def _starts(nodes: DataFrame, limit: int, fan_in: int, n_nodes: int) -> DataFrame:
    """(review_id, node, held, opens, total) as every node of a tree level begins; nodes are
    numbered below `n_nodes`."""
    if n_nodes <= fan_in:
        walked = _gathered(nodes, "review_id").select("review_id", _walk(F.col("nodes"), _long(limit + 1), _long(0), limit).alias("w"))
        return walked.select("review_id", F.col("w.opens").alias("total"), F.inline_outer("w.starts"))
    level = nodes.withColumn("parent", F.floor(F.col("node") / fan_in).cast("bigint"))
    children = _gathered(level, "review_id", "parent")
    parents = children.select(
        "review_id", F.col("parent").alias("node"), F.aggregate("nodes", _empty_table(), _compose(limit)).alias("table")
    )
    above = _starts(parents, limit, fan_in, -(-n_nodes // fan_in)).withColumnRenamed("node", "parent")
    walked = children.join(above, ["review_id", "parent"]).select(
        "review_id", "total", _walk(F.col("nodes"), F.col("held"), F.col("opens"), limit).alias("w")
    )
    return walked.select("review_id", "total", F.inline_outer("w.starts"))


def number_files(
    files: DataFrame, max_lines: int = rules.MAX_CHUNK_LINES, block_files: int = 1024, fan_in: int = 256
) -> DataFrame:
    """(review_id, ordinal, lines, chunk_index, total_chunks) of `files`, which need review_id,
    ordinal (unique, from 0, increasing within a review) and lines (null counts as none). Rows
    without a review_id or an ordinal are of no review and get no number.

    All sizes take this one path; the largest ordinal (one scalar) says how many levels the
    tree has.
    """
    limit = int(max_lines)
    slim = files.select(
        "review_id",
        F.floor(F.col("ordinal") / block_files).cast("bigint").alias("node"),
        F.struct(F.col("ordinal").cast("bigint").alias("ordinal"), F.coalesce(F.col("lines").cast("bigint"), _long(0)).alias("lines")).alias("file"),
    )
    # stated here, the join below brings no filter of its own to one of its two sides, and both
    # read one exchange
    slim = slim.where(F.col("review_id").isNotNull() & F.col("node").isNotNull())
    n_nodes = (slim.agg(F.max("node")).first()[0] or 0) + 1
    blocks = slim.groupBy("review_id", "node").agg(F.sort_array(F.collect_list("file")).alias("files"))
    tables = blocks.select("review_id", "node", F.aggregate("files", _empty_table(), _add_file(limit)).alias("table"))
    starts = _starts(tables, limit, fan_in, n_nodes)

    kind = "struct<held: bigint, opens: bigint, numbers: array<bigint>>"

    def step(acc: Column, file: Column) -> Column:
        opens, held = _after_file(acc["held"], file["lines"], limit)
        return _let(
            acc["opens"] + opens.cast("bigint"),
            lambda n: F.struct(held.alias("held"), n.alias("opens"), F.concat(acc["numbers"], F.array(n - 1)).alias("numbers")),
        ).cast(kind)

    zero = F.struct(F.col("held"), F.col("opens"), F.array().cast("array<bigint>").alias("numbers")).cast(kind)
    numbered = blocks.join(starts, ["review_id", "node"]).select(
        "review_id", "total", F.inline_outer(F.arrays_zip("files", F.aggregate("files", zero, step)["numbers"].alias("numbers")))
    )
    return numbered.select(
        "review_id", "files.ordinal", "files.lines", F.col("numbers").alias("chunk_index"), F.col("total").alias("total_chunks")
    )


def _lines() -> Column:
    return (F.col("additions") + F.col("deletions")).cast("bigint").alias("lines")


def assign_chunks(
    files: DataFrame,
    max_lines: int = rules.MAX_CHUNK_LINES,
    block_files: int = 1024,
    fan_in: int = 256,
) -> DataFrame:
    """Add `chunk_index` and `total_chunks` to kept files.

    `files` needs review_id, ordinal (unique, increasing within a review) and
    additions / deletions. The numbers are joined back to the full rows on
    (review_id, ordinal); `number_files` alone moves no text.
    """
    numbered = number_files(files.select("review_id", "ordinal", _lines()), max_lines, block_files, fan_in).drop("lines")
    return files.join(numbered, ["review_id", "ordinal"])


def chunk_table(files: DataFrame, max_lines: int = rules.MAX_CHUNK_LINES) -> DataFrame:
    """One row per chunk of kept files: review_id, chunk_index, total_chunks, total_lines,
    n_files. Files that have their numbers keep them; others are numbered, without a join."""
    numbered = (
        files.withColumn("lines", _lines())
        if "chunk_index" in files.columns
        else number_files(files.select("review_id", "ordinal", _lines()), max_lines)
    )
    return numbered.groupBy("review_id", "chunk_index").agg(
        F.max("total_chunks").alias("total_chunks"),
        F.sum("lines").cast("bigint").alias("total_lines"),
        F.count(F.lit(1)).alias("n_files"),
    )
